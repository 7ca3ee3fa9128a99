import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moenda.llm import binpack, mix, overlap, records


def brute(rows, width=3, threshold=0.6, least=40):
    sets = {}
    for i, split, _, text in rows:
        w = overlap.words_of(text or "")
        if len(w) >= least:
            sets[i, split] = set(zip(*(w[k:] for k in range(width))))
    out = set()
    for (i, a), x in sets.items():
        for (j, b), y in sets.items():
            if a == "eval" and b == "train" and i != j and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"p{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[3] or "a b c").split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.randint(30, 120))
        rows.append((i, rng.choice(["eval", "train", "train"]), "s", " ".join(w)))
    return rows + [(n, "eval", "s", None), (n + 1, "train", None, ""), (n + 2, "eval", "s", "curto"), (n + 3, "other", "s", rows[0][3]), rows[0], (rows[0][0], "train", "s", rows[0][3])]


SCHEMA = "doc_id bigint, split string, source string, text string"


@pytest.mark.parametrize("seed,bits", [(1, 24), (2, 14)])
def test_overlaps_equal_brute_force(spark, seed, bits):
    rows = corpus(seed, 150)
    found = overlap.Overlaps(spark.createDataFrame(rows, SCHEMA), most_bits=bits)
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in found.document_pairs().collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and len(got) > 5
    report = {(r["split"], r["source"]): r for r in found.report().collect()}
    assert sum(r["pairs"] for (s, _), r in report.items() if s == "eval") >= len(got)


def test_copies_and_nothing(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "eval" if k < 5 else "train", "s", text) for k in range(30)]
    found = overlap.Overlaps(spark.createDataFrame(rows, SCHEMA))
    assert found.document_pairs().count() == 125 and found.pairs.count() == 1
    assert {r["split"]: r["pairs"] for r in found.report().collect()} == {"eval": 125, "train": 125}
    none = overlap.Overlaps(spark.createDataFrame(rows, SCHEMA).filter("split = 'train'"))
    assert none.document_pairs().count() == 0


def test_words():
    assert overlap.words_of("Ação! É_isto  áb 12x") == ["acao", "e", "isto", "ab", "12x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit_plan(lengths):
    runs, sequences = binpack.plan_runs(dict(Counter(lengths)), 50)
    used, placed = defaultdict(list), Counter()
    for length, rank, records, first, offset, per in runs:
        for r in range(records):
            used[first + r // per].append((offset + r % per * length, length))
        placed[length] += records
    assert placed == Counter(lengths) and set(used) == set(range(sequences))
    for parts in used.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 50 and parts[0][0] == 0
    # as many as best-fit decreasing opens, one record after another
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 50) - n)
    assert sequences == len(gaps)


def test_plan_rejects_lengths():
    with pytest.raises(ValueError):
        binpack.plan_runs({51: 1}, 50)


def test_packing_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        n = rng.choice([7, 7, 7, rng.randint(1, 60), rng.randint(60, 150)])
        rows.append((rng.choice(["a", "b", None]), [rng.randrange(99) for _ in range(n)], f"r{k}", rng.choice(["train", "eval"]), "x"))
    rows += [rows[0], ("a", [], "empty", "train", "x"), ("a", None, "null", "train", "x"), ("a", [1], None, "train", "x")]
    df = spark.createDataFrame(rows, "dataset_id string, input_ids array<int>, source_ref_sha256 string, split string, fill string")
    out = binpack.sequences(df, 64).collect()
    assert all(len(r["input_ids"]) == r["fill"] == sum(r["source_token_counts"]) <= 64 for r in out)
    held = defaultdict(list)
    where = binpack.assign(df, 64).collect()
    assert all(r["offset"] + r["tokens"] <= 64 for r in where)
    by_sequence = {(r["dataset_id"], r["split"], r["sequence_no"]): [] for r in where}
    for r in where:
        by_sequence[r["dataset_id"], r["split"], r["sequence_no"]].append(r)
        held[r["source_ref_sha256"]].append((r["start"], r["tokens"]))
    for d, ids, ref, _, _ in rows:
        if ids:
            parts = sorted(held[ref])
            assert sum(n for _, n in parts) == len(ids) and (len(parts) == 1) == (len(ids) <= 64)
    assert len(by_sequence) == len(out)
    assert binpack.sequences(df.filter("false"), 64).count() == 0
    again = sorted(map(str, binpack.assign(df.repartition(7), 64).collect()))
    assert again == sorted(map(str, where))


def test_fill_and_rake():
    assert mix.fill(100, np.array([1.0, 1, 2]), np.array([10.0, 1e9, 1e9])).tolist() == [10, 30, 60]
    assert mix.fill(100, np.array([1.0, 1]), np.array([10.0, 20])).tolist() == [10, 20]
    assert mix.fill(5, np.array([0.0, 1]), np.array([9.0, np.inf])).tolist() == [0, 5]
    x = mix.rake(np.array([4.0, 6, 5, 5]), np.full(4, np.inf), [(np.array([0, 1, 0, 1]), np.array([12.0, 8])), (np.array([0, 0, 1, 1]), np.array([10.0, 10]))])
    assert np.allclose([x[0] + x[1], x[2] + x[3], x[0] + x[2]], [10, 10, 12], atol=1e-5)


def test_mixes(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["pt", "es"]), "t", rng.randint(1, 40)) for k in range(3000)] + [(9001, "a", "pt", "t", 0), (9002, None, "pt", "t", 5), (9003, "tiny", "pt", "t", 3)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, language string, topic string, tokens bigint")
    target = [("m", "a", 2.0, 1, 0.5), ("m", "b", 1.0, None, 0.5), ("m", "tiny", 1.0, 3, 0.5), ("m", "none", 1.0, 5, 0.5), ("big", "c", 1.0, 2, 9.0), (None, "a", 1.0, 1, 1.0)]
    goals = spark.createDataFrame(target, "mix_id string, source string, target_weight double, max_repeats int, size_ratio double")
    mixes = mix.Mixes(sized, goals)
    uses = mixes.uses().collect()
    assert len({(r["mix_id"], r["doc_id"]) for r in uses}) == len(uses)
    cap = {("m", "a"): 1, ("m", "tiny"): 3, ("big", "c"): 2}
    assert all(0 < r["uses"] <= cap.get((r["mix_id"], r["source"]), 10**9) for r in uses)
    shares = {(r["mix_id"], r["source"]): r for r in mixes.shares().collect()}
    whole = sum(d[4] for d in docs)
    have = {s: sum(d[4] for d in docs if d[1] == s) for s in "abc"}
    assert shares["m", "tiny"]["tokens"] == 9 and shares["m", "none"]["tokens"] == 0 and shares["m", "none"]["target_share"] == 0.2
    assert shares["big", "c"]["tokens"] == 2 * have["c"] and shares["big", "c"]["actual_share"] == 1.0
    assert abs(shares["m", "a"]["tokens"] + shares["m", "b"]["tokens"] + 9 - whole / 2) <= 40
    assert abs(shares["m", "a"]["tokens"] - 2 * shares["m", "b"]["tokens"]) <= 120 or shares["m", "a"]["tokens"] == have["a"]
    skewed = mix.Mixes(sized, goals, {"language": {"pt": 0.9, "es": 0.1}})
    lang = dict((d[0], d[2]) for d in docs)
    tok = Counter()
    for r in skewed.uses().filter("mix_id = 'm' and source = 'b'").collect():
        tok[lang[r["doc_id"]]] += r["uses"] * r["tokens"]
    assert tok["pt"] > 2 * tok["es"]
    assert mix.Mixes(sized.filter("false"), goals).uses().count() == 0


def test_sampling_order_holds_over_the_whole_range(spark):
    # one document holds nearly all tokens, so most others come after twice the hash's range
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64(F.lit("m"), "id"), 11).alias("u")).collect()
    order = [r["doc_id"] for r in sorted(ids, key=lambda r: r["u"])]
    huge = order[-1]
    docs = [(k, "s", "pt", "t", 1_000_000 if k == huge else 1) for k in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, language string, topic string, tokens bigint")
    goals = spark.createDataFrame([("m", "s", 1.0, None, 0.001)], "mix_id string, source string, target_weight double, max_repeats int, size_ratio double")
    used = {r["doc_id"] for r in mix.Mixes(sized, goals).uses().collect()}
    wanted = 0.001 * sum(d[4] for d in docs)
    assert used == {k for n, k in enumerate(order[:-1]) if n + 1 <= wanted} and len(used) > 1000


def test_sampling_order_is_spread(spark):
    n = 100_000
    unit = (F.shiftrightunsigned(F.xxhash64("id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    for part in (1.0, 0.3, 1e-3, 1e-12):
        rows = spark.range(n).select((unit / F.lit(part)).alias("at"))
        rows = rows.withColumn("place", mix.place_of(F.col("at")))
        assert rows.groupBy("place").count().agg(F.max("count")).first()[0] < 3 * n / mix.OCTAVE_PARTS
        places = [r["place"] for r in sorted(rows.collect())]
        assert places == sorted(places)


def test_too_long_documents_are_passed_over(spark):
    assert mix.filled(10, np.array([4, 9, 3, 5, 3, 0])).tolist() == [True, False, True, False, True, True]
    docs = [(k, "s", "pt", "t", 900 if k == 7 else 10) for k in range(100)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, language string, topic string, tokens bigint")
    goals = spark.createDataFrame([("m", "s", 1.0, None, 0.3)], "mix_id string, source string, target_weight double, max_repeats int, size_ratio double")
    got = mix.Mixes(sized, goals)
    total = sum(r["tokens"] * r["uses"] for r in got.uses().collect())
    assert 0.3 * 1890 - 10 < total <= 0.3 * 1890
    (fit,) = [r for r in got.fits().collect() if r["margin"] == "source"]
    assert fit["goal_share"] == fit["actual_share"] == 1


def test_three_margins(spark):
    docs = [(k, f"s{k % 2}", "pt" if k % 4 < 3 else "es", f"t{k % 3}", 10) for k in range(6000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, language string, topic string, tokens bigint")
    goals = spark.createDataFrame([("m", "s0", 3.0, None, 0.4), ("m", "s1", 1.0, None, 0.4)], "mix_id string, source string, target_weight double, max_repeats int, size_ratio double")
    fits = {(r["margin"], r["name"]): r for r in mix.Mixes(sized, goals).fits().collect()}
    # all of es is in s1, a quarter of the mix: the shares of languages and topics stay as they are
    assert all(abs(r["goal_share"] - r["actual_share"]) < 0.02 for r in fits.values()) and fits["language", "es"]["goal_share"] == 0.25
    plain = {(r["margin"], r["name"]): r for r in mix.Mixes(sized, goals, {}).fits().collect()}
    assert plain["language", "es"]["actual_share"] < 0.15


def test_hot_runs_are_spread(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_LEAST", 2)
    monkeypatch.setattr(overlap, "HOT_KEYS", 5)
    common = [f"c{k}" for k in range(60)]
    rows = [(0, "eval", "s", " ".join(common))] + [(k, "train", "s", " ".join(common[: 60 - k % 5])) for k in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, split string, source string, text string")
    found = overlap.Overlaps(docs)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in found.document_pairs().collect()} == {(0, k) for k in range(1, 40)}
    pairs, members = found.class_pairs()
    assert pairs.count() == 5 and members.count() == 40


@pytest.mark.parametrize("value", ['["x", "y"]', '{"u": 1, "v": {"w": null}}', "true", '"a: b = c"'])
def test_nested_fields(value):
    one = f'{{"a": 1, "um nome de muitas palavras mesmo": {value}, "b": "z"}}'
    other = f'{{"b": "z", "um nome de muitas palavras mesmo": {value}, "a": 1}}'
    assert records.named_fields(one) == records.named_fields(other) is not None
    assert records.named_fields('{"a": {"x": 1, "y": 2}, "b": 1}') == records.named_fields('{"b": 1, "a": {"y": 2, "x": 1}}')


def test_record_of_any_length():
    pairs = [(f"campo {k}", f"valor {k} " + "x" * 50) for k in range(4000)]
    one = json.dumps(dict(pairs))
    assert len(one) > 200_000 and records.named_fields(one) == records.named_fields(json.dumps(dict(pairs[::-1]))) == records.named_fields("\n".join(f"{a}: {b}" for a, b in pairs[::-1]))
    deep = '{"a": ' + "[" * 100_000 + "]" * 100_000 + ', "b": 1}'
    records.named_fields(deep)
