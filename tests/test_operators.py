import random

import pytest
from pyspark.sql import functions as F

from moenda.operators import boilerplate, dedup, filters, pack, project, schedule, select, validate
from moenda.sources import payload


def test_waterfill_golden():
    assert list(schedule.waterfill(dict.fromkeys("abcdef", 100_000), 416_000).values()) == [69334, 69334, 69333, 69333, 69333, 69333]
    caps = {"a": 10_000, "b": 20_000, **dict.fromkeys("cdef", 100_000)}
    assert list(schedule.waterfill(caps, 416_000).values()) == [10_000, 20_000, 96_500, 96_500, 96_500, 96_500]
    with pytest.raises(ValueError, match="available_sequences=360000 maximum_optimizer_steps=45000"):
        schedule.waterfill(dict.fromkeys("abcdef", 60_000), 416_000)


def _shuffled(n, *seed):
    order = list(range(n))
    random.Random(schedule.stable_seed(*seed)).shuffle(order)
    return order


def _counts(spark, rows):
    return spark.createDataFrame(list(rows.items()), "dataset_id string, rows bigint")


def test_proportional(spark):
    rows = dict(zip("abcdef", range(2, 8)))
    refs = [tuple(r)[1:] for r in schedule.proportional(_counts(spark, rows)).orderBy("position").collect()]
    assert len(refs) == 27 == len(set(refs)) and {n: sum(a == n for a, _ in refs) for n in rows} == rows
    for name in rows:
        assert [k for a, k in refs if a == name] == _shuffled(rows[name], 42, name, "rows")
    # at every position no data set is a whole turn away from its share
    for t in range(1, 28):
        assert all(abs(sum(a == n for a, _ in refs[:t]) - t * rows[n] / 27) < 2 for n in rows)
    equal = list(schedule.turns_of(dict.fromkeys("abc", 2)))
    assert equal[:3] == equal[3:] == sorted("abc", key=lambda n: schedule.stable_seed(42, "interleave", n))
    assert schedule.proportional(_counts(spark, {"a": 0, "b": 3})).count() == 3 and list(schedule.turns_of({})) == []
    with pytest.raises(ValueError, match="not unique"):
        schedule.proportional(_counts(spark, {"a": 1}).unionByName(_counts(spark, {"a": 1})))


def test_balanced(spark):
    names = list("fabdec")
    refs = [tuple(r) for r in schedule.balanced(_counts(spark, dict.fromkeys(names, 8))).orderBy("position").collect()]
    assert [p for p, _, _ in refs] == list(range(48))
    for turn in range(8):
        order = sorted(names)
        random.Random(schedule.stable_seed(42, "round", turn)).shuffle(order)
        assert [(a, k) for _, a, k in refs[turn * 6 : turn * 6 + 6]] == [(a, _shuffled(8, 42, a, "rows")[turn]) for a in order]
    with pytest.raises(ValueError):
        schedule.balanced(_counts(spark, {"a": 1, "b": 2}))
    assert schedule.training_schedule(_counts(spark, {"a": 1, "b": 2}), "real").count() == 3


def test_seeds():
    assert schedule.stable_seed(42, "brwac", "rows") == int(__import__("hashlib").sha256(b'[42,"brwac","rows"]').hexdigest()[:16], 16)


def test_scheduled_sequences(spark):
    order = schedule.proportional(_counts(spark, {"a": 2, "b": 1}))
    held = spark.createDataFrame([("a", 0, [1]), ("a", 1, [2]), ("b", 0, [3])], "dataset_id string, row_index bigint, input_ids array<int>")
    assert sorted(r["input_ids"][0] for r in schedule.scheduled_sequences(order, held).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="not unique"):
        schedule.scheduled_sequences(order.unionByName(order), held)
    with pytest.raises(Exception, match="no sequence"):
        schedule.scheduled_sequences(order, held.filter("dataset_id = 'a'")).collect()


def test_buffered_shuffle(spark):
    rng, held, new, want = random.Random(2), [0, 1, 2], 3, []
    while held:
        at = rng.randrange(len(held))
        want.append(held[at])
        if new < 10:
            held[at], new = new, new + 1
        else:
            held.pop(at)
    assert [r for _, r in select.shuffled_positions([10], 3, 1, 2)] == want
    assert sorted(select.shuffled_positions([3, 4], 100, 1, 2)) == [(0, k) for k in range(3)] + [(1, k) for k in range(4)]
    assert list(select.shuffled_positions([], 4, 1, 2)) == []
    some = select.buffered_shuffle(spark, {"x": 50, "y": 30}, 8, 42, "t", 20).collect()
    assert some == select.buffered_shuffle(spark, {"x": 50, "y": 30}, 8, 42, "t").filter("position < 20").collect() and len(some) == 20


def test_steps_and_ranks(spark):
    rows = spark.range(26).select(F.col("id").alias("position"))
    got = schedule.steps_and_ranks(rows, 8, 2, 3).collect()
    assert sorted(r["position"] for r in got if r["step"] == 2 and r["rank"] == 0) == [8, 9, 10, 11]
    assert sorted(r["position"] for r in got if r["step"] == 2 and r["rank"] == 1) == [12, 13, 14, 15]
    assert len(got) == 24
    for steps in (None, 4):
        with pytest.raises(Exception, match="last batch"):
            schedule.steps_and_ranks(rows, 8, 2, steps).collect()
    assert schedule.steps_and_ranks(rows.filter("position < 24"), 8, 2).count() == 24


def test_reduced_ranks(spark):
    rows = spark.createDataFrame([(1, 2.0, 3, False), (1, 4.0, 1, True), (2, 1.0, 1, False)], "step int, loss double, n int, bad boolean")
    assert sorted(map(tuple, schedule.reduced_ranks(rows, ["step"], ["n"], ["loss"], ["bad"]).collect())) == [(1, 4, 4.0, True), (2, 1, 1.0, False)]


def _loop(records, eval_sequences, length, limits):
    import hashlib

    h = lambda *p: hashlib.sha256("\x1f".join(map(str, p)).encode()).hexdigest()
    total, split = 0, {"eval": [], "train": []}
    for ref, n in sorted(records, key=lambda r: h(42, "d", "split", r[0])):
        split["eval" if total < eval_sequences * length else "train"].append((ref, n))
        total += n
    out = {}
    for name, part in split.items():
        flat = [(ref, k) for ref, n in sorted(part, key=lambda r: h(42, "d", name, r[0])) for k in range(n)]
        out[name] = [flat[k : k + length] for k in range(0, len(flat) - length + 1, length)][: limits.get(name)]
    return out


def test_packing_equals_loop(spark):
    rng = random.Random(3)
    records = [(f"r{k}", rng.randint(2, 40)) for k in range(60)] + [("long", 100)]
    df = spark.createDataFrame([("d", r, n) for r, n in records], "dataset_id string, source_hash string, n bigint")
    ids = spark.createDataFrame([("d", r, list(range(n))) for r, n in records], "dataset_id string, source_hash string, input_ids array<int>")
    placed = pack.placed(pack.split_by_budget(df, 3, length=16))
    limits = {"eval": 3}
    rows = pack.sequences(pack.pieces(placed, 16, limits), ids, 16).collect()
    expected = _loop(records, 3, 16, limits)
    for split in ("eval", "train"):
        got = [r for r in sorted(rows, key=lambda r: r["sequence"]) if r["split"] == split]
        assert [r["input_ids"] for r in got] == [[k for _, k in s] for s in expected[split]]
        assert all(sum(r["source_token_counts"]) == 16 for r in got)
    tails = {r["split"]: r for r in pack.tails(placed, 16, limits).collect()}
    assert tails["eval"]["emitted"] == 3 and tails["train"]["tail"] < 16
    with pytest.raises(ValueError, match="did not contain enough tokens"):
        pack.require_budget(pack.tails(placed, 16), {"train": 10_000})


def test_keep_first(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "")], "i int, t string").withColumn("d", F.lit("x"))
    assert sorted(r["i"] for r in dedup.keep_first(rows, ["d"], F.col("t"), "i").collect()) == [1, 2, 5]
    odd = rows.unionByName(rows).unionByName(spark.createDataFrame([(1, "c"), (None, "a"), (7, None)], "i int, t string").withColumn("d", F.lit("x")))
    assert sorted((r["i"], r["t"]) for r in dedup.keep_first(odd, ["d"], F.col("t"), "i").collect()) == [(1, "a"), (1, "c"), (2, "b"), (5, "")]
    with pytest.raises(ValueError):
        dedup.require_unique(rows, ["t"], "text")


def test_selection(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(50)], "i bigint, s int")
    chosen, seen = select.prefix_k(rows, 4, "i", F.col("s") == 0)
    assert [r["i"] for r in chosen.collect()] == [0, 3, 6, 9] and seen.count() == 10
    _, all_seen = select.prefix_k(rows, 1000, "i", F.col("s") == 0)
    assert all_seen.count() == 50
    assert [r["i"] for r in select.capped_prefix(rows, "i", 8, 9, F.col("s") == 1).collect()] == [1, 4, 7]
    best = select.bottom_k(rows, 5, 1, "t", F.col("i")).collect()
    assert [r["selection_rank"] for r in best] == list(range(5)) and best == select.bottom_k(rows.repartition(7), 5, 1, "t", F.col("i")).collect()


def test_scores_and_reasons(spark):
    rows = spark.createDataFrame([(4.0,), (3.9999,), (float("nan"),), (float("inf"),), (None,)], "s double")
    assert [r["s"] for r in filters.score_filter(rows, "s", 4).collect()] == [4.0]
    with pytest.raises(TypeError):
        filters.score_filter(spark.createDataFrame([(True,)], "s boolean"), "s", 4)
    pages = spark.createDataFrame([(" done", "t", "m", None), ("done", " ", "m", ""), ("x", None, None, None), ("done", "t", "", None), ("done", "t", "m", "7"), (None, "t", "m", "NULL")], "status string, text string, text_md5 string, same_as string")
    got = [r[0] for r in pages.select(filters.first_reason(filters.page_reasons())).collect()]
    assert got == [None, "filtered_missing_text", "filtered_status", "filtered_missing_text_md5", "filtered_same_as", "filtered_status"]


def test_page_rules():
    rules = filters.PageRules(["Resultados da busca"], ["busca"], ["tag"], ["s"], ["pesquisa"])
    assert rules.reason("Resultados da busca: x", None, None) == "search"
    assert rules.reason("Resultados da buscativa", None, None) is None
    assert rules.reason(None, "http://a/%2574ag/x", "http://a/tag/x") == "listing"
    assert rules.reason(None, None, "http://a/?%2573=1") == "search"
    assert rules.reason(None, "http://[bad", "http://a/x?q=PESQUISA+a") == "search"
    assert rules.reason(None, None, None) is None


def test_short_lines(spark):
    long = "x" * 150
    docs = [(1, f"{'a' * 39}\n{'b' * 40}\n{'c' * 41}\n{long}\n{long}"), (2, "curto"), (3, f"{long}\n{long}\n{'y' * 30}"), (4, None), (5, "z" * 100)]
    got = {r["i"]: r for r in filters.short_line_filter(spark.createDataFrame(docs, "i int, t string"), "i", "t").collect()}
    assert got[1]["lines_removed"] == 1 and got[1]["kept"]
    assert not got[2]["kept"] and got[2]["discarded_empty"]
    assert got[3]["kept"] and got[5]["kept"] and not got[4]["kept"]


def test_boilerplate_blocks(spark):
    common = "\n".join(f"linha comum número {k} do rodapé do site" for k in range(4))
    docs = [(k, "s", f"texto próprio {k} {'abc ' * 100}\n{common}") for k in range(5)]
    df = spark.createDataFrame(docs, "doc bigint, domain string, text string")
    blocks = boilerplate.repeated_blocks(df).collect()
    assert len(blocks) == 2 and sum(b["occurrences"] for b in blocks) == 10
    rows = boilerplate.removed(df).collect()
    assert all(r["lines_removed"] == 4 and r["kept"] for r in rows)
    assert boilerplate.repeated_blocks(df.limit(4)).count() == 0
    para = "um parágrafo que vários sites repetem palavra por palavra, longo o bastante para contar aqui"
    across = spark.createDataFrame([(k, f"s{k % 3}", f"{'x ' * 200}{k}\n\n{para}") for k in range(6)], "doc bigint, domain string, text string")
    (p,) = boilerplate.repeated_paragraphs(across).collect()
    assert (p["documents"], p["domains"], p["occurrences"]) == (6, 3, 6)
    assert boilerplate.repeated_paragraphs(across.filter("doc < 4")).count() == 0
    assert boilerplate.report(across).first()["documents_kept"] == 6
    assert boilerplate.removed(df.filter("false")).count() == 0


def test_projections(spark):
    turns = spark.createDataFrame([(1, 0, "USER", "oi"), (1, 1, "SYSTEM", " "), (1, 2, "SYSTEM", "olá"), (2, 0, "USER", "")], "d int, n int, s string, u string")
    got = {r["dialogue"]: r for r in project.dialogue_documents(turns, "d", "n", "s", "u").collect()}
    assert got[1]["text"] == "Usuário: oi\nAssistente: olá" and got[1]["turns_kept"] == 2 and got[2]["text"] is None
    with pytest.raises(Exception, match="unknown speaker"):
        project.dialogue_documents(turns.withColumn("s", F.lit("BOT")), "d", "n", "s", "u").collect()
    talk = spark.createDataFrame([("c", 0, "z", ""), ("c", 1, "a", "um"), ("c", 2, "z", "dois"), ("c", 3, None, "três")], "c string, n int, u string, t string")
    (row,) = project.conversation_documents(talk, "c", "n", "u", "t").collect()
    assert row["text"] == "Participante 2: um\nParticipante 1: dois\nParticipante 3: três" and row["participants"] == 3


def test_payload():
    import hashlib

    import zstandard

    raw = "página".encode()
    good, md5 = zstandard.compress(raw).hex().upper(), hashlib.md5(raw).hexdigest()
    assert payload.decode(good, md5.upper()) == ("página", None, True)
    assert payload.decode(good, "0" * 32) == ("página", None, False)
    assert payload.decode(good, "xyz")[1] == "invalid_text_md5"
    assert payload.decode("ABC", md5)[1] == "invalid_text_hex"
    assert payload.decode("", md5)[1] == "empty_compressed_texts"
    assert payload.decode("00" * 9, md5)[1] == "invalid_zstd_frames"
    assert payload.decode(zstandard.compress(b"\xff\xfe").hex(), md5)[1] == "non_utf8_decompressed_texts"
    assert payload.decode(good, md5, largest=2)[1] == "oversized_decompressed_texts"
    broken = bytes.fromhex(zstandard.compress(random.Random(1).randbytes(70_000)).hex())[:65_535]
    assert payload.decode(broken.hex(), md5)[1] == "truncated_zstd_frames_65535_bytes"
    assert payload.decode(broken[:60_000].hex(), md5)[1] == "corrupt_zstd_frames"


def test_losses_and_lookup(spark):
    losses = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 100.0)], "dataset_id string, loss double")
    got = {r["dataset_id"]: r for r in schedule.macro_losses(losses).collect()}
    assert got[None]["loss"] == 51.0 and got["b"]["perplexity"] == pytest.approx(2.718281828**80, rel=1e-3)
    shards = spark.createDataFrame([("d", 0, 3), ("d", 1, 2)], "dataset_id string, shard int, rows bigint")
    asked = spark.createDataFrame([("d", k) for k in range(7)] + [("e", 0)], "dataset_id string, row_index bigint")
    assert sorted((r["row_index"], r["shard"], r["row_in_shard"]) for r in schedule.rows_at(asked, shards).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1)]


def test_validation(spark):
    good = ("ab" * 32, list(range(1024)), ["s"], [1024])
    rows = spark.createDataFrame([good], "sequence_id string, input_ids array<int>, source_ref_sha256 array<string>, source_token_counts array<int>")
    validate.require_valid(rows)
    bad = rows.unionByName(rows).unionByName(rows.withColumn("input_ids", F.slice("input_ids", 1, 3)))
    found = validate.row_checks(bad).first()
    assert found["surplus_ids"] == 2 and found["bad_length"] == 1
    with pytest.raises(ValueError):
        validate.require_valid(bad)


def test_hot_keys_are_spread(spark):
    from moenda.operators import skew

    rows = spark.createDataFrame([(k, "h" if k % 3 else f"k{k}") for k in range(300)], "i int, k string")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") * 2)
    for total in (300, 300 * skew.HOT_KEYS):
        got = skew.join_counted(rows, counted.filter("k <> 'k0'"), ["k"], ["p"], F.xxhash64("i"), total).collect()
        assert len(got) == 299 and all(r["p"] == (400 if r["k"] == "h" else 2) for r in got)


def test_written_tables_can_be_discarded(spark):
    from moenda import runtime

    kept = runtime.written(spark.range(5), "some")
    assert kept.count() == 5 and runtime.discard_written(spark) and not runtime.discard_written(spark)
    assert runtime.written(spark.range(3), "some").count() == 3
