import numpy as np
import pytest
from pyspark.sql import functions as F

from moenda.llm import abuse


def words(text):
    return [" ".join(u) for u in abuse.units(text)]


def voters(text):
    found = 0
    for v in abuse.parsed(text)[2]:
        found |= v
    return {n for k, n in enumerate(abuse.NAMES) if found >> k & 1}


@pytest.mark.parametrize(
    "text",
    ["seu b.a.b.a.c.a", "seu b a b a c a", "seu BABACCCA", "seu bab​aca", "seu b4b4c4", "seu b@baca", "seu bаbаca"],
)
def test_disguises(text):
    assert "babaca" in words(text)[0].split() and {"insult", "insult_to_you"} <= voters(text)


@pytest.mark.parametrize(
    "text, voter",
    [
        ("Você não passa de um canalha.", "insult"), ("Ela é uma canalha", "insult"), ("seus otários", "insult_to_you"), ("you complete moron", "insult_to_you"), ("nojento, imundo e covarde, um verme", "insults"),
        ("eu vou te matar amanhã", "harm_by_me"), ("I will hurt you", "harm_by_me"), ("sei muito bem onde você dorme", "where_you_are"), ("some da tua terra", "go_away"), ("tenho ódio de você", "disgust_at_you"),
        ("esses ladrões são uma peste", "are_vermin"), ("raça maldita", "vile_kind"), ("é preciso expulsar todos do país", "remove_from"), ("quer transar, manda nudes", "sexual_offer"), ("p***a", "disguised"), ("consulta com a médica", "care"),
    ],
)
def test_voters(text, voter):
    assert voter in voters(text)


def test_voters_against_vote_alone_and_far_words_do_not_meet():
    assert voters("o tribunal e a delegacia") == {"report"}
    assert "harm_to_you" not in voters("matar " + "palavra " * 30 + "você")
    assert voters("") == set() and abuse.parsed(None) == ([], [], [])


def test_every_voter_can_vote_and_every_class_has_words():
    for name, (classes, _) in abuse.VOTERS.items():
        chosen = ["p***a" if c == "disguised" else next(w for w in abuse.LEXICA[c].split()[k:] if not w.endswith("*")) for k, c in enumerate(classes)]
        assert name in voters(" ".join(chosen)), name


def test_units():
    assert words("Um. Dois três!\n\nquatro") == ["um", "dois tres", "quatro"]
    assert abuse.units("") == [] and abuse.units("...") == []
    long = " ".join(f"palavra{k}" for k in range(60)) + " seu idiota. fim"
    assert [len(u) for u in abuse.units(long)] == [62, 1]
    # a voter against meets the word it is about in a sentence of any length
    quoted = "segundo o tribunal " + "que julgou o caso ontem " * 12 + "a palavra idiota é ofensiva"
    assert {"report", "insult"} <= voters(quoted) and len(abuse.units(quoted)) == 1
    assert sum(len(u) for u in abuse.units("palavra " * 20_000)) == 20_000


def test_label_model_finds_rates_and_dependence():
    rng = np.random.default_rng(1)
    bit = {v: 1 << k for k, v in enumerate(abuse.NAMES)}
    abusive = rng.random(200_000) < 0.02
    rates = {"insult": (0.6, 0.003), "insult_to_you": (0.0, 0.0), "vulgar": (0.5, 0.002), "harm_to_you": (0.3, 0.001), "report": (0.01, 0.2)}
    patterns = np.zeros(len(abusive), int)
    for name, (yes, no) in rates.items():
        patterns |= np.where(rng.random(len(abusive)) < np.where(abusive, yes, no), bit[name], 0)
    # a voter that copies another one tells nothing more
    patterns |= np.where(patterns & bit["insult"], bit["insult_to_you"], 0)
    values, n = np.unique(patterns, return_counts=True)
    post = abuse.label_model(dict(zip(values.tolist(), n.tolist())))
    copied = bit["insult"] | bit["insult_to_you"]
    assert post[0] < 0.02 and post[bit["report"]] < 0.01
    # rates and dependence share what they explain, so the copied vote may be trusted less than its true 0.66, not more
    assert 0.1 < post[copied] < 0.75 and post[copied | bit["report"]] < post[copied] < post[copied | bit["vulgar"]] and post[copied | bit["vulgar"]] > 0.9
    votes_for = [bin(p & ~bit["report"]).count("1") for p in patterns.tolist()]
    assert np.corrcoef([post[p] for p in patterns.tolist()], abusive)[0, 1] > np.corrcoef(votes_for, abusive)[0, 1]
    assert abuse.label_model({0: 5})[0] < 0.5


def test_judgements_correct_what_voters_agree_on():
    bit = {v: 1 << k for k, v in enumerate(abuse.NAMES)}
    table = {
        "": 80_000, "report": 10_000, "report care": 1_994, "report figure": 1_696, "sexual": 243, "insult": 571, "report creature": 834, "insult report": 260, "creature figure": 129, "sexual creature": 180,
        "insult are_vermin": 87, "insult care": 94, "sexual report": 71, "remove_from": 38, "sexual report care": 40, "sexual sexual_words sexual_offer": 59, "sexual sexual_words": 34, "are_vermin": 65, "insult insult_to_you vulgar": 10,
    }
    pattern = {names: sum(bit[n] for n in names.split()) for names in table}
    counts = {pattern[names]: n for names, n in table.items()}
    harmless, abusive = pattern["insult are_vermin"], pattern["insult insult_to_you vulgar"]
    # a harmless word of two classes makes two voters agree, which looks like abuse
    assert abuse.label_model(counts)[harmless] > 0.9
    # the first sentence of each judged document, and its judgement; one of either kind is wrong
    rows = [(harmless, 0, 1)] * 8 + [(harmless, 1, 0)] + [(pattern["insult care"], 0, 1)] * 9 + [(abusive, 1, 0)] * 4 + [(abusive, 0, 1)] + [(pattern["insult"], 0, 1)] * 40 + [(0, 0, 1)] * 400 + [(0, 1, 0)] * 5
    votes = np.array([v for row in rows for v in (row[0], 0, 0)])
    judged = abuse.Judged(votes, np.repeat(np.arange(len(rows)), 3), np.array([row[1:] for row in rows]))
    post = abuse.label_model(counts, judged)
    assert post[harmless] < 0.1 and post[pattern["insult care"]] < 0.1 and post[abusive] > 0.9 and post[0] < 0.001


def test_judged_documents_reach_the_label_model(spark, monkeypatch):
    given, made = [], abuse.label_model
    monkeypatch.setattr(abuse, "label_model", lambda counts, judged=None: given.append(judged) or made(counts, judged))
    documents = spark.createDataFrame([(1, "seu idiota. tudo bem"), (2, "bom dia"), (3, "seu babaca")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "abusive"), (1, "hateful"), (2, "clean")], "doc_id bigint, label string")
    sentences = abuse.sentences_of(documents, ["doc_id"])
    abuse.fitted(sentences, labels)
    abuse.fitted(sentences, labels.filter("false"))
    assert sorted(given[0].judged.tolist()) == [[0, 1], [2, 0]] and len(given[0].votes) == len(given[0].document) == 3 and given[1] is None


def test_held_out(spark, data):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/content_label.parquet")
    sentences = abuse.sentences_of(documents, ["doc_id"])
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = abuse.fitted(sentences, labels.filter(half))
    rows = abuse.scored(sentences, model, ["doc_id"]).join(abuse.judgements(labels).filter(~half), "doc_id").collect()
    hits = [(r["score"] >= abuse.FOUND, r["yes"] > r["no"]) for r in rows]
    # a tenth of the judgements is wrong
    assert np.mean([a == b for a, b in hits]) > 0.85 and len(hits) > 20


def test_cases(spark):
    bad = "você é um idiota, vai tomar no cu"
    documents = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "texto limpo", 1.0), *[(4, bad, 1.0)] * 3, (5, "x " * 50_000 + bad, 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, " CLEAN", "a"), (4, "Abusive", "a"), (4, None, "b"), (9, "odd", "c")], "doc_id bigint, label string, annotator string")
    sentences = abuse.sentences_of(documents, ["doc_id"])
    model = abuse.fitted(sentences, labels)
    rows = abuse.scored(sentences, model, ["doc_id"]).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 7 and scores[1] == scores[2] == 0 and scores[4] > scores[3]
    empty = abuse.fitted(sentences.filter("false"), labels.filter("false"))
    assert abuse.scored(sentences, empty, ["doc_id"]).count() == 7
    bounded = abuse.fitted(sentences, labels, max_entries=30)
    assert abuse.scored(sentences, bounded, ["doc_id"]).count() == 7
