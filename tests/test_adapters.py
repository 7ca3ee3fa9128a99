"""Each kind of source from its files to validated shards."""

import copy
import hashlib
import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from moenda.functions.tokenizers import CodePoints, FromFile
from moenda.plans import config, pipeline
from moenda.sources import adapters, files

PREPARATION = {
    "tokenizer": {"model_id": "m", "revision": "r", "trust_remote_code": False}, "sequence_length": 1024, "seed": 42, "output_root": "derived",
    "storage": {"format": "parquet", "compression": "zstd", "sequences_per_shard": 1024}, "cleaning": {"unicode_normalization": "NFC", "strip_html": True, "strip_control_characters": True},
}
PROFILES = {
    "smoke": {"train_sequences": 8, "eval_sequences": 2, "candidate_documents": 40, "selection": "representative", "max_source_records": 200, "shuffle_buffer_size": 16},
    "mvp": {"train_sequences": 256, "eval_sequences": 32, "candidate_documents": 4096, "selection": "representative"},
}
BOILERPLATE = {
    "decision_by_profile": {"smoke": "pending", "mvp": "remove_exact"}, "cross_domain_paragraphs": {"minimum_characters": 80, "minimum_documents": 5, "minimum_domains": 3},
    "within_domain_blocks": {"lines_per_block": 3, "minimum_characters": 60, "minimum_documents": 5}, "document_filter": {"minimum_remaining_characters": 300, "maximum_removed_fraction": 0.8},
}
PAGES = {
    "page_filter": {"search_title_markers": ["busca"], "search_query_parameters": ["s"], "search_query_value_markers": [], "search_path_segments": [], "listing_path_segments": ["tag"]},
    "line_filter": {"minimum_characters": 40}, "boilerplate": BOILERPLATE,
}


def text(k):
    return f"documento {k} " + f"palavra{k} &amp; " * 60


def dataset(name, source, filters):
    return {"dataset_id": name, "adapter": name, "source": {"root_env": "DATA"} | source, "filters": filters, "profiles": copy.deepcopy(PROFILES)}


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    with zipfile.ZipFile(root / "plain.zip", "w") as z:
        for k in range(50):
            z.writestr(f"data/{k}.txt", text(k))
    with zipfile.ZipFile(root / "talk.zip", "w") as z:
        for k in range(50):
            z.writestr(f"clear_threads/{k}.tsv", "".join(f"1\t{u}\t{text(k)}\n" for u in ("ana", "bia")) + "2\tana\t\n")
    (root / "dialogues").mkdir()
    for f in (1, 2):
        turns = [[{"speaker": s, "utterance": text(k)} for s in ("USER", "SYSTEM")] for k in range(20 * f, 20 * f + 20)]
        (root / "dialogues" / f"dialogues_{f:03d}.json").write_text(json.dumps([{"dialogue_id": "x", "turns": t} for t in turns]), encoding="utf-8")
    (root / "scored" / "default").mkdir(parents=True)
    for s in range(2):
        pq.write_table(pa.table({"text": [text(100 * s + k) for k in range(60)], "edu_int_score": [4 + k % 2 if k % 3 else 1 for k in range(60)], "source": ["a b"] * 60}), root / "scored" / "default" / f"train-{s}.parquet")
    rows = ["\t".join(files.PAGE_COLUMNS)]
    for k in range(60):
        raw = (text(k) + "\ncurta\n" + "\n".join(f"rodapé do sítio com uma linha comprida, número {x}" for x in range(3))).encode()
        values = {"id": str(k), "domain_id": f"d{k % 2}", "url": f"http://a/{'tag' if k == 7 else 'p'}/{k}", "url_md5": "u", "title": "Busca: x" if k == 8 else "t", "status": "done" if k != 9 else "new", "text": zstandard.compress(raw).hex().upper(), "text_md5": hashlib.md5(raw).hexdigest(), "same_as": "NULL"}
        if k == 10:
            values["text"] = "ABC"
        rows.append("\t".join(values.get(c, "") for c in files.PAGE_COLUMNS))
    (root / "pages.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def configs(tmp_path_factory):
    root = tmp_path_factory.mktemp("configs")
    (root / "datasets").mkdir()
    all_of = [
        dataset("brwac", {"path": "plain.zip"}, {"punctuation_spacing": "detokenize_brwac_v1"}), dataset("outerspace", {"archives_by_profile": {"smoke": "talk.zip", "mvp": "talk.zip"}}, {}),
        dataset("multiwoz_ptbr", {"relative_directory": "dialogues", "expected_files": 2}, {"speaker_labels": {"USER": "Usuário", "SYSTEM": "Assistente"}}),
        dataset("gigaverbo", {"path": "scored", "shard_glob": "default/train-*.parquet", "expected_shards": 2, "dataset_id": "d", "revision": "r", "config_name": "default", "split": "train"}, {"min_edu_int_score": 4}),
        dataset("wackywacky", {"path": "pages.tsv", "max_field_size_bytes": 10**6, "max_decompressed_text_bytes": 10**6, "fingerprint_sample_bytes": 4096}, PAGES),
    ]
    for d in all_of:
        (root / "datasets" / f"{d['dataset_id']}.json").write_text(json.dumps(d), encoding="utf-8")
    (root / "preparation.json").write_text(json.dumps(PREPARATION), encoding="utf-8")
    return str(root)


@pytest.mark.parametrize("name", ["brwac", "outerspace", "multiwoz_ptbr", "gigaverbo"])
def test_prepare(spark, configs, data, tmp_path, name):
    found = pipeline.prepare(spark, configs, name, "smoke", data, str(tmp_path))
    assert found["counts"] == {"train": 8, "eval": 2} and found["dataset_id"] == name
    base = os.path.join(str(tmp_path), name, found["preparation_id"])
    assert pipeline.validate_preparation(spark, base) == found == pipeline.prepare(spark, configs, name, "smoke", data, str(tmp_path))
    assert not os.listdir(os.path.join(str(tmp_path), ".work", name))
    if name == "brwac":
        assert found["scan_metrics"] == {"members_eligible": 50, "documents_selected": 40}
    if name == "outerspace":
        assert found["scan_metrics"]["messages_kept"] == 80 and found["scan_metrics"]["messages"] == 120


def test_scans(spark, configs, data):
    def scan(name):
        return adapters.adapter_of(name).scan(spark, data, config.load(configs, name, "smoke")[0])

    talk = scan("outerspace").documents.orderBy("position").collect()
    assert len(talk) == 40 and talk[0]["text"].startswith("Participante 1: documento") and "\nParticipante 2: documento" in talk[0]["text"]
    order = sorted((hashlib.sha256(f"42\x1fbrwac\x1fdata/{k}.txt".encode()).hexdigest(), k) for k in range(50))
    assert [r["source_ref"].rsplit("/", 1)[1] for r in scan("brwac").documents.orderBy("position").collect()] == [f"{k}.txt" for _, k in order[:40]]
    scored = scan("gigaverbo")
    rows = scored.documents.orderBy("position").collect()
    assert len(rows) == 40 and scored.metrics["records_seen"] == rows[-1]["position"] + 1 and not scored.capped and all("&" in r["text"] and "&amp;" not in r["text"] for r in rows)
    pages = scan("wackywacky")
    assert {k: pages.metrics[k] for k in ("rows_filtered_status", "pages_listing", "pages_search", "texts_invalid_text_hex", "texts_decoded")} == {"rows_filtered_status": 1, "pages_listing": 1, "pages_search": 1, "texts_invalid_text_hex": 1, "texts_decoded": 56}
    with pytest.raises(ValueError):
        adapters.adapter_of("other")
    with pytest.raises(TypeError):
        adapters.register("other", object())


def test_pages_wait_for_review(spark, configs, data, tmp_path):
    with pytest.raises(pipeline.ReviewRequired):
        pipeline.prepare(spark, configs, "wackywacky", "smoke", data, str(tmp_path / "out"))
    (stage,) = os.listdir(tmp_path / "out" / ".work" / "wackywacky")
    decided = tmp_path / "configs"
    (decided / "datasets").mkdir(parents=True)
    (decided / "preparation.json").write_text(json.dumps(PREPARATION), encoding="utf-8")
    with open(os.path.join(configs, "datasets", "wackywacky.json"), encoding="utf-8") as f:
        changed = json.load(f)
    changed["filters"]["boilerplate"]["decision_by_profile"]["smoke"] = "remove_exact"
    (decided / "datasets" / "wackywacky.json").write_text(json.dumps(changed), encoding="utf-8")
    resolved = config.load(str(decided), "wackywacky", "smoke")
    assert config.scan_digest(resolved[0]) == config.scan_digest(config.load(configs, "wackywacky", "smoke")[0]) and resolved[1] != config.load(configs, "wackywacky", "smoke")[1]
    kept = tmp_path / "out" / ".work" / "wackywacky" / stage / "documents.json"
    before = json.loads(kept.read_text())
    kept.write_text(json.dumps(before | {"metrics": {"from": 1}}))
    found = pipeline.prepare(spark, str(decided), "wackywacky", "smoke", data, str(tmp_path / "out"))
    assert found["counts"] == {"train": 8, "eval": 2} and found["scan_metrics"] == {"from": 1}  # the scan was not repeated
    with open(tmp_path / "out" / "wackywacky" / found["preparation_id"] / pipeline.REPORT, encoding="utf-8") as f:
        report = json.load(f)
    assert report["applied"] and report["removal"]["lines_removed"] == 120 and report["line_filter"]["lines_removed"] == 40


def test_configs(configs, tmp_path):
    resolved, sha = config.load(configs, "brwac", "smoke")
    assert len(sha) == 64 and resolved["profile"]["train_sequences"] == 8 and "profiles" not in resolved["dataset"]
    for path, value in (("seed", 43), ("seed", True), ("sequence_length", 1024.0), ("storage.compression", "gzip"), ("cleaning", {}), ("tokenizer.model_id", "")):
        bad = copy.deepcopy(PREPARATION)
        *above, last = path.split(".")
        (bad[above[0]] if above else bad)[last] = value
        with pytest.raises(config.ConfigError):
            config.check_preparation(bad)
    good = dataset("brwac", {"path": "x"}, {})
    config.check_dataset(good, "brwac")
    for change in ({"adapter": "x"}, {"profiles": {"smoke": PROFILES["smoke"]}}, {"profiles": PROFILES | {"other": {}}}, {"filters": []}):
        with pytest.raises(config.ConfigError):
            config.check_dataset(good | change, "brwac")
    for change in ({"train_sequences": 9}, {"candidate_documents": 0}, {"candidate_documents": True}, {"selection": "any"}):
        with pytest.raises(config.ConfigError):
            config.check_profile(PROFILES["smoke"] | change, "smoke")
    real = PROFILES["mvp"] | {"eval_sequences": 256, "allocation_policy": "equal_share_without_replacement", "without_replacement": True, "allocation_sha256": "a" * 64}
    config.check_profile(real, "real")
    with pytest.raises(config.ConfigError):
        config.check_profile(real | {"allocation_sha256": "a"}, "real")
    for name, profile in (("none", "smoke"), ("brwac", "real"), ("Bad", "smoke")):
        with pytest.raises(config.ConfigError):
            config.load(configs, name, profile)


def test_roots(tmp_path):
    (tmp_path / "data").mkdir()
    os.symlink(tmp_path / "data", tmp_path / "link")
    assert config.output_root(str(tmp_path / "out"), str(tmp_path / "data")) == str(tmp_path / "out")
    for bad in ("", " ", "/", "~", str(tmp_path / "link"), str(tmp_path / "data" / "x"), str(tmp_path)):
        with pytest.raises(config.ConfigError):
            config.output_root(bad, str(tmp_path / "data"))
    named = {"dataset": {"source": {"root_env": "DATA"}}}
    assert config.dataset_root(named, {"DATA": str(tmp_path)}) == os.path.realpath(tmp_path)
    for env in ({}, {"DATA": "relative"}, {"DATA": str(tmp_path / "none")}):
        with pytest.raises(config.ConfigError):
            config.dataset_root(named, env)


def test_digests(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a" * 3_000_000)
    assert files.file_sha256(str(path), 2_000_000) == hashlib.sha256(b"a" * 2_000_000).hexdigest() and files.file_sha256(str(path), 10**9) == files.file_sha256(str(path))
    guard = files.sampled_guard(str(path), 1000)
    assert files.unchanged(str(path), guard)
    path.write_bytes(b"a" * 2_999_999 + b"b")
    assert not files.unchanged(str(path), guard)


def test_tokenizer_from_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"um": 0, "dois": 1, "</s>": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    made.save(path)
    own = FromFile(path, 4, 2)
    rows = spark.createDataFrame([("um dois um",), ("",), (None,), ("três",)], "t string").select(own.ids(F.col("t")).alias("i")).collect()
    assert [r["i"] for r in rows] == [[0, 1, 0, 2], [2], None, [3, 2]] and own.decode([0, 1, 2, 0]) == "um dois um"
    assert own.fingerprint() == FromFile(path, 4, 2).fingerprint() != CodePoints().fingerprint() and own.fingerprint() != FromFile(path, 4, 3).fingerprint()
    with pytest.raises(ValueError):
        FromFile(path, 5, 2).fingerprint()
