import json
import os
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from moenda.plans import cli, manifest, pipeline
from moenda.sources import archive, files
from moenda.streaming import ingest

SENTINEL = "PRIVATE-SENTINEL"


@pytest.fixture(scope="module")
def documents(spark):
    texts = [f"{SENTINEL} documento {k} " + "palavra " * (60 + k % 50) for k in range(40)]
    texts[7] = texts[3]
    return spark.createDataFrame([(k, t, f"ref-{k}") for k, t in enumerate(texts)], "position bigint, text string, source_ref string")


def test_run_is_repeatable_and_private(spark, documents, tmp_path):
    spec = pipeline.Spec("amostra", profiles={"smoke": pipeline.Profile(8, 2, 128)})
    one = pipeline.run(spark, documents, spec, str(tmp_path / "a"))
    two = pipeline.run(spark, documents.repartition(5), spec, str(tmp_path / "b"))
    assert one == two and one["counts"] == {"train": 8, "eval": 2}
    assert pipeline.run(spark, documents, spec, str(tmp_path / "a")) == one
    for folder, _, names in os.walk(tmp_path / "a"):
        for n in names:
            content = open(os.path.join(folder, n), "rb").read()
            assert SENTINEL.encode() not in content and b"ref-1" not in content
    base = tmp_path / "a" / "amostra" / one["preparation_id"]
    schema = pq.read_schema(base / "train" / "shard-00000.parquet")
    assert schema.field("input_ids").type == pa.list_(pa.field("element", pa.int32(), False), 1024)
    assert pipeline.resolve_inputs(str(tmp_path / "a"), ["amostra"], "smoke")["amostra"] == one
    with pytest.raises(ValueError):
        pipeline.resolve_inputs(str(tmp_path / "a"), ["amostra"], "mvp")
    (base / "train" / "extra.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="differ from the manifest"):
        pipeline.validate_preparation(spark, str(base))
    os.remove(base / "train" / "extra.parquet")
    # a run that was stopped before its manifest uses the shards that are there
    os.remove(base / "dataset_manifest.json")
    before = os.stat(base / "train" / "shard-00000.parquet").st_mtime_ns
    assert pipeline.run(spark, documents, spec, str(tmp_path / "a")) == one and os.stat(base / "train" / "shard-00000.parquet").st_mtime_ns == before
    os.remove(base / "dataset_manifest.json")
    pq.write_table(pq.read_table(base / "train" / "shard-00000.parquet").slice(1), base / "train" / "shard-00000.parquet")
    with pytest.raises(Exception, match="with other rows"):
        pipeline.run(spark, documents, spec, str(tmp_path / "a"))


def test_gates(spark, documents, tmp_path):
    with pytest.raises(pipeline.ReviewRequired):
        pipeline.run(spark, documents, pipeline.Spec("x", decision="pending"), str(tmp_path))
    with pytest.raises(ValueError, match="did not contain enough tokens"):
        pipeline.run(spark, documents, pipeline.Spec("x", profile="mvp"), str(tmp_path))
    with pytest.raises(ValueError, match="no profile"):
        pipeline.Spec("x", profile="real").budget
    again = documents.withColumn("source_ref", F.lit("same"))
    with pytest.raises(ValueError, match="not unique"):
        pipeline.run(spark, again, pipeline.Spec("x"), str(tmp_path))


@pytest.fixture(scope="module")
def pages(spark):
    footer = "\n".join(f"rodape repetido do site com linha comprida numero {k} sempre igual" for k in range(3))
    notice = "Este aviso de privacidade aparece igual em todos os sites e tem mais de oitenta letras no total."
    rows = []
    for k in range(40):
        body = f"documento {k} " + f"palavra{k} " * 150
        rows.append((k, f"Menu\n{body}\n\n{notice}\n\n{footer}", f"ref-{k}", f"site{k % 4}", None, None, f"http://x/{'busca' if k == 39 else 'p'}/{k}", "done", "m", None))
    return spark.createDataFrame(rows, "position bigint, text string, source_ref string, domain string, title string, url_final string, url string, status string, text_md5 string, same_as string")


def _decoded(spark, root, m):
    rows = spark.read.parquet(*(os.path.join(root, m["dataset_id"], m["preparation_id"], s) for s in ("train", "eval"))).collect()
    return {tuple(r["input_ids"]) for r in rows}


def test_remove_exact_removes(spark, pages, tmp_path):
    profiles = {"smoke": pipeline.Profile(8, 2, 128)}
    keep = pipeline.run(spark, pages, pipeline.Spec("w", profiles=profiles), str(tmp_path))
    gone = pipeline.run(spark, pages, pipeline.Spec("w", decision="remove_exact", profiles=profiles), str(tmp_path))
    footer = [4 + ord(c) % 200 for c in "rodape repetido"]

    def holds(ids):
        return any(list(ids[k : k + len(footer)]) == footer for k in range(len(ids)))

    assert any(map(holds, _decoded(spark, str(tmp_path), keep)))
    assert not any(map(holds, _decoded(spark, str(tmp_path), gone)))
    with open(tmp_path / "w" / gone["preparation_id"] / pipeline.REPORT, encoding="utf-8") as f:
        report = json.load(f)
    assert report["line_filter"]["lines_removed"] == 40 and report["applied"]
    assert report["removal"]["paragraphs"] == 2 and report["removal"]["documents_kept"] == 40 and report["removal"]["lines_removed"] == 160
    assert pipeline.run(spark, pages, pipeline.Spec("w", decision="remove_exact", profiles=profiles), str(tmp_path)) == gone
    marked = pipeline.Spec("w", decision="remove_exact", profiles=profiles, page_markers={"search_segments": ["busca"]})
    rows, report = pipeline.reviewed(pipeline.eligible(pages, marked), marked)
    assert rows.count() == 39 and report["removal"]["documents"] == 39
    with pytest.raises(pipeline.ReviewRequired):
        pipeline.run(spark, pages, pipeline.Spec("p", decision="pending", profiles=profiles), str(tmp_path))
    (ident,) = os.listdir(tmp_path / "p")
    with open(tmp_path / "p" / ident / pipeline.REPORT, encoding="utf-8") as f:
        report = json.load(f)
    assert report["finalization_blocked"] and not report["applied"] and report["removal"]["lines_removed"] == 160
    with pytest.raises(ValueError, match="lack domain"):
        pipeline.run(spark, pages.drop("domain"), pipeline.Spec("w", decision="remove_exact"), str(tmp_path))
    with pytest.raises(ValueError, match="decision"):
        pipeline.Spec("w", decision="remove")


def test_capacity_and_allocation(documents):
    spec = pipeline.Spec("x", profiles={"smoke": pipeline.Profile(8, 2, 1000)})
    report = pipeline.capacity(documents, spec, eval_reserve=2)
    assert report["capacity_kind"] == "exact" and report["train_sequences"] > 5
    less = pipeline.capacity(documents, pipeline.Spec("x", profiles={"smoke": pipeline.Profile(8, 2, 20)}), eval_reserve=2)
    assert less["capacity_kind"] == "lower_bound"
    reports = [r | {"capacity_report_id": manifest.content_id(**{k: v for k, v in r.items() if k != "capacity_report_id"})} for r in (dict(report, dataset_id=n) for n in "abc")]
    assert pipeline.allocate(reports, 24) == pipeline.allocate(reports[::-1], 24)
    with pytest.raises(ValueError, match="available_sequences"):
        pipeline.allocate(reports, 8_000)
    found = pipeline.allocate(reports, 16)
    pipeline.require_allocation(found, reports[::-1])
    with pytest.raises(ValueError, match="isn't that"):
        pipeline.require_allocation(found | {"target": 8}, reports)
    for change in ({"train_sequences": 10**6}, {"documents": True}, {"capacity_kind": "some"}):
        with pytest.raises(ValueError, match="capacity report"):
            pipeline.allocate([reports[0] | change], 8)
    with pytest.raises(ValueError):
        pipeline.allocate(reports, 7)


def test_capacity_of_more_than_the_profile(spark, documents, tmp_path, capsys, monkeypatch):
    spec = pipeline.Spec("x", profiles={"smoke": pipeline.Profile(8, 2, 20)})
    less = pipeline.capacity(documents, spec, eval_reserve=2)
    whole = pipeline.capacity(documents, spec, eval_reserve=2, candidate_documents=pipeline.ALL)
    assert whole["capacity_kind"] == "exact" and whole["documents"] == 40 and whole["train_sequences"] > less["train_sequences"]
    more = pipeline.capacity(documents, spec, eval_reserve=2, candidate_documents=30)
    assert more["capacity_kind"] == "lower_bound" and more["documents"] == 30
    for bad in (0, -1, True, "some"):
        with pytest.raises(ValueError):
            pipeline.capacity(documents, spec, candidate_documents=bad)
    many = documents.crossJoin(spark.range(4)).withColumn("position", F.col("position") + 40 * F.col("id"))
    many = many.select("position", F.concat("text", F.col("position").cast("string")).alias("text"), F.concat("source_ref", F.lit("-"), F.col("position").cast("string")).alias("source_ref"))
    path = str(tmp_path / "d.parquet")
    many.write.parquet(path)
    monkeypatch.setattr(cli, "session", lambda: spark)

    def called(*more):
        assert cli.main(["capacity", "--documents", path, "--dataset", "x", "--eval-reserve", "2", *more]) == 0
        return json.loads(capsys.readouterr().out)

    assert called()["documents"] == 160 and called()["capacity_kind"] == "exact"
    assert called("--candidate-documents", "128")["capacity_kind"] == "lower_bound"


def test_stage_cache(spark, tmp_path):
    cache = pipeline.StageCache(str(tmp_path), "d", {"a": 1})
    assert cache.get(spark, "s", "f") is None
    cache.put(spark.range(3), "s", {"source": "f", "n": 2})
    rows, side = cache.get(spark, "s", "f")
    assert rows.count() == 3 and side["n"] == 2
    with pytest.raises(ValueError):
        cache.get(spark, "s", "other")
    cache.clear()
    assert cache.get(spark, "s", "f") is None


def test_manifest_helpers(tmp_path):
    assert manifest.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    assert len(manifest.content_id(x=1)) == 20 and manifest.content_id(x=1, y=2) == manifest.content_id(y=2, x=1)
    manifest.write_json_atomic(str(tmp_path / "m" / "x.json"), {"a": 1})
    assert os.listdir(tmp_path / "m") == ["x.json"] and json.load(open(tmp_path / "m" / "x.json")) == {"a": 1}
    for bad in ("/x", ["C:\\x"], {"k": {"/k": 1}}):
        with pytest.raises(ValueError):
            manifest.reject_absolute_paths(bad)


def test_zip_source(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in {"data/alpha.txt": "á", "data/beta.txt": "b", "data/nested/x.txt": "no", "clear_threads/t.tsv": "1\tana\toi \"\n2\tbia\t\n", "names.tsv": "n"}.items():
            z.writestr(name, text)
    rows = archive.contents(archive.members(spark, path, archive.TEXT_MEMBERS), path).select("member", "text", archive.crc_hex(F.col("crc")).alias("crc")).collect()
    assert {r["member"]: r["text"] for r in rows} == {"data/alpha.txt": "á", "data/beta.txt": "b"} and all(len(r["crc"]) == 8 for r in rows)
    threads = archive.thread_messages(archive.contents(archive.members(spark, path, archive.THREAD_MEMBERS), path))
    assert [(r["row"], r["user"], r["message"]) for r in threads.orderBy("row").collect()] == [(0, "ana", 'oi "'), (1, "bia", "")]
    before = archive.directory_digest(path), archive.record_digest(path)
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("data/gamma.txt", "c")
    assert archive.directory_digest(path) != before[0] and archive.record_digest(path) != before[1]


def test_page_dump(spark, tmp_path):
    path = tmp_path / "p.tsv"
    good = "\t".join(files.PAGE_COLUMNS)
    row = "\t".join('"quoted' if c == "title" else c[0] for c in files.PAGE_COLUMNS)
    path.write_text(f"{good}\n{row}\r\n{row}\n", encoding="utf-8")
    rows = files.pages_tsv(spark, str(path)).collect()
    assert len(rows) == 2 and rows[0]["title"] == '"quoted' and rows[0]["updated_at"] == "u"
    two = tmp_path / "two"
    two.mkdir()
    for name in "ab":
        (two / name).write_text(f"{good}\n{row}\n", encoding="utf-8")
    assert files.pages_tsv(spark, str(two)).count() == 2
    path.write_bytes(f"{good}\n{row}\n".encode().replace(b"quoted", b"q\xff"))
    with pytest.raises(Exception, match="malformed"):
        files.pages_tsv(spark, str(path)).collect()
    path.write_text(f"{good}\n{row.replace('quoted', 'é' * 6)}\n", encoding="utf-8")
    assert files.pages_tsv(spark, str(path), 13).count() == 1
    with pytest.raises(Exception, match="malformed"):
        files.pages_tsv(spark, str(path), 12).collect()
    path.write_text(f"{good}\na\tb\n", encoding="utf-8")
    with pytest.raises(Exception, match="malformed"):
        files.pages_tsv(spark, str(path)).collect()
    path.write_text("x\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.pages_tsv(spark, str(path))


def test_dialogues_and_scored(spark, tmp_path):
    for k in (1, 2):
        turns = [{"speaker": "USER", "utterance": "oi", "frames": []}]
        (tmp_path / f"dialogues_{k:03d}.json").write_text(json.dumps([{"dialogue_id": f"d{k}", "turns": turns}]), encoding="utf-8")
    got = files.dialogues_json(spark, str(tmp_path), 2).collect()
    assert [(r["file"][-8:], r["speaker"]) for r in sorted(got)] == [("001.json", "USER"), ("002.json", "USER")]
    with pytest.raises(ValueError):
        files.dialogues_json(spark, str(tmp_path), 3)
    folder = tmp_path / "s"
    folder.mkdir()
    pq.write_table(pa.table({"text": ["a"], "edu_int_score": [5], "other": [1]}), folder / "x.parquet")
    assert files.scored_parquet(spark, str(folder), 1).columns == ["text", "edu_int_score", "source", "subset"]
    with pytest.raises(ValueError):
        files.scored_parquet(spark, str(folder), 2)
    (tmp_path / "i.json").write_text(json.dumps({"format_version": 1, "files": {"x.parquet": {"size": os.path.getsize(folder / "x.parquet")}}}))
    assert len(files.pinned_index_digest(str(folder), str(tmp_path / "i.json"))) == 64
    assert len(files.sampled_guard(str(folder / "x.parquet"))["windows"]) == 5
    assert files.files_digest([str(folder / "x.parquet")]) == files.files_digest([str(folder / "x.parquet")])
    with pytest.raises(ValueError):
        files.safe_path(str(folder), "../i.json")


def test_stream_ingest(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    os.makedirs(src)

    def put(name, rows):
        pq.write_table(pa.table({"stream_index": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "edu_int_score": pa.array([r[2] for r in rows], pa.int32()), "source": ["s p" for _ in rows], "subset": ["b" for _ in rows]}), f"{src}/{name}.parquet")

    put("a", [(0, "um", 5), (1, "dois", 3), (2, "um ", 4), (3, None, 5)])
    ingest.ingest(spark, src, out, ck).awaitTermination()
    put("b", [(4, "um", 5), (5, "<p>três</p>", 4)])
    ingest.ingest(spark, src, out, ck).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["text"] for r in rows) == ["três", "um"] and {r["source"] for r in rows} == {None}
