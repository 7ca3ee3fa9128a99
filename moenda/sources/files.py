"""Page dumps, dialogues and scored records as tables; digests of files."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a page dump, in order.
PAGE_COLUMNS = (
    "id domain_id parent_page_id same_as url url_md5 url_final url_final_md5 status_code title recursion_level status retry_count text html text_md5 html_md5 created_at updated_at"
).split()
DIALOGUE_SCHEMA = "array<struct<dialogue_id:string,turns:array<struct<speaker:string,utterance:string>>>>"


def pages_tsv(spark: SparkSession, path: str, max_field_bytes: int | None = None) -> DataFrame:
    """The 19 columns of a page dump of one or more files, and its lines' order as ``position``.

    Quotes and backslashes are data; a line with another number of fields or that isn't UTF-8, a field over
    the limit or a file with another header is an error.  ``position`` grows with the line and has
    gaps; it comes from the files' splits and costs no pass over the data.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_block_start")
    lines = raw.select(F.monotonically_increasing_id().alias("position"), "value", F.when(place == 0, F.col("_metadata.file_path")).alias("start"))
    header = "\t".join(PAGE_COLUMNS)
    heads = lines.filter("start is not null").groupBy("start").agg(F.min_by("value", "position").alias("head"), F.min("position").alias("position"))
    heads = heads.collect()  # a row per file
    plain = [(r["head"] or "").lstrip("\ufeff").rstrip("\r") for r in heads]
    if not heads or any(x != header for x in plain):
        raise ValueError("the header of the page dump is not as expected")
    lines = lines.filter(~F.col("position").isin([r["position"] for r in heads]))
    line = F.regexp_replace("value", r"\r\z", "")
    fields = F.split(line, "\t", -1)
    good = (F.size(fields) == len(PAGE_COLUMNS)) & F.is_valid_utf8("value")
    if max_field_bytes:
        good = good & ~F.exists(fields, lambda x: F.octet_length(x) > max_field_bytes)
    rows = lines.filter(line != "").withColumn("f", F.when(good, fields).otherwise(F.raise_error(F.lit("malformed line in the page dump"))))
    return rows.select("position", *(F.col("f")[i].alias(name) for i, name in enumerate(PAGE_COLUMNS)))


def dialogues_json(spark: SparkSession, folder: str, files: int = 17) -> DataFrame:
    """(file, dialogue_index, turn_index, speaker, utterance) of ``dialogues_NNN.json`` files;
    a missing or surplus file is an error.  Other keys aren't read."""
    expected = [f"dialogues_{k:03d}.json" for k in range(1, files + 1)]
    found = sorted(n for n in os.listdir(folder) if n.endswith(".json"))
    if found != expected:
        raise ValueError(f"expected {expected[0]} to {expected[-1]}, found {len(found)} files")
    raw = spark.read.option("wholetext", True).text([os.path.join(folder, n) for n in expected]).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.from_json("value", DIALOGUE_SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    dialogues = raw.select("file", F.posexplode("d").alias("dialogue_index", "d"))
    return dialogues.select("file", "dialogue_index", F.posexplode_outer("d.turns").alias("turn_index", "t")).select("file", "dialogue_index", "turn_index", "t.speaker", "t.utterance")


def scored_parquet(spark: SparkSession, folder: str, shards: int | None = None, pattern: str = "*.parquet", places: bool = False) -> DataFrame:
    """text, edu_int_score and, where present, source and subset; nothing else is read.  With ``places`` also
    the name of the shard and the row in it."""
    rows = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    if shards is not None and (n := len(rows.inputFiles())) != shards:
        raise ValueError(f"expected {shards} shards, found {n}")
    missing = {"text", "edu_int_score"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    where = [F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row")] if places else []
    return rows.select(*where, "text", "edu_int_score", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("source", "subset")))


def file_sha256(path: str, first: int | None = None) -> str:
    """Digest of a file, or of its first bytes; it is read in pieces."""
    with open(path, "rb") as f:
        if first is None:
            return hashlib.file_digest(f, "sha256").hexdigest()
        found = hashlib.sha256()
        while first and (piece := f.read(min(first, 1 << 20))):
            found.update(piece)
            first -= len(piece)
        return found.hexdigest()


def digest_of(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def unchanged(path: str, guard: dict) -> bool:
    """Whether a file still has the size and the windows that a guard was taken of."""
    return os.path.getsize(path) == guard["size"] and sampled_guard(path, guard["window"]) == guard


def files_digest(paths: list[str]) -> str:
    """Digest of the names, sizes and contents of a list of files."""
    records = [{"name": os.path.basename(p), "size": os.path.getsize(p), "sha256": file_sha256(p)} for p in paths]
    return hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def pinned_index_digest(folder: str, index: str) -> str:
    """Compares the shards of a folder with a download index (names and sizes) and gives a
    digest of the index's metadata alone."""
    with open(index, encoding="utf-8") as f:
        listed = json.load(f)
    if listed.get("format_version") != 1:
        raise ValueError("unknown version of the index")
    here = {n: os.path.getsize(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".parquet")}
    named = {os.path.basename(k): v["size"] for k, v in listed["files"].items() if k.endswith(".parquet")}
    if here != named:
        raise ValueError("the shards differ from the index")
    return hashlib.sha256(json.dumps(listed["files"], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sampled_guard(path: str, window: int = 65_536) -> dict:
    """Size and digests of five windows of a file too large to hash before every run."""
    size = os.path.getsize(path)
    digests = []
    with open(path, "rb") as f:
        for quarter in range(5):
            f.seek(max(0, min(size * quarter // 4, size - window)))
            digests.append(hashlib.sha256(f.read(window)).hexdigest())
    return {"size": size, "window": window, "windows": digests}


def safe_path(root: str, name: str) -> str:
    """A regular file below a root; links and paths that leave it are errors."""
    full = os.path.join(os.path.realpath(root), name)
    if os.path.realpath(full) != full or not os.path.isfile(full) or os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise ValueError(f"{name} is not a regular file below the root")
    return full
