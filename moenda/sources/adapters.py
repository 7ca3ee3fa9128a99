"""The documents of each kind of source, as a preparation takes them: scanned, filtered, selected, projected.

An adapter is anything with ``scan(spark, root, resolved)`` that gives a ``Scan``; ``register`` adds one.
Selections rank by hash before contents are read.  Relations are lazy, but for counts that
a scan reports.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, project, select
from ..runtime import written
from . import archive, files, payload


@dataclass(frozen=True)
class Scan:
    """Documents (position, text, source_ref; pages also domain), what identifies their source, and counts.

    ``capped`` says that a limit on records, not on documents, ended the scan.
    """

    documents: DataFrame
    source_sha256: str
    metrics: dict[str, int] = field(default_factory=dict)
    capped: bool = False


def guard_of(root: str, resolved: dict) -> str:
    """Digest of names, sizes and times of a source's files: another one tells that kept stages are stale."""
    source = resolved["dataset"]["source"]
    start = source.get("path") or source.get("relative_directory") or source["archives_by_profile"][resolved["profile_name"]]
    top = os.path.join(root, start)
    found = [top] if os.path.isfile(top) else [os.path.join(d, n) for d, _, names in os.walk(top) for n in names]
    return files.digest_of([[os.path.relpath(p, root), os.stat(p).st_size, os.stat(p).st_mtime_ns] for p in sorted(found)])


class Adapter(Protocol):
    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan: ...


def _ask(resolved: dict) -> tuple[dict, dict, dict, int, int]:
    return resolved["dataset"]["source"], resolved["dataset"]["filters"], resolved["profile"], resolved["preparation"]["seed"], resolved["profile"]["candidate_documents"]


class PlainArchive:
    """Text files of a ZIP archive, in the order of a hash of their names."""

    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan:
        source, _, _, seed, k = _ask(resolved)
        path = files.safe_path(root, source["path"])
        rows = archive.members(spark, path, archive.TEXT_MEMBERS)
        chosen = written(select.bottom_k(rows, k, seed, resolved["dataset_id"], F.col("member")), "selected")
        texts = archive.contents(chosen.select("selection_rank", "member"), path)
        ref = project.member_ref(F.lit(os.path.basename(path)), F.col("member"))
        return Scan(texts.select(F.col("selection_rank").alias("position"), "text", ref.alias("source_ref")), archive.directory_digest(path), {"members_eligible": rows.count(), "documents_selected": chosen.count()})


class ConversationArchive:
    """Threads of a ZIP archive, their participants numbered."""

    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan:
        source, _, _, seed, k = _ask(resolved)
        path = files.safe_path(root, source["archives_by_profile"][resolved["profile_name"]])
        rows = archive.members(spark, path, archive.THREAD_MEMBERS)
        chosen = written(select.bottom_k(rows, k, seed, resolved["dataset_id"], F.col("member")), "selected")
        messages = archive.thread_messages(archive.contents(chosen.select("member"), path))
        told = written(project.conversation_documents(messages, "member", "row", "user", "message"), "conversations")
        ref = F.concat(F.lit(resolved["dataset_id"] + ":"), F.col("conversation"))
        joined = told.join(chosen.select(F.col("member").alias("conversation"), "selection_rank"), "conversation").filter("text is not null")
        sums = told.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum("messages_kept"), F.lit(0)).alias("messages_kept"), F.count_if(F.col("text").isNull()).alias("empty")).first()
        return Scan(joined.select(F.col("selection_rank").alias("position"), "text", ref.alias("source_ref")), archive.record_digest(path), {"members_eligible": rows.count(), "documents_selected": chosen.count()} | sums.asDict())


class Dialogues:
    """Dialogues of JSON files, selected by a hash of file and place."""

    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan:
        source, kept, _, seed, k = _ask(resolved)
        folder = os.path.join(root, source["relative_directory"])
        turns = files.dialogues_json(spark, folder, source["expected_files"])
        ref = F.concat(F.lit(resolved["dataset_id"] + ":"), "file", F.lit(":"), F.col("dialogue_index").cast("string"))
        said = turns.withColumn("ref", ref).filter("turn_index is not null")
        told = written(project.dialogue_documents(said, "ref", "turn_index", "speaker", "utterance", kept["speaker_labels"]), "dialogues")
        chosen = select.bottom_k(told.filter("text is not null"), k, seed, resolved["dataset_id"], F.col("dialogue"))
        sums = told.agg(F.count(F.lit(1)).alias("dialogues"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("turns_kept"), F.lit(0)).alias("turns_kept"), F.count_if(F.col("text").isNull()).alias("empty")).first()
        names = sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".json"))
        return Scan(chosen.select(F.col("selection_rank").alias("position"), "text", F.col("dialogue").alias("source_ref")), files.files_digest(names), sums.asDict())


class ScoredRecords:
    """Records of Parquet shards in the order of a buffered shuffle: the first with a score and a text."""

    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan:
        source, kept, profile, seed, k = _ask(resolved)
        folder, name = os.path.split(source["shard_glob"])
        folder = os.path.join(root, source["path"], folder)
        rows = files.scored_parquet(spark, folder, source["expected_shards"], name, places=True)
        shards = sorted(os.path.basename(f) for f in rows.inputFiles())
        counts = {n: pq.ParquetFile(os.path.join(folder, n)).metadata.num_rows for n in shards}  # footers only
        most = profile["max_source_records"]
        order = select.buffered_shuffle(spark, counts, profile["shuffle_buffer_size"], seed, resolved["dataset_id"], most)
        seen = order.join(rows, ["shard", "row"]).withColumnRenamed("position", "stream_index")
        good = filters.score_filter(seen, "edu_int_score", kept["min_edu_int_score"])
        told = written(project.scored_documents(good, source["dataset_id"], source["revision"], source["config_name"], source["split"]), "scored")
        chosen = told.orderBy("stream_index").limit(k)
        whole = min(most, sum(counts.values()))
        found = chosen.agg(F.count(F.lit(1)).alias("n"), F.max("stream_index").alias("last")).first()
        records = found["last"] + 1 if found["n"] == k else whole
        capped = found["n"] < k and whole < sum(counts.values())
        return Scan(chosen.select(F.col("stream_index").alias("position"), "text", "source_ref"), files.files_digest([os.path.join(folder, n) for n in shards]), {"records_seen": records, "documents_selected": found["n"]}, capped)


class Pages:
    """Pages of a dump: filtered by reason, decoded, and selected as they come or by hash."""

    def scan(self, spark: SparkSession, root: str, resolved: dict) -> Scan:
        source, kept, profile, seed, k = _ask(resolved)
        path = files.safe_path(root, source["path"])
        rows = files.pages_tsv(spark, path, source["max_field_size_bytes"])
        marks = kept["page_filter"]
        rules = filters.PageRules(marks["search_title_markers"], marks["search_path_segments"], marks["listing_path_segments"], marks["search_query_parameters"], marks["search_query_value_markers"])
        native = F.coalesce(filters.first_reason(filters.page_reasons()), F.lit("passed"))
        judged = rows.drop("html").withColumn("reason", native)
        passed = judged.filter("reason = 'passed'").withColumn("page", rules.column(F.col("title"), F.col("url_final"), F.col("url")))
        passed = written(passed, "pages-passed")
        decoded = written(payload.decoded(passed.filter("page is null").withColumnRenamed("text", "payload"), "position", "payload", "text_md5", source["max_decompressed_text_bytes"]), "pages-decoded")
        pages = passed.drop("text", "reason").join(decoded.filter("reason is null").select("position", "text", "md5_match"), "position").withColumnRenamed("position", "row_number")
        keyed = project.page_keys(pages, seed)
        order = ["row_number"] if profile["selection"] == "engineering_prefix" else ["selection_score", "row_number"]
        chosen = written(keyed.orderBy(*order).limit(k), "pages-selected")
        counts = {f"rows_{r['reason']}": r["n"] for r in judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts |= {f"pages_{r['page']}": r["n"] for r in passed.filter("page is not null").groupBy("page").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts |= {f"texts_{r['reason'] or 'decoded'}": r["n"] for r in decoded.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts |= {"text_md5_mismatches": decoded.filter("not md5_match").count(), "documents_selected": chosen.count()}
        ref = F.concat(F.lit(project.PAGE_TAG + ":"), "record_key")
        return Scan(chosen.select(F.col("row_number").alias("position"), "text", ref.alias("source_ref"), F.col("domain_ref").alias("domain")), files.digest_of(files.sampled_guard(path, source["fingerprint_sample_bytes"])), counts)


ADAPTERS: dict[str, Adapter] = {"brwac": PlainArchive(), "adrenaline": ConversationArchive(), "outerspace": ConversationArchive(), "multiwoz_ptbr": Dialogues(), "gigaverbo": ScoredRecords(), "wackywacky": Pages()}


def register(dataset_id: str, adapter: Adapter) -> None:
    if not callable(getattr(adapter, "scan", None)):
        raise TypeError("an adapter needs scan()")
    ADAPTERS[dataset_id] = adapter


def adapter_of(dataset_id: str) -> Adapter:
    if dataset_id not in ADAPTERS:
        raise ValueError(f"no adapter for {dataset_id}")
    return ADAPTERS[dataset_id]
