"""The library's operators as queries over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import stable_hash
from ..operators import boilerplate, dedup, filters, pack, project, schedule, select, validate
from ..runtime import spread, table, written
from ..sources import payload

SEED, EVAL_SEQUENCES = 42, 8
#: Event types stand in for speakers, users for dialogues, rooms of events for conversations.
DIALOGUE_SPEAKERS = {"click": "Clique", "view": "Vista", "purchase": "Compra", "signup": "Cadastro", "error": "Erro"}


def hash_bottom_k(spark: SparkSession, d: str) -> DataFrame:
    chosen = select.bottom_k(table(spark, d, "documents").select("doc_id", "source_ref"), 128, SEED, "documents", F.col("source_ref"))
    return chosen.select("doc_id", "selection_score", "selection_rank")


def reservoir(spark: SparkSession, d: str) -> DataFrame:
    pages = project.page_keys(table(spark, d, "wackywacky").filter("text is not null"))
    return pages.orderBy("selection_score", "row_number").limit(128).select("row_number", "record_key", "selection_score", "domain_ref")


def prefix_k(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = select.prefix_k(table(spark, d, "gigaverbo").select("stream_index", "edu_int_score"), 100, "stream_index", F.col("edu_int_score") >= 4)
    return chosen


def prefix_metrics(spark: SparkSession, d: str) -> DataFrame:
    good = F.coalesce(F.col("edu_int_score") >= 4, F.lit(False))
    chosen, seen = select.prefix_k(table(spark, d, "gigaverbo").select("stream_index", "edu_int_score"), 100, "stream_index", good)
    return seen.agg(F.count(F.lit(1)).alias("records_seen"), F.count_if(~good).alias("records_filtered_score"), F.max("stream_index").alias("last_index"))


def capped_prefix(spark: SparkSession, d: str) -> DataFrame:
    return select.capped_prefix(table(spark, d, "gigaverbo").select("stream_index", "edu_int_score"), "stream_index", 400, 50, F.col("edu_int_score") >= 3)


def skip_n(spark: SparkSession, d: str) -> DataFrame:
    return select.skip(table(spark, d, "gigaverbo").select("stream_index", "source"), "stream_index", 25)


def score_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.score_filter(table(spark, d, "gigaverbo"), "edu_int_score", 4).select("stream_index", "edu_int_score")


def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(filters.first_reason(filters.page_reasons()), F.lit("eligible"))
    return table(spark, d, "wackywacky").select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Markers of search and listing pages.
PAGE_MARKERS = {
    "titles": ["resultados da pesquisa", "resultados de pesquisa", "resultados da busca", "resultados de busca", "search results", "ficha"],
    "query_keys": ["search", "utm_source"], "query_values": ["especial:pesquisar", "special:search"], "search_segments": ["search", "busca", "buscar", "pesquisa", "pesquisar"],
    "listing_segments": ["tag", "tags", "category", "categories", "categoria", "categorias", "archive", "archives", "arquivo", "arquivos"],
}


def page_filter_url(spark: SparkSession, d: str) -> DataFrame:
    """The markers and, so that some rows of the tables meet them, a title and a key that these hold."""
    rules = filters.PageRules(**PAGE_MARKERS)
    pages = spread(table(spark, d, "wackywacky").select("row_number", "title", "url_final", "url"))
    return pages.select("row_number", F.coalesce(rules.column(F.col("title"), F.col("url_final"), F.col("url")), F.lit("kept")).alias("page"))


def page_decode(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "wackywacky").select("row_number", "text", "text_md5")).select("row_number", "text_md5", payload.encoded(F.col("text")).alias("payload"))
    return payload.decoded(pages, "row_number", "payload", "text_md5").select("row_number", F.md5("text").alias("decoded_md5"), "reason", "md5_match")


def clean_plain(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).select("doc_id", tx.cleaned(F.col("text")).alias("text"))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))


def detokenize(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(tx.cleaned(F.col("text"), policy="detokenize_brwac_v1")).alias("text_md5"))


def clean_html(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "wackywacky")).select("row_number", tx.cleaned(F.col("html")).alias("text"))
    return rows.select("row_number", F.md5("text").alias("text_md5"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))


def clean_scored(spark: SparkSession, d: str) -> DataFrame:
    """Two passes, as scored records get before they are tokenized."""
    return spread(table(spark, d, "gigaverbo")).select("stream_index", F.md5(tx.cleaned(F.col("text"), passes=2)).alias("text_md5"))


def normalize_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = tx.normalized_paragraphs(F.col("text"))
    rows = spread(table(spark, d, "documents")).filter("text is not null").select("doc_id", tx.cleaned(F.col("text")).alias("text"))
    return rows.select("doc_id", F.size(p).cast("bigint").alias("paragraphs"), F.size(F.flatten(p)).cast("bigint").alias("lines"), F.md5(F.array_join(F.transform(p, lambda x: F.array_join(x, "\n")), "\n\n")).alias("text_md5"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts that aren't empty; written, so that no filter runs the cleaning again."""
    rows = spread(table(spark, d, "documents")).select("doc_id", F.coalesce("dataset_id", F.lit("unknown")).alias("dataset_id"), F.sha2("source_ref", 256).alias("source_hash"), tx.cleaned(F.col("text")).alias("text"))
    return written(rows, "clean").filter("text <> ''")


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_clean(spark, d), ["dataset_id"], F.col("text"), "doc_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _records_of(_survivors(spark, d))


def _records_of(kept: DataFrame) -> DataFrame:
    """The narrow rows that are split and placed; texts and ids stay out of the running sums."""
    return written(kept.select("dataset_id", "source_hash", tx.codepoint_count(F.col("text")).alias("n")), "records")


def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).filter(F.length("text") >= 200).select("doc_id")


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("doc_id", "dataset_id")


def dedup_metrics(spark: SparkSession, d: str) -> DataFrame:
    received = table(spark, d, "documents").groupBy(F.coalesce("dataset_id", F.lit("unknown")).alias("dataset_id")).agg(F.count(F.lit(1)).alias("received"))
    clean = _clean(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("nonempty"))
    kept = _records(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("tokenized"), F.sum("n").alias("tokens"))
    rows = received.join(clean, "dataset_id", "left").join(kept, "dataset_id", "left").na.fill(0)
    return rows.select("dataset_id", "received", (F.col("received") - F.col("nonempty")).alias("empty_or_short"), (F.col("nonempty") - F.col("tokenized")).alias("duplicates"), "tokenized", "tokens")


def duplicate_source_check(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates_of(table(spark, d, "documents"), ["source_ref"]).agg(F.count(F.lit(1)).alias("duplicates"))


def tokenize_codepoint(spark: SparkSession, d: str) -> DataFrame:
    ids = tx.codepoint_ids(F.col("text"))
    return _clean(spark, d).select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


def _split_of(records: DataFrame) -> DataFrame:
    return written(pack.split_by_budget(records, EVAL_SEQUENCES, SEED), "split")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return _split_of(_records(spark, d))


def split_eval_train(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("dataset_id", "source_hash", "split_score", "split", "n")


def _pieces(split_rows: DataFrame, split: str) -> DataFrame:
    return pack.pieces(pack.placed(split_rows, SEED).filter(F.col("split") == split), limits={"eval": EVAL_SEQUENCES})


def _packed(spark: SparkSession, d: str, split: str) -> DataFrame:
    kept = written(_survivors(spark, d), "kept")
    ids = kept.select("dataset_id", "source_hash", tx.codepoint_ids(F.col("text")).alias("input_ids"))
    rows = pack.sequences(_pieces(_split_of(_records_of(kept)), split), ids)
    return rows.select("dataset_id", "split", "sequence", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.array_join("source_ref_sha256", ",").alias("sources"), F.array_join("source_token_counts", ",").alias("counts"))


def pack_train(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "train")


def pack_eval(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "eval")


def pack_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(_split(spark, d), "train").select("dataset_id", "source_hash", "sequence", "skip", "count")


def pack_tails(spark: SparkSession, d: str) -> DataFrame:
    return pack.tails(_split(spark, d), limits={"eval": EVAL_SEQUENCES})


def capacity_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.capacity(_split(spark, d), EVAL_SEQUENCES)


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_document").groupBy("source_ref_sha256").agg(F.count_distinct("split").alias("splits"))
    return rows.agg(F.count_if(F.col("splits") > 1).alias("leaked"), F.count(F.lit(1)).alias("sources"))


def short_line_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.short_line_filter(_clean(spark, d), "doc_id", "text")
    return rows.select("doc_id", "lines", "lines_removed", "chars_before", "chars_after", "kept", F.md5("text").alias("text_md5"))


def short_line_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.short_line_filter(_clean(spark, d), "doc_id", "text")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"), F.sum("lines_removed").alias("lines_removed"), F.count_if("discarded_empty").alias("empty"), F.count_if("discarded_short").alias("short"), F.count_if("discarded_fraction").alias("fraction"), F.count_if("kept").alias("kept"))


RULES = boilerplate.Rules(paragraph_chars=40)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(table(spark, d, "wackywacky").select("row_number", "domain_id", "text").filter("text is not null"))
    return written(pages.select(F.col("row_number").alias("doc"), F.coalesce("domain_id", F.lit("")).alias("domain"), tx.cleaned(F.col("text")).alias("text")), "pages-clean")


def cross_domain_repeats(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_paragraphs(_pages(spark, d), RULES)


def within_domain_blocks(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_blocks(_pages(spark, d), RULES)


def boilerplate_removed(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.removed(_pages(spark, d), RULES).select("doc", F.md5("text").alias("text_md5"), "chars_before", "chars_after", "lines_removed", "kept")


def boilerplate_report(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.report(_pages(spark, d), RULES)


def dialogue_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = project.dialogue_documents(table(spark, d, "events"), "user_id", "event_id", "event_type", "props", DIALOGUE_SPEAKERS)
    return rows.select("dialogue", F.md5("text").alias("text_md5"), "turns", "turns_kept")


def anonymize_participants(spark: SparkSession, d: str) -> DataFrame:
    rows = project.conversation_documents(table(spark, d, "events").withColumn("room", F.col("event_id") % 97), "room", "event_id", "user_id", "props")
    return rows.select("conversation", F.md5("text").alias("text_md5"), "messages", "messages_kept", "participants")


def participant_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy((F.col("event_id") % 97).alias("conversation")).agg(F.count_distinct("user_id").alias("participants"), F.count(F.lit(1)).alias("messages"))


def scored_projection(spark: SparkSession, d: str) -> DataFrame:
    good = filters.score_filter(table(spark, d, "gigaverbo"), "edu_int_score", 4)
    rows = project.scored_documents(good, "gigaverbo", "main", "default", "train")
    return rows.select("stream_index", F.md5("text").alias("text_md5"), "source_ref", "source", "subset")


def safe_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gigaverbo").select("stream_index", filters.safe_label(F.col("source")).alias("source"), filters.safe_label(F.col("subset")).alias("subset"))


def member_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(project.member_ref(F.lit("corpus.zip"), F.col("source_ref")), 256).alias("ref"))


def sequence_id_unique(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates_of(table(spark, d, "packed_sequence"), ["sequence_id"]).select("sequence_id", "n")


def packed_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_checks(table(spark, d, "packed_sequence"))


def inspection_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(table(spark, d, "packed_sequence"))


def split_sources_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return validate.shared_sources(table(spark, d, "packed_sequence"))


def _sequence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packed_sequence").filter("split = 'train'").groupBy("dataset_id").agg(F.count_distinct("sequence_id").alias("rows"))


def waterfill(spark: SparkSession, d: str) -> DataFrame:
    have = {r["dataset_id"]: r["rows"] for r in _sequence_counts(spark, d).orderBy("dataset_id").collect()}  # a row per data set
    target = sum(have.values()) // 2
    return spark.createDataFrame([(k, have[k], v) for k, v in schedule.waterfill(have, target).items()], "dataset_id string, capacity bigint, allocated bigint")


def proportional_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.proportional(_sequence_counts(spark, d), SEED)


def balanced_schedule(spark: SparkSession, d: str) -> DataFrame:
    have = _sequence_counts(spark, d)
    return schedule.balanced(have.select("dataset_id", F.least("rows", have.agg(F.min("rows")).scalar()).alias("rows")), SEED)


def schedule_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Stored training sequences in the order of a proportional schedule; rows of a data set are in the order of their ids."""
    rows = table(spark, d, "packed_sequence").filter("split = 'train'").select("dataset_id", "sequence_id", "input_ids").dropDuplicates(["dataset_id", "sequence_id"])
    held = dedup.running_sum(rows.select("dataset_id", "sequence_id", F.lit(1).alias("n")), ["dataset_id"], "sequence_id", "n", "row_index").join(rows, ["dataset_id", "sequence_id"])
    found = schedule.scheduled_sequences(schedule.proportional(_sequence_counts(spark, d), SEED), held.select("dataset_id", "row_index", "sequence_id", "input_ids"))
    return found.select("position", "dataset_id", "sequence_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("dataset_id"), "event_id")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d)
    return schedule.steps_and_ranks(rows, 8, 2, rows.count() // 8)


def step_rank_batches(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("position", "step", "rank")


def batch_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).groupBy("step", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


def eval_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = schedule.eval_rank(table(spark, d, "events").withColumn("row_index", F.col("event_id")), 4)
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def eval_macro_perplexity(spark: SparkSession, d: str) -> DataFrame:
    losses = table(spark, d, "events").select(F.col("event_type").alias("dataset_id"), (F.abs("value") / 100).alias("loss"))
    rows = schedule.macro_losses(losses)
    return rows.select(F.coalesce("dataset_id", F.lit("macro")).alias("dataset_id"), "sequences", F.round("loss", 6).alias("loss"), F.round("perplexity", 3).alias("perplexity"))


def row_range_lookup(spark: SparkSession, d: str) -> DataFrame:
    shards = table(spark, d, "events").groupBy(F.lit("all").alias("dataset_id"), F.expr("event_id div 1000").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
    asked = table(spark, d, "events").select(F.lit("all").alias("dataset_id"), F.col("event_id").alias("row_index"))
    return schedule.rows_at(asked, shards).select("row_index", "shard", "row_in_shard")


def buffered_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The order of a buffered shuffle depends on row counts alone: simulated on (file, row) references."""
    files = table(spark, d, "gigaverbo").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()  # a row per file
    order = select.buffered_shuffle(spark, {r["file"]: r["n"] for r in files}, 64, SEED, "gigaverbo")
    return order.select("position", "row")


def rank_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _steps(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id").withColumn("bad", F.col("dataset_id") == "error")
    return schedule.reduced_ranks(rows.groupBy("step", "rank").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"), F.bool_or("bad").alias("bad")), ["step"], ["n"], ["highest"], ["bad"])


def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", stable_hash(SEED, F.col("source"), F.col("lang"), F.col("doc_id")).alias("h"))


ALL = [
    hash_bottom_k, reservoir, prefix_k, prefix_metrics, capped_prefix, skip_n, score_filter, reject_reason_counts, page_filter_url, page_decode, clean_plain, detokenize, clean_html, clean_scored,
    normalize_paragraphs, min_length_filter, exact_dedup, dedup_metrics, duplicate_source_check, tokenize_codepoint, token_totals, split_eval_train, pack_train, pack_eval,
    pack_provenance, pack_tails, capacity_report, split_leakage, short_line_filter, short_line_metrics, cross_domain_repeats, within_domain_blocks, boilerplate_removed,
    boilerplate_report, dialogue_projection, anonymize_participants, participant_counts, scored_projection, safe_label, member_refs, sequence_id_unique, packed_validation,
    inspection_summary, split_sources_disjoint, waterfill, proportional_schedule, balanced_schedule, schedule_sequences, rank_totals, step_rank_batches, batch_dataset_counts, eval_ranks, eval_macro_perplexity,
    row_range_lookup, buffered_shuffle, stable_hashes,
]
