"""Checks and content-free summaries of packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pack import SEQUENCE


def row_checks(rows: DataFrame, length: int = SEQUENCE, vocabulary: int | None = None) -> DataFrame:
    """One row: how many sequences there are and how many break each rule."""
    ids, counts, refs = F.col("input_ids"), F.col("source_token_counts"), F.col("source_ref_sha256")
    bad_id = F.exists(ids, lambda x: x.isNull() | (x < 0) | (x >= F.lit(vocabulary if vocabulary is not None else 2**31 - 1)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col("sequence_id").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))).alias("bad_sequence_id"),
        F.count_if(F.coalesce(F.size(ids) != length, F.lit(True))).alias("bad_length"),
        F.count_if(bad_id).alias("bad_ids"),
        F.count_if(F.coalesce((F.size(counts) != F.size(refs)) | (F.size(counts) < 1), F.lit(True))).alias("bad_provenance"),
        F.count_if(F.exists(counts, lambda x: x < 1) | (F.aggregate(counts, F.lit(0), lambda a, x: a + x) != length)).alias("bad_counts"),
        (F.count(F.lit(1)) - F.count_distinct("sequence_id")).alias("surplus_ids"),
    )


def require_valid(rows: DataFrame, length: int = SEQUENCE) -> None:
    found = row_checks(rows, length).first().asDict()
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if broken or not found["rows"]:
        raise ValueError(f"invalid sequences: {broken or 'no rows'}")


def shared_sources(rows: DataFrame) -> DataFrame:
    """Sources that sequences of several splits hold (there must be none)."""
    each = rows.select("split", F.explode("source_ref_sha256").alias("source")).distinct()
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("splits")).filter("splits > 1")


def summary(rows: DataFrame) -> DataFrame:
    """Per data set and split: rows, tokens, fewest and most sources of a sequence, sources."""
    per = rows.groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("input_ids")).alias("tokens"), F.min(F.size("source_ref_sha256")).cast("bigint").alias("fewest"), F.max(F.size("source_ref_sha256")).cast("bigint").alias("most"))
    sources = rows.select("dataset_id", "split", F.explode("source_ref_sha256").alias("source")).distinct().groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("sources"))
    return per.join(sources, ["dataset_id", "split"])
