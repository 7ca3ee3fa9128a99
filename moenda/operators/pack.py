"""Split by budget and packing into sequences of fixed length."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import stable_hash
from .dedup import running_sum

SEQUENCE = 1024


def split_by_budget(records: DataFrame, eval_sequences: int, seed: int = 42, length: int = SEQUENCE) -> DataFrame:
    """(dataset_id, source_hash, n) with split_score and split.

    In the order of the score a record is ``eval`` as long as the records before it hold
    fewer tokens than the evaluation budget.
    """
    scored = records.withColumn("split_score", stable_hash(seed, F.col("dataset_id"), "split", F.col("source_hash")))
    summed = running_sum(scored, ["dataset_id"], "split_score", "n", "before")
    return summed.withColumn("split", F.when(F.col("before") < eval_sequences * length, "eval").otherwise("train")).drop("before")


def placed(records: DataFrame, seed: int = 42) -> DataFrame:
    """Records with ``start``, their offset in the concatenation of their data set and split."""
    keyed = records.withColumn("pack_key", stable_hash(seed, F.col("dataset_id"), F.col("split"), F.col("source_hash")))
    return running_sum(keyed, ["dataset_id", "split"], "pack_key", "n", "start").drop("pack_key")


def pieces(records: DataFrame, length: int = SEQUENCE, limits: dict[str, int] | None = None) -> DataFrame:
    """A row for each record and sequence that share tokens: sequence, lo (offset in the
    concatenation), skip (tokens of the record before it) and count."""
    spread = records.withColumn("sequence", F.explode(F.expr(f"sequence(start div {length}, (start + n - 1) div {length})")))
    for split, limit in (limits or {}).items():
        spread = spread.filter((F.col("split") != split) | (F.col("sequence") < limit))
    lo = F.greatest(F.col("start"), F.col("sequence") * length)
    hi = F.least(F.col("start") + F.col("n"), (F.col("sequence") + 1) * length)
    return spread.withColumn("lo", lo).withColumn("skip", lo - F.col("start")).withColumn("count", hi - lo)


def sequences(parts: DataFrame, ids: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Full sequences: input_ids, source_ref_sha256 and source_token_counts in order.

    ``ids`` has (dataset_id, source_hash, input_ids); only slices of it meet the sequences.
    The unfilled tail is left out.
    """
    cut = F.slice("input_ids", (F.col("skip") + 1).cast("int"), F.col("count").cast("int"))
    held = parts.join(ids, ["dataset_id", "source_hash"]).select("dataset_id", "split", "sequence", F.struct("lo", "source_hash", cut.alias("ids")).alias("part"))
    rows = held.groupBy("dataset_id", "split", "sequence").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    rows = rows.select("dataset_id", "split", "sequence", F.flatten("parts.ids").alias("input_ids"), F.col("parts.source_hash").alias("source_ref_sha256"), F.transform("parts.ids", lambda x: F.size(x)).alias("source_token_counts"))
    return rows.filter(F.size("input_ids") == length)


def tails(records: DataFrame, length: int = SEQUENCE, limits: dict[str, int] | None = None) -> DataFrame:
    """(dataset_id, split, tokens, emitted, not_selected, tail) for each split."""
    sums = records.groupBy("dataset_id", "split").agg(F.sum("n").alias("tokens"))
    full = F.expr(f"tokens div {length}")
    for split, limit in (limits or {}).items():
        full = F.when(F.col("split") == split, F.least(full, F.lit(limit))).otherwise(full)
    return sums.withColumn("emitted", full).withColumn("not_selected", F.col("tokens") - F.col("emitted") * length).withColumn("tail", F.col("not_selected") % length)


def require_budget(tail_rows: DataFrame, limits: dict[str, int]) -> None:
    """Raises if a split has fewer sequences than asked for."""
    for row in tail_rows.collect():  # one row per data set and split
        if row["emitted"] < limits.get(row["split"], 0):
            raise ValueError(f"{row['dataset_id']} did not contain enough tokens for {limits[row['split']]} {row['split']} sequences")


def sequence_ids(rows: DataFrame) -> DataFrame:
    """Adds sequence_id: a hash of data set, split, number and the ids as little-endian
    int32, written as the Python literal of these bytes."""

    @F.pandas_udf(StringType())
    def ident(dataset: pd.Series, split: pd.Series, number: pd.Series, ids: pd.Series) -> pd.Series:
        made = (hashlib.sha256("\x1f".join((d, s, str(n), repr(np.asarray(x, "<i4").tobytes()))).encode()).hexdigest() for d, s, n, x in zip(dataset, split, number, ids))
        return pd.Series(list(made), dtype=object)

    return rows.withColumn("sequence_id", ident("dataset_id", "split", "sequence", "input_ids"))


def capacity(records: DataFrame, eval_sequences: int, length: int = SEQUENCE) -> DataFrame:
    """Sequences that a data set can give, with what is left over, per split."""
    rows = records.groupBy("dataset_id").agg(*(F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"{s}_tokens") for s in ("eval", "train")), F.count(F.lit(1)).alias("documents"))
    return rows.withColumns({"train_sequences": F.expr(f"train_tokens div {length}"), "train_rest": F.col("train_tokens") % length, "eval_reserved": F.expr(f"eval_tokens div {length}") >= eval_sequences})
