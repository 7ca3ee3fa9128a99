"""Encoding of texts with a public tokenizer, and token budgets.

Null and empty texts have the ids ``[]`` and 0 tokens.  Very long texts are encoded
whole; their time is in proportion to their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..runtime import spread
from . import bpe, labels


def _only(df: DataFrame, keep: list[str], made: list[str]) -> list[str]:
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} would occur twice; rename them first")
    return keep


def encode_texts(df: DataFrame, text: str, keep: list[str], ids: str = "ids", tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """The columns ``keep`` and the ids of each text, without special tokens.

    Each Python worker loads the tokenizer once; a batch of texts becomes one array
    of ids with offsets.  Rows keep their order and number, repeated rows stay; an
    empty table gives an empty one.  Other columns, whatever their names, are not
    read; a kept column named like ``ids`` is an error.
    """
    rows = spread(df.select(*_only(df, keep, [ids]), F.col(text).alias("_text")))
    schema = StructType([*rows.select(*keep).schema, StructField(ids, ArrayType(IntegerType()))])

    def run(batches):
        own = bpe.load(tokenizer, directory)
        for batch in batches:
            packed = [own.encode_packed(t) if t else b"" for t in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *(len(p) >> 2 for p in packed)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, ids])

    return rows.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], tokens: str = "tokens", tokenizer: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """As ``encode_texts``, with the number of tokens (bigint) in place of the ids."""
    rows = spread(df.select(*_only(df, keep, [tokens]), F.col(text).alias("_text")))
    schema = StructType([*rows.select(*keep).schema, StructField(tokens, LongType())])

    def run(batches):
        own = bpe.load(tokenizer, directory)
        for batch in batches:
            n = np.fromiter((own.count(t) if t else 0 for t in batch.column(len(keep)).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n)], names=[*keep, tokens])

    return rows.mapInArrow(run, schema)


def observed_lengths(tokenized: DataFrame) -> DataFrame:
    """Ids per record of ``tokenized_document``; a record written twice counts once."""
    sizes = tokenized.filter(F.col("source_ref_sha256").isNotNull()).select("source_ref_sha256", F.coalesce(F.size("input_ids"), F.lit(0)).cast("bigint").alias("observed"))
    return sizes.groupBy("source_ref_sha256").agg(F.max("observed").alias("observed"))


def named_slices(df: DataFrame, corpus: str, source: Column, language: Column, domain: Column, *more: str) -> DataFrame:
    return df.select(F.lit(corpus).alias("corpus"), labels.source(source).alias("source"), labels.language(language).alias("language"), labels.domain(domain).alias("domain"), *more)


def budget_cube(slices: DataFrame, dimensions: list[str], measures: list[str]) -> DataFrame:
    """Sums over every subset of the dimensions.

    The measures are added up by all dimensions first, with map-side combining, so the
    cube expands slices and not documents.  A dimension that a row sums over is
    null and has its bit set in ``level`` (the last dimension is bit 0); the
    dimensions themselves must hold no nulls.
    """
    base = slices.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("documents"), *(F.sum(m).alias(m) for m in measures))
    cube = base.cube(*dimensions).agg(F.grouping_id().cast("int").alias("level"), F.sum("documents").alias("documents"), *(F.sum(m).alias(m) for m in measures))
    return cube.select("level", *dimensions, "documents", *measures)
