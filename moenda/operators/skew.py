"""Joining rows with a table of counted keys when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows; so there are fewer than HOT_KEYS.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], payload: list[str], spread: Column, total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has each key once.

    ``counted[count]`` is how often a key occurs (in rows or in anything of which a
    key has no more than rows) and ``total`` the sum of these, so fewer than
    ``HOT_KEYS`` keys can hold more than ``total / HOT_KEYS`` each.  Those are broadcast, a
    number of rows that does not grow with the data; all other keys are joined by a
    shuffle in which the rows of hot keys take part under ``spread``, a value that
    differs from row to row, and so fill no partition.  Keys must be hashes (numbers or hex) or names that no
    number equals, and not null; ``payload`` are columns of ``counted``.
    """
    hot_count = F.lit(max(total // HOT_KEYS, 1))
    hot = counted.filter(F.col(count) > hot_count).select(*keys, F.struct(*payload).alias("_hot"))
    cold = counted.filter(F.col(count) <= hot_count).select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*payload).alias("_cold"))
    marked, kinds = rows.join(F.broadcast(hot), keys, "left"), dict(rows.dtypes)
    for k in keys:
        marked = marked.withColumn(f"_at_{k}", F.when(F.col("_hot").isNotNull(), spread.cast(kinds[k])).otherwise(F.col(k)))
    condition = None
    for k in keys:
        part = F.col(f"_at_{k}") == F.col(f"_{k}")
        condition = part if condition is None else condition & part
    found = marked.join(cold, condition, "left").withColumn("_found", F.coalesce("_hot", "_cold")).filter(F.col("_found").isNotNull())
    return found.select(*rows.columns, *(F.col(f"_found.{p}").alias(p) for p in payload))
