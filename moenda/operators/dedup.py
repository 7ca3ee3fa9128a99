"""Exact duplicates and unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, within: list[str], content: Column, order: str) -> DataFrame:
    """Of rows with the same content within the given columns, the first one in order.

    The first is found as a minimum with map-side combining, so a content that any
    share of the rows hold is no hot partition; rows then prove to be it by content and
    place in the order.  Rows of the same content and place are kept once; rows without a place or
    with null content are of no order and left out.
    """
    keyed = rows.withColumn("_content", F.sha2(content, 256))
    firsts = keyed.groupBy(*within, "_content").agg(F.min(order).alias(order))
    return keyed.join(firsts, [*within, "_content", order], "left_semi").dropDuplicates([*within, "_content", order]).drop("_content")


def duplicates_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, key: list[str], what: str) -> None:
    if found := duplicates_of(rows, key).limit(1).collect():
        raise ValueError(f"{what} is not unique: {found[0].asDict()}")


def running_sum(rows: DataFrame, within: list[str], hashed: str, value: str, name: str) -> DataFrame:
    """Exclusive running sums in the order of a column of SHA-256 hex digests.

    Digests are uniform, so their first digits cut the order into even parts: sums of
    the parts are added up first (a small table), then rows within their part.  No
    task sorts more than a part, whatever the number of rows.
    """
    part = F.substring(hashed, 1, 3)
    sums = rows.groupBy(*within, part.alias("_part")).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_sum")
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*within, "_part").orderBy(hashed).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_part", part).withColumn("_inner", inner).join(sums, [*within, "_part"]).withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")
