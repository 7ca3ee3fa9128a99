"""Lines that come back on page after page of one source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..runtime import spread, written


def keyed_lines(pages: DataFrame, row: str, document: str, source: str, text: str) -> DataFrame:
    """One row per line that holds a letter: its number, and hashes of its source,
    of its letters in lower case, and of its document.

    Rows without source or text have no lines; a null document counts as one
    document of that source.
    """
    held = spread(pages.select(row, document, source, text).filter(F.col(source).isNotNull() & F.col(text).isNotNull()))
    lines = held.select(
        F.col(row).alias("row_number"), F.xxhash64(source).alias("s"), F.xxhash64(document).alias("d"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    letters = lines.select("row_number", F.col("line_no").cast("bigint").alias("line_no"), "s", "d", F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "").alias("letters"))
    return letters.filter(F.col("letters") != "").select("row_number", "line_no", "s", "d", F.xxhash64("letters").alias("k"))


def repeated_lines(pages: DataFrame, row: str = "row_number", document: str = "id", source: str = "domain_id", text: str = "text", min_documents: int = 5, min_share: float = 0.0) -> DataFrame:
    """(row_number, line_no) of every line that at least ``min_documents`` different
    documents of its source hold, and at least the share ``min_share`` of them.

    Lines are the same if their letters are, letter case ignored.  Each occurrence is
    a row, repeats within a page too.  The counts are made of distinct (source, line,
    document) triples, which no single source or line can crowd, and joined back by
    ``join_counted``.  An empty table gives no rows.
    """
    lines = keyed_lines(pages, row, document, source, text)
    holders = lines.select("s", "k", "d").distinct()
    counted = holders.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents)
    if min_share > 0:
        sizes = holders.select("s", "d").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("all"))
        counted = counted.join(sizes, "s").filter(F.col("n") >= min_share * F.col("all")).drop("all")
    counted = written(counted, "repeated-lines")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = join_counted(lines.drop("d"), counted, ["s", "k"], ["n"], F.xxhash64("row_number", "line_no"), total)
    return found.select("row_number", "line_no")


def without_lines(pages: DataFrame, doomed: DataFrame, row: str = "row_number", text: str = "text") -> DataFrame:
    """(row_number, text, removed): the pages without the listed lines.

    A page without listed lines keeps its text, null stays null, and a page that
    loses every line becomes empty.
    """
    by_page = doomed.groupBy(F.col("row_number").alias("_row")).agg(F.collect_list("line_no").alias("_lines"))
    joined = pages.select(F.col(row).alias("row_number"), F.col(text).alias("text")).join(by_page, F.col("row_number") == F.col("_row"), "left").select("row_number", "text", "_lines")

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for value, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if value is not None and lines:
                    out = set(lines)
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in out)
                texts.append(value)
                removed.append(len(lines or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row_number", "text", "removed"])

    return joined.mapInArrow(run, "row_number bigint, text string, removed bigint")
