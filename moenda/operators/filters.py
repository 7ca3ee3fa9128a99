"""Filters that name the first reason, scores, short lines, search and listing pages."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import clean, normalized_paragraphs


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, null if none does; a null condition doesn't."""
    chain = None
    for name, condition in reasons:
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return chain.otherwise(F.lit(None).cast("string"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z", "")


def page_reasons(status: str = "status", text: str = "text", text_md5: str = "text_md5", same_as: str = "same_as") -> list[tuple[str, Column]]:
    def blank(name: str) -> Column:
        return F.col(name).isNull() | (stripped(F.col(name)) == "")

    return [
        ("filtered_status", F.coalesce(stripped(F.col(status)) != "done", F.lit(True))),
        ("filtered_missing_text", blank(text)),
        ("filtered_missing_text_md5", blank(text_md5)),
        ("filtered_same_as", ~F.coalesce(stripped(F.col(same_as)), F.lit("")).isin("", "NULL")),
    ]


def score_filter(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows whose score is a finite number of at least ``least``; a boolean is no score."""
    kind = dict(rows.dtypes)[score]
    if kind == "boolean":
        raise TypeError("a boolean column can't be a score")
    finite = F.col(score) >= least
    if kind in ("double", "float"):
        finite = finite & ~F.isnan(score) & (F.abs(F.col(score)) < F.lit(float("inf")))
    return rows.filter(finite)


def safe_label(label: Column) -> Column:
    """The label if it is a plain name of at most 128 characters, else null."""
    return F.when(label.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"), label)


def short_line_filter(rows: DataFrame, key: str, text: str, least: int = 40, min_after: int = 300, max_removed: float = 0.8) -> DataFrame:
    """Documents (key) without lines of less than ``least`` characters.

    Columns: text, lines, lines_removed, chars_before, chars_after, discarded_empty,
    discarded_short, discarded_fraction, kept.  The last reasons need a removed line; a
    document that no line was removed from is kept unless it is empty.
    """
    docs = rows.select(key, normalized_paragraphs(F.coalesce(F.col(text), F.lit(""))).alias("before"))
    docs = docs.withColumn("after", F.filter(F.transform("before", lambda p: F.filter(p, lambda x: F.length(x) >= least)), lambda p: F.size(p) > 0))

    def joined(paragraphs: str) -> Column:
        return F.array_join(F.transform(paragraphs, lambda p: F.array_join(p, "\n")), "\n\n")

    def count(paragraphs: str) -> Column:
        return F.size(F.flatten(paragraphs)).cast("bigint")

    docs = docs.select(key, joined("after").alias("text"), count("before").alias("lines"), (count("before") - count("after")).alias("lines_removed"), F.length(joined("before")).cast("bigint").alias("chars_before"), F.length(joined("after")).cast("bigint").alias("chars_after"))
    removed = F.col("lines_removed") > 0
    fraction = F.when(F.col("chars_before") > 0, (F.col("chars_before") - F.col("chars_after")) / F.col("chars_before")).otherwise(0.0)
    docs = docs.withColumns({"discarded_empty": F.col("chars_after") == 0, "discarded_short": removed & (F.col("chars_after") < min_after), "discarded_fraction": removed & (fraction > max_removed)})
    return docs.withColumn("kept", ~(F.col("discarded_empty") | F.col("discarded_short") | F.col("discarded_fraction")))


class PageRules:
    """Markers of search and listing pages, compared without case."""

    def __init__(self, titles=(), search_segments=(), listing_segments=(), query_keys=(), query_values=()):
        self.titles, self.search, self.listing = (frozenset(x.casefold() for x in v) for v in (titles, search_segments, listing_segments))
        self.keys, self.values = frozenset(x.casefold() for x in query_keys), tuple(x.casefold() for x in query_values)

    def _title(self, title: str | None) -> bool:
        text = " ".join((clean(title) or "").casefold().split())
        return any(text == m or (text.startswith(m) and text[len(m)] in " :-–—|") for m in self.titles)

    def _url(self, url: str | None) -> str | None:
        if not url:
            return None
        try:
            parts = urlsplit(url)
            pairs = parse_qsl(parts.query, keep_blank_values=True)
        except ValueError:
            return None
        segments = {unquote(s).strip().casefold() for s in parts.path.split("/") if s.strip()}
        if segments & self.listing:
            return "listing"
        if segments & self.search:
            return "search"
        for key, value in pairs:
            if unquote(key).strip().casefold() in self.keys or any(v in unquote(value).casefold() for v in self.values):
                return "search"
        return None

    def reason(self, title: str | None, url_final: str | None, url: str | None) -> str | None:
        """search, listing or None: the title first, then the final url, then the first one."""
        if self._title(title):
            return "search"
        return self._url(url_final) or self._url(url)

    def column(self, title: Column, url_final: Column, url: Column) -> Column:
        rules = self

        @F.pandas_udf(StringType())
        def reasons(t: pd.Series, f: pd.Series, u: pd.Series) -> pd.Series:
            return pd.Series([rules.reason(*x) for x in zip(t, f, u)], dtype=object)

        return reasons(title, url_final, url)
