"""Exact boilerplate: paragraphs repeated across domains, line blocks within one.

A paragraph is boilerplate if it has at least ``paragraph_chars`` characters and enough
distinct documents of enough distinct domains hold it.  A block is ``window``
successive lines of a document (across paragraph borders) of at least ``block_chars``
characters together that enough distinct documents of its domain hold.  Removed are
whole such paragraphs and every line of such blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..functions.text import normalized_paragraphs
from ..runtime import written
from .skew import join_counted

# What the hashes of paragraphs and blocks begin with.
PARAGRAPH_TAG, BLOCK_TAG = "wackywacky-cross-domain-paragraph-v2", "wackywacky-within-domain-block-v2"


@dataclass(frozen=True)
class Rules:
    paragraph_chars: int = 80
    paragraph_documents: int = 5
    paragraph_domains: int = 3
    window: int = 3
    block_chars: int = 60
    block_documents: int = 5
    min_after: int = 300
    max_removed: float = 0.8


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, domain, para_no, line_no, line, paragraph): every line with its hashed paragraph."""
    paragraphs = docs.select("doc", "domain", normalized_paragraphs(F.coalesce(F.col("text"), F.lit(""))).alias("p"))
    paragraphs = paragraphs.select("doc", "domain", F.posexplode(F.transform("p", lambda x: F.struct(x.alias("lines"), F.array_join(x, " ").alias("text")))).alias("para_no", "p"))
    lines = paragraphs.select("doc", "domain", "para_no", stable_hash(PARAGRAPH_TAG, F.col("p.text")).alias("paragraph"), F.length("p.text").alias("para_chars"), F.posexplode("p.lines").alias("in_para", "line"))
    return lines


def blocks_of(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc, domain, first, block): windows of lines that are long enough, hashed."""
    flat = docs.select("doc", "domain", F.flatten(normalized_paragraphs(F.coalesce(F.col("text"), F.lit("")))).alias("l"))
    w = rules.window
    windows = F.transform(F.sequence(F.lit(0), F.size("l") - w), lambda i: F.struct(i.alias("first"), F.slice("l", i + 1, w).alias("lines")))
    rows = flat.filter(F.size("l") >= w).select("doc", "domain", F.explode(windows).alias("b"))
    chars = F.aggregate("b.lines", F.lit(0), lambda a, x: a + F.length(x))
    return rows.filter(chars >= rules.block_chars).select("doc", "domain", F.col("b.first").cast("bigint").alias("first"), stable_hash(BLOCK_TAG, F.array_join("b.lines", "\n")).alias("block"))


def repeated_paragraphs(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(paragraph, documents, domains, occurrences).

    Occurrences count repeats within a document; documents and domains don't.  Counted
    from distinct (paragraph, domain, document) rows, so that a paragraph that any share
    of the documents holds is spread over tasks.
    """
    one = lines_of(docs).filter((F.col("in_para") == 0) & (F.col("para_chars") >= rules.paragraph_chars))
    by_doc = one.groupBy("paragraph", "domain", "doc").agg(F.count(F.lit(1)).alias("n"))
    by_domain = by_doc.groupBy("paragraph", "domain").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    found = by_domain.groupBy("paragraph").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("domains"), F.sum("n").alias("occurrences"))
    return found.filter((F.col("documents") >= rules.paragraph_documents) & (F.col("domains") >= rules.paragraph_domains))


def repeated_blocks(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(domain, block, documents, occurrences)."""
    by_doc = blocks_of(docs, rules).groupBy("domain", "block", "doc").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("domain", "block").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).filter(F.col("documents") >= rules.block_documents)


def _total(counted: DataFrame) -> int:
    return counted.agg(F.sum("occurrences")).first()[0] or 0


def removed(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc, text, chars_before, chars_after, lines_removed, kept) of every document (doc, domain, text).

    A document is dropped if it lost something and what is left is too short or too
    small a part; one that loses every line has an empty text.  ``doc`` must be unique.
    """
    flat = docs.select("doc", "domain", normalized_paragraphs(F.coalesce(F.col("text"), F.lit(""))).alias("p"))
    spread = F.xxhash64("doc")
    paragraphs = written(repeated_paragraphs(docs, rules).select("paragraph", "occurrences", F.lit(True).alias("found")), "repeated-paragraphs")
    first_lines = lines_of(docs).filter(F.col("in_para") == 0).select("doc", "para_no", "paragraph")
    hits = join_counted(first_lines, paragraphs, ["paragraph"], ["found"], spread, _total(paragraphs), "occurrences").groupBy("doc").agg(F.collect_set("para_no").alias("bad_paras"))
    # a block's key is one of its own and its domain's, so that hot ones are spread by one value
    keyed = F.xxhash64("domain", "block")
    repeated = written(repeated_blocks(docs, rules).select("domain", "block", "occurrences", F.lit(True).alias("found"), keyed.alias("key")), "repeated-blocks")
    own = blocks_of(docs, rules).withColumn("key", keyed)
    repeated = repeated.groupBy("key").agg(F.sum("occurrences").alias("occurrences"), F.collect_set(F.struct("domain", "block")).alias("are"))
    blocks = join_counted(own, repeated, ["key"], ["are"], spread, _total(repeated), "occurrences").filter(F.array_contains("are", F.struct("domain", "block")))
    firsts = blocks.groupBy("doc").agg(F.collect_set("first").alias("firsts"))
    both = flat.join(hits, "doc", "left").join(firsts, "doc", "left")
    # line numbers of a paragraph start at the number of lines before it
    starts = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.aggregate(F.slice("p", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)))
    bad_lines = F.array_distinct(F.flatten(F.transform(F.coalesce("firsts", F.array().cast("array<bigint>")), lambda f: F.sequence(f, f + rules.window - 1))))
    both = both.withColumn("starts", F.when(F.size("p") > 0, starts).otherwise(F.array().cast("array<bigint>"))).withColumn("bad_lines", bad_lines).withColumn("bad_paras", F.coalesce("bad_paras", F.array().cast("array<int>")))

    def kept_lines(p, i):
        left = F.filter(p, lambda x, k: ~F.array_contains("bad_lines", F.element_at("starts", i + 1) + k))
        return F.when(F.array_contains("bad_paras", i), F.array().cast("array<string>")).otherwise(left)

    both = both.withColumn("q", F.transform("p", kept_lines))

    def joined(name: str):
        return F.array_join(F.filter(F.transform(name, lambda x: F.array_join(x, "\n")), lambda x: x != ""), "\n\n")

    out = both.select("doc", joined("q").alias("text"), F.length(joined("p")).cast("bigint").alias("chars_before"), F.length(joined("q")).cast("bigint").alias("chars_after"), (F.size(F.flatten("p")) - F.size(F.flatten("q"))).cast("bigint").alias("lines_removed"))
    lost = F.col("lines_removed") > 0
    share = F.when(F.col("chars_before") > 0, (F.col("chars_before") - F.col("chars_after")) / F.col("chars_before")).otherwise(0.0)
    return out.withColumn("kept", ~(lost & ((F.col("chars_after") < rules.min_after) | (share > rules.max_removed))))


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of totals."""
    p = repeated_paragraphs(docs, rules).agg(F.count(F.lit(1)).alias("paragraphs"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("paragraph_occurrences"))
    b = repeated_blocks(docs, rules).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("block_occurrences"))
    r = removed(docs, rules).agg(F.count(F.lit(1)).alias("documents"), F.count_if("kept").alias("documents_kept"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed"))
    return p.join(b).join(r)  # one row each
