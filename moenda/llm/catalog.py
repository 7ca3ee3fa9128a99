"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, written
from . import abuse, binpack, labels, lines, mix, overlap, pages, records, tokens


def _document_counts(spark: SparkSession, d: str) -> DataFrame:
    documents, gigaverbo = table(spark, d, "documents"), table(spark, d, "gigaverbo")
    own = tokens.count_tokens(documents.withColumn("ref", F.sha2("source_ref", 256)), "text", ["doc_id", "ref", "source", "lang", "web_domain"])
    other = tokens.count_tokens(gigaverbo, "text", ["stream_index", "source", "lang", "web_domain"])
    seen = tokens.observed_lengths(table(spark, d, "tokenized_document"))
    own = own.join(seen, own.ref == seen.source_ref_sha256, "left").withColumn("observed", F.coalesce("observed", F.lit(0))).withColumnRenamed("doc_id", "id")
    other = other.withColumn("observed", F.lit(0).cast("bigint")).withColumnRenamed("stream_index", "id")
    cols = (F.col("source"), F.col("lang"), F.col("web_domain"))
    return tokens.named_slices(own, "documents", *cols, "id", "tokens", "observed").unionByName(tokens.named_slices(other, "gigaverbo", *cols, "id", "tokens", "observed"))


def p1_document_counts(spark: SparkSession, d: str) -> DataFrame:
    return _document_counts(spark, d).select("corpus", "id", "tokens", "observed")


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    counts = written(_document_counts(spark, d), "token-counts")  # exact counts are kept, sums come from them
    return tokens.budget_cube(counts, ["corpus", "source", "language", "domain"], ["tokens", "observed"])


def p1_observed(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.sha2("source_ref", 256).alias("ref"), "source", "lang", "web_domain")
    seen = tokens.observed_lengths(table(spark, d, "tokenized_document"))
    joined = documents.join(seen, documents.ref == seen.source_ref_sha256)
    slices = tokens.named_slices(joined, "documents", F.col("source"), F.col("lang"), F.col("web_domain"), "observed")
    return slices.groupBy("source", "language", "domain").agg(F.count(F.lit(1)).alias("documents"), F.sum("observed").alias("observed"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.surroundings(table(spark, d, "wackywacky"))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "wackywacky")
    return lines.without_lines(stored, pages.surroundings(stored))


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many lines each rule keeps or removes."""
    return pages.decided(table(spark, d, "wackywacky")).groupBy("rule", "around").agg(F.count(F.lit(1)).alias("lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "wackywacky"))


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "wackywacky")
    return lines.without_lines(stored, lines.repeated_lines(stored))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return records.copies(records.refined(table(spark, d, "wackywacky")))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return records.records(records.refined(table(spark, d, "wackywacky")))


def p5_assignments(spark: SparkSession, d: str) -> DataFrame:
    return binpack.assign(table(spark, d, "tokenized_document"))


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    return binpack.sequences(table(spark, d, "tokenized_document"))


def _overlaps(spark: SparkSession, d: str) -> overlap.Overlaps:
    return overlap.Overlaps(overlap.with_splits(table(spark, d, "documents"), table(spark, d, "tokenized_document")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).document_pairs().select("doc_id_a", "doc_id_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).report()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"), "text", ["doc_id"])


def _mixes(spark: SparkSession, d: str) -> mix.Mixes:
    documents = table(spark, d, "documents").select("doc_id", "text", "source", labels.language(F.col("lang")).alias("language"), F.coalesce("dataset_id", F.lit("unknown")).alias("topic"))
    return mix.Mixes(tokens.count_tokens(documents, "text", ["doc_id", "source", "language", "topic"]), table(spark, d, "mix_target"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixes(spark, d).uses()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixes(spark, d).shares()


def p8_fits(spark: SparkSession, d: str) -> DataFrame:
    return _mixes(spark, d).fits()


def _abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    sentences = abuse.sentences_of(table(spark, d, "documents"), ["doc_id", "source"])
    return abuse.scored(sentences, abuse.fitted(sentences, table(spark, d, "content_label")), ["doc_id", "source"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).filter(F.col("score") >= abuse.FOUND).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = _abuse_scores(spark, d).groupBy(labels.source(F.col("source")).alias("source"))
    return rates.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= abuse.FOUND).alias("found"), F.avg("score").alias("mean_score")).withColumn("rate", F.col("found") / F.col("documents"))


def _named(source: str, language: str, domain: str) -> str:
    plain = f"regexp_replace(lower(trim({source})), '[\\s-]+', '_', 'g')"
    primary = f"regexp_extract(lower(trim({language})), '^([a-z]*)', 1)"
    codes = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.LANGUAGE_CODES.items())
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({domain})), '^[a-z][a-z0-9+.-]*://', ''), '[/:?#].*$', ''), '^www\\.|\\.$', '')"
    return f"""CASE WHEN regexp_full_match({plain}, '[a-z0-9_.]{{1,64}}') THEN {plain} ELSE 'unknown' END AS source,
CASE WHEN {language} IS NULL OR {primary} IN ('', 'und', 'unk', 'unknown', 'none', 'null') THEN 'und' ELSE CASE {primary} {codes} ELSE {primary} END END AS language,
CASE WHEN {domain} IS NULL OR {host} = '' THEN 'unknown' ELSE {host} END AS domain"""


_REPEATED = """l AS (SELECT row_number, id, domain_id, line_no, line, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS k FROM (
SELECT row_number, id, domain_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM wackywacky WHERE domain_id IS NOT NULL AND text IS NOT NULL)),
f AS (SELECT domain_id, k FROM l WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 5),
found AS (SELECT row_number, line_no FROM l JOIN f USING (domain_id, k))"""

SQL = {
    "p1_observed": f"""WITH t AS (SELECT source_ref_sha256, max(coalesce(len(input_ids), 0)) AS n FROM tokenized_document WHERE source_ref_sha256 IS NOT NULL GROUP BY 1)
SELECT source, language, domain, count(*) AS documents, CAST(sum(n) AS BIGINT) AS observed FROM (SELECT {_named("source", "lang", "web_domain")}, n FROM documents JOIN t ON sha256(source_ref) = source_ref_sha256) GROUP BY 1, 2, 3""",
    "p3_found": f"WITH {_REPEATED} SELECT row_number, line_no FROM found",
    "p3_pages": f"""WITH {_REPEATED}, kept AS (SELECT row_number, string_agg(line, chr(10) ORDER BY line_no) AS t FROM l ANTI JOIN found USING (row_number, line_no) GROUP BY 1), n AS (SELECT row_number, count(*) AS removed FROM found GROUP BY 1)
SELECT w.row_number, CASE WHEN removed IS NULL THEN text ELSE coalesce(t, '') END AS text, coalesce(removed, 0) AS removed FROM wackywacky w LEFT JOIN n USING (row_number) LEFT JOIN kept USING (row_number)""",
}

# accents: what is left of a decomposed letter; words are whole runs of letters and digits
_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"
SQL["p6_found"] = f"""WITH s AS (SELECT DISTINCT source_ref_sha256 AS ref, split FROM tokenized_document WHERE split IN ('eval', 'train')),
d AS (SELECT doc_id, split, {_WORDS} AS w FROM documents JOIN s ON sha256(source_ref) = ref WHERE text IS NOT NULL),
r AS (SELECT DISTINCT doc_id, split, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h FROM (SELECT doc_id, split, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 40)),
n AS (SELECT doc_id, split, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS common FROM r x JOIN r y USING (h) WHERE x.split = 'eval' AND y.split = 'train' AND x.doc_id <> y.doc_id GROUP BY ALL)
SELECT DISTINCT least(x, y) AS doc_id_a, greatest(x, y) AS doc_id_b FROM c JOIN n a ON a.doc_id = x AND a.split = 'eval' JOIN n b ON b.doc_id = y AND b.split = 'train' WHERE common >= 0.6 * (a.n + b.n - common) - 1e-9"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_token_budget, p1_document_counts, p1_observed, p2_found, p2_pages, p2_rules, p3_found, p3_pages, p4_found, p4_records, p5_assignments, p5_sequences, p6_found, p6_report, p7_ids, p8_mix, p8_shares, p8_fits, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
