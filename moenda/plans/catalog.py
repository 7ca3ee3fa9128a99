"""Queries of the library and, where SQL can say it, SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q

SEED, L = q.SEED, 1024


def _h(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


# Entities that the tables hold, and the usual ones; the ampersand last, so that each is decoded once.
ENTITIES = {"nbsp": "chr(160)", "lt": "'<'", "gt": "'>'", "quot": "'\"'", "apos": "chr(39)", "#39": "chr(39)", "amp": "'&'"}
_BREAKS = "(?i)<br\\b[^>]*>|</?(?:p|div|li|tr|blockquote)\\b[^>]*>"


def _unescaped(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, '&{name};', {char})"
    return x


def _visible(x: str) -> str:
    y = "regexp_replace(t, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style"):
        y = f"regexp_replace({y}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|$)', '', 'g')"
    y = f"regexp_replace(regexp_replace({y}, '<![A-Za-z][^>]*>', '', 'g'), '{_BREAKS}', chr(10), 'g')"
    y = f"regexp_replace({y}, '</?[A-Za-z][^>]*>', '', 'g')"
    return f"list_transform([{x}], lambda t: CASE WHEN regexp_matches(t, '</?[A-Za-z][^>]*>|<!--') THEN {_unescaped(y)} ELSE {_unescaped('t')} END)[1]"


def _clean(column: str, policy: str = "preserve") -> str:
    x = f"regexp_replace(nfc_normalize({column}), '\\r\\n?', chr(10), 'g')"
    x = f"nfc_normalize({_visible(x)})"
    x = f"regexp_replace({x}, '[\\x01-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\t\\p{{Z}}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    if policy != "preserve":
        for pattern, to in ((" +([,.])", "\\1"), ("(\\() +", "\\1"), (" +(\\))", "\\1")):
            x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _paragraphs(column: str) -> str:
    lines = "list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\p{Z}]+', ' ', 'g'))), lambda x: x <> '')"
    return f"list_filter(list_transform(regexp_split_to_array({column}, '\\n\\s*\\n+'), lambda p: {lines}), lambda p: len(p) > 0)"


CLEAN = f"""clean AS (SELECT * FROM (SELECT doc_id, coalesce(dataset_id, 'unknown') AS dataset_id, sha256(source_ref) AS source_hash, {_clean("text")} AS text
FROM documents) WHERE text <> '')"""
FIRST = f"""{CLEAN},
kept AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY dataset_id, sha256(text) ORDER BY doc_id) = 1)"""
RECORDS = f"""{FIRST},
records AS (SELECT dataset_id, source_hash, text, CAST(length(text) + 1 AS BIGINT) AS n FROM kept)"""
SPLIT = f"""{RECORDS},
scored AS (SELECT *, {_h(f"'{SEED}'", "dataset_id", "'split'", "source_hash")} AS split_score FROM records),
split AS (SELECT *, CASE WHEN coalesce(sum(n) OVER (PARTITION BY dataset_id ORDER BY split_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {q.EVAL_SEQUENCES * L} THEN 'eval' ELSE 'train' END AS split FROM scored)"""
PIECES = f"""{SPLIT},
keyed AS (SELECT *, {_h(f"'{SEED}'", "dataset_id", "split", "source_hash")} AS pack_key FROM split),
placed AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY dataset_id, split ORDER BY pack_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM keyed),
spread AS (SELECT *, unnest(range(start // {L}, (start + n - 1) // {L} + 1)) AS sequence FROM placed),
pieces AS (SELECT *, greatest(start, sequence * {L}) AS lo, greatest(start, sequence * {L}) - start AS skip, least(start + n, (sequence + 1) * {L}) - greatest(start, sequence * {L}) AS count
FROM spread WHERE split = 'train' OR sequence < {q.EVAL_SEQUENCES})"""


def _packed(split: str) -> str:
    ids = "list_slice(list_append(list_transform(string_split(text, ''), lambda c: 4 + unicode(c) % 200), 2), skip + 1, skip + count)"
    return f"""WITH {PIECES},
cut AS (SELECT dataset_id, split, sequence, lo, source_hash, count, array_to_string({ids}, ',') AS ids FROM pieces WHERE split = '{split}')
SELECT dataset_id, split, sequence, md5(string_agg(ids, ',' ORDER BY lo)) AS ids_md5, string_agg(source_hash, ',' ORDER BY lo) AS sources, string_agg(CAST(count AS VARCHAR), ',' ORDER BY lo) AS counts
FROM cut GROUP BY ALL HAVING sum(count) = {L}"""


SHORT = f"""{CLEAN},
p AS (SELECT doc_id, {_paragraphs("text")} AS p FROM clean),
f AS (SELECT doc_id, p, list_filter(list_transform(p, lambda x: list_filter(x, lambda l: length(l) >= 40)), lambda x: len(x) > 0) AS f FROM p),
t AS (SELECT doc_id, CAST(len(flatten(p)) AS BIGINT) AS lines, CAST(len(flatten(p)) - len(flatten(f)) AS BIGINT) AS lines_removed,
array_to_string(list_transform(p, lambda x: array_to_string(x, chr(10))), chr(10) || chr(10)) AS b, coalesce(array_to_string(list_transform(f, lambda x: array_to_string(x, chr(10))), chr(10) || chr(10)), '') AS a FROM f),
s AS (SELECT doc_id, lines, lines_removed, CAST(length(b) AS BIGINT) AS chars_before, CAST(length(a) AS BIGINT) AS chars_after, a,
length(a) = 0 AS empty, lines_removed > 0 AND length(a) < 300 AS short, lines_removed > 0 AND (length(b) - length(a)) / greatest(length(b), 1) > 0.8 AS fraction FROM t)"""

R = q.RULES
PAGES = f"""docs AS (SELECT row_number AS doc, coalesce(domain_id, '') AS domain, {_clean("text")} AS text FROM wackywacky WHERE text IS NOT NULL),
pp AS (SELECT doc, domain, {_paragraphs("text")} AS p FROM docs),
para AS (SELECT doc, domain, unnest(p) AS lines, unnest(range(len(p))) AS para_no FROM pp),
hashed AS (SELECT doc, domain, para_no, lines, {_h("'wackywacky-cross-domain-paragraph-v2'", "array_to_string(lines, ' ')")} AS paragraph, length(array_to_string(lines, ' ')) AS chars FROM para),
rep_p AS (SELECT paragraph, count(DISTINCT doc) AS documents, count(DISTINCT domain) AS domains, count(*) AS occurrences FROM hashed WHERE chars >= {R.paragraph_chars}
GROUP BY paragraph HAVING count(DISTINCT doc) >= {R.paragraph_documents} AND count(DISTINCT domain) >= {R.paragraph_domains}),
line AS (SELECT doc, domain, para_no, paragraph, unnest(lines) AS line, unnest(range(len(lines))) AS in_para FROM hashed),
num AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para_no, in_para) - 1 AS line_no FROM line),
win AS (SELECT doc, domain, line_no, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM num WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
blk AS (SELECT doc, domain, line_no, {_h("'wackywacky-within-domain-block-v2'", "l0 || chr(10) || l1 || chr(10) || l2")} AS block FROM win WHERE l2 IS NOT NULL AND length(l0) + length(l1) + length(l2) >= {R.block_chars}),
rep_b AS (SELECT domain, block, count(DISTINCT doc) AS documents, count(*) AS occurrences FROM blk GROUP BY domain, block HAVING count(DISTINCT doc) >= {R.block_documents}),
doomed AS (SELECT DISTINCT doc, line_no + k AS line_no FROM blk JOIN rep_b USING (domain, block), (SELECT unnest([0, 1, 2]) AS k)),
left_ AS (SELECT n.* FROM num n ANTI JOIN doomed d ON n.doc = d.doc AND n.line_no = d.line_no WHERE n.paragraph NOT IN (SELECT paragraph FROM rep_p)),
q AS (SELECT doc, para_no, string_agg(line, chr(10) ORDER BY line_no) AS t, count(*) AS k FROM left_ GROUP BY doc, para_no),
a AS (SELECT doc, string_agg(t, chr(10) || chr(10) ORDER BY para_no) AS a, sum(k) AS k FROM q GROUP BY doc),
b AS (SELECT doc, coalesce(array_to_string(list_transform(p, lambda x: array_to_string(x, chr(10))), chr(10) || chr(10)), '') AS b, len(flatten(p)) AS k FROM pp),
r AS (SELECT doc, coalesce(a.a, '') AS text, CAST(length(b.b) AS BIGINT) AS chars_before, CAST(length(coalesce(a.a, '')) AS BIGINT) AS chars_after, CAST(coalesce(b.k, 0) - coalesce(a.k, 0) AS BIGINT) AS lines_removed FROM b LEFT JOIN a USING (doc)),
removed AS (SELECT *, NOT (lines_removed > 0 AND (chars_after < {R.min_after} OR (chars_before - chars_after) / greatest(chars_before, 1) > {R.max_removed})) AS kept FROM r)"""

_SPEAKER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in q.DIALOGUE_SPEAKERS.items()) + " END"
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_SAFE = "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,127}}') THEN {0} END"

DATASETS = ["adrenaline", "brwac", "gigaverbo", "multiwoz_ptbr", "outerspace", "wackywacky"]
SEQUENCES = "counts AS (SELECT dataset_id, count(DISTINCT sequence_id) AS rows FROM packed_sequence WHERE split = 'train' GROUP BY 1)"


def _words(seed: int, n: int) -> str:
    """The first 32-bit words that the generator gives for a seed."""
    rng = random.Random(seed)
    return "[" + ",".join(str(rng.getrandbits(32)) for _ in range(n)) + "]"


def _below(word: str, bound: str) -> str:
    """What a word gives as a number below a bound; too large a number is drawn again."""
    return f"({word} >> (32 - length(bin({bound}))))"


def _seed(*parts) -> int:
    return int(hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()[:16], 16)


def _dealt(name: str, groups: str, key: str) -> str:
    """Shuffled lists ``o`` of the groups (key, n, w): from the end each place is exchanged with a drawn one."""
    swapped = "list_transform(range(len(o)), lambda x: CASE x WHEN i THEN o[j + 1] WHEN j THEN o[i + 1] ELSE o[x + 1] END)"
    return f"""{name} AS (SELECT {key}, w, n - 1 AS i, 1 AS p, range(n) AS o FROM {groups}
UNION ALL SELECT {key}, w, CASE WHEN j <= i THEN i - 1 ELSE i END, p + 1, CASE WHEN j <= i THEN {swapped} ELSE o END FROM (SELECT *, {_below("w[p]", "i + 1")} AS j FROM {name} WHERE i > 0))"""


def _row_orders(rows: str) -> str:
    words = ", ".join(f"('{x}', {_words(_seed(SEED, x, 'rows'), 1500)})" for x in DATASETS)
    return f"""words AS (SELECT * FROM (VALUES {words}) v(dataset_id, w)), sized AS (SELECT dataset_id, {rows} AS n, w FROM counts JOIN words USING (dataset_id)),
{_dealt("deal", "sized", "dataset_id")},
orders AS (SELECT dataset_id, unnest(o) AS row_index, unnest(range(len(o))) AS nth FROM deal WHERE i <= 0)"""


TURNS = f"""ranked AS (SELECT *, sha256('[{SEED},"interleave","' || dataset_id || '"]')[1:16] AS tie FROM counts),
gains AS (SELECT list(CAST(rows AS BIGINT) ORDER BY tie) AS gain, list(dataset_id ORDER BY tie) AS names, CAST(sum(rows) AS BIGINT) AS price FROM ranked),
turn AS (SELECT 0 AS t, 0 AS best, list_transform(gain, lambda x: CAST(0 AS BIGINT)) AS due FROM gains
UNION ALL SELECT t + 1, b, list_transform(range(len(due)), lambda k: due[k + 1] - CASE WHEN k + 1 = b THEN price ELSE 0 END)
FROM (SELECT t, due, list_position(due, list_max(due)) AS b, price FROM (SELECT t, list_transform(range(len(due)), lambda k: due[k + 1] + gain[k + 1]) AS due, price FROM turn, gains WHERE t < price))),
picked AS (SELECT t - 1 AS position, names[best] AS dataset_id FROM turn, gains WHERE t > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY position) - 1 AS nth FROM picked)"""


def _scheduled() -> dict[str, str]:
    rounds = ", ".join(f"({k}, {_words(_seed(SEED, 'round', k), 24)})" for k in range(150))
    buffer = int(hashlib.sha256("\x1f".join((str(SEED), "gigaverbo", "buffer")).encode()).hexdigest(), 16)
    return {
        "waterfill": f"""WITH {SEQUENCES}, t AS (SELECT CAST(sum(rows) AS BIGINT) // 2 AS target, count(*) AS n FROM counts),
a AS (SELECT rows, row_number() OVER (ORDER BY rows, dataset_id) - 1 AS k, coalesce(sum(rows) OVER (ORDER BY rows, dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM counts),
l AS (SELECT CAST((target - used) // (n - k) AS BIGINT) AS level, CAST((target - used) % (n - k) AS BIGINT) AS rest FROM a, t WHERE rows > (target - used) // (n - k) ORDER BY k LIMIT 1)
SELECT dataset_id, rows AS capacity, least(rows, level) + CASE WHEN rows > level AND row_number() OVER (PARTITION BY rows > level ORDER BY dataset_id) <= rest THEN 1 ELSE 0 END AS allocated FROM counts, l""",
        "proportional_schedule": f"WITH RECURSIVE {SEQUENCES}, {_row_orders('rows')}, {TURNS} SELECT position, dataset_id, row_index FROM numbered JOIN orders USING (dataset_id, nth)",
        "schedule_sequences": f"""WITH RECURSIVE {SEQUENCES}, {_row_orders('rows')}, {TURNS},
stored AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sequence_id) - 1 AS row_index FROM (SELECT dataset_id, sequence_id, md5(array_to_string(any_value(input_ids), ',')) AS ids_md5 FROM packed_sequence WHERE split = 'train' GROUP BY 1, 2))
SELECT position, dataset_id, sequence_id, ids_md5 FROM numbered JOIN orders USING (dataset_id, nth) JOIN stored USING (dataset_id, row_index)""",
        "balanced_schedule": f"""WITH RECURSIVE {SEQUENCES}, least_ AS (SELECT min(rows) AS fewest, count(*) AS many, list(dataset_id ORDER BY dataset_id) AS names FROM counts), {_row_orders('(SELECT fewest FROM least_)')},
rounds AS (SELECT r.*, many AS n FROM (VALUES {rounds}) r(nth, w), least_ WHERE nth < fewest), {_dealt("mixed", "rounds", "nth")},
places AS (SELECT nth, unnest(o) AS place, unnest(range(len(o))) AS spot FROM mixed WHERE i <= 0)
SELECT nth * many + spot AS position, dataset_id, row_index FROM places JOIN orders USING (nth), least_ WHERE dataset_id = names[place + 1]""",
        "buffered_shuffle": f"""WITH RECURSIVE words AS (SELECT {_words(buffer, 4000)} AS w, (SELECT count(*) FROM gigaverbo) AS n),
s AS (SELECT 1 AS p, least(64, n) AS next, range(least(64, n)) AS held, CAST(NULL AS BIGINT) AS row, -1 AS position FROM words
UNION ALL SELECT p + 1, CASE WHEN ok AND next < n THEN next + 1 ELSE next END, CASE WHEN NOT ok THEN held WHEN next < n THEN list_transform(range(len(held)), lambda x: CASE WHEN x = j THEN next ELSE held[x + 1] END) ELSE held[:j] || held[j + 2:] END,
CASE WHEN ok THEN held[j + 1] END, CASE WHEN ok THEN position + 1 ELSE position END FROM (SELECT *, j < len(held) AS ok FROM (SELECT s.*, n, {_below("w[p]", "len(held)")} AS j FROM s, words WHERE len(held) > 0)))
SELECT position, row FROM s WHERE row IS NOT NULL""",
    }


M = q.PAGE_MARKERS


def _any(values: list[str]) -> str:
    return "|".join(values)


def _url_reason(url: str) -> str:
    rest = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?]*)?', '')"
    path, query = f"split_part({rest}, '?', 1)", f"CASE WHEN {rest} LIKE '%?%' THEN regexp_replace({rest}, '^[^?]*\\?', '') ELSE '' END"
    segments = f"list_transform(string_split({path}, '/'), lambda x: lower(trim(url_decode(x))))"
    pairs = f"list_transform(string_split({query}, '&'), lambda x: lower(url_decode(url_decode(replace(x, '+', ' ')))))"
    keys = f"list_transform({pairs}, lambda x: trim(split_part(x, '=', 1)))"
    values = f"list_transform({pairs}, lambda x: regexp_replace(x, '^[^=]*=?', ''))"
    return f"""CASE WHEN {url} IS NULL THEN NULL WHEN list_has_any({segments}, {M['listing_segments']}) THEN 'listing' WHEN list_has_any({segments}, {M['search_segments']}) THEN 'search'
WHEN list_has_any({keys}, {M['query_keys']}) OR len(list_filter({values}, lambda x: regexp_matches(x, '{_any(M['query_values'])}'))) > 0 THEN 'search' END"""


_MD5 = "regexp_full_match(trim(coalesce(text_md5, '')), '[0-9a-fA-F]{32}')"

SQL = {
    "hash_bottom_k": f"SELECT doc_id, selection_score, row_number() OVER (ORDER BY selection_score, source_ref) - 1 AS selection_rank FROM (SELECT doc_id, source_ref, {_h(f"'{SEED}'", "'documents'", 'source_ref')} AS selection_score FROM documents ORDER BY 3, 2 LIMIT 128)",
    "reservoir": f"""SELECT row_number, record_key, {_h(f"'{SEED}'", "'wackywacky-reservoir'", "record_key")} AS selection_score, {_h("'wackywacky-domain'", "CASE WHEN coalesce(trim(domain_id), '') <> '' THEN domain_id ELSE record_key END")} AS domain_ref
FROM (SELECT *, {_h("'wackywacky'", "coalesce(id, '')", "coalesce(url_md5, '')", "coalesce(text_md5, '')", "CAST(row_number AS VARCHAR)")} AS record_key FROM wackywacky WHERE text IS NOT NULL) ORDER BY 3, 1 LIMIT 128""",
    "prefix_k": "SELECT stream_index, edu_int_score FROM gigaverbo WHERE edu_int_score >= 4 ORDER BY stream_index LIMIT 100",
    "prefix_metrics": "WITH g AS (SELECT stream_index, coalesce(edu_int_score >= 4, false) AS good FROM gigaverbo), c AS (SELECT stream_index FROM g WHERE good ORDER BY 1 LIMIT 100), s AS (SELECT CASE WHEN count(*) < 100 THEN NULL ELSE max(stream_index) END AS stop FROM c) SELECT count(*) AS records_seen, count(*) FILTER (NOT good) AS records_filtered_score, max(stream_index) AS last_index FROM g, s WHERE stop IS NULL OR stream_index <= stop",
    "capped_prefix": "SELECT stream_index, edu_int_score FROM gigaverbo WHERE stream_index < 400 AND edu_int_score >= 3 ORDER BY stream_index LIMIT 50",
    "skip_n": "SELECT stream_index, source FROM gigaverbo WHERE stream_index >= 25",
    "score_filter": "SELECT stream_index, edu_int_score FROM gigaverbo WHERE edu_int_score >= 4",
    "reject_reason_counts": f"SELECT CASE WHEN status IS NULL OR {_STRIP.format('status')} <> 'done' THEN 'filtered_status' WHEN text IS NULL OR {_STRIP.format('text')} = '' THEN 'filtered_missing_text' WHEN text_md5 IS NULL OR {_STRIP.format('text_md5')} = '' THEN 'filtered_missing_text_md5' WHEN {_STRIP.format("coalesce(same_as, '')")} NOT IN ('', 'NULL') THEN 'filtered_same_as' ELSE 'eligible' END AS reason, count(*) AS n FROM wackywacky GROUP BY 1",
    "clean_plain": f"SELECT doc_id, md5(t) AS text_md5, CAST(coalesce(length(t), 0) AS BIGINT) AS chars FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)",
    "detokenize": f"SELECT doc_id, md5({_clean('text', 'detokenize')}) AS text_md5 FROM documents",
    "clean_html": f"SELECT row_number, md5(t) AS text_md5, CAST(coalesce(length(t), 0) AS BIGINT) AS chars FROM (SELECT row_number, {_clean('html')} AS t FROM wackywacky)",
    "clean_scored": f"SELECT stream_index, md5({_clean(_clean('text'))}) AS text_md5 FROM gigaverbo",
    "page_filter_url": f"SELECT row_number, CASE WHEN regexp_matches(trim(regexp_replace(lower({_clean('title')}), '\\s+', ' ', 'g')), '^({_any(M['titles'])})([ :\\-–—|]|$)') THEN 'search' ELSE coalesce({_url_reason('url_final')}, {_url_reason('url')}, 'kept') END AS page FROM wackywacky",
    "page_decode": f"SELECT row_number, CASE WHEN {_MD5} AND text IS NOT NULL THEN md5(text) END AS decoded_md5, CASE WHEN NOT {_MD5} THEN 'invalid_text_md5' WHEN text IS NULL THEN 'empty_compressed_texts' END AS reason, CASE WHEN {_MD5} AND text IS NOT NULL THEN md5(text) = lower(trim(text_md5)) END AS md5_match FROM wackywacky",
    "rank_totals": "WITH e AS (SELECT event_id // 8 + 1 AS step, value, event_type FROM events WHERE event_id < (SELECT count(*) // 8 * 8 FROM events)) SELECT step, count(*) AS n, max(value) AS highest, bool_or(event_type = 'error') AS bad FROM e GROUP BY 1",
    "normalize_paragraphs": f"SELECT doc_id, CAST(len(p) AS BIGINT) AS paragraphs, CAST(coalesce(len(flatten(p)), 0) AS BIGINT) AS lines, md5(coalesce(array_to_string(list_transform(p, lambda x: array_to_string(x, chr(10))), chr(10) || chr(10)), '')) AS text_md5 FROM (SELECT doc_id, {_paragraphs(_clean('text'))} AS p FROM documents WHERE text IS NOT NULL)",
    "min_length_filter": f"WITH {CLEAN} SELECT doc_id FROM clean WHERE length(text) >= 200",
    "exact_dedup": f"WITH {FIRST} SELECT doc_id, dataset_id FROM kept",
    "dedup_metrics": f"WITH {RECORDS}, r AS (SELECT coalesce(dataset_id, 'unknown') AS dataset_id, count(*) AS received FROM documents GROUP BY 1), c AS (SELECT dataset_id, count(*) AS nonempty FROM clean GROUP BY 1), k AS (SELECT dataset_id, count(*) AS tokenized, CAST(sum(n) AS BIGINT) AS tokens FROM records GROUP BY 1) SELECT dataset_id, received, received - coalesce(nonempty, 0) AS empty_or_short, coalesce(nonempty, 0) - coalesce(tokenized, 0) AS duplicates, coalesce(tokenized, 0) AS tokenized, coalesce(tokens, 0) AS tokens FROM r LEFT JOIN c USING (dataset_id) LEFT JOIN k USING (dataset_id)",
    "duplicate_source_check": "SELECT count(*) AS duplicates FROM (SELECT source_ref FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "tokenize_codepoint": f"WITH {CLEAN} SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n, CAST(list_sum(list_transform(string_split(text, ''), lambda c: 4 + unicode(c) % 200)) + 2 AS BIGINT) AS checksum FROM clean",
    "token_totals": f"WITH {RECORDS} SELECT dataset_id, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest FROM records GROUP BY 1",
    "split_eval_train": f"WITH {SPLIT} SELECT dataset_id, source_hash, split_score, split, n FROM split",
    "pack_train": _packed("train"),
    "pack_eval": _packed("eval"),
    "pack_provenance": f"WITH {PIECES} SELECT dataset_id, source_hash, sequence, skip, count FROM pieces WHERE split = 'train'",
    "pack_tails": f"WITH {SPLIT}, s AS (SELECT dataset_id, split, CAST(sum(n) AS BIGINT) AS tokens FROM split GROUP BY 1, 2), e AS (SELECT *, CASE WHEN split = 'eval' THEN least(tokens // {L}, {q.EVAL_SEQUENCES}) ELSE tokens // {L} END AS emitted FROM s) SELECT dataset_id, split, tokens, emitted, tokens - emitted * {L} AS not_selected, (tokens - emitted * {L}) % {L} AS tail FROM e",
    "capacity_report": f"WITH {SPLIT}, s AS (SELECT dataset_id, CAST(coalesce(sum(n) FILTER (split = 'eval'), 0) AS BIGINT) AS eval_tokens, CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train_tokens, count(*) AS documents FROM split GROUP BY 1) SELECT *, train_tokens // {L} AS train_sequences, train_tokens % {L} AS train_rest, eval_tokens // {L} >= {q.EVAL_SEQUENCES} AS eval_reserved FROM s",
    "split_leakage": "SELECT count(*) FILTER (splits > 1) AS leaked, count(*) AS sources FROM (SELECT source_ref_sha256, count(DISTINCT split) AS splits FROM tokenized_document GROUP BY 1)",
    "short_line_filter": f"WITH {SHORT} SELECT doc_id, lines, lines_removed, chars_before, chars_after, NOT (empty OR short OR fraction) AS kept, md5(a) AS text_md5 FROM s",
    "short_line_metrics": f"WITH {SHORT} SELECT count(*) AS documents, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(lines_removed) AS BIGINT) AS lines_removed, count(*) FILTER (empty) AS empty, count(*) FILTER (short) AS short, count(*) FILTER (fraction) AS fraction, count(*) FILTER (NOT (empty OR short OR fraction)) AS kept FROM s",
    "cross_domain_repeats": f"WITH {PAGES} SELECT * FROM rep_p",
    "within_domain_blocks": f"WITH {PAGES} SELECT * FROM rep_b",
    "boilerplate_removed": f"WITH {PAGES} SELECT doc, md5(text) AS text_md5, chars_before, chars_after, lines_removed, kept FROM removed",
    "boilerplate_report": f"WITH {PAGES} SELECT (SELECT count(*) FROM rep_p) AS paragraphs, (SELECT CAST(coalesce(sum(occurrences), 0) AS BIGINT) FROM rep_p) AS paragraph_occurrences, (SELECT count(*) FROM rep_b) AS blocks, (SELECT CAST(coalesce(sum(occurrences), 0) AS BIGINT) FROM rep_b) AS block_occurrences, count(*) AS documents, count(*) FILTER (kept) AS documents_kept, CAST(sum(lines_removed) AS BIGINT) AS lines_removed FROM removed",
    "dialogue_projection": f"SELECT user_id AS dialogue, md5(string_agg(label || ': ' || said, chr(10) ORDER BY event_id) FILTER (said <> '')) AS text_md5, count(*) AS turns, count(*) FILTER (said <> '') AS turns_kept FROM (SELECT user_id, event_id, {_SPEAKER} AS label, {_clean('props')} AS said FROM events) GROUP BY 1",
    "anonymize_participants": f"WITH e AS (SELECT event_id % 97 AS conversation, event_id, user_id, {_clean('props')} AS said FROM events), f AS (SELECT conversation, user_id, min(event_id) AS first FROM e GROUP BY 1, 2), n AS (SELECT conversation, user_id, row_number() OVER (PARTITION BY conversation ORDER BY first) AS number FROM f) SELECT conversation, md5(string_agg('Participante ' || number || ': ' || said, chr(10) ORDER BY event_id) FILTER (said <> '')) AS text_md5, count(*) AS messages, count(*) FILTER (said <> '') AS messages_kept, count(DISTINCT user_id) AS participants FROM e JOIN n USING (conversation, user_id) GROUP BY 1",
    "participant_counts": "SELECT event_id % 97 AS conversation, count(DISTINCT user_id) AS participants, count(*) AS messages FROM events GROUP BY 1",
    "scored_projection": f"SELECT stream_index, md5(t) AS text_md5, 'gigaverbo:' || {_h("'gigaverbo'", "'main'", "'default'", "'train'", 'CAST(stream_index AS VARCHAR)')} AS source_ref, {_SAFE.format('source')} AS source, {_SAFE.format('subset')} AS subset FROM (SELECT *, {_clean('text')} AS t FROM gigaverbo WHERE edu_int_score >= 4) WHERE t <> ''",
    "safe_label": f"SELECT stream_index, {_SAFE.format('source')} AS source, {_SAFE.format('subset')} AS subset FROM gigaverbo",
    "member_refs": "SELECT doc_id, sha256('brwac:corpus.zip:' || source_ref) AS ref FROM documents",
    "sequence_id_unique": "SELECT sequence_id, count(*) AS n FROM packed_sequence GROUP BY 1 HAVING count(*) > 1",
    "packed_validation": f"SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(regexp_full_match(sequence_id, '[0-9a-f]{{64}}'), false)) AS bad_sequence_id, count(*) FILTER (coalesce(len(input_ids) <> {L}, true)) AS bad_length, count(*) FILTER (list_min(input_ids) < 0 OR list_max(input_ids) >= 2147483647) AS bad_ids, count(*) FILTER (coalesce(len(source_token_counts) <> len(source_ref_sha256) OR len(source_token_counts) < 1, true)) AS bad_provenance, count(*) FILTER (list_min(source_token_counts) < 1 OR list_sum(source_token_counts) <> {L}) AS bad_counts, count(*) - count(DISTINCT sequence_id) AS surplus_ids FROM packed_sequence",
    "inspection_summary": "WITH s AS (SELECT dataset_id, split, count(DISTINCT source) AS sources FROM (SELECT dataset_id, split, unnest(source_ref_sha256) AS source FROM packed_sequence) GROUP BY 1, 2) SELECT dataset_id, split, count(*) AS rows, CAST(sum(len(input_ids)) AS BIGINT) AS tokens, min(len(source_ref_sha256)) AS fewest, max(len(source_ref_sha256)) AS most, any_value(sources) AS sources FROM packed_sequence JOIN s USING (dataset_id, split) GROUP BY 1, 2",
    "split_sources_disjoint": "SELECT source, count(DISTINCT split) AS splits FROM (SELECT split, unnest(source_ref_sha256) AS source FROM packed_sequence) GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "step_rank_batches": "SELECT event_id AS position, event_id // 8 + 1 AS step, event_id % 8 // 4 AS rank FROM events WHERE event_id < (SELECT count(*) // 8 * 8 FROM events)",
    "batch_dataset_counts": "SELECT event_id // 8 + 1 AS step, event_type AS dataset_id, count(*) AS n FROM events WHERE event_id < (SELECT count(*) // 8 * 8 FROM events) GROUP BY 1, 2",
    "eval_ranks": "SELECT event_id % 4 AS rank, count(*) AS n FROM events GROUP BY 1",
    "eval_macro_perplexity": "WITH p AS (SELECT event_type AS dataset_id, count(*) AS sequences, avg(abs(value) / 100) AS loss FROM events GROUP BY 1), a AS (SELECT * FROM p UNION ALL SELECT 'macro', CAST(sum(sequences) AS BIGINT), avg(loss) FROM p) SELECT dataset_id, sequences, round(loss, 6) AS loss, round(exp(least(loss, 80)), 3) AS perplexity FROM a",
    "row_range_lookup": "WITH s AS (SELECT event_id // 1000 AS shard, count(*) AS rows FROM events GROUP BY 1), e AS (SELECT shard, rows, coalesce(sum(rows) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s) SELECT event_id AS row_index, shard, CAST(event_id - start AS BIGINT) AS row_in_shard FROM events JOIN e ON event_id >= start AND event_id < start + rows",
    "stable_hashes": f"SELECT doc_id, {_h(f"'{SEED}'", "coalesce(source, '')", "coalesce(lang, '')", 'CAST(doc_id AS VARCHAR)')} AS h FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in q.ALL}


def oracle_sql() -> dict[str, str]:
    return SQL | _scheduled()
