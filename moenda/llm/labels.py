"""One spelling for the languages, sources and web domains of a table.

Every function has a result for null: the name ``unknown`` (languages: ``und``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter codes of the languages that have a two-letter one here.
LANGUAGE_CODES = {"por": "pt", "spa": "es", "eng": "en", "fra": "fr", "ita": "it", "deu": "de"}
_WITHOUT = ["", "und", "unk", "unknown", "none", "null"]


def language(column: Column) -> Column:
    """Primary subtag in lower case: pt-BR, PT and por give pt."""
    primary = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]*)", 1)
    named = primary
    for long, short in LANGUAGE_CODES.items():
        named = F.when(primary == long, short).otherwise(named)
    return F.when(column.isNull() | primary.isin(_WITHOUT), "und").otherwise(named)


def source(column: Column) -> Column:
    """Lower case, hyphens and blanks as underscores; unusable names give unknown."""
    plain = F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")
    return F.when(plain.rlike("^[a-z0-9_.]{1,64}$"), plain).otherwise("unknown")


def domain(column: Column) -> Column:
    """Host in lower case without scheme, www, port, path and closing dot."""
    host = F.regexp_replace(F.lower(F.trim(column)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(host, r"[/:?#].*$", "")
    host = F.regexp_replace(host, r"^www\.|\.$", "")
    return F.when(column.isNull() | (host == ""), "unknown").otherwise(host)
