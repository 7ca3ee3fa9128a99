"""Records that differ only in how they are written.

Two texts are the same record if their letters and digits are the same in the same
order, letter case ignored and accents respected (in composed form, so that it does
not matter how an accent is encoded).  A text that is only a record of named fields
is also compared as its set of (name, value) pairs, each compared in that way.  Prose
with a colon in each line reads as such a text too: it still is the same as any text
with the same letters in the same order.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mix64
from ..operators.skew import join_counted
from ..runtime import spread, written
from . import sketch

_NOT_ALNUM = re.compile(r"[\W_]+")
_NAME_ENDS = re.compile("[:=]")
# possessive, so that a text of any length is parsed in linear time
_JSON_FIELD = re.compile(r'\s*+"((?:[^"\\]|\\.)*+)"\s*+:\s*+(?:"((?:[^"\\]|\\.)*+)"|([^",{}\[\]]++))\s*+(?:,|\Z)')


def folded(text: str) -> str:
    """Letters and digits of a text in composed form, letter case ignored."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _NOT_ALNUM.sub("", text.casefold())


def _is_name(name: str) -> bool:
    """Field names of all notations: whatever has a letter or digit."""
    return folded(name) != ""


class _Fields(list):
    """The pairs of a JSON object, in order and with repeats."""


_FALSE_TRUE = {None: "null", False: "false", True: "true"}


def _shown(value) -> str:
    """What of a JSON value is compared: its letters and digits, those of inner objects in the order of their sorted pairs."""
    if isinstance(value, _Fields):
        return "".join(a + b for a, b in sorted((folded(a), folded(_shown(b))) for a, b in value))
    if isinstance(value, list):
        return "".join(map(_shown, value))
    return value if isinstance(value, str) else _FALSE_TRUE[value]


def _json_pairs(text: str) -> list[tuple[str, str]] | None:
    plain = text.strip().rstrip(".; ")
    try:
        whole = json.loads(plain, object_pairs_hook=_Fields, parse_float=str, parse_int=str, parse_constant=str, strict=False)
        return [(a, _shown(b)) for a, b in whole] if all(_is_name(a) for a, _ in whole) else None
    except (ValueError, RecursionError):
        pass  # not quite JSON, such as values without quotes
    body, at, pairs = plain[1:-1], 0, []
    while at < len(body):
        if not (m := _JSON_FIELD.match(body, at)):
            return None
        name, value = m[1], m[2] if m[2] is not None else m[3]
        if "\\" in name or "\\" in value:
            try:
                name, value = json.loads(f'"{name}"'), json.loads(f'"{value}"')
            except ValueError:
                return None
        if not _is_name(name):
            return None
        pairs.append((name, value))
        at = m.end()
    return pairs


def _parted(parts: list[str]) -> list[tuple[str, str]] | None:
    pairs = []
    for part in parts:
        if part.strip(" \t\r\xa0.") == "":
            continue
        m = _NAME_ENDS.search(part)
        if not m or not _is_name(part[: m.start()]):
            return None
        pairs.append((part[: m.start()], part[m.end() :]))
    return pairs


def named_fields(text: str) -> frozenset[tuple[str, str]] | None:
    """The (name, value) pairs of a text that is only a record of at least two
    named fields: a JSON object, whatever its values, or ``name: value`` / ``name = value`` on lines or
    between ``;`` or ``|``.  Names and values are folded.  None for any other text."""
    if not (":" in text or "=" in text):
        return None
    plain = text.strip()
    if plain.startswith("{") and plain.rstrip(".; ").endswith("}"):
        pairs = _json_pairs(plain)
    else:
        lines = [x for x in plain.split("\n") if x.strip(" \t\r\xa0")]
        pairs = _parted(lines) if len(lines) > 1 else None
        for mark in "|;":
            if pairs is None and mark in plain:
                pairs = _parted([y for x in lines for y in x.split(mark)])
    if not pairs or len(pairs) < 2:
        return None
    fields = frozenset((folded(a), folded(b)) for a, b in pairs)
    return fields if len({a for a, _ in fields}) == len(fields) else None


_WEIGHTS = mix64(np.arange(1, 0x3001, dtype=np.uint64))


def invariant(canonical: str) -> int:
    """A 64-bit hash of the length and the letter histogram, blind to the order."""
    codes = np.frombuffer(canonical.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) and codes.max() >= 0x3000:
        weights = mix64(codes.astype(np.uint64) + np.uint64(1))
    else:
        weights = _WEIGHTS[codes]
    with np.errstate(over="ignore"):
        total = weights.sum(dtype=np.uint64) + np.uint64(len(codes)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _cheap(text: str) -> tuple[str, frozenset | None]:
    return folded(text), named_fields(text)


def _invariants(canonical: str, fields: frozenset | None) -> set[int]:
    """Of the ordered letters, and of the pairs of a record."""
    found = {invariant(canonical)}
    if fields is not None:
        found.add(invariant("".join(a + b for a, b in fields)))
    return found


def exact_key(canonical: str, fields: frozenset | None) -> tuple[int, int]:
    """The costlier key: 128 bits of the ordered letters or of the sorted pairs."""
    data = canonical if fields is None else "\x1e" + "\x1e".join(f"{a}\x1f{b}" for a, b in sorted(fields))
    value = xxhash.xxh3_128_digest(data.encode("utf-8", "surrogatepass"))
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def _first_pass(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [(r, c) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := _cheap(t))[0] for c in _invariants(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["row", "c"])

    return rows.mapInArrow(run, "row bigint, c bigint")


def _second_pass(rows: DataFrame, shared: np.ndarray, bits: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(np.packbits(shared))

    def run(batches):
        several = held.value

        def alone(c: int) -> bool:
            b = (c & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            return not several[b >> 3] >> (7 - (b & 7)) & 1

        for batch in batches:
            out = []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                canonical, fields = _cheap(t)
                if canonical:
                    c = invariant(canonical)
                    if all(map(alone, _invariants(canonical, fields))):
                        out.append((r, c, None, None, None, None))
                    else:
                        out.append((r, c, *exact_key(canonical, None), *((None, None) if fields is None else exact_key("", fields))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], names=["row", "c", "a", "b", "p", "q"])

    return rows.mapInArrow(run, "row bigint, c bigint, a bigint, b bigint, p bigint, q bigint")


def _linked(keys: DataFrame) -> DataFrame:
    """(row, c, a, b): letter orders (a, b) that share pairs (p, q) get the least of their keys.

    Orders and pairs are the two sides of a graph of few distinct edges; its connected
    components are the records.  Labels spread over it until each pair has one.
    """
    plain = keys.select("row", "c", "a", "b")
    edges = keys.filter(F.col("p").isNotNull()).select("a", "b", "p", "q").distinct()
    edges = written(edges.withColumns({"la": F.col("a"), "lb": F.col("b")}), "record-edges")
    total = edges.count()

    def open_pairs() -> bool:
        labels = edges.groupBy("p", "q").agg(F.min(F.struct("la", "lb")).alias("low"), F.max(F.struct("la", "lb")).alias("high"))
        return not labels.filter("low <> high").isEmpty()

    moved = False
    while open_pairs():
        moved = True
        for x, y in (("p", "q"), ("a", "b")):
            least = edges.groupBy(x, y).agg(F.min(F.struct("la", "lb")).alias("low"), F.count(F.lit(1)).alias("n"))
            least = least.select(x, y, "n", F.col("low.la").alias("la"), F.col("low.lb").alias("lb"))
            edges = written(join_counted(edges.drop("la", "lb"), least, [x, y], ["la", "lb"], F.xxhash64("a", "b", "p", "q"), total), "record-edges")
    if not moved:
        return plain
    renamed = edges.filter("a <> la or b <> lb").select("a", "b", "la", "lb").distinct()
    orders = plain.filter(F.col("a").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    orders = written(orders.join(renamed, ["a", "b"], "left").select("a", "b", "n", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "record-orders")
    total = orders.agg(F.sum("n")).first()[0]
    named = join_counted(plain.filter(F.col("a").isNotNull()), orders, ["a", "b"], ["la", "lb"], F.xxhash64("row"), total)
    named = named.select("row", "c", F.col("la").alias("a"), F.col("lb").alias("b"))
    return written(plain.filter(F.col("a").isNull()).unionByName(named), "record-linked")


def refined(pages: DataFrame, row: str = "row_number", text: str = "text") -> DataFrame:
    """(row, c, a, b) of every text with a letter or digit; a and b are null where
    the cheap invariants alone show that no other text is the same record.

    First all texts are grouped by length and letter histogram, of which only hashes
    leave the executors.  A bitmap of fixed size tells which of these classes may
    have several members; only their texts get the costlier keys.  A bitmap too
    small for the corpus lets more texts through and changes no result.
    """
    rows = spread(pages.filter(F.col(text).isNotNull() & F.col(row).isNotNull()).select(F.col(row).cast("bigint").alias("row"), F.col(text).alias("text")))
    cheap = written(_first_pass(rows), "record-invariants")
    bits = sketch.bits_for(cheap.count(), most=27)
    shared = sketch.counts(cheap, "c", bits) > 1
    return _linked(written(_second_pass(rows, shared, bits), "record-keys"))


def records(keys: DataFrame) -> DataFrame:
    """(kept_row, copies) of every record: the smallest row, and how many rows hold it.

    A third of all rows may be one record: the groups are counted with map-side
    combining and never gathered."""
    several = keys.filter(F.col("a").isNotNull()).groupBy("a", "b").agg(F.min("row").alias("kept_row"), F.count(F.lit(1)).alias("copies"))
    alone = keys.filter(F.col("a").isNull()).select(F.col("row").alias("kept_row"), F.lit(1).cast("bigint").alias("copies"))
    return several.select("kept_row", "copies").unionByName(alone)


def copies(keys: DataFrame) -> DataFrame:
    """(kept_row, copy_row) for every row that repeats the record of a smaller row."""
    keyed = keys.filter(F.col("a").isNotNull()).select("row", "a", "b")
    groups = keyed.groupBy("a", "b").agg(F.min("row").alias("kept_row"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    groups = written(groups, "record-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    found = join_counted(keyed, groups, ["a", "b"], ["kept_row"], F.xxhash64("row"), total)
    return found.filter(F.col("row") != F.col("kept_row")).select("kept_row", F.col("row").alias("copy_row"))
