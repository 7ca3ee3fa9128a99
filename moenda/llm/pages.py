"""The main body of web pages, and the lines of their text that are not part of it.

The elements of a page's html are hashed as subtrees: a container's signature (the
tags and classes on the way to it) with the letters below it.  The hashes are counted
per site over pages of different content, and so are their shapes: the tags below a
container at its place, with no text, which find lists whose titles change from page to page.
Containers that recur on many pages of their site are template; of the others, the one that
holds the headline and most text of its own is the main body.  What lies inside it in
a container of its own (teasers, share prompts, advertising) goes if it recurs, or if
its place does and it is short, with all that lies in it; figures and tables go only if
they recur, and cells go with their table.  What lies outside goes: nearly all of it recurs by letters
or shape; the rest, mostly on sites of few pages, goes for its place beside the main body.
``decided`` tells the rule of every line.  The lines of the visible text are aligned
with the letters of the html, in order, and take the decision of their container.

Lines without html (it is null, cut or another page's) are decided by what the same
line was elsewhere on the site, then by the same line with the site's name masked
anywhere, then by the words before its colon, and at last by their neighbours.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_schema
from ..functions.hashing import h64, mix64
from ..operators.skew import join_counted
from ..runtime import spread, written

#: Elements that hold blocks, elements without content or end.
CONTAINERS = frozenset("body main article section div aside nav header footer form table td th fieldset figure dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of an article wherever they stand, and parts of these.
PARTS, CELLS = frozenset(("figure", "table")), frozenset(("td", "th"))
HIDDEN = frozenset("head script style noscript template title".split())

#: A subtree recurs if so many pages of a site, of different content, hold it.
MIN_PAGES = 3
#: Letters from which a container within the main body is a part of it though its place recurs.
OWN_LETTERS = 400
#: Letters that the headline is worth in the choice of the main body.
HEADLINE_LETTERS = 2_000
#: Lines of at least so many letters are found first; shorter ones are looked for between these.
ANCHOR_LETTERS = 14

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<", re.DOTALL)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WORDS = re.compile(r"[^\W\d_]+")

_DIGITS = re.compile(r"\d+")

UNKNOWN, MAIN, AROUND = 0, 1, 2
#: Why a line is where it is: what its container or one around it is, or what is known of such lines elsewhere.
RULES = ("unknown", "main body", "subtree recurs", "shape recurs", "short in a recurring place", "outside the main body", "headline", "same line elsewhere", "same line without the site's name", "same words before the colon", "sentence", "neighbours")
R_UNKNOWN, R_MAIN, R_SUBTREE, R_SHAPE, R_PLACE, R_OUTSIDE, R_HEADLINE, R_LINE, R_MASKED, R_PREFIX, R_SENTENCE, R_NEIGHBOUR = range(len(RULES))

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as any page has needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def range_hashes(values: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """A 64-bit hash of each range of the values, from running sums, without copies of the ranges."""
    up, down = _POWERS.of(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])
        first, last = np.array(starts, np.int64), np.array(ends, np.int64)
        return mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def letters(text: str) -> str:
    return _NOT_LETTERS.sub("", text).lower()


class _Names(dict):
    """Hashes of the tags of a page and the classes of its containers."""

    def __missing__(self, name: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[name] = value = h64(name)
        return value


_NAMES = _Names()


class Tree:
    """Containers of a page and the letters of its html in order."""

    __slots__ = ("parent", "path", "part", "own", "spans", "stream", "ends", "tags", "tag_starts", "tag_ends", "complete")

    def __init__(self, html: str):
        self.parent, self.path, self.part, self.own = [-1], [h64("body")], [0], [0]  # part: 1 of PARTS, 2 of CELLS
        self.spans: list[tuple[int, int, int]] = []  # start, end, container
        self.ends = [0]
        self.tags: list[int] = []
        self.tag_starts, self.tag_ends = [0], [0]
        parts: list[str] = []
        stack: list[tuple[str, int]] = [("", 0)]
        at, hidden = 0, None
        for m in _TOKEN.finditer(html):
            text = m[4]
            if text is not None:
                if hidden is None and not text.isspace():
                    own = letters(entities.unescape(text) if "&" in text else text)
                    if own:
                        here = stack[-1][1]
                        if self.spans and self.spans[-1][2] == here:
                            self.spans[-1] = (self.spans[-1][0], at + len(own), here)
                        else:
                            self.spans.append((at, at + len(own), here))
                        at += len(own)
                        self.own[here] += len(own)
                        parts.append(own)
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if hidden is not None:
                if m[1] and tag == hidden:
                    hidden = None
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        for _, c in stack[k:]:
                            self.ends[c], self.tag_ends[c] = at, len(self.tags)
                        del stack[k:]
                        break
                continue
            if tag in HIDDEN:
                if not m[3].endswith("/"):
                    hidden = tag
                continue
            if tag not in CONTAINERS:
                self.tags.append(_NAMES[tag])
            elif tag != "body":
                above = stack[-1][1]
                name = " ".join(x.strip("\"'") for x in _CLASS.findall(m[3]))
                self.tags.append(_NAMES[f"{tag}.{_DIGITS.sub('', name)}"])
                self.parent.append(above)
                self.path.append(h64(f"{self.path[above]}>{tag}.{name}"))
                self.part.append(1 if tag in PARTS else 2 if tag in CELLS else 0)
                self.own.append(0)
                self.ends.append(at)
                self.tag_starts.append(len(self.tags))
                self.tag_ends.append(len(self.tags))
                stack.append((tag, len(self.parent) - 1))
        for _, c in stack:
            self.ends[c], self.tag_ends[c] = at, len(self.tags)
        self.stream = "".join(parts)
        tail = html[-200:].lower()
        self.complete = "</html>" in tail or "</body>" in tail or (0 < len(html) and not stack[1:])

    def starts(self) -> list[int]:
        """Where the letters of each container with all that lies in it begin; they end at ``ends``."""
        found: list[int | None] = [None] * len(self.parent)
        for start, _, c in self.spans:
            while c >= 0 and found[c] is None:
                found[c] = start
                c = self.parent[c]
        return [e if s is None else s for s, e in zip(found, self.ends)]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the letters, and of the tags, below each container."""
        codes = np.frombuffer(self.stream.encode("utf-32-le", "surrogatepass"), "<u4")
        return range_hashes(codes, self.starts(), self.ends), range_hashes(np.array(self.tags, np.int64), self.tag_starts, self.tag_ends)


def site_words(title: str | None) -> frozenset[str]:
    """Words of the site's name, which titles give after their last bar."""
    if not title or "|" not in title:
        return frozenset()
    return frozenset(w for w in _WORDS.findall(title.rsplit("|", 1)[1].lower()) if len(w) >= 4)


def headline(title: str | None) -> str:
    return letters((title or "").rsplit("|", 1)[0])


def aligned(lines: list[str], tree: Tree) -> list[int]:
    """Container of each line of letters, -1 where the html doesn't hold it.

    Long lines are found first, in order; each shorter one is looked for in the whole gap between those.
    """
    places, at, stream = [-1] * len(lines), 0, tree.stream
    for no, line in enumerate(lines):
        if len(line) >= ANCHOR_LETTERS and (where := stream.find(line, at)) >= 0:
            places[no], at = where, where + len(line)
    ends, after = [0] * len(lines), len(stream)
    for no in range(len(lines) - 1, -1, -1):
        ends[no] = after
        if places[no] >= 0:
            after = places[no]
    at = 0
    for no, line in enumerate(lines):
        if line and len(line) < ANCHOR_LETTERS:
            places[no] = stream.find(line, at, ends[no])
        if places[no] >= 0:
            at = places[no] + len(line)
    found, spans, k = [], tree.spans, 0
    for where, line in zip(places, lines):
        if where < 0:
            found.append(-1)
            continue
        while k < len(spans) - 1 and spans[k][1] <= where:
            k += 1
        best, most, j = spans[k][2], 0, k
        while j < len(spans) and spans[j][0] < where + len(line):
            shared = min(where + len(line), spans[j][1]) - max(where, spans[j][0])
            if shared > most:
                best, most = spans[j][2], shared
            j += 1
        found.append(best)
    return found


PARSED = (
    "row_number bigint, host bigint, content bigint, complete boolean, "
    "containers array<struct<subtree:bigint,shape:bigint,place:bigint,parent:int,part:int,own:int,headline:boolean>>, "
    "lines array<struct<no:int,container:int,site:bigint,masked:bigint,prefix:bigint,kind:int>>"
)

#: Kinds of lines: bits of ``kind``.
IS_HEADLINE, IS_SENTENCE, NO_LETTERS = 1, 2, 4


def parse_page(row: int, host: str | None, title: str | None, text: str, html: str | None) -> dict:
    """What is kept of a page: hashes of its subtrees, and of its lines."""
    host_key = h64(host or f"\x00{row}")
    raw = text.split("\n")
    own = [letters(x) for x in raw]
    name, head = site_words(title), headline(title)
    containers, places, complete = [], [-1] * len(raw), False
    if html:
        tree = Tree(html)
        places, complete = aligned(own, tree), tree.complete
        below, shapes = tree.hashes()
        direct: dict[int, list[str]] = {}
        if head:
            for start, end, c in tree.spans:
                direct.setdefault(c, []).append(tree.stream[start:end])
        for c, (path, up, part, size) in enumerate(zip(tree.path, tree.parent, tree.part, tree.own)):
            containers.append({"subtree": h64(f"{host_key}|{path}|{below[c]}"), "shape": h64(f"{host_key}|{path}|tags|{shapes[c]}"), "place": h64(f"{host_key}|{path}"), "parent": up, "part": part, "own": size, "headline": bool(head) and any(head in x for x in direct.get(c, ()))})
    lines = []
    for no, (line, key, place) in enumerate(zip(raw, own, places)):
        if not line.strip():
            continue
        kind = (IS_HEADLINE if head and key == head else 0) | (0 if key else NO_LETTERS)
        stripped = line.strip(" \t\r\xa0»")
        if len(key) >= 60 and stripped[-1:] in ".!?…\"”":
            kind |= IS_SENTENCE
        words = [w for w in _WORDS.findall(line.lower()) if w not in name]
        before, colon, after = line.partition(":")
        prefix = h64("p" + letters(before)) if colon and len(before) <= 40 and len(after.strip()) >= 10 else 0
        lines.append({"no": no, "container": place, "site": h64(f"{host_key}|{key}"), "masked": h64(" ".join(words)), "prefix": prefix, "kind": kind})
    return {"row_number": row, "host": host_key, "content": h64(f"{host_key}|{''.join(own)}"), "complete": complete, "containers": containers, "lines": lines}


def main_container(containers: list[dict], recurs: dict[int, int], complete: bool) -> int | None:
    """Place of the main body in the list of containers; None where it can't be told."""
    best, most = None, 0
    for c, x in enumerate(containers):
        if not x["own"] or (recurs.get(x["subtree"], 0) >= MIN_PAGES and not x["headline"]):
            continue
        worth = x["own"] + HEADLINE_LETTERS * x["headline"]
        if worth > most:
            best, most = c, worth
    if best is None and complete:
        return max(range(len(containers)), key=lambda c: containers[c]["own"], default=None)
    if best is not None and not complete and not containers[best]["headline"]:
        return None
    return best


def container_labels(containers: list[dict], recurs: dict[int, int], complete: bool) -> list[tuple[int, int]]:
    """(MAIN or AROUND, rule) of each container, UNKNOWN where the main body can't be told."""
    main = main_container(containers, recurs, complete)
    below = [x["own"] for x in containers]
    for c in range(len(containers) - 1, 0, -1):
        below[containers[c]["parent"]] += below[c]
    out: list[tuple[int, int]] = []
    stays = []  # within the main body, and in no container that goes
    for c, x in enumerate(containers):
        again = recurs.get(x["subtree"], 0) >= MIN_PAGES
        shaped = recurs.get(x["shape"], 0) >= MIN_PAGES
        rule = R_SUBTREE if again else R_SHAPE if shaped else R_OUTSIDE
        if main is None:
            out.append((AROUND, R_SUBTREE) if again and x["own"] else (UNKNOWN, R_UNKNOWN))
            continue
        up = x["parent"]
        if c == main:
            out.append((MAIN, R_MAIN))
            stays.append(True)
        elif up < 0 or not stays[up]:
            # what encloses it may recur already
            above = out[up][1] if up >= 0 and out[up][0] == AROUND else R_OUTSIDE
            out.append((AROUND, above if above in (R_SUBTREE, R_PLACE) or (above == R_SHAPE and not again) else rule))
            stays.append(False)
        elif x["part"] == 2 and up != main:
            out.append(out[up])
            stays.append(True)
        else:
            placed = not x["part"] and recurs.get(x["place"], 0) >= MIN_PAGES
            if again:
                out.append((AROUND, R_SUBTREE))
            elif placed and x["own"] < OWN_LETTERS:
                out.append((AROUND, R_SHAPE if shaped else R_PLACE))
            else:
                out.append((MAIN, R_MAIN))
            stays.append(not again and not (placed and below[c] < OWN_LETTERS))
    return out


def settle(lines: list[dict], votes: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(label, rule) of the lines: known ones stay, others by votes and then by neighbours."""

    def vote(key: int, least: int) -> int:
        around, main = votes.get(key, (0, 0)) if key else (0, 0)
        if around + main < least:
            return UNKNOWN
        return AROUND if around > main else MAIN

    out = []
    for x in lines:
        label, rule = x["label"], x["rule"]
        if label == UNKNOWN and not x["kind"] & NO_LETTERS:
            choices = (
                (MAIN if x["kind"] & IS_HEADLINE else UNKNOWN, R_HEADLINE), (vote(x["site"], 1), R_LINE), (vote(x["masked"], 2), R_MASKED),
                (AROUND if x["prefix"] and vote(x["prefix"], 3) == AROUND else UNKNOWN, R_PREFIX), (MAIN if x["kind"] & IS_SENTENCE else UNKNOWN, R_SENTENCE),
            )
            label, rule = next((c for c in choices if c[0] != UNKNOWN), (UNKNOWN, R_UNKNOWN))
        out.append((label, rule))
    first = next((i for i, x in enumerate(lines) if x["kind"] & IS_HEADLINE), None)
    if first is None:
        first = next((i for i, x in enumerate(lines) if x["kind"] & IS_SENTENCE and out[i][0] == MAIN), 0)
    last = max((i for i, x in enumerate(lines) if out[i][0] == MAIN), default=-1)
    after, afters = UNKNOWN, []
    for label, _ in reversed(out):
        afters.append(after)
        after = label or after
    for i, (label, _) in enumerate(out):
        if label == UNKNOWN:
            before, after = out[i - 1][0] if i else UNKNOWN, afters[len(out) - 1 - i]
            if lines[i]["kind"] & NO_LETTERS:
                label = before or after or MAIN
            else:
                label = AROUND if (i < first or i > last) and AROUND in (before, after) else MAIN
            out[i] = label, R_NEIGHBOUR
    return out


#: Pages whose lines and containers a worker holds as Python objects at once.
HELD_PAGES = 500


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, HELD_PAGES):
            yield batch.slice(start, HELD_PAGES)


def _parse(pages: DataFrame) -> DataFrame:
    schema = arrow_schema(PARSED)

    def run(batches):
        for batch in _slices(batches):
            rows = [parse_page(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.mapInArrow(run, PARSED)


def _per_row(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.groupBy("row_number").agg(F.collect_list(F.struct(*columns)).alias("found"))


def _label(parsed: DataFrame, recurring: DataFrame) -> DataFrame:
    kind = "row_number bigint, first boolean, lines array<struct<no:int,label:int,rule:int,site:bigint,masked:bigint,prefix:bigint,kind:int>>"
    schema = arrow_schema(kind)
    joined = parsed.join(recurring, "row_number", "left").select("row_number", "first", "complete", "containers", "lines", "found")

    def run(batches):
        for batch in _slices(batches):
            rows = []
            for x in batch.to_pylist():
                labels = container_labels(x["containers"], {f["key"]: f["n"] for f in x["found"] or ()}, x["complete"])
                lines = []
                for y in x["lines"]:
                    label, rule = labels[y.pop("container")] if y["container"] >= 0 else (UNKNOWN, R_UNKNOWN)
                    lines.append(y | {"label": label, "rule": rule})
                rows.append({"row_number": x["row_number"], "first": x["first"], "lines": lines})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return joined.mapInArrow(run, kind)


def _settle(labelled: DataFrame, votes: DataFrame) -> DataFrame:
    joined = labelled.join(votes, "row_number", "left").select("row_number", "lines", "found")

    def run(batches):
        for batch in _slices(batches):
            rows, numbers, around, rules = [], [], [], []
            for x in batch.to_pylist():
                known = {f["key"]: (f["around"], f["main"]) for f in x["found"] or ()}
                for y, (label, rule) in zip(x["lines"], settle(x["lines"], known)):
                    rows.append(x["row_number"])
                    numbers.append(y["no"])
                    around.append(label == AROUND)
                    rules.append(RULES[rule])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(around, pa.bool_()), pa.array(rules, pa.string())], names=["row_number", "line_no", "around", "rule"])

    return joined.mapInArrow(run, "row_number bigint, line_no bigint, around boolean, rule string")


def surroundings(pages: DataFrame, **columns: str) -> DataFrame:
    """(row_number, line_no) of the lines of each text, not blank, outside the main body; see ``decided``."""
    return decided(pages, **columns).filter("around").select("row_number", "line_no")


def decided(pages: DataFrame, row: str = "row_number", site: str = "domain_id", url: str = "url", title: str = "title", text: str = "text", html: str = "html") -> DataFrame:
    """(row_number, line_no, around, rule) of the lines of each text that aren't blank.

    A null text has no lines.  Pages without site belong to the host of their url, and
    without that to a site of their own.  Null or empty html leaves the lines to what
    other pages tell.  Counts are of pages of different content, so copies of a page
    don't make its article recur; copies are decided like any row.
    """
    host = F.coalesce(F.col(site), F.nullif(F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://([^/?#]+)", 1), F.lit("")))
    chosen = pages.filter(F.col(text).isNotNull()).select(F.col(row).cast("bigint").alias("row_number"), host.alias("host"), F.col(title).alias("title"), F.col(text).alias("text"), F.col(html).alias("html"))
    parsed = written(_parse(spread(chosen)), "pages-parsed")
    firsts = parsed.groupBy("content").agg(F.min("row_number").alias("row_number")).select("row_number", F.lit(True).alias("first"))
    parsed = parsed.join(firsts, "row_number", "left").withColumn("first", F.coalesce("first", F.lit(False)))

    held = F.array_distinct(F.concat(F.col("containers.subtree"), F.col("containers.shape"), F.col("containers.place")))
    keys = parsed.select("row_number", "first", F.explode(held).alias("key"))
    counted = written(keys.filter("first").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES), "pages-subtrees")
    total = counted.agg(F.sum("n")).first()[0] or 0
    recurring = _per_row(join_counted(keys.select("row_number", "key"), counted, ["key"], ["n"], F.xxhash64("row_number"), total), ["key", "n"])
    labelled = written(_label(parsed, recurring), "pages-labelled")

    each = labelled.select("row_number", "first", F.explode("lines").alias("x")).select("row_number", "first", "x.label", F.explode(F.array_distinct(F.array("x.site", "x.masked", "x.prefix"))).alias("key")).filter("key <> 0")
    asked = each.filter(F.col("label") == UNKNOWN).select("row_number", "key").distinct()
    told = each.filter(F.col("first") & (F.col("label") != UNKNOWN)).groupBy("key").agg(F.count_if(F.col("label") == AROUND).alias("around"), F.count_if(F.col("label") == MAIN).alias("main"))
    wanted = written(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(told, "key"), "pages-votes")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    votes = _per_row(join_counted(asked, wanted, ["key"], ["around", "main"], F.xxhash64("row_number"), total), ["key", "around", "main"])
    return _settle(labelled.select("row_number", "lines"), votes)
