"""Evaluation records that occur, exactly or almost, in the training split.

Two documents overlap if the runs of ``width`` successive words that both hold make up
at least the share ``threshold`` of the runs that at least one of them holds.  Found by an
exact bipartite prefix join: in one total order of all runs, rare ones first, two
sets of that similarity must meet within a prefix of each, so only prefixes are
indexed (evaluation) and probed (training); bounds from lengths, places in the
prefixes and small bitmaps drop most of what meets, and the rest is verified on whole sets.

The order comes from sketches of fixed size that count the runs of the evaluation split, and those of the
training split that may occur in it.  A run whose entry of the first is zero occurs in no
evaluation document, comes first in the order, and need not be sent anywhere; a
training document with too many such runs can't reach the threshold and sends
nothing.  The others follow by their counts in both splits.  Any order gives the same
result.  Runs that many training documents send are spread over tasks.

Texts are cut into words once; their sets of runs are written and used throughout.

Documents with the same runs are one class, of which one member is indexed or probed;
the pairs of members are written out at the end, in salted parts.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mix64
from ..runtime import spread, written
from . import sketch

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")

#: Distinct words whose hashes one worker remembers.
WORD_MEMO = 1 << 18
#: Parts into which the members of one class are spread when pairs are written out.
SALTS = 64
#: Runs that hold more than this part of all rows, and at least so many, are spread over tasks.
HOT_KEYS, HOT_LEAST = 10_000, 1_000
#: Ids of documents to be verified are broadcast up to this number (8 MB).
BROADCAST_IDS = 1_000_000


_MAPS = [f"m{k}" for k in range(8)]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()
_FACTORS = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Longest runs of letters and digits, without letter case and accents."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def runs_of(words: list[str], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of successive words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += hashes[k : k + n] * _FACTORS[k]
    return np.unique(mix64(total))


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def _sets(batch: pa.RecordBatch, column: int, width: int, min_words: int):
    """(place in the batch, runs) of the texts that are long enough."""
    for i, text in enumerate(batch.column(column).to_pylist()):
        if text and len(words := words_of(text)) >= max(min_words, width):
            yield i, runs_of(words, width)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype())))


def _sets_of(documents: DataFrame, width: int, min_words: int) -> DataFrame:
    """(doc_id, split, source, a, b, runs) of the texts that are long enough; a and b are the class of equal sets."""

    def run(batches):
        for batch in batches:
            found = list(_sets(batch, 3, width, min_words))
            chosen = batch.take(pa.array([i for i, _ in found], pa.int32()))
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(r.tobytes()), "<i8") for _, r in found], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*chosen.columns[:3], pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists([r.view(np.int64) for _, r in found], pa.int64())], names=["doc_id", "split", "source", "a", "b", "runs"])

    return spread(documents.select("doc_id", "split", "source", "text")).mapInArrow(run, "doc_id bigint, split string, source string, a bigint, b bigint, runs array<bigint>")


def _order(sets: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """uint8 counts of the runs by entry: 0 for those of no evaluation set, 1 to 16 by the counts in both splits, and its bits."""
    held = sets.filter("split = 'eval'").select(F.explode("runs").alias("h"))
    bits = sketch.bits_for(held.count(), most=most_bits)
    evaluation = sketch.counts(held, "h", bits)
    known = sets.sparkSession.sparkContext.broadcast(np.packbits(evaluation > 0))

    def run(batches):
        several = known.value
        for batch in batches:
            runs = batch.column(0).flatten().to_numpy()
            at = sketch.bucket_of(runs, bits)
            yield pa.RecordBatch.from_arrays([pa.array(runs[several[at >> 3] >> (7 - (at & 7)) & 1 == 1])], names=["h"])

    training = sketch.counts(sets.filter("split = 'train'").select("runs").mapInArrow(run, "h bigint"), "h", bits)
    ranks = 1 + np.floor(2 * np.log2(np.maximum(evaluation.astype(np.int64) + training, 1))).astype(np.uint8)
    return np.where(evaluation > 0, ranks, 0).astype(np.uint8), bits


def _prefixes(sets: DataFrame, order: np.ndarray, bits: int, threshold: float) -> DataFrame:
    """(doc_id, split, a, b, size, unseen, m0 to m7, h) of each set: number of runs, how
    many are surely in no evaluation document, parities of the runs by their last nine
    bits and, of the prefix, the runs behind the unseen ones."""
    held = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        known = held.value
        for batch in batches:
            sizes, prefix, parity, absent = [], [], [], []
            ends, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            ranks = known[sketch.bucket_of(values, bits)]
            low = (values & 511).astype(np.int64)
            for start, end in zip(ends[:-1], ends[1:]):
                runs, own = values[start:end], ranks[start:end]
                unseen = int((own == 0).sum())
                take = prefix_length(len(runs), threshold)
                parity.append(np.packbits(np.bincount(low[start:end], minlength=512).astype(np.uint8) & 1))
                sizes.append(len(runs))
                absent.append(unseen)
                prefix.append(runs[np.argsort(own, kind="stable")[unseen:take]])
            maps = np.array(parity, np.uint8).reshape(-1, 64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sizes, pa.int32()), pa.array(absent, pa.int32()), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(8)), _lists(prefix, pa.int64())],
                names=["doc_id", "split", "a", "b", "size", "unseen", *_MAPS, "h"],
            )

    return sets.select("doc_id", "split", "a", "b", "runs").mapInArrow(run, "doc_id bigint, split string, a bigint, b bigint, size int, unseen int, " + ", ".join(f"{m} bigint" for m in _MAPS) + ", h array<bigint>")


class Overlaps:
    """The overlaps of a table (doc_id, split, source, text); splits are eval and train.

    Texts that are null or shorter than ``min_words`` overlap with nothing, as do rows
    of other splits; a doc_id given in both splits takes part in both, but not with
    itself.  Repeated rows count once.
    """

    def __init__(self, documents: DataFrame, width: int = 3, threshold: float = 0.6, min_words: int = 40, most_bits: int = 24):
        documents = documents.filter(F.col("split").isin("eval", "train") & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "split", "source", "text")
        sets = written(_sets_of(rows, width, min_words), "overlap-sets")
        self.members = sets.select("doc_id", "split", "source", "a", "b").distinct()
        order, bits = _order(sets, most_bits)
        prefixes = _prefixes(sets, order, bits, threshold).filter(F.size("h") > 0)
        # one row a class and split, named by its least doc_id; all else is the same for all members
        classes = prefixes.groupBy("split", "a", "b").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("size", "unseen", *_MAPS, "h")))
        classes = written(classes, "overlap-classes")
        self.pairs = written(self._verified(self._candidates(classes, threshold), sets, threshold), "overlap-pairs")

    @staticmethod
    def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
        entries = classes.select("split", "doc", "size", "unseen", F.posexplode("h").alias("at", "h"))
        # size and place share a column, as there is a row for every run of every prefix
        entries = entries.select("split", "doc", "h", F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR((F.col("unseen") + F.col("at")).cast("bigint")).alias("place"))

        def needed(x: Column, y: Column) -> Column:
            return F.ceil(F.lit(threshold / (1 + threshold)) * (x + y) - 1e-9)

        # so long as either set has so many runs from the common one on, the prefixes that
        # these two sizes need hold it: sets that are similar enough meet so at least once
        x = entries.filter("split = 'eval'").select("h", F.col("doc").alias("x_doc"), F.col("place").alias("x_place"))
        y = entries.filter("split = 'train'").select("h", F.col("doc").alias("y_doc"), F.col("place").alias("y_place"))
        # fewer than HOT_KEYS runs can be in more than that part of all rows; their rows are dealt out
        often = y.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        least = F.greatest(F.lit(HOT_LEAST), F.expr(f"n_all div {HOT_KEYS}"))
        hot = often.join(F.broadcast(often.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all")))).filter(F.col("n") > least).select("h", F.lit(True).alias("hot"))
        hot = F.broadcast(written(hot, "overlap-hot"))
        x = x.join(hot, "h", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        y = y.join(hot, "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("y_doc"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        sizes = F.shiftright("x_place", 32), F.shiftright("y_place", 32)
        close = (sizes[0] >= F.lit(threshold) * sizes[1] - 1e-9) & (sizes[1] >= F.lit(threshold) * sizes[0] - 1e-9)
        left = (size - F.col(p).bitwiseAND(F.lit(0xFFFFFFFF)) for size, p in zip(sizes, ("x_place", "y_place")))
        met = x.join(y, ["h", "salt"]).filter(close & (F.least(*left) >= needed(*sizes))).select("x_doc", "y_doc").distinct()

        # a run of one set only turns the parity of its entry: as many entries differ, so many
        # runs at least are not common
        for side, split in (("x", "eval"), ("y", "train")):
            own = classes.filter(F.col("split") == split)
            met = met.join(own.select(F.col("doc").alias(f"{side}_doc"), F.col("size").alias(f"{side}_size"), *(F.col(m).alias(f"{side}_{m}") for m in _MAPS)), f"{side}_doc")
        apart = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in _MAPS), F.lit(0))
        return met.filter((F.col("x_size") + F.col("y_size") - apart) / 2 >= needed(F.col("x_size"), F.col("y_size"))).select("x_doc", "y_doc")

    @staticmethod
    def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
        both = written(candidates, "overlap-candidates")
        few = both.count() <= BROADCAST_IDS
        for side, split in (("x", "eval"), ("y", "train")):
            wanted = both.select(F.col(f"{side}_doc").alias("doc_id")).distinct()
            own = sets.filter(F.col("split") == split).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            both = both.join(own.select(F.col("doc_id").alias(f"{side}_doc"), *(F.col(c).alias(f"{side}_{c}") for c in ("a", "b", "runs"))), f"{side}_doc")
        both = both.withColumn("common", F.size(F.array_intersect("x_runs", "y_runs")))
        union = F.size("x_runs") + F.size("y_runs") - F.col("common")
        return both.filter(F.col("common") >= F.lit(threshold) * union - 1e-9).select("x_a", "x_b", "y_a", "y_b", (F.col("common") / union).alias("similarity"))

    def _spread(self, split: str, side: str) -> DataFrame:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias(f"{side}_salt")
        return self.members.filter(F.col("split") == split).select(F.col("a").alias(f"{side}_a"), F.col("b").alias(f"{side}_b"), salt, F.col("doc_id").alias(f"{side}_doc"), F.col("source").alias(f"{side}_source"))

    def document_pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b, similarity), a < b, for every pair of documents."""
        pairs = self.pairs
        for side, split in (("x", "eval"), ("y", "train")):
            members = self._spread(split, side)
            keys = [f"{side}_a", f"{side}_b", f"{side}_salt"]
            parts = members.select(*keys).distinct()
            pairs = pairs.join(parts, keys[:2]).join(members, keys)
        pairs = pairs.filter("x_doc != y_doc")
        return pairs.select(F.least("x_doc", "y_doc").alias("doc_id_a"), F.greatest("x_doc", "y_doc").alias("doc_id_b"), "similarity").distinct()

    def class_pairs(self) -> tuple[DataFrame, DataFrame]:
        """The pairs of classes (x_a, x_b of eval, y_a, y_b of train, similarity) and the members of each class
        (doc_id, split, source, a, b): all overlaps, without writing out pairs of copies."""
        return self.pairs, self.members

    def report(self) -> DataFrame:
        """(split, source, documents, overlapping, pairs), counted by class: of copies only
        the number counts, so no pair of documents is written out."""
        sized = self.members.groupBy("split", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        partners = []
        for split, own, side, other in (("eval", "x", "y", "train"), ("train", "y", "x", "eval")):
            n = sized.filter(F.col("split") == other).select(F.col("a").alias(f"{side}_a"), F.col("b").alias(f"{side}_b"), "n")
            partners.append(self.pairs.join(n, [f"{side}_a", f"{side}_b"]).groupBy(F.lit(split).alias("split"), F.col(f"{own}_a").alias("a"), F.col(f"{own}_b").alias("b")).agg(F.sum("n").alias("partners")))
        linked = partners[0].unionByName(partners[1])
        by_class = self.members.groupBy("split", "a", "b", "source").agg(F.count(F.lit(1)).alias("n")).join(linked, ["split", "a", "b"], "left")
        found = F.coalesce("partners", F.lit(0))
        return by_class.groupBy("split", "source").agg(F.sum("n").alias("documents"), F.sum(F.when(found > 0, F.col("n")).otherwise(0)).alias("overlapping"), F.sum(F.col("n") * found).alias("pairs"))


def with_splits(documents: DataFrame, tokenized: DataFrame) -> DataFrame:
    """(doc_id, split, source, text): documents with the split of their record."""
    splits = tokenized.filter("split is not null").select(F.col("source_ref_sha256").alias("ref"), "split").distinct()
    return documents.select("doc_id", "source", "text", F.sha2("source_ref", 256).alias("ref")).join(splits, "ref").select("doc_id", "split", "source", "text")
