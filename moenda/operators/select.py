"""Deterministic selection: bottom-k by hash, prefixes, caps, skips, seeded shuffles."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash

#: What the seeds of a buffered shuffle are made of beside seed and tag.
SHUFFLE_PARTS = ("shards", "buffer")


def bottom_k(rows: DataFrame, k: int, seed: int, tag: str, key: Column) -> DataFrame:
    """The k rows of the smallest (hash of seed, tag and key; key), ranked from 0.

    Planned as a top-k per partition that is merged, not as a sort of all rows.
    """
    chosen = rows.withColumn("selection_score", stable_hash(seed, tag, key)).withColumn("_key", key).orderBy("selection_score", "_key").limit(k)
    return chosen.withColumn("selection_rank", (F.row_number().over(W.orderBy("selection_score", "_key")) - 1).cast("bigint")).drop("_key")


def prefix_k(rows: DataFrame, k: int, position: str, eligible: Column) -> tuple[DataFrame, DataFrame]:
    """The first k eligible rows in order, and all rows up to the last of them.

    The second table is what a sequential scan would have seen before it stopped;
    counters must be taken over it.
    """
    chosen = rows.filter(eligible).orderBy(position).limit(k)
    stop = chosen.agg(F.max(position).alias("_stop"), F.count(F.lit(1)).alias("_n"))
    seen = rows.join(F.broadcast(stop), F.when(F.col("_n") < k, F.lit(True)).otherwise(F.col(position) <= F.col("_stop"))).drop("_stop", "_n")
    return chosen, seen


def capped_prefix(rows: DataFrame, position: str, max_rows: int, k: int, eligible: Column) -> DataFrame:
    """The first k eligible rows among the first ``max_rows`` positions, ordered; either stops."""
    return rows.filter(F.col(position) < max_rows).filter(eligible).orderBy(position).limit(k)


def skip(rows: DataFrame, position: str, n: int) -> DataFrame:
    return rows.filter(F.col(position) >= n)


def shuffled_positions(counts: list[int], buffer_size: int, shard_seed: int, buffer_seed: int) -> Iterator[tuple[int, int]]:
    """(shard, row) in the order of a buffered shuffle of shards with so many rows.

    The order depends on counts and seeds only.  Shards are shuffled and read one after another; a full
    buffer gives up a random place to each row that comes, and in the end random places of what is left.
    """
    order = list(range(len(counts)))
    random.Random(shard_seed).shuffle(order)
    coming = ((shard, row) for shard in order for row in range(counts[shard]))
    held, rng = list(islice(coming, buffer_size)), random.Random(buffer_seed)
    for new in coming:
        at = rng.randrange(len(held))
        out, held[at] = held[at], new
        yield out
    while held:
        yield held.pop(rng.randrange(len(held)))


def buffered_shuffle(spark: SparkSession, counts: dict[str, int], buffer_size: int, seed: int, tag: str, most: int | None = None) -> DataFrame:
    """(position, shard, row) of the first ``most`` rows of a buffered shuffle of named shards.

    The order of a row follows from that of the ones before, so one task makes it, holds a
    buffer and streams its rows; the driver holds a count per shard.
    """
    names, sizes = list(counts), list(counts.values())
    seeds = [int(hashlib.sha256("\x1f".join((str(seed), tag, part)).encode()).hexdigest(), 16) for part in SHUFFLE_PARTS]

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                pairs, at = islice(shuffled_positions(sizes, buffer_size, *seeds), most), 0
                while part := list(islice(pairs, 1 << 16)):
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array([names[s] for s, _ in part], pa.string()), pa.array([r for _, r in part], pa.int64())], names=["position", "shard", "row"])
                    at += len(part)

    return spark.range(1, numPartitions=1).mapInArrow(run, "position bigint, shard string, row bigint")
