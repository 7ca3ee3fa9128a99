"""Arrays of fixed size about hashed keys: what may occur, and how often about.

A sketch answers only questions whose wrong answers cost work and never rows.
Its size is set by ``bits`` and does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a chunk; a chunk is one row on its way to the driver.
_CHUNK_BITS = 14


def bits_for(rows: int, least: int = 14, most: int = 24) -> int:
    """Bits of a sketch with about eight entries a key, within fixed bounds."""
    return min(most, max(least, (8 * max(rows, 1)).bit_length()))


def bucket(key: Column, bits: int) -> Column:
    """The entry of a 64-bit hash; ``bucket_of`` gives the same in numpy."""
    return F.shiftrightunsigned(key, 64 - bits)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def counts(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """uint8 array of 2**bits entries: occurrences of the hashed keys, at most 255.

    The rows are added up by entry before anything is sent, so that the driver gets
    2**bits bytes, in chunks, whatever the number of rows.
    """
    chunk_bits = min(_CHUNK_BITS, bits)
    by_entry = keys.groupBy(bucket(F.col(key), bits).alias("e")).agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n"))
    by_entry = by_entry.select(F.shiftright("e", chunk_bits).cast("int").alias("chunk"), F.pmod("e", F.lit(1 << chunk_bits)).cast("int").alias("at"), F.col("n").cast("int").alias("n"))

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        values = np.zeros(1 << chunk_bits, np.uint8)
        values[table["at"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([values.tobytes()], pa.binary())})

    result = np.zeros(1 << bits, np.uint8)
    for row in by_entry.groupBy("chunk").applyInArrow(dense, "chunk int, bytes binary").toLocalIterator():
        at = row["chunk"] << chunk_bits
        result[at : at + (1 << chunk_bits)] = np.frombuffer(row["bytes"], np.uint8)
    return result
