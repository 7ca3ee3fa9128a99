"""Stable 64-bit hashes in Python that any worker gives alike."""

from __future__ import annotations

import numpy as np
import xxhash


def h64(data: bytes | str, seed: int = 0) -> int:
    """xxh3 of bytes (or UTF-8 text) as a signed 64-bit integer."""
    if isinstance(data, str):
        data = data.encode("utf-8", "surrogatepass")
    value = xxhash.xxh3_64_intdigest(data, seed)
    return value - (1 << 64) if value >> 63 else value


def mix64(values: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over unsigned 64-bit integers."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def stable_hash(*parts):
    """SHA-256 hex of the parts as strings, joined by the unit separator.

    A null part counts as an empty one, so that the number of parts stays the same.
    """
    from pyspark.sql import functions as F

    columns = [F.coalesce((p if hasattr(p, "cast") else F.lit(str(p))).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *columns), 256)
