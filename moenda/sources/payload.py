"""Compressed page payloads: upper-case hex of a zstd frame."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the format.
LARGEST = 134_217_728
TRUNCATED_SIZE = 65_535
MAGIC = b"\x28\xb5\x2f\xfd"
_MD5 = re.compile(r"[0-9a-fA-F]{32}")


def decode(payload: str | None, md5: str | None, largest: int = LARGEST) -> tuple[str | None, str | None, bool | None]:
    """(text, reason of rejection, whether the md5 matches); a wrong md5 doesn't reject."""
    if md5 is None or not _MD5.fullmatch(md5.strip()):
        return None, "invalid_text_md5", None
    try:
        data = bytes.fromhex(payload or "")
    except ValueError:
        return None, "invalid_text_hex", None
    if not data:
        return None, "empty_compressed_texts", None
    if data[:4] != MAGIC:
        return None, "invalid_zstd_frames", None
    try:
        declared = zstandard.frame_content_size(data)
    except zstandard.ZstdError:
        return None, "invalid_zstd_frames", None
    if declared > largest:
        return None, "oversized_decompressed_texts", None
    try:
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=largest)
    except (zstandard.ZstdError, MemoryError):
        return None, "truncated_zstd_frames_65535_bytes" if len(data) == TRUNCATED_SIZE else "corrupt_zstd_frames", None
    if len(raw) > largest:
        return None, "oversized_decompressed_texts", None
    matches = hashlib.md5(raw).hexdigest() == md5.strip().lower()
    try:
        return raw.decode("utf-8"), None, matches
    except UnicodeDecodeError:
        return None, "non_utf8_decompressed_texts", matches


def decoded(rows: DataFrame, key: str, payload: str, md5: str, largest: int = LARGEST) -> DataFrame:
    """(key, text, reason, md5_match) of each row."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = [decode(p, m, largest) for p, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())], names=[key, "text", "reason", "md5_match"])

    return rows.select(key, payload, md5).mapInArrow(run, f"`{key}` {kind}, text string, reason string, md5_match boolean")


@F.pandas_udf(StringType())
def _encode(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor()
    return texts.map(lambda t: None if t is None else pack.compress(t.encode()).hex().upper())


def encoded(text: Column) -> Column:
    return _encode(text)
