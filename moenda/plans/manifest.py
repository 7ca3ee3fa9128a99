"""Canonical JSON, content-addressed identities, atomic files, sharded output."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_sha256

SHARD_ROWS, LENGTH = 1024, 1024

def shard_schema() -> pa.Schema:
    """Made where it is needed: pickling drops that the ids can't be null."""

    def many(kind: pa.DataType, size: int = -1) -> pa.DataType:
        return pa.list_(pa.field("element", kind, False), size)

    fields = {"sequence_id": pa.string(), "input_ids": many(pa.int32(), LENGTH), "source_ref_sha256": many(pa.string()), "source_token_counts": many(pa.int32())}
    return pa.schema([pa.field(name, kind, False) for name, kind in fields.items()])


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8")


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def content_id(**parts) -> str:
    """First 20 hex digits of the digest of the named parts."""
    return digest(parts)[:20]


def write_json_atomic(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with open(partial, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(partial, path)


def reject_absolute_paths(value) -> None:
    """Metadata must not tell where it was made."""
    if isinstance(value, dict):
        for k, v in value.items():
            reject_absolute_paths(k)
            reject_absolute_paths(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            reject_absolute_paths(v)
    elif isinstance(value, str) and (value.startswith(("/", "\\\\", "~")) or re.match(r"[A-Za-z]:[\\/]", value)):
        raise ValueError("an absolute path in metadata")


def write_shards(rows: DataFrame, folder: str, rows_per_shard: int = SHARD_ROWS) -> list[dict]:
    """Writes sequences as shard-NNNNN.parquet of exactly so many rows, in the order of
    ``sequence`` (numbers from 0 without gaps); returns a record per shard.

    Each shard is one group of a shuffle by its number, written to a temporary name and
    renamed, so a repeated or speculative task leaves the same file.  A shard that is there already is
    used if it holds the same rows, and an error if not.  The folder must be shared by the executors.
    """
    os.makedirs(folder, exist_ok=True)

    def record(name: str, out: pa.Table) -> pa.Table:
        path = os.path.join(folder, name)
        return pa.table({"path": [name], "rows": [out.num_rows], "tokens": [out.num_rows * LENGTH], "size_bytes": [os.path.getsize(path)], "sha256": [file_sha256(path)]})

    def write(table: pa.Table) -> pa.Table:
        schema, number = shard_schema(), table["shard"][0].as_py()
        table = table.sort_by("sequence")
        ids = pa.FixedSizeListArray.from_arrays(pa.concat_arrays([c.flatten() for c in table["input_ids"].chunks]).cast(pa.int32()), type=schema.field("input_ids").type)
        rest = {f.name: table[f.name].combine_chunks().cast(f.type) for f in schema if f.name != "input_ids"}
        out = pa.table([rest.get(f.name, ids) for f in schema], schema=schema)
        name = f"shard-{number:05d}.parquet"
        path = os.path.join(folder, name)
        if os.path.lexists(path):  # of a run that was stopped: used if it is the same
            if os.path.islink(path) or not pq.read_table(path).equals(out):
                raise OSError(f"{name} is there with other rows")
            return record(name, out)
        partial = f"{path}.{uuid.uuid4().hex}.partial"
        pq.write_table(out, partial, compression="zstd", version="2.6", use_dictionary=False, write_statistics=True)
        if not pq.read_table(partial).equals(out):
            raise OSError(f"{name} was not written as given")
        os.replace(partial, path)
        return record(name, out)

    keyed = rows.select(F.expr(f"sequence div {rows_per_shard}").alias("shard"), "sequence", "sequence_id", "input_ids", "source_ref_sha256", "source_token_counts")
    made = keyed.groupBy("shard").applyInArrow(write, "path string, rows bigint, tokens bigint, size_bytes bigint, sha256 string")
    return sorted((r.asDict() for r in made.collect()), key=lambda r: r["path"])  # a row per file


def _fault(folder: str, r: dict) -> str | None:
    path = os.path.join(folder, r["path"])
    if os.path.islink(path) or os.path.getsize(path) != r["size_bytes"] or file_sha256(path) != r["sha256"]:
        return f"{r['path']} was changed"
    meta = pq.ParquetFile(path)
    if not meta.schema_arrow.equals(shard_schema()) or meta.metadata.num_rows != r["rows"] or r["rows"] < 1:
        return f"{r['path']} has another schema or number of rows"
    groups = (meta.metadata.row_group(g) for g in range(meta.metadata.num_row_groups))
    if any(g.column(c).compression != "ZSTD" for g in groups for c in range(g.num_columns)):
        return f"{r['path']} is not compressed with ZSTD"
    return None


def validate_shards(spark: SparkSession, folder: str, records: list[dict]) -> None:
    """Files as recorded, none missing or surplus, schema and compression right.

    The driver compares names; the files are read and hashed by tasks, some at a time each.
    """
    here = sorted(n for n in os.listdir(folder)) if os.path.isdir(folder) else []
    if here != sorted(r["path"] for r in records):
        raise ValueError("the files of the folder differ from the manifest")
    if not records:
        return

    def run(batches):
        for batch in batches:
            found = [fault for r in batch.to_pylist() if (fault := _fault(folder, r))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["fault"])

    listed = spark.createDataFrame([tuple(r[k] for k in ("path", "rows", "size_bytes", "sha256")) for r in records], "path string, rows bigint, size_bytes bigint, sha256 string")
    parts = min(len(records), 4 * spark.sparkContext.defaultParallelism)
    for row in listed.repartition(parts, "path").mapInArrow(run, "fault string").limit(1).collect():
        raise ValueError(row["fault"])
