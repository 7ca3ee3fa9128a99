"""Members of ZIP archives as rows, and digests that identify an archive.

The directory of an archive is read first; contents are read only of the members that
were selected, by tasks that each open the archive and seek.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT_MEMBERS = r"^data/[^/]+\.txt$"
THREAD_MEMBERS = r"^(?:.*/)?clear_threads/[^/]+\.tsv$"


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Directory(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("membersPerPartition", "100000"))

    def partitions(self):
        with zipfile.ZipFile(self.path) as archive:
            n = len(archive.infolist())
        return [_Range(self.path, k, min(k + self.size, n)) for k in range(0, max(n, 1), self.size)]

    def read(self, partition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as archive:
            for place, info in enumerate(archive.infolist()[partition.first : partition.last], partition.first):
                if not info.is_dir():
                    yield place, info.filename, info.CRC, info.file_size, info.compress_size


class ZipMembers(DataSource):
    """``spark.read.format("zipmembers").load(path)``: the directory of an archive."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "place bigint, member string, crc bigint, size bigint, csize bigint"

    def reader(self, schema):
        return _Directory(self.options)


def members(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    rows = spark.read.format("zipmembers").option("path", path).load()
    return rows.filter(F.col("member").rlike(pattern)) if pattern else rows


def contents(selected: DataFrame, path: str, member: str = "member") -> DataFrame:
    """The selected rows with ``text``; bytes that aren't UTF-8 are an error."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema)

    def run(batches):
        with zipfile.ZipFile(path) as archive:
            for batch in batches:
                texts = [archive.read(name).decode("utf-8") for name in batch.column(batch.schema.get_field_index(member)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return selected.mapInArrow(run, f"{fields}, text string")


def crc_hex(crc: Column) -> Column:
    return F.lower(F.lpad(F.hex(crc), 8, "0"))


def thread_messages(threads: DataFrame, member: str = "member", text: str = "text") -> DataFrame:
    """(member, row, user, message) of threads with three tab-separated fields a line; any other
    number of fields is an error.  Time stamps aren't kept."""
    lines = threads.select(F.col(member).alias("member"), F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("row", "line")).filter("line <> ''")
    fields = F.split(F.regexp_replace("line", r"\r\z", ""), "\t", -1)
    checked = lines.withColumn("f", F.when(F.size(fields) == 3, fields).otherwise(F.raise_error(F.concat(F.lit("not three fields in "), "member"))))
    return checked.select("member", F.col("row").cast("bigint").alias("row"), F.col("f")[1].alias("user"), F.col("f")[2].alias("message"))


def directory_digest(path: str) -> str:
    """SHA-256 over the size of an archive and its directory, in order."""
    with zipfile.ZipFile(path) as archive, open(path, "rb") as raw:
        raw.seek(0, 2)
        digest = hashlib.sha256(b"zip-central-directory-v1" + struct.pack(">Q", raw.tell()))
        for info in archive.infolist():
            name = info.filename.encode("utf-8")
            digest.update(struct.pack(">I", len(name)) + name + struct.pack(">IQQ", info.CRC, info.file_size, info.compress_size))
    return digest.hexdigest()


def record_digest(path: str) -> str:
    """SHA-256 over the directory as length-prefixed JSON records."""
    digest = hashlib.sha256()
    with zipfile.ZipFile(path) as archive:
        for info in archive.infolist():
            record = json.dumps([info.filename, info.CRC, info.file_size, info.compress_size], separators=(",", ":"), ensure_ascii=False).encode()
            digest.update(struct.pack(">I", len(record)) + record)
    return digest.hexdigest()
