"""Sessions, shared folders and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(app: str = "moenda", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, Arrow, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Their import path need not contain the folder from which the driver imported it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="moenda-")  # executors may fetch it at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Where lineage may be cut: ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none (tests, one machine) a folder of its own is
    made, and removed when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="moenda-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return "file://" + _OWN_FOLDERS[app]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it from there.

    Unlike a cached table it survives the loss of executors, and unlike a plain
    DataFrame it is computed once.  The tables stay until ``discard_written``, as later jobs may
    still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/moenda/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> bool:
    """Deletes all tables that this application has written into the shared folder.

    For whoever has read all results: tables that were not read yet can't be read any more.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/moenda/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores before costly work per row, where a scan has few partitions.

    Small files can't be split; a scan of many files is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores // 2 else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
