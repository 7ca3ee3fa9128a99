"""Incremental ingest of scored records: filter, project, drop exact repeats, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import cleaned
from ..operators.filters import safe_label, score_filter
from ..runtime import written

SCHEMA = "stream_index bigint, text string, edu_int_score int, source string, subset string"


def eligible(records: DataFrame, least: float = 4) -> DataFrame:
    """Works on batches and streams alike; the score comes before anything costly."""
    rows = score_filter(records, "edu_int_score", least)
    rows = rows.select("stream_index", cleaned(F.col("text")).alias("text"), safe_label(F.col("source")).alias("source"), safe_label(F.col("subset")).alias("subset"))
    return rows.filter("text <> ''").withColumn("text_sha256", F.sha2("text", 256))


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


#: Parts of the table of digests, by their first digits.
SEEN_PARTS = 32


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, least: float = 4, files_per_trigger: int = 8) -> StreamingQuery:
    """Takes in what is new since the last run and ends.

    The digests of texts taken in are a table beside the output, partitioned by their first digits, so
    that the query keeps no state that grows: a batch reads the parts that its rows fall in.
    Output and digests of a batch carry its number; a batch that is repeated after a failure
    writes over its own and writes no row twice.
    """
    seen = f"{output}/_digests"  # readers of Parquet skip names that begin so

    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        part = F.pmod(F.conv(F.substring("text_sha256", 1, 4), 16, 10).cast("int"), F.lit(SEEN_PARTS)).alias("part")
        new = rows.dropDuplicates(["text_sha256"]).select("*", part)
        if _exists(spark, seen):
            before = spark.read.schema("text_sha256 string, batch bigint, part int").parquet(seen).filter(F.col("batch") != batch)
            new = new.join(before, ["part", "text_sha256"], "left_anti")
        new = written(new, "ingest-new")
        new.drop("part").write.mode("overwrite").parquet(f"{output}/batch={batch}")
        once = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.select("text_sha256", F.lit(batch).cast("bigint").alias("batch"), "part").repartition("part").write.mode("overwrite").partitionBy("batch", "part").parquet(seen)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", once)

    rows = eligible(stream(spark, folder, files_per_trigger), least)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
