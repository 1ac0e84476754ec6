"""Step logs and metric logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.telemetry import append_defaults
from tessera.schemas import METRIC_ROW, STEP_LOG

METRIC_KEY = ["tune_index", "plugin", "dataset", "metric"]


def _with_rank(log: DataFrame) -> DataFrame:
    """Rank from the file name ``<tag>_r<rank>.csv``."""
    rank = F.regexp_extract(F.col("_metadata.file_path"), r"_r(\d+)\.csv(?:/[^/]*)?$", 1)
    return log.select("*", F.nullif(rank, F.lit("")).cast("bigint").alias("rank"))


def read_step_log(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(STEP_LOG).option("header", True)
    return _with_rank(reader.option("recursiveFileLookup", True).csv(path))


def stream_step_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(STEP_LOG).option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_rank(reader.option("recursiveFileLookup", True).csv(path))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_ROW).json(path)


def stream_metric_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(METRIC_ROW)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def append_metrics(rows: DataFrame, path: str, plugin: str, tune_index: int, images_seen: int) -> None:
    """Append an evaluation's rows to the JSON log and write its own CSV."""
    filled = append_defaults(rows, plugin, tune_index, images_seen)
    filled.write.mode("append").json(f"{path}/all_metrics")
    filled.coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{path}/tune_{tune_index:04d}"
    )


def idempotent_metric_sink(path: str):
    """``foreachBatch`` function storing each metric key once, retries included.

    Every event directory is replaced as a whole, so a batch written twice after
    a failure leaves one copy.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        fresh = batch.dropDuplicates(METRIC_KEY)
        (
            fresh.withColumn("epoch", F.lit(_epoch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(path)
        )

    return write


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Latest stored copy of each metric key."""
    rows = spark.read.parquet(path)
    columns = [f.name for f in METRIC_ROW.fields]
    others = [c for c in columns if c not in METRIC_KEY]
    newest = rows.groupBy(*METRIC_KEY).agg(F.max_by(F.struct(*others), "epoch").alias("r"))
    return newest.select(*METRIC_KEY, "r.*").select(*columns)
