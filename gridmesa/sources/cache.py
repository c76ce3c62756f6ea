"""Results kept by map: Parquet partitioned by format version and map, read back only for the version asked for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 6


def write_results(results: DataFrame, path: str, version: int = VERSION) -> None:
    """Rows with a map_id (the content hash); a map's earlier rows are replaced, other maps stay."""
    results.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "map_id").parquet(path)


def read_results(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """The rows of one version; of another there are none. The filter prunes partitions."""
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def cached_maps(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """The maps that need no new analysis."""
    return read_results(spark, path, version).select("map_id").distinct()


def write_text(lines: DataFrame, path: str) -> None:
    """Grid text lines (map_id, y, line), a folder for each map, rows in the order of y."""
    lines.repartition("map_id").sortWithinPartitions("map_id", "y").select("map_id", "line").write.mode("overwrite").partitionBy("map_id").text(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; in a local one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridmesa-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str = "landed") -> DataFrame:
    """df after a round trip through a shared table, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
