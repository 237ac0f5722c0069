"""Readers of the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.scratch import small_side


def read_table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The table `name` under `root`, restricted to `columns` so that the scan reads nothing else."""
    table = spark.read.parquet(f"{root}/{name}.parquet")
    return table.select(*columns) if columns else table


def read_once(spark: SparkSession, root: str, name: str, key: str, *columns: str) -> DataFrame:
    """The table's rows, of several with one key the first by place, without moving any column but the key.

    A scan of the keys alone tells which come twice and where they stand first; the rows are then held against these few. Wide
    columns stay where they are read unless the repeated keys are too many to be broadcast. Rows with a null key count as one.
    """
    table = spark.read.parquet(f"{root}/{name}.parquet")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    again = table.select(F.col(key).alias("_key"), place.alias("_at")).groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = table.select(key, *columns, place.alias("_at")).join(small_side(again), F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.filter("_first is null or _at = _first").select(key, *columns)


def spread(rows: DataFrame) -> DataFrame:
    """Rows for a costly function: where they come in fewer partitions than half the cores, as from a small file, over all cores.

    A table of a cluster's size comes in enough partitions and isn't moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() < cores else rows


def open_store(spark: SparkSession, name: str, schema: str, location: str | None = None) -> DataFrame:
    """A store's table: the shared one at `location` if one is named, else an empty one of this session under `name`, made once."""
    if location:
        return spark.read.schema(schema).parquet(f"{location.rstrip('/')}/{name}")
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    return spark.table(name)
