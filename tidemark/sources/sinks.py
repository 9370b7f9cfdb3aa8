"""Sinks: tables with keys, and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Appends to the Parquet table at path the rows whose keys it does not have; of equal new keys any one. Null keys are
    equal to none, and so always added. One writer at a time.
    """
    spark = rows.sparkSession
    whole = rows.dropna(subset=keys).dropDuplicates(keys)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        whole = whole.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    some_null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    whole.select(*rows.columns).unionByName(rows.where(some_null)).write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Writes a report of few rows as one file of JSON, a row each; null members are kept."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_counted(rows: DataFrame, path: str, touched: dict[str, Column]) -> dict[str, int]:
    """Writes rows as the Parquet table at path, and tells how many meet each condition (null: not met), counted while they
    are written; no rows count 0.
    """
    told = Observation()
    counts = [F.count_if(c).alias(name) for name, c in touched.items()]
    rows.observe(told, *counts).write.mode("overwrite").parquet(path)
    return {name: told.get[name] or 0 for name in touched}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_batch(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """Writes a batch of several tables as one: its part of each under root, and then the record that it is whole.

    A batch that was cut short is not seen by `read_batches`, and its parts are replaced when it is written again; one that
    is whole is not written again. One writer of a batch at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    done = f"{root}/batches/batch={batch_id}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/tables/{name}/batch={batch_id}")
    spark.range(1).select(F.current_timestamp().alias("written_at")).write.mode("overwrite").parquet(done)


def read_batches(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of one table of all whole batches, with the column batch."""
    whole = spark.read.parquet(f"{root}/batches").select("batch").distinct()
    return spark.read.option("mergeSchema", True).parquet(f"{root}/tables/{name}").join(whole, "batch", "left_semi")


def write_tables(stream: DataFrame, tables: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """Writes what `tables` makes of each micro-batch with `write_batch`; so a batch that is run again counts once."""
    return (
        stream.writeStream.foreachBatch(lambda rows, k: write_batch(tables(rows), root, k))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
