"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of ASCII letters, ASCII digits and anything beyond ASCII, with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words on UTF-8: every other ASCII byte becomes a blank, on which bytes.split() parts.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null has none."""
    return utf8(text).translate(WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that are worked on at once: bounds what long texts can hold in a Python worker.
ROWS = 256


#: Bytes of texts and the like in an Arrow batch, where the session has no limit of its own: what a Python worker and,
#: beside the heap, the JVM hold for a task at once. Spark's own are 10,000 rows (20 MB of texts of 2 kB).
BATCH, BATCH_SETTING = 1 << 21, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), on batches of about BATCH bytes. Spark reads the limit as the result runs, which may be
    after any call here, so it stays set in the session; one that is set already is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's spark.checkpoint.dir. Only on one machine (a local
    master, as in tests) is a temporary one taken where that is unset; on a cluster this is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^,\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no more than a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one run in the shared folder, by name. What a result reads has to stay; the rest is dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df, written once as Parquet and read again. Shuffles that made it are cleared at once: this is a setting of
        the session only, which is put back.
        """
        path, setting = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes all tables written under these names."""
        for path in [p for n in names for p in self.paths.pop(n, ())]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key with more than one in PARTS of all rows is hot (there are fewer than PARTS such keys, whatever the input), and
#: its rows are dealt out in shares of about that size.
PARTS = 256


#: Rows under which no key has so many that dealing them out is worth two more jobs.
FEW = 4096


def spread_join(
    rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, by: str, how: str = "inner", total: int | None = None
) -> DataFrame:
    """rows joined with side on key, the rows of a hot key dealt out to many tasks by a hash of `by`, and that key's rows
    of side, which are few, given to each of them. counts: (key, n), how many rows there are of each key; only the hot
    ones reach the driver. total: the rows, if known. The result is that of the plain join.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    if total < FEW:
        return rows.join(side, key, how)
    found = counts.where(F.col("n") * PARTS > total).select(key, F.ceil(F.col("n") * PARTS / max(total, 1)).cast("int")).collect()
    if not found:
        return rows.join(side, key, how)
    kind = rows.schema[key].dataType
    table = F.array(*[F.struct(F.lit(k).cast(kind).alias(key), F.lit(n).alias("_salts")) for k, n in found])
    hot = F.broadcast(rows.sparkSession.range(1).select(F.explode(table).alias("x")).select("x.*"))
    some = F.col("_salts").isNotNull()
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(some, F.pmod(F.hash(by), F.col("_salts"))).otherwise(0)).drop("_salts")
    each = F.when(some, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(each)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def as_rows(df: DataFrame) -> F.Column:
    """All columns of df as one struct, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def map_batches(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Applies fn to each Arrow batch's columns (as lists); what it returns must have the columns of schema."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn({name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return map_arrow(df, run, schema)


def ddl(df: DataFrame, name: str, as_name: str | None = None) -> str:
    """A column's name and type for a schema string."""
    return f"`{as_name or name}` {df.schema[name].dataType.simpleString()}"


def text_key(text_col: str) -> F.Column:
    """Identity of a text: equal texts and only they share it; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
