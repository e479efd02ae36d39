"""Shared plumbing of the corpus operators: shared storage, row identity, ordered prefix sums.

Lineage is cut with ``checkpoint()`` or with tables written below the folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs one task and never a local file.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


#: Largest Arrow batch that an operator's Python workers are sent: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is named, a temporary one on a single machine and an error on a cluster,
    whose hosts could not read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which outlives the tables it was made of.

    Spark deletes its files once the frame is garbage only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true;
    elsewhere they stay below the shared folder until that is cleaned.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def configured(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (``__`` for a dot) for the length of a block."""
    names = {name.replace("__", "."): value for name, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of bounded rows and bytes, however long the texts."""
    return configured(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS), spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder and deleted when the block ends; within it Arrow batches are small.

    What leaves the block must not read them any more: finish it with ``checkpoint``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textloom-{uuid.uuid4().hex}"
        self.batches = small_batches(spark)

    def __enter__(self) -> Scratch:
        self.batches.__enter__()
        return self

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def __exit__(self, *_: object) -> None:
        self.batches.__exit__(None, None, None)
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        delete(self.spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffles_dropped(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Each query's shuffle files go when it ends, so that rounds do not add up on the disks."""
    return configured(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def tidied(run: Callable) -> Callable:
    """The Arrow function ``run``, giving memory that it no longer uses back to the system when its task ends.

    Python workers outlive their tasks, and what one operator's allocators keep is missing to the next.
    """

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, for steps that make Python objects of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def identity(*columns: Column) -> Column:
    """128 bits of these atomic columns, equal only where all of them are (nulls included).

    What is hashed can be read back: every value follows its length in bytes and a colon, a null is a dash.
    """

    def marked(column: Column) -> Column:
        value = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat(*map(marked, columns)))


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_identity(docs: DataFrame) -> Column:
    """``identity`` over all columns of a table, those of nested types as JSON."""

    def atomic(field: T.StructField) -> Column:
        value = column(field.name)
        if isinstance(field.dataType, T.TimestampType):  # as a string, an hour that a time zone has twice would be ambiguous
            return F.unix_micros(value)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.when(value.isNotNull(), F.to_json(F.struct(value), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
        return value

    return identity(*map(atomic, docs.schema.fields))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def rows_named(docs: DataFrame, idents: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identity over all columns is in ``idents`` (column ident); one of identical rows."""
    key = free_name("ident", docs.columns)
    named = docs.withColumn(key, row_identity(docs))
    wanted = idents.select(F.col("ident").alias(key)).distinct()
    return named.join(wanted, key, "left_semi").dropDuplicates([key]).select(*map(column, docs.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(scratch: Scratch, df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``group`` that come earlier in ``order``.

    One range exchange on (group, order) spreads even a single hot group over all tasks; each task sums its own run,
    and only one row per group and task takes part in the second pass. ``group`` is a non-null string, ``value`` a long, or a
    double of whole values.
    """
    spark = df.sparkSession
    kind = np.float64 if isinstance(df.schema[value].dataType, T.DoubleType) else np.int64
    fields = T.StructType([*df.schema.fields, T.StructField("task", T.LongType(), False), T.StructField("run", df.schema[value].dataType, False)])

    def local(batches):
        task, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(group).dictionary_encode()
            ids, names = np.asarray(codes.indices), codes.dictionary.to_pylist()
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(kind)
            sums = np.cumsum(values) - values
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            length = np.diff(np.r_[first, len(ids)])
            base = sums[first].copy()
            if names[ids[0]] == last:
                base[0] -= total
            run = sums - np.repeat(base, length)
            last, total = names[ids[-1]], run[-1] + values[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(ids), task, np.int64)), pa.array(run)],
                names=[*batch.schema.names, "task", "run"],
            )

    ranged = df.repartitionByRange(partitions(spark), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    summed = scratch.table(ranged.mapInArrow(tidied(local), fields), name)
    parts = summed.groupBy(group, "task").agg(F.sum(value).alias("part"))
    earlier = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "task", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("offset"))
    return summed.join(parts, [group, "task"]).withColumn("before", F.col("run") + F.col("offset")).drop("task", "run", "offset")
