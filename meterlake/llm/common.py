"""What the operators of this subpackage share: tables, the shared folder, skew-safe lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and one machine does all (tests) a temporary folder is made and set.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="meterlake-"))
    return context.getCheckpointDir().rsplit("/", 1)[0]


_OWN: set[str] = set()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the application's part of the shared root; nothing exists there yet. That part goes when the driver ends."""
    own = f"{shared_root(spark)}/meterlake-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Left join on ``key`` where a few keys may hold most of ``left``.

    ``right`` has unique keys, and ``weight`` says how many rows of ``left`` each has; together
    they are at most ``rows``. Keys above ``rows / (2 * partitions)`` number at most
    ``2 * partitions``: that many rows are broadcast. All others meet in a shuffle.
    """
    spark = left.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limit = max(16, rows // (2 * parts))
    columns = [c for c in right.columns if c not in (key, weight)]
    heavy = right.where(F.col(weight) > limit).drop(weight)
    light = right.where(F.col(weight) <= limit).drop(weight)
    hot = heavy.select(F.col(key), F.lit(True).alias("_hot"), F.struct(*columns).alias("_value"))
    marked = left.join(F.broadcast(hot), key, "left")
    picked = [c for c in left.columns if c != key]
    easy = marked.where("_hot").select(key, *picked, *[F.col("_value")[c].alias(c) for c in columns])
    rest = marked.where("_hot is null").select(key, *picked).join(light, key, "left")
    return easy.unionByName(rest.select(key, *picked, *columns))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, which Spark bounds by bytes: what Python makes of one part is gone before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give back to the system what a worker's allocators keep after a task, as workers outlive it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: Keys of a few bytes each that are broadcast to choose rows, at most.
MOST_KEYS = 300_000


def chosen_rows(docs: DataFrame, key: Column, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``key`` is in the one column of ``keys`` or not (semi or anti).

    Rows travel as one struct, so that no column name of theirs can clash. Up to ``MOST_KEYS`` keys,
    which are stored and counted, are broadcast; with more of them the rows are shuffled.
    """
    found = stored(keys.toDF("found_key"), "keys")
    found = F.broadcast(found) if found.count() <= MOST_KEYS else found.hint("shuffle_merge")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("row_key"))
    return rows.join(found, F.col("row_key").eqNullSafe(F.col("found_key")), how).select("row.*")


def whole(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
