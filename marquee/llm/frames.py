"""Helpers shared by the corpus operators: free column names, written cuts of the lineage, size checks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words `[^\x20\x09-\x0D]+` as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it, so that no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a new one of this machine if all runs on it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="marquee-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that written() has made and release() has not removed.
_TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts the lineage and survives lost executors.

    The table stays until release(), since results are lazy and read it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/marquee-{uuid.uuid4().hex}"
    # the shuffle files of what is written now are of no more use: without this they stay until the driver collects garbage
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables written() has made that are still there: what release() takes."""
    return len(_TABLES)


def release(spark: SparkSession, after: int = 0, keep: DataFrame | None = None) -> None:
    """Removes the tables that written() has made after the first `after` ones, but for the one that keep reads; results that need them must be written by then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = [] if keep is None else [x.rpartition("/")[0].rpartition("/")[2] for x in keep.inputFiles()]
    for path in _TABLES[after:]:
        if path.rpartition("/")[2] not in kept:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            _TABLES.remove(path)


def release_one(spark: SparkSession, table: DataFrame) -> None:
    """Removes one table that written() has made; nothing may read it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = {x.rpartition("/")[0].rpartition("/")[2] for x in table.inputFiles()}
    for path in [x for x in _TABLES if x.rpartition("/")[2] in names]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _TABLES.remove(path)


#: Bytes in memory up to which a table may be broadcast, or handled by one task.
SMALL = 64 << 20


def written_bytes(df: DataFrame) -> int:
    """An estimate of the memory that a table that written() returned takes: its files' size, or its rows at the width of their types, whichever is more."""
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(files, df.count() * (16 + int(df._jdf.schema().defaultSize())))


def is_small(df: DataFrame) -> bool:
    """Whether a table that written() returned may be broadcast."""
    return written_bytes(df) <= SMALL


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it takes at most SMALL bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df) else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2000 rows where the session has Spark's default of 10000: a fifth of the memory in tasks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns the freed memory of this process, Arrow's too, to the system: Python workers wait for further tasks with what they have grown to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def appended(docs: DataFrame, keep: Sequence[str], text: str, fields: str, compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns keep of docs and the columns `fields` that compute makes of each Arrow batch of the text column, row by row."""
    small_batches(docs.sparkSession)
    at, extra = (keep.index(text), []) if text in keep else (len(keep), [F.col(f"`{text}`")])
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(fields).fields])
    names, n = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *compute(batch.column(at))], names)
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in keep], *extra).mapInArrow(run, schema)
