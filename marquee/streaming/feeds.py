"""Live feeds: ingest, roll-up and debounce as Structured Streaming, for file sources and any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vocab as V
from ..operators.mutate import changes, delete_ids, with_changes, without
from ..operators.rollup import said_values
from ..operators.stores import BUCKETS, bucketed
from .state import NO_END, TITLE_FIELDS, Bursts, Expiries, TitleRollup, rocksdb_state

#: How late rows may come to once_per_id() and to windows; later ones are dropped there. Ingest, tombstones and roll-ups drop none: their state is a log.
LATENESS = "10 minutes"


#: Ids of a batch up to which they are broadcast, so that the store is scanned but not shuffled.
SMALL_BATCH = 1_000_000
#: Parts in which the state of memberships is kept; each is read and written whole by a batch that touches it.
MEMBER_BUCKETS = 1024
STORED = ("file_id", "file_name", "caption", "category")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is fixed, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_event_time(rows: DataFrame, column: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Watermarks need a timestamp with zone: the column is taken as UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def once_per_id(rows: DataFrame, key: str) -> DataFrame:
    """Each id once within the watermark: what is sent again is dropped."""
    return rows.dropDuplicatesWithinWatermark([key])


def debounced(rows: DataFrame, key: str, seconds: int = V.DEBOUNCE_SECONDS) -> DataFrame:
    """(key, first, last, n): one row for each burst of a key, out when nothing came for the seconds. Rows just the seconds apart are two bursts."""
    # windows that touch are one, so they are a microsecond shorter
    window = F.session_window("ts", f"{seconds * 1_000_000 - 1} microseconds")
    return rows.groupBy(window, key).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(key, F.col("session_window.start").alias("first"), "last", "n")


def _log_sink(path: str, step: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that appends what a batch changes, as partition epoch=N of a log; a batch that runs again replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(path).filter(F.col("epoch") < epoch) if epoch else None
        step(batch, before).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def _changes_log(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    fields = T.StructType([stored.schema["file_id"], *T.StructType.fromDDL("file_name string, caption string, category string, epoch long, bucket int").fields])
    try:
        return spark.read.schema(fields).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)  # no batch has come yet


def of_buckets(rows: DataFrame, touched: list[int]) -> DataFrame:
    """The rows of these buckets, of a table partitioned by bucket: only their files are read."""
    return rows.filter(F.col("bucket").isin(touched))


def ingest(rows: DataFrame, path: str, checkpoint: str, stored: DataFrame, in_buckets: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Files (file_id, file_name, caption) upserted into a store, as a log of changes; idempotent by id. The snapshot is current().

    The log is partitioned by epoch and by bucket of ids, and a batch reads the buckets that it touches only; so it does
    of the store with in_buckets, which says that it is a table partitioned by the same buckets (bucketed() gives the
    column). The more buckets, the closer a small batch comes to reading just its own ids.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, own = batch.sparkSession, bucketed(batch, buckets)
        # as many rows as there are buckets
        counts = own.groupBy("bucket").count().collect()
        touched, small = sorted(r["bucket"] for r in counts), sum(r["count"] for r in counts) <= SMALL_BATCH
        ids = own.select("file_id").distinct()
        of_batch = lambda rows: rows.select(*STORED).join(F.broadcast(ids) if small else ids, "file_id", "left_semi")
        known = of_batch(of_buckets(stored, touched) if in_buckets else stored)
        if epoch:
            log = of_buckets(_changes_log(spark, path, stored), touched).filter(F.col("epoch") < epoch)
            known = with_changes(known, log.join(F.broadcast(ids) if small else ids, "file_id", "left_semi"))
        changed = bucketed(changes(batch, known), buckets).hint("rebalance", "bucket")
        changed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """The store with the log at path. Written, it is the next store, and its log can go."""
    return with_changes(stored.select(*STORED), _changes_log(spark, path, stored))


def tombstones(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Deletes (file_id) as a log. The files that are left are alive()."""
    sink = _log_sink(path, lambda batch, _: batch.select("file_id").distinct())
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unsubscribed(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Users (id) who leave, as a log. Those who stay are subscribed()."""
    sink = _log_sink(path, lambda batch, _: batch.select("id").distinct())
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribed(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """The users (id, ...) without those who have left."""
    return without(users, spark.read.parquet(path), "id")


def join_requests(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Requests (user_id, channel) to join, each pair once however often it is sent: the state has the pairs that came. joined() has each user's channels."""
    return append_to(rows.select("user_id", "channel").dropDuplicates(["user_id", "channel"]), path, checkpoint)


def joined(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(user_id, channels) of the requests so far."""
    return spark.read.schema(schema).parquet(path).groupBy("user_id").agg(F.collect_set("channel").alias("channels"))


def alive(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The files of both stores without the deleted ones."""
    return delete_ids(files, spark.read.parquet(path))


def rollup_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Feed rows rolled up by title in keyed state; after each batch the roll-ups of the titles that it touched are written. rollups() has the last of each.

    The state has each title's filenames and values, so a batch reads its own rows and the state of its
    titles, and nothing that was written before. Of several rows of one filename the first that comes counts.
    """
    said = said_values(rows).select("base_name", "filename", F.coalesce(F.col("tag") == "#SERIES", F.lit(False)).alias("series"), "q", "r", "l", "p")
    states = said.groupBy("base_name").transformWithStateInPandas(TitleRollup(), TITLE_FIELDS, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/titles/epoch={epoch}")

    with rocksdb_state(rows.sparkSession):
        return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollups(spark: SparkSession, path: str) -> DataFrame:
    """The last roll-up of each title."""
    log = spark.read.parquet(f"{path}/titles")
    fields = [c for c in log.columns if c not in ("base_name", "epoch")]
    return log.groupBy("base_name").agg(F.max_by(F.struct(*fields), "epoch").alias("r")).select("base_name", "r.*")


def bursts(rows: DataFrame, key: str, seconds: int = V.DEBOUNCE_SECONDS) -> DataFrame:
    """(key, first, last, n): as debounced(), by state and event-time timers: a burst comes out once the watermark is past its last row by the seconds.

    Python is called for each key of each batch: for bursts that need no more than a window has, debounced() is much faster.

    rows: with_event_time() of (key, ts). Rows in any order within the lateness count; those behind the watermark are dropped.
    """
    kind = rows.schema[key].dataType.simpleString()
    at = rows.select(key, "ts", F.unix_micros("ts").alias("at"))
    out = at.groupBy(key).transformWithStateInPandas(Bursts(key, seconds), f"`{key}` {kind}, first long, last long, n long", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


def expiries(grants: DataFrame, buckets: int = MEMBER_BUCKETS) -> DataFrame:
    """(id, expiry_time): each membership that ends, out once the watermark is past its end; a later grant of the same member moves it.

    grants: with_event_time() of (id, ts, expiry_time: timestamp); those without an end change nothing. State is kept by
    buckets of ids, so that a batch asks the store for as many values as there are buckets, not members.
    """
    part = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    end = F.coalesce(F.unix_micros("expiry_time"), F.lit(NO_END))
    # the rows without an end stay until the state, since their time moves the watermark
    rows = grants.select(part.alias("part"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), "ts", end.alias("end"))
    out = rows.groupBy("part").transformWithStateInPandas(Expiries(), "part int, id long, end long", "Append", "EventTime")
    return out.select(F.when(F.col("part") >= 0, F.col("id")).alias("id"), F.timestamp_micros("end").alias("expiry_time"))


def unanswered_stream(offers: DataFrame, clicks: DataFrame, seconds: int = 120) -> DataFrame:
    """(event_id, user_id): offers that no click of their user follows within the seconds, out when both watermarks tell that none can come.

    Both sides: with_event_time() of (user_id, ts, and event_id of the offers).
    """
    o, c = offers.select("event_id", "user_id", F.col("ts").alias("offered")), clicks.select(F.col("user_id").alias("by"), F.col("ts").alias("clicked"))
    within = (F.col("user_id") == F.col("by")) & (F.col("clicked") >= F.col("offered")) & (F.col("clicked") <= F.col("offered") + F.expr(f"INTERVAL '{seconds}' SECOND"))
    return o.join(c, within, "left_outer").filter("clicked is null").select("event_id", "user_id")


def debounce_timers(rows: DataFrame, key: str, seconds: int = V.DEBOUNCE_SECONDS) -> DataFrame:
    """(key, n): as debounced(), by a timer for each key that every row of the key sets anew: for state that a window can't hold."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(seconds * 1000)

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """rows, as they come out, as Parquet files at path; each once, whatever is run again."""
    with rocksdb_state(rows.sparkSession):
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
