"""History as a stream: message numbers in ranges, from where the last run stopped to the last message there is.

The source deals the numbers, and keeps the next one as its offset; what a number stands for is joined in
each batch. A run that stops starts again with the batch that it hadn't finished, whose output is replaced,
and a later run with a greater last number goes on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.engage import count_outcomes
from ..operators.mutate import changed, judged, with_changes

#: Numbers of a partition, and of a batch handed over inside it.
STEP, AT_ONCE = 1 << 20, 1 << 16
#: Partitions of a batch; numbers are cheap and come in batches, so that more of them make partitions longer, not more.
MOST_PARTITIONS = 64


class NumberRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class MessageNumbers(DataSource):
    """Stream of (id): the numbers first to last; options first, last and step (numbers of a partition, more where a batch would have over MOST_PARTITIONS)."""

    @classmethod
    def name(cls) -> str:
        return "message_numbers"

    def schema(self) -> str:
        return "id long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return NumberReader({k: int(self.options[k]) for k in ("first", "last")} | {"step": int(self.options.get("step", STEP))})


class NumberReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, int]) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.options["first"]}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": max(self.options["first"], self.options["last"] + 1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        step = max(self.options["step"], -(-(end["next"] - start["next"]) // MOST_PARTITIONS))
        return [NumberRange(low, min(low + step, end["next"])) for low in range(start["next"], end["next"], step)]

    def read(self, partition: NumberRange) -> Iterator[pa.RecordBatch]:
        for low in range(partition.low, partition.high, AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, min(low + AT_ONCE, partition.high)))], ["id"])

    def commit(self, end: dict) -> None:
        pass


def backfill(messages: DataFrame, first: int, last: int, path: str, checkpoint: str, stored: DataFrame, step: int = STEP) -> StreamingQuery:
    """Messages (id, file_id, file_name, caption) first to last upserted into a store, as a log of changes, with the outcomes of each batch; each message once over all runs."""
    spark = messages.sparkSession
    spark.dataSource.register(MessageNumbers)
    numbers = spark.readStream.format("message_numbers").options(first=str(first), last=str(last), step=str(step)).load()

    def write(batch: DataFrame, epoch: int) -> None:
        rows = messages.join(batch, "id").drop("id")
        before = with_changes(stored, batch.sparkSession.read.parquet(f"{path}/log").filter(F.col("epoch") < epoch)) if epoch else stored
        found = judged(rows, before).persist()  # for both outputs: messages and store are met once
        count_outcomes(found.select("file_id", "status")).write.mode("overwrite").parquet(f"{path}/outcomes/epoch={epoch}")
        changed(found).write.mode("overwrite").parquet(f"{path}/log/epoch={epoch}")
        found.unpersist()

    return numbers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(status, n) of all runs so far."""
    return spark.read.parquet(f"{path}/outcomes").groupBy("status").agg(F.sum("n").cast("long").alias("n"))
