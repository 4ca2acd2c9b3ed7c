"""Tables that a job writes for itself or for later jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Stored relations by session and by what they were made from: a stored index serves all queries of a session.
_STORED: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share; only on one machine, where none is set, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='marquee-')}/marquee-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written and read again: what follows reads fixed rows, also when tasks are run again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The path where make(path) has stored something of that name from that source in this session; made at the first call."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _STORED:
        path = shared_folder(spark)
        make(path)
        _STORED[key] = path
    return _STORED[key]
