"""Saving into two stores of bounded size: what each row becomes, and a merge that rewrites only the buckets it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from .order import placed

BUCKETS = 32
FIRST, SECOND = "primary", "secondary"


def size_of(name: str = "file_name", caption: str = "caption") -> Column:
    """Bytes that a row takes of its store's capacity."""
    return F.coalesce(F.octet_length(name), F.lit(0)) + F.coalesce(F.octet_length(caption), F.lit(0))


def arrived(incoming: DataFrame) -> DataFrame:
    """Incoming rows (file_id, file_name, caption, seq) as they would be stored, each id as it came first, with its size."""
    clean = incoming.select("file_id", "seq", text.ingest_normal(F.col("file_name")).alias("file_name"), text.ingest_normal(F.col("caption")).alias("caption"))
    rows = clean.groupBy("file_id").agg(F.min(F.struct("seq", "file_name", "caption")).alias("r")).select("file_id", "r.*")
    return rows.withColumns({"category": extract.ingest_category(F.col("file_name")), "size": size_of().cast("long")})


def _known(rows: DataFrame, stored: DataFrame, store: str) -> DataFrame:
    held = stored.filter(F.col("store") == store).select("file_id", F.coalesce("caption", F.lit("")).alias("held"), F.lit(True).alias("known"))
    return rows.join(held, "file_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def saved(incoming: DataFrame, stored: DataFrame, first_bytes: int, second_bytes: int) -> DataFrame:
    """(file_id, file_name, caption, category, status, store): what becomes of each row, in the order of arrival.

    Store 1 takes new ids while what it holds is below first_bytes; from then on they go to store 2, and
    once that holds second_bytes they are `err`, in no store. An id that its store has is `upd` with another caption, else
    `dup`. What a store holds when a row comes is a sum over all rows before it, made by ranges and
    not by one task. stored: (file_id, file_name, caption, store), an id once in each store.
    """
    used = {r["store"]: r["used"] for r in stored.groupBy("store").agg(F.sum(size_of()).alias("used")).collect()}
    order, out, rest = [F.asc("seq"), F.asc("file_id")], [], arrived(incoming)
    for store, most in ((FIRST, first_bytes), (SECOND, second_bytes)):
        rows = _known(rest, stored, store)
        old = rows.filter("known").withColumn("status", F.when(F.col("caption") != F.col("held"), "upd").otherwise("dup"))
        new = placed(rows.filter("not known"), order, "size").withColumn("fits", F.col("before") + (used.get(store) or 0) < most)
        fields = ["file_id", "file_name", "caption", "category", "status", F.lit(store).alias("store")]
        out += [old.select(*fields), new.filter("fits").withColumn("status", F.lit("suc")).select(*fields)]
        rest = new.filter("not fits").select(*rest.columns)
    err = rest.select("file_id", "file_name", "caption", "category", F.lit("err").alias("status"), F.lit(None).cast("string").alias("store"))
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(err)


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """With `bucket`, by the id: a table partitioned by it is read and written in some buckets only."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))


COLUMNS = ("file_id", "file_name", "caption", "category")


def create(stored: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Both stores as a table in buckets of ids."""
    rows = bucketed(stored.select(*COLUMNS, "store"), buckets)
    rows.repartition("store", "bucket").write.mode("overwrite").partitionBy("store", "bucket").parquet(path)


def merge(spark: SparkSession, path: str, outcomes: DataFrame, buckets: int = BUCKETS) -> None:
    """The rows that were saved or updated go into the table at path. Only buckets with such rows are read and written; all others keep their files.

    An updated row keeps its name. Merging the same outcomes again changes nothing, so an interrupted merge is run again.
    """
    changed = bucketed(outcomes.filter("status in ('suc', 'upd')"), buckets)
    # at most two stores' buckets, whatever the batch
    touched = [(r["store"], r["bucket"]) for r in changed.select("store", "bucket").distinct().collect()]
    if not touched:
        return
    table = spark.read.parquet(path)
    within = F.concat_ws("/", "store", "bucket").isin([f"{s}/{b}" for s, b in touched])
    here = table.filter(F.col("store").isin(sorted({s for s, _ in touched})) & F.col("bucket").isin(sorted({b for _, b in touched})) & within)
    old = here.select("store", "bucket", "file_id", F.struct(*COLUMNS).alias("old"))
    new = changed.select("store", "bucket", "file_id", F.struct(*COLUMNS).alias("new"))
    both = old.join(new, ["store", "bucket", "file_id"], "full_outer")
    rows = both.select("file_id", F.coalesce("old.file_name", "new.file_name").alias("file_name"), *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("caption", "category")], "store", "bucket")
    rows.repartition("store", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store", "bucket").parquet(path)


def drop_all(spark: SparkSession, path: str) -> DataFrame:
    """(store, dropped, left): the table at path is overwritten by an empty one; its rows before, and those that are read after."""
    table = spark.read.parquet(path)
    before = [(r["store"], r["n"]) for r in table.groupBy("store").agg(F.count("*").alias("n")).collect()]
    spark.createDataFrame([], table.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    after = spark.read.schema(table.schema).parquet(path).groupBy("store").agg(F.count("*").alias("left"))
    counts = spark.createDataFrame(before, "store string, dropped long")
    return counts.join(after, "store", "left").select("store", "dropped", F.coalesce("left", F.lit(0).cast("long")).alias("left"))
