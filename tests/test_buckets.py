"""Ingest reads the buckets that a batch touches; leaves of the season tree are placed by ranges."""

from __future__ import annotations

from collections import defaultdict

from marquee.operators import groups, mutate, stores
from marquee.streaming import feeds
from pyspark.sql import functions as F

FIELDS = "file_id string, file_name string, caption string"


def test_small_batches_read_their_buckets(spark, tmp_path, monkeypatch):
    """Many batches of one id each: each reads one bucket of the store and of the log, and the end is that of one upsert after another."""
    base, n = str(tmp_path), 6
    old = spark.range(400).select(F.col("id").cast("string").alias("file_id"), F.concat(F.lit("Old "), "id").alias("file_name"), F.lit("c").alias("caption"), F.lit("movie").alias("category"))
    stores.bucketed(old, 16).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/store")
    stored = spark.read.parquet(f"{base}/store")
    batches = [[("7", "New name", f"caption {k % 4}"), ("x", "Film x", f"caption {k // 2}")][k % 2 : k % 2 + 1] for k in range(n)]
    want = old
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(f"{base}/in/batch={k}")
        want = mutate.upserted(spark.createDataFrame(rows, FIELDS), want)
    read, of_buckets = [], feeds.of_buckets

    def counting(rows, touched):
        out = of_buckets(rows, touched)
        files = out.select(F.col("_metadata.file_path").alias("f")).distinct().count()
        read.append((touched, files, out.select("bucket").distinct().count()))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        return out

    monkeypatch.setattr(feeds, "of_buckets", counting)
    rows = feeds.read_stream(spark, f"{base}/in", FIELDS, files_per_batch=1)
    feeds.ingest(rows, f"{base}/log", f"{base}/cp", stored, in_buckets=True, buckets=16).awaitTermination()
    assert len(read) == 2 * n - 1 and all(len(t) == 1 and buckets <= 1 for t, _, buckets in read)
    got = feeds.current(spark, f"{base}/log", stored)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_store_may_have_a_column_named_bucket(spark, tmp_path):
    """A store that isn't in buckets, with a column of that name that means something else."""
    base = str(tmp_path)
    stored = spark.createDataFrame([("1", "One", "a", "movie", 99), ("2", "Two", "b", "movie", 98)], f"{FIELDS}, category string, bucket int")
    spark.createDataFrame([("1", "Other", "a"), ("2", "Two", "z"), ("3", "Three", None)], FIELDS).write.parquet(f"{base}/in")
    feeds.ingest(feeds.read_stream(spark, f"{base}/in", FIELDS), f"{base}/log", f"{base}/cp", stored).awaitTermination()
    got = feeds.current(spark, f"{base}/log", stored)
    want = mutate.upserted(spark.read.parquet(f"{base}/in"), stored)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_nothing_arrives(spark, tmp_path):
    base = str(tmp_path)
    stored = spark.createDataFrame([("1", "One", "a", "movie")], f"{FIELDS}, category string")
    spark.createDataFrame([], FIELDS).write.parquet(f"{base}/in")
    feeds.ingest(feeds.read_stream(spark, f"{base}/in", FIELDS), f"{base}/log", f"{base}/cp", stored).awaitTermination()
    assert feeds.current(spark, f"{base}/log", stored).count() == 1


def test_a_leaf_of_very_many_files_is_placed_by_ranges(spark):
    """A third of the files in one leaf, ties and repeated rows in it: places are those of a sort, and no window is by leaf."""
    rows = [("hot", 1, 1, f"Hot S01E01 {q}", f"{k:04d}") for k, q in zip(range(900), ["720p", "1080p", "2160p", "cam"] * 225, strict=True)]
    rows += [rows[0]] * 3 + [(f"t{k % 50}", k % 3, k % 2, f"T {k}", f"a{k:04d}") for k in range(1800)] + [("", 0, 0, "x", "none")]
    keyed = spark.createDataFrame(rows, "title_key string, season int, episode int, shown string, file_id string").repartition(8)
    out = groups.season_tree(keyed)
    scores = dict(keyed.select("shown", groups.extract.sort_score(F.col("shown")).alias("s")).distinct().collect())
    leaves, series = defaultdict(list), {t for t, s, *_ in rows if s > 0}
    for title, season, episode, shown, file_id in rows:
        if title:
            leaves[title, season, episode].append((-scores[shown], file_id))
    want = sorted((t, "series" if t in series else "movie", s, e, k, f) for (t, s, e), files in leaves.items() for k, (_, f) in enumerate(sorted(files), 1))
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("[range#" in line for line in windows)
