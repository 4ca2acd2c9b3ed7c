"""Properties of operators, and the streams."""

from __future__ import annotations

from marquee.operators import engage, groups, mutate, rollup, search
from marquee.plans.query import prepare
from marquee.sources import catalog
from marquee.sources import fixtures as X
from marquee.streaming import feeds
from pyspark.sql import functions as F


def test_pages_make_the_whole_list(spark, sf):
    q = prepare("red")
    found = search.search(X.files(spark, sf), q)
    whole = [r.file_id for r in search.ranked(found, q).select("file_id").collect()]
    pages, offset = [], 0
    while offset is not None:
        rows, offset, total = search.page(found, q, offset, limit=7)
        pages += [r.file_id for r in rows.select("file_id").collect()]
    assert pages == whole and len(whole) == total == len(set(whole))


def test_empty_query_finds_nothing(spark, sf):
    assert search.search(X.files(spark, sf), prepare("please", ("please",))).count() == 0


def test_upsert_is_idempotent(spark, sf):
    stored = X.named_files(spark, sf).select("file_id", "file_name", "caption", "category")
    once = mutate.upserted(X.incoming(spark, sf), stored)
    twice = mutate.upserted(X.incoming(spark, sf), once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.status for r in mutate.upsert_status(X.incoming(spark, sf), once).select("status").distinct().collect()} == {"dup"}


def test_rollup_does_not_depend_on_order(spark, sf):
    feed = X.feed(spark, sf)
    a = sorted(map(str, rollup.title_rollup(feed).collect()))
    assert a == sorted(map(str, rollup.title_rollup(feed.orderBy(F.desc("filename")).repartition(3)).collect()))


def test_primary_store_wins(spark):
    rows = [("a", "one", 1, None, None, "secondary"), ("a", "two", 1, None, None, "primary"), ("b", "three", 1, None, None, "secondary")]
    got = catalog.federate(spark.createDataFrame(rows, catalog.SCHEMA))
    assert {(r.file_id, r.file_name) for r in got.collect()} == {("a", "two"), ("b", "three")}


def test_equality_reaches_the_scan(spark, sf, tmp_path):
    keyed = catalog.with_keys(catalog.federate(X.files(spark, sf)))
    mutate.write_partitioned(keyed, str(tmp_path / "keyed"))
    read = spark.read.parquet(str(tmp_path / "keyed")).filter("title_key = 'blue bolt' and content_type = 'movie'").select("file_id")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(title_key,blue bolt)" in plan and "PartitionFilters: [isnotnull(content_type" in plan


def test_sets_fields_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], (True, "x"))], "id int, s array<int>, b struct<is_banned: boolean, ban_reason: string>")
    assert mutate.add_to_set(rows, "s", F.lit(3)).first().s == [1, 2, 3]
    assert mutate.pull_from_set(rows, "s", F.lit(1)).first().s == [2]
    assert mutate.set_field(rows, "b", "ban_reason", F.lit("y")).first().b.ban_reason == "y"
    assert mutate.emptied(rows)[1] == 1
    mutate.write_listing(spark.createDataFrame([("a",)], "line string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "a"


def test_browse_counts(spark, sf):
    files = X.files(spark, sf)
    n = groups.browse(files, "movie", limit=1000).count()
    assert groups.has_more(files, "movie", n - 1) and not groups.has_more(files, "movie", n)


def test_pick_metadata(spark):
    found = spark.createDataFrame([("Loki 2", 2021, None, 9, 0), ("Loki", 2020, "p", 9, 1), ("loki", 2021, None, 1, 2)], "title string, year int, poster string, votes int, rank int")
    assert groups.pick_metadata(found, "Loki", 2021).first()["rank"] == 2
    assert groups.pick_metadata(found, "Loki", None).first()["rank"] == 1


def test_quota_day_ends_at_2359(spark):
    days = spark.createDataFrame([("2024-01-15 18:28:59",), ("2024-01-15 18:29:00",)], "t string").select(engage.quota_day(F.col("t").cast("timestamp_ntz")).alias("d"))
    assert [str(r.d) for r in days.collect()] == ["2024-01-15", "2024-01-16"]


def test_streams(spark, sf, tmp_path):
    base = str(tmp_path)
    X.incoming(spark, sf).repartition(2).write.parquet(f"{base}/in")
    stored = X.named_files(spark, sf).select("file_id", "file_name", "caption", "category")
    rows = feeds.read_stream(spark, f"{base}/in", "file_id string, file_name string, caption string", files_per_batch=1)
    feeds.ingest(rows, f"{base}/log", f"{base}/cp1", stored).awaitTermination()
    want = mutate.upserted(X.incoming(spark, sf), stored)
    assert sorted(map(str, feeds.current(spark, f"{base}/log", stored).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(f"{base}/log").count() == mutate.upsert_status(X.incoming(spark, sf), stored).filter("status <> 'dup'").count()

    gone = X.named_files(spark, sf).filter("k % 2 = 0").select("file_id")
    gone.write.parquet(f"{base}/gone")
    feeds.tombstones(feeds.read_stream(spark, f"{base}/gone", "file_id string"), f"{base}/left", f"{base}/cp2").awaitTermination()
    assert feeds.alive(spark, f"{base}/left", X.files(spark, sf)).count() == mutate.delete_ids(X.files(spark, sf), gone).count()

    feed = X.feed(spark, sf)
    feed.repartition(3).write.parquet(f"{base}/feed")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.schema)
    feeds.rollup_stream(feeds.read_stream(spark, f"{base}/feed", schema, files_per_batch=1), f"{base}/roll", f"{base}/cp3").awaitTermination()
    assert sorted(map(str, feeds.rollups(spark, f"{base}/roll").collect())) == sorted(map(str, rollup.title_rollup(feed).collect()))


def test_debounce_and_dedup_streams(spark, sf, tmp_path):
    e = X.table(spark, sf, "events").select("event_id", "user_id", "ts")
    e.write.parquet(f"{tmp_path}/e")
    rows = feeds.with_event_time(feeds.read_stream(spark, f"{tmp_path}/e", "event_id long, user_id long, ts timestamp_ntz"))
    q = feeds.debounced(feeds.once_per_id(rows, "event_id"), "user_id", 3600).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.first, r.n) for r in spark.table("bursts").collect()}
    batch = {(r.user_id, r.first, r.n) for r in feeds.debounced(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 3600).collect()}
    assert got <= batch and len(batch) - len(got) <= 5  # sessions still open at the end


def test_api(spark, sf):
    from marquee.api import Catalog

    c = Catalog(X.files(spark, sf), ("please",))
    rows, after, total = c.search_page("please red", limit=5)
    assert rows.count() == min(5, total) and c.search("red").count() == total
    assert after == (5 if total > 5 else None)
    assert c.search_page("please")[1:] == (None, 0) and c.search("please").count() == 0 and c.cards("please").count() == 0
    key = c.browse(limit=1).first().title_key
    tree, _, summary = c.details(key)
    assert tree.count() == c.browse(limit=1).first().files and summary.count() == 1
    assert c.search_page("red", lang="hindi")[2] == c.search_page("red", lang="hindi", limit=1000)[0].count()
    assert c.facets("red").filter("facet = 'year'").count() > 0
    assert c.title_rollup("red")[0].count() == 1
    after, status = c.upsert(X.incoming(spark, sf))
    assert after.count() == catalog.federate(c.files).count() + status.filter("status = 'suc'").count()
    stay, gone = c.delete_matching("red")
    assert stay.count() + (gone.agg(F.sum("deleted")).first()[0] or 0) == c.files.count()
    assert c.file("00000020").count() == 1 and c.recent().count() > 0 and c.correct("please") is None


def test_limits_and_grants(spark):
    assert [engage.limit_of(x, 20) for x in (None, " ", "7", "x")] == [20, 20, 7, -1]
    members = spark.createDataFrame([(1, "a"), (2, "b")], "id int, expiry_time string")
    grants = spark.createDataFrame([(1, "c", 1), (1, None, 2), (3, "d", 1)], "id int, expiry_time string, at int")
    assert {tuple(r) for r in mutate.granted(members, grants).collect()} == {(1, None), (2, "b"), (3, "d")}


def test_grants_of_one_time_as_in_sql(spark, tmp_path):
    """Grants that share a member's last time, grants without a member or a time, members without an id: what the SQL of member_grants gives."""
    import duckdb
    from marquee.queries import ORACLES, QUERIES
    from oracle import same_rows

    day = "TIMESTAMP_NTZ '2000-01-01'"
    spark.sql(f"SELECT * FROM VALUES (1L, 1L, {day}, '1-URGENT'), (2L, 5L, {day}, '2-HIGH'), (3L, NULL, {day}, '2-HIGH') AS t(o_orderkey, o_custkey, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [f"(7L, {s}, {n}, {q}, {day} + INTERVAL '{k}' DAY)" for k, (s, n, q) in enumerate([("1L", 2, 30.0), ("1L", 2, 40.0), ("1L", 2, 1.0), ("1L", 1, 50.0), ("8L", 1, 30.0), ("8L", 1, 30.0), ("CAST(NULL AS BIGINT)", 1, 30.0), ("9L", "CAST(NULL AS INT)", 30.0)])]
    spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS t(l_orderkey, l_suppkey, l_linenumber, l_quantity, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(QUERIES["member_grants"](spark, str(tmp_path)), con, ORACLES["member_grants"])


def test_federate_shuffles_only_ids_of_the_first_store(spark, sf, tmp_path):
    X.files(spark, sf).write.partitionBy("store").parquet(str(tmp_path / "f"))
    plan = catalog.federate(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "SortAggregate" not in plan


def test_debounce_timers(spark, sf, tmp_path):
    import time

    X.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind")).write.parquet(f"{tmp_path}/e")
    rows = feeds.read_stream(spark, f"{tmp_path}/e", "event_id long, kind string")
    q = feeds.debounce_timers(rows, "kind", seconds=1).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("quiet").count() < 5:
            time.sleep(1)
        got = {r.kind: r.n for r in spark.table("quiet").collect()}
    finally:
        q.stop()
    assert got == {r.event_type: r["count"] for r in X.table(spark, sf, "events").groupBy("event_type").count().collect()}


def test_a_stored_key_reaches_the_scan(spark, sf, tmp_path):
    files = X.files(spark, sf)
    mutate.write_partitioned(catalog.with_keys(files), str(tmp_path / "keyed"))
    stored = spark.read.parquet(str(tmp_path / "keyed"))
    key = catalog.with_keys(files).groupBy("title_key").count().orderBy(F.desc("count"), "title_key").first()[0]
    found = catalog.by_key(stored, key)
    assert f"EqualTo(title_key,{key})" in found._jdf.queryExecution().executedPlan().toString()
    ids = lambda rows: sorted((r.file_id, r.store) for r in rows.collect())
    assert ids(found) == ids(catalog.by_key(files, key)) and ids(found)


def test_listing_and_pull(spark, tmp_path):
    mutate.write_listing(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "list"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "list")).collect()) == ["a", "b"]
