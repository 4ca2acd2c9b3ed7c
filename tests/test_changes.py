"""Stores, codes and streams against brute force."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

from marquee.api import Catalog
from marquee.operators import codes, engage, stores
from marquee.operators.rollup import title_rollup
from marquee.sources import fixtures as X
from marquee.streaming import feeds, history, state
from pyspark.sql import functions as F


def test_saving_into_stores_that_run_full(spark, tmp_path):
    r = random.Random(1)
    stored = [(f"f{k}", "n" * 10, r.choice(["old", None]), "movie", s) for k in range(40) for s in r.choice([["primary"], ["secondary"]])]
    came = [(f"f{r.randrange(120)}", "name " + "x" * r.randrange(30), r.choice(["old", "new", None]), k) for k in range(150)]
    table = spark.createDataFrame(stored, "file_id string, file_name string, caption string, category string, store string")
    arriving = spark.createDataFrame(came, "file_id string, file_name string, caption string, seq long").repartition(4)
    held = {(s, f): c or "" for f, _, c, _, s in stored}
    used = {s: sum(len(n) + len(c or "") for _, n, c, _, x in stored if x == s) for s in ("primary", "secondary")}
    most = {"primary": used["primary"] + 400, "secondary": used["secondary"] + 250}
    want, seen = {}, set()
    for file_id, name, caption, _ in came:
        if file_id in seen:
            continue
        seen.add(file_id)
        want[file_id] = ("err", None)
        for s in ("primary", "secondary"):
            if (s, file_id) in held:
                want[file_id] = ("upd" if held[s, file_id] != (caption or "") else "dup", s)
                break
            if used[s] < most[s]:
                used[s] += len(name) + len(caption or "")
                want[file_id] = ("suc", s)
                break
    out = stores.saved(arriving, table, most["primary"], most["secondary"])
    assert {x.file_id: (x.status, x.store) for x in out.collect()} == want
    assert {s for s, _ in want.values()} == {"suc", "upd", "dup", "err"}

    path = str(tmp_path / "s")
    stores.create(table, path, buckets=64)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in (x.removeprefix("file://") for x in spark.read.parquet(path).inputFiles())}
    before, one = files(), out.filter("status = 'upd'").limit(1)
    stores.merge(spark, path, one, buckets=64)
    assert len(set(before.items()) - set(files().items())) == 1  # the one bucket's file
    for _ in range(2):
        stores.merge(spark, path, out, buckets=64)
    after = {(x.store, x.file_id): x.caption for x in spark.read.parquet(path).collect()}
    caption = {f: c or "" for f, _, c, _ in reversed(came)}
    changed = {(s, f): caption[f] for f, (status, s) in want.items() if status in ("suc", "upd")}
    assert after == {(s, f): c for f, _, c, _, s in stored} | changed
    assert sorted(map(tuple, stores.drop_all(spark, path).collect())) == sorted((s, sum(k[0] == s for k in after), 0) for s in ("primary", "secondary"))


def test_claims_in_the_order_of_time(spark):
    r, day = random.Random(2), datetime(2024, 1, 1)
    made = [(f"c{k}", r.choice([3600, 86400, 5 * 86400])) for k in range(60)] + [("none", 0)]
    claims = [(k, r.choice([None, *range(12)]), r.choice([None, "no such", "none", *[c for c, _ in made]]), r.choice([None] + [day + timedelta(hours=r.randrange(400)) for _ in range(9)])) for k in range(500)]
    members = [(3, day + timedelta(days=2)), (4, None)]
    seconds, until, used, want = dict(made), {u: t for u, t in members if t}, {}, {}
    for k, user, code, at in sorted(claims, key=lambda c: (c[3] is not None, c[3] or day, c[0])):
        if user is not None and at is not None and until.get(user, day) > at:
            want[k] = "member"
        elif not seconds.get(code):
            want[k] = "invalid"
        elif user is None or at is None or code in used:
            want[k] = "used" if user is not None and at is not None else None
        else:
            want[k], used[code], until[user] = "ok", user, at + timedelta(seconds=seconds[code])
    c = spark.createDataFrame(made, "code_hash string, seconds int")
    rows = spark.createDataFrame(claims, "claim_id int, user_id int, code_hash string, at timestamp_ntz")
    m = spark.createDataFrame(members, "id int, expiry_time timestamp_ntz")
    won = codes.granted(c, rows, m)
    got = {x.claim_id: x.status for x in codes.claim_status(c, rows, m, won).collect()}
    assert {k: v for k, v in got.items() if want[k]} == {k: v for k, v in want.items() if v}
    assert {x.code_hash: x.user_id for x in codes.listed(c, won).collect() if x.used} == used and len(used) > 15
    again = codes.added(c, spark.createDataFrame([("x", 60), ("x", 60), ("y", 0)], "code string, seconds int"))
    assert again.count() == len(made) + 1


def test_counters(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    n = spark.createDataFrame([(1, t[0]), (1, t[3]), (1, t[6]), (2, t[0])], "user_id long, ts timestamp_ntz")
    resets = spark.createDataFrame([(1, t[3]), (None, t[1]), (3, t[5])], "user_id long, ts timestamp_ntz")
    assert {r.user_id: r["count"] for r in engage.counters(n, resets).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.user_id: r["count"] for r in engage.counters(n, resets.limit(0)).collect()} == {1: 3, 2: 1}


def test_rollup_reads_its_batch_only(spark, sf, tmp_path):
    """Of many batches each reads its own rows; a row that comes again counts once; the setting of the state store is as before."""
    feed = X.feed(spark, sf).drop("ts").filter("base_name < 'd'")
    feed.union(feed.limit(20)).repartition(8).write.parquet(f"{tmp_path}/in")
    stream = feeds.read_stream(spark, f"{tmp_path}/in", feed.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    before = spark.conf.get(state.PROVIDER, None)
    q = feeds.rollup_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert spark.conf.get(state.PROVIDER, None) == before
    read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(read) == 8 and sum(read) == feed.count() + 20
    assert sorted(map(str, feeds.rollups(spark, f"{tmp_path}/out").collect())) == sorted(map(str, title_rollup(feed).collect()))


def test_bursts_join_what_comes_late():
    b = state.Bursts("k", 5)
    assert b._joined([[10_000_000, 10_000_000, 1], [0, 4_000_000, 2], [8_000_000, 8_000_000, 1]]) == [[0, 10_000_000, 4]]
    assert b._joined([[5_000_000, 5_000_000, 1], [0, 0, 1]]) == [[0, 0, 1], [5_000_000, 5_000_000, 1]]


def test_bursts_by_windows_and_by_timers(spark, tmp_path):
    """Rows just the gap apart are two bursts, late rows join bursts, a key may be null; a key has one timer, and no plan of stream_bursts calls Python."""
    import datetime as dt

    at = lambda s: dt.datetime(2000, 1, 1) + dt.timedelta(seconds=s)
    schema = "k long, ts timestamp_ntz"
    batches = [[(1, at(0)), (1, at(20)), (2, at(0)), (2, at(19.999999)), (None, at(3))], [(1, at(10)), (2, at(9.999999)), (3, at(5)), (3, at(500))], [(-1, at(3700))], [(3, at(520)), (-1, at(9000))]]
    for k, some in enumerate(batches):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    got = []
    for name, of in (("windows", feeds.debounced), ("timers", feeds.bursts)):
        stream = feeds.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), lateness="3600 seconds")
        out = of(stream, "k", 10)
        if name == "windows":
            assert "Python" not in out._jdf.queryExecution().logical().toString()
        feeds.append_to(out, f"{tmp_path}/{name}", f"{tmp_path}/cp_{name}").awaitTermination()
        rows = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}").filter("not k <=> -1").selectExpr("k", "cast(first AS timestamp_ntz) AS a", "cast(last AS timestamp_ntz) AS b", "n")
        got.append(sorted(map(tuple, rows.collect()), key=str))
    want = [(1, at(0), at(0), 1), (1, at(10), at(10), 1), (1, at(20), at(20), 1), (2, at(0), at(9.999999), 2), (2, at(19.999999), at(19.999999), 1), (None, at(3), at(3), 1), (3, at(5), at(5), 1), (3, at(500), at(500), 1), (3, at(520), at(520), 1)]
    assert got == [sorted(want, key=str)] * 2


def test_an_end_at_the_watermark_has_not_passed(spark, tmp_path):
    """Memberships that end just at the time asked at stay, as in the SQL; a later grant moves an end; the state has no member's own timer."""
    import datetime as dt

    day = dt.datetime(2000, 1, 10)
    us = dt.timedelta(microseconds=1)
    rows = [(1, day - us), (2, day), (3, day + us), (4, day - 3 * us), (4, day + us), (5, day - 5 * us), (5, day - 2 * us), (None, day - us), (6, None)]
    grants = [(i, dt.datetime(2000, 1, 1), e) for i, e in rows]
    schema = "id long, ts timestamp_ntz, expiry_time timestamp_ntz"
    for k, some in enumerate([grants[::2], grants[1::2], [(-1, day + dt.timedelta(days=30), None)]]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
    stream = feeds.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*"), lateness="30 days")
    out = feeds.expiries(stream.withColumn("expiry_time", stream.expiry_time.cast("timestamp")), buckets=2)
    feeds.append_to(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").selectExpr("id", "cast(expiry_time AS timestamp_ntz) AS e").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, day - us), (5, day - 2 * us), (None, day - us)], key=str)


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    messages = spark.createDataFrame([(k, f"f{k % 40}", f"name {k}", f"c{k // 40}") for k in range(100)], "id long, file_id string, file_name string, caption string")
    stored = spark.createDataFrame([("f0", "name", "c0", "movie")], "file_id string, file_name string, caption string, category string")
    run = lambda last: history.backfill(messages, 0, last, str(tmp_path / "o"), str(tmp_path / "cp"), stored, step=7)
    counts = []
    for last in (39, 39, 99):
        q = run(last)
        q.awaitTermination()
        counts.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert counts == [40, 0, 60]
    assert {r.status: r.n for r in history.outcomes(spark, str(tmp_path / "o")).collect()} == {"suc": 39, "dup": 1, "upd": 40}


def test_history_of_many_steps_is_few_partitions():
    """Partitions don't grow with the history, and hold each number once; a short one is dealt by its step."""
    for first, last, step in ((0, 1_200_000, 1000), (5, 5_000_004, 7), (0, 38, 7), (3, 3, 1), (9, 8, 4)):
        r = history.NumberReader({"first": first, "last": last, "step": step})
        parts = r.partitions(r.initialOffset(), r.latestOffset())
        assert len(parts) == min(history.MOST_PARTITIONS, -(-(last + 1 - first) // step))
        assert [p.low for p in parts[1:]] == [p.high for p in parts[:-1]]
        assert not parts or (parts[0].low, parts[-1].high) == (first, last + 1)


def test_catalog_methods(spark, sf):
    c = Catalog(X.files(spark, sf), ("send",)).with_stop_phrases(("Please", "send"))
    assert c.stop_phrases == ("send", "please")
    assert c.trending(X.nested_search_log(spark, sf)).columns == ["place", "label", "count"]
    assert c.quota(X.downloads(spark, sf), "2024-01-30 12:00:00").columns == ["user_id", "used", "remaining"]
    asked = spark.createDataFrame([("bluue bolt",)], "text string")
    assert c.correct_all(asked).filter("place = 1").count() == 1
    assert len(c.browse(limit=60).collect()) > 40 or X.files(spark, sf).count() < 60
    assert F
