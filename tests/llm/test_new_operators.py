"""Operators 11 to 13 against brute force, on tables with nulls, ties, repeated rows, odd vectors and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from marquee.llm import golden, minmax, shingle_join, url_rules, vector_codes
from marquee.llm.kernel import splitmix
from marquee.llm.queries import QUERIES

from .data import documents
from .test_operators_llm import LOWER, WORD

# ---- 11


def brute_links(rows: list[tuple], num: int, den: int) -> tuple[dict, dict]:
    """(doc_id: set of shingles per text, doc_id: component), rows of one id are one document."""
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc_id].append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    ids = [x for x in sets if x is not None]
    least = {x: x for x in ids}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return sets, {x: root(x) for x in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows, schema = documents(seed)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    sets, component = brute_links([r[:2] for r in rows], 85, 100)
    want = sorted((str(r[0]), None if r[0] is None else component[r[0]]) for r in rows)
    got = minmax.near_duplicates(docs, bucket_bytes=1 << 12).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert all(r.n_shingles in [len(s) for s in sets[r.doc_id]] for r in got)
    assert minmax.near_duplicates(docs.limit(0)).collect() == []


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    for share in (0.95, 0.85, 0.5):
        pool = splitmix(r.integers(0, 1 << 60, 3000).astype(np.uint64)) >> np.uint64(10)
        n = int(2000 * share / (2 - share) * 2 / 2)
        common, one, two = pool[:n], pool[n : n + (2000 - n)], pool[n + (2000 - n) : n + 2 * (2000 - n)]
        sets = [np.concatenate([common, x]) for x in (one, two)]
        s = minmax.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        half = s.shape[1] // 2
        assert abs((s[0] == s[1]).mean() - true) < 0.1
        assert abs((s[0] == s[1])[:half].mean() - (s[0] == s[1])[half:].mean()) < 0.2
    assert (1 - 0.85**minmax.ROWS) ** (2 * minmax.PERMUTATIONS // minmax.ROWS) < 1e-8


def test_near_pairs_at_the_limit_are_found(spark):
    """200 pairs of just above and just below 0.85, which nothing else links."""
    r, rows, want = random.Random(4), [], {}
    for k in range(200):
        w = [f"p{k}w{x}" for x in range(r.randint(60, 200))]
        at = r.randint(5, len(w) - 5)
        v = list(w)
        for x in range(r.choice([1, 2, 3, 4])):
            v[min(at + 2 * x, len(v) - 1)] = f"z{k}{x}"
        a, b = ({tuple(y[j : j + 3]) for j in range(len(y) - 2)} for y in (w, v))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 85 * len(a | b) else 2 * k + 1
    got = {x.doc_id: x.component_id for x in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and len(set(want.values())) < 400


def test_split_lists_lose_nothing(spark, monkeypatch):
    """Lists that are estimated as long are split over buckets and blocks."""
    monkeypatch.setattr(minmax, "LONG_LIST", 4)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"x{r.randrange(90)}"
        rows.append((k, " ".join(w)))
    _, component = brute_links(rows, 85, 100)
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_bytes=1 << 10).collect()
    assert {x.doc_id: x.component_id for x in got} == component


# ---- 12

FIELDS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def some_clients(seed: int, n: int) -> list[tuple]:
    r, day = random.Random(seed), datetime(2024, 3, 1)
    blank = lambda *xs: r.choice([None, "", " \t\n", *xs])
    at = lambda: r.choice([None, day, day - timedelta(days=30), day - timedelta(days=30, microseconds=1), day - timedelta(days=r.randrange(90))])
    rows = []
    for k in range(n):
        master = r.choice([None, 0, 0, 0, r.randrange(n // 4)])
        rows.append((r.choice([None, k, k, k]), master, blank("crm", "web", "store", "partner", "other"), at(), blank("Ann Röy", "Ann R", "Åsa", " Bo "), blank("a@b.c", "d@e.f"), blank("Cor", "Bel"), r.choice([None, 1, 2]), blank("retail", "public"), r.choice([None, 1.005, -2.5, 7.0, math.nan, math.inf])))
    return rows + rows[:9] + rows[:3]


def brute_golden(rows: list[tuple]) -> list[tuple]:
    clusters = defaultdict(list)
    for row in rows:
        c = dict(zip(FIELDS, row, strict=True))
        for f in ("source", "name", "email", "city", "segment"):
            if c[f] is not None and not c[f].strip(" \t\n\x0b\x0c\r"):
                c[f] = None
        if c["balance"] is not None and not math.isfinite(c["balance"]):
            c["balance"] = None
        clusters[c["client_id"] if c["master_id"] is None else c["master_id"]].append(c)
    out = []
    for cluster, records in clusters.items():
        last = max((c["updated_at"] for c in records if c["updated_at"]), default=None)
        for c in records:
            c["trust"] = golden.TRUST.index(c["source"]) if c["source"] in golden.TRUST else 4
            c["stale"] = c["updated_at"] is None or last - c["updated_at"] > timedelta(days=30)
            c["filled"] = (c["city"] is not None) + (c["nation_id"] is not None)
            time = (1, 0) if c["updated_at"] is None else (0, -(c["updated_at"] - datetime(2000, 1, 1)) / timedelta(microseconds=1))
            # records that tie are ordered by all their fields, nulls first, as structs are
            rest = [(c[f] is not None, c[f] if c[f] is not None else 0) for f in ("nation_id", "balance", "name", "email", "city", "segment")]
            c["recent"] = (time, c["trust"], (c["client_id"] is None, c["client_id"] or 0), c["filled"], rest)
            c["trusted"] = (c["stale"], c["trust"], c["recent"])
        first = lambda f, key: min((c for c in records if c[f] is not None), key=key, default={})  # noqa: E731, B023
        segment, email = first("segment", lambda c: c["recent"]), first("email", lambda c: c["trusted"])
        name = first("name", lambda c: (-len(c["name"]), c["trusted"]))
        balance = first("balance", lambda c: (c["segment"] != segment.get("segment"), c["recent"]))  # noqa: B023
        address = min(records, key=lambda c: (-c["filled"], c["trusted"]))
        cents = math.floor(100 * balance["balance"] + 0.5) if balance else None
        out.append((cluster, len(records), sum(c["stale"] for c in records), name.get("name"), email.get("email"), segment.get("segment"), address["city"], address["nation_id"], cents, *[x.get("client_id") for x in (name, email, segment, balance)], address["client_id"] if address["filled"] else None))
    return out


@pytest.mark.parametrize(("seed", "group_rows"), [(1, 128), (2, 6), (3, 20)])
def test_golden_records(spark, seed, group_rows):
    rows = some_clients(seed, 400)
    clients = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], f"{CLIENTS}, cluster string, `r.x` string, copies int").repartition(5)
    got = golden.golden_records(clients, group_rows=group_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_golden(rows), key=str)


def test_golden_records_of_odd_tables(spark):
    assert golden.golden_records(spark.createDataFrame([], CLIENTS)).collect() == []
    nothing = spark.createDataFrame([(None,) * 10] * 300, CLIENTS)
    assert [tuple(r) for r in golden.golden_records(nothing).collect()] == [(None, 300, 300, *[None] * 11)]


def test_large_clusters_meet_in_small_groups(spark):
    """No window of a reduction or of the last step has more rows than group_rows, however large the cluster."""
    rows = [(k, 0, "web", datetime(2024, 1, 1), f"n{k}", None, None, None, f"s{k}", 1.0) for k in range(3000)]
    seen = []
    keep = golden._filled

    def counted(frame, key):
        seen.append(frame.groupBy(*key).count().agg({"count": "max"}).first()[0])
        return keep(frame, key)

    golden._filled = counted
    try:
        out = golden.golden_records(spark.createDataFrame(rows, CLIENTS), group_rows=50).collect()
    finally:
        golden._filled = keep
    assert len(out) == 1 and out[0].n_records == 3000 and len(seen) >= 3
    assert max(seen) <= 100  # groups are dealt by a hash: about group_rows


# ---- 13


def brute_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], list]:
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < vector_codes.LIMIT / 256 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return [], []
    w = len(kept[0][2]) // parts
    part = lambda v, k: v[k * w : (k + 1) * w]
    books = [[part(r[2], k) for r in kept[:entries]] for k in range(parts)]
    distance = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[k])), key=lambda e: (distance(part(v, k), books[k][e]), e)) for k in range(parts)] for _, _, v in kept]  # noqa: B023
        if turn < rounds:
            for k in range(parts):
                for e in range(len(books[k])):
                    if mine := [part(r[2], k) for r, c in zip(kept, codes, strict=True) if c[k] == e]:
                        books[k][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(distance(part(v, k), books[k][c[k]]) for k in range(parts)) for (_, _, v), c in zip(kept, codes, strict=True)]
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return [(i, label, bytes(c).hex(), e, by_label[label]) for (i, label, _), c, e in zip(kept, codes, errors, strict=True)], books


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes(spark, seed):
    r = random.Random(seed)
    rows = [(k, [r.choice([0.0, -0.5, 0.25, r.uniform(-1, 1)]) for _ in range(8)], r.choice([None, 1, 2])) for k in range(120)]
    rows += [(500, None, 1), (501, [1.0, None, *[0.0] * 6], 1), (502, [math.nan] * 8, 1), (503, [math.inf] * 8, 1), (504, [1e30] * 8, 1), (505, [], 1), (506, [1.0] * 7, 1), (507, [1.0] * 16, 1)]
    rows += [(None, [0.5] * 8, None), (3, [0.1] * 8, 2), rows[5], rows[5], (508, [-1000.0] * 8, 2)]
    frame = spark.createDataFrame([(*x, "c", "c") for x in rows], "vec_id long, embedding array<double>, label int, code string, `a.b` string").repartition(3)
    want, books = brute_codes(rows, 4, 10, 2)
    got, learned = vector_codes.encode_vectors(frame, n_parts=4, n_entries=10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [b.tolist() for b in learned] == books
    assert vector_codes.codebooks_digest(learned) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_vector_codes_of_few_rows(spark):
    none, books = vector_codes.encode_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert none.collect() == [] and books == []
    rows = [(2, [float(k) for k in range(16)], None), (1, [0.0] * 16, None)]
    got, _ = vector_codes.encode_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect())) == [(1, None, "00" * 16, 0, 0), (2, None, "00" + "01" * 15, 0, 0)]


def test_exponion_scans_few_entries_and_finds_the_nearest():
    r = np.random.default_rng(1)
    for width in (1, 4):
        book = vector_codes.Codebook(np.vstack([r.integers(-200, 200, (60, width)), np.zeros((4, width), dtype=np.int64)]))
        parts = r.integers(-250, 250, (3000, width))
        apart = ((parts[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        for start in (np.zeros(3000, dtype=np.int64), apart.argmin(axis=1)):
            entry, least = book.nearest(parts, start)
            assert (entry == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()


# ---- native operators over real links


def executed_plans(spark, run) -> list[str]:
    """The physical plans of all jobs that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = store.executionsList()
    return [rows.apply(k).physicalPlanDescription() for k in range(before, rows.size())]


def test_links_between_pages_take_no_python(spark, sf, tmp_path):
    """Pages with canonical and refresh links, and classes of a shared path: no job of the rounds runs Python."""
    html = '<link rel="canonical" href="http://h{}.example.net/{}"><meta http-equiv="refresh" content="0; url=http://h{}.example.com/de/{}">'
    pages = spark.createDataFrame([(k, f"http://h{k}.org/{k}", html.format(k // 2, k // 2, k // 3, k // 3)) for k in range(60)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")  # rows from Python would be in the plans
    pages = spark.read.parquet(f"{tmp_path}/pages")
    plans = executed_plans(spark, lambda: url_rules.judge(pages).collect()) + executed_plans(spark, lambda: QUERIES["url_mirrors"](spark, sf).collect())
    assert len(plans) > 6 and not [x[0] for p in plans if (x := re.search(".*(Python|Pandas|Arrow).*", p))]
    verdicts = {r.verdict for r in url_rules.judge(pages).collect()}
    assert verdicts == {"allow", "block"} or verdicts == {"block"}


def test_golden_records_take_no_python_and_no_broadcast(spark, tmp_path):
    spark.createDataFrame(some_clients(5, 300), CLIENTS).write.parquet(f"{tmp_path}/c")
    clients = spark.read.parquet(f"{tmp_path}/c")
    plans = executed_plans(spark, lambda: golden.golden_records(clients, group_rows=8).collect())
    assert len(plans) > 6 and not [x[0] for p in plans if (x := re.search(".*(Python|Pandas|Arrow|BroadcastHashJoin|BroadcastNestedLoop).*", p))]
