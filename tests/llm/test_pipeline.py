"""The registered queries against their SQL, and each pipeline stage against what its operator decides on the stage's own input."""

from __future__ import annotations

import hashlib
import random
import zlib

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from marquee.llm import frames
from marquee.llm.decontaminate import find_contamination
from marquee.llm.frames import table, written
from marquee.llm.langid import held_out, identify, train
from marquee.llm.line_dedup import LINE_DEDUP_SQL
from marquee.llm.mixing import MIX_SQL
from marquee.llm.queries import ORACLES, QUERIES
from marquee.llm.shingle_join import link_components
from oracle import same_rows
from pyspark.sql import functions as F

from .data import documents
from .test_operators_llm import brute_spans


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf))
        ids = {r[0] for r in docs.select("doc_id").collect()}
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name != names[-1]:
            assert out.columns == columns and out.schema == docs.schema
        if name == "language_id":
            model = train(docs.filter(~held_out(F.col("doc_id"))))
            found = {r.doc_id for r in identify(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert kept == found
        if name in ("line_dedup", "mixing"):
            # the operator's SQL on the stage's own input
            con = duckdb.connect()
            con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
            want = con.sql({"line_dedup": LINE_DEDUP_SQL, "mixing": MIX_SQL}[name])
            if name == "mixing":
                assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
            else:
                digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
                assert sorted((r.doc_id, digest(r.text)) for r in out.collect()) == sorted((r[0], r[3]) for r in want.fetchall())
                assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_duplicates":
            classes = link_components(docs, width=5, num=80, den=100).collect()
            assert kept == {r.component_id for r in classes}
        if name == "decontamination":
            assert ids - kept == {r[0] for r in find_contamination(docs, table(spark, sf, "benchmark")).filter("contaminated").collect()}
        if name == "mixing":
            assert kept == ids
        docs = out
    before = frames.made()
    ran = corpus_pipeline.run(spark, sf)
    assert frames.made() - before <= 3  # the last stage's input and what the mix has written
    assert sorted(map(str, ran.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_tables(spark, sf):
    rows, schema = documents(odd=True)
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, sf))
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()


def test_op2_strings(spark, sf):
    """The registered query's digests and strings against plain patterns, for every document."""
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op2_personal_data"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = [f"{k}:{s}:{e}" for k, s, e in brute_spans(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        said = [x for x in r.spans.split(",") if x]
        assert [x for x in said if x in base] == base
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
        order = [(("email", "ip", "card", "phone").index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in said)]
        assert order == sorted(order) and all(0 <= s < e <= len(texts[r.doc_id]) for _, s, e in order)


def test_op7_on_held_out_rows(spark, sf):
    rows = QUERIES["op7_langid"](spark, sf).collect()
    truth = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(truth) and all(r.held_out == truth[r.doc_id][1] and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id][0] for r in rows if r.held_out]
    assert held and sum(held) >= 0.97 * len(held)

def test_language_stage(spark):
    """A text that halves share stays if one language has most words; texts without a letter go; a missing lang is filled in."""
    r = random.Random(3)
    words = {"en": "the of and house with that river".split(), "ru": "дом река и что это был свет".split()}
    rows = [(k, " ".join(r.choices(words[g], k=40)), g if k % 5 else None) for k, g in enumerate(r.choices(list(words), k=200))]
    rows += [(900, " ".join(r.choices(words["en"], k=30) + r.choices(words["ru"], k=10)), None), (901, "12 + 3", "en"), (902, None, None), (903, "", "ru"), (904, "日本 語 文", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    truth = {k: ("ru" if "о" in t or "и" in t else "en") for k, t, _ in rows[:200]}
    assert got == truth | {900: "en"}


def test_near_duplicates_against_brute_force(spark):
    """Shingles of five words at 0.8: two separated edits of a word in 104 link, which three words at 0.9 do not."""
    r = random.Random(14)
    rows = []
    for _ in range(30):
        w = [f"w{r.randrange(500)}" for _ in range(104)]
        rows.append(" ".join(w))
        for edits in ((30, 70), (20, 50, 80), (10, 30, 50, 70, 90)):
            rows.append(" ".join(f"Edit{k}" if k in edits else x for k, x in enumerate(w)))
    rows += ["one two three", "ONE two three", "one two", "", None]
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split()) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    again = docs.union(docs.filter("doc_id % 7 = 0")).union(docs.filter("doc_id = 0"))
    kept = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, again, "").collect()]
    assert len(kept) == len(set(kept))
    assert set(kept) == {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    kept = set(kept)
    assert kept == {k for k in range(len(rows)) if find(k) == k}
    assert 1 not in kept and 3 in kept


def test_release_removes_what_was_written(spark):
    one = written(spark.range(5))
    path = frames._TABLES[-1]
    assert one.count() == 5 and spark.read.parquet(path).count() == 5
    at = frames.made()
    two, three = written(spark.range(3)), written(spark.range(4))
    frames.release(spark, at, keep=three)
    assert three.count() == 4 and one.count() == 5 and frames.made() == at + 1
    frames.release(spark)
    assert not frames._TABLES
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
