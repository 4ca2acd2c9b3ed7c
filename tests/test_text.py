"""Golden cases of the rules, and the driver's functions against the columns' ones."""

from __future__ import annotations

import random

import pytest
from marquee.functions import alphabets, extract, parse, scalar, text
from marquee.functions import vocab as V
from marquee.operators import fuzzy, rollup, search
from marquee.plans import query as Q
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("said", ["season 1 episode 2", "season1episode2", "s01 e02", "s01.e02", "s1e2", "S01_EP02", "1x02"])
def test_episode_tokens(spark, said):
    assert Q.normalize(said) == "s01e02"
    assert value(spark, parse.normalized(F.lit(f"loki {said}"))) == "loki s01e02"


@pytest.mark.parametrize("name,title", [("Shiddat 2021 480p Hindi BluRay", "Shiddat"), ("Loki S02E01 1080p WEBRip", "Loki"), ("You S01E01 Hindi", "You")])
def test_clean_title(spark, name, title):
    assert value(spark, text.clean_file_title(F.lit(name))) == title


@pytest.mark.parametrize("a,b,score", [("shidat", "shiddat", 92), ("yuth", "youth", 89), ("yoou", "you", 86), ("losst", "lost", 89)])
def test_per_word_score(spark, a, b, score):
    assert value(spark, fuzzy.per_word_score([a], F.array(F.lit(b)))) == score


def test_per_word_score_of_joined_words_is_zero(spark):
    assert value(spark, fuzzy.per_word_score(["iron", "man"], F.array(F.lit("ironman")))) == 0


def test_word_count_guard(spark):
    assert not value(spark, fuzzy.word_count_fits(["you"], F.split(F.lit("now you see me"), " ")))


TIERS = [
    ("welcome to the jungle", "welcome to the jungle", 100), ("welcome to the jungle", "jumanji welcome to the jungle", 60), ("welcome to jungle", "welcome to the jungle", 34),
    ("mirzapur the movie", "Mirzapur S03E04 Hindi 1080p", 0), ("jungle welcome", "welcome jungle", 95), ("welcome", "welcomeback home", 25), ("back", "welcomeback home", 15), ("1080p", "anything", 50),
]


@pytest.mark.parametrize("asked,name,tier", TIERS)
def test_title_tier(spark, asked, name, tier):
    assert value(spark, search.title_tier(F.lit(name), Q.parse(asked))) == tier


def test_year_mismatch_caps_the_tier(spark):
    q = Q.parse("mirzapur 2026")
    row = spark.createDataFrame([("Mirzapur S03E04 Hindi 1080p", None)], "file_name string, caption string").select(search.rank_keys(q)["title_tier"].alias("v")).first()
    assert row[0] == 20


def model_gap(words, wanted):
    best = None
    for s in [i for i, w in enumerate(words) if w == wanted[0]]:
        at = s
        for w in wanted[1:]:
            at = next((j for j in range(at + 1, len(words)) if words[j] == w), None)
            if at is None:
                break
        else:
            best = at - s + 1 - len(wanted) if best is None else min(best, at - s + 1 - len(wanted))
    return best


def test_phrase_gap_against_a_model(spark):
    r = random.Random(5)
    rows = [[r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(300)]
    for wanted in (["a"], ["a", "b"], ["a", "b", "a"]):
        got = spark.createDataFrame([(k, w) for k, w in enumerate(rows)], "k int, w array<string>").select("k", search.phrase_gap(F.col("w"), wanted)).collect()
        assert {k: g for k, g in got} == {k: model_gap(w, wanted) for k, w in enumerate(rows)}


def test_parsing_on_driver_and_in_columns(spark):
    r = random.Random(16)
    parts = ["Loki", "season 2", "Season2episode 3", "s01 e002", "S1.E2", "3x4", "ep 5", "e7", "hindi", "TAMIL", "1999", "2035", "movie", "all episodes", "dom's", "S.W.A.T", "é", "send", "s5", "-", "full season"]
    rows = [r.choice(["", " "]) + r.choice([" ", "  ", "."]).join(r.choices(parts, k=r.randint(0, 7))) for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in rows], "x string")
    for x in parse.parsed(frame, "x").collect():
        q = Q.parse(x.x)
        assert (x.normalized, x.title, x.season, x.episode, x.year, tuple(x.languages), x.wants_movie) == (q.normalized, q.title, q.season, q.episode, q.year, q.languages, q.wants_movie), x.x
    for x in parse.requested(frame, "x").collect():
        assert (x.title, x.year, x.season) == Q.title_year_season(x.x), x.x
    for x, a, b in frame.select("x", parse.cleaned(F.col("x"), ("send", "all")), parse.normalized(F.col("x"))).collect():
        assert (a, b) == (Q.clean(x, ("send", "all")), Q.normalize(x)), x


def test_strip_tech_on_driver_and_in_columns(spark):
    r = random.Random(6)
    words = ["Loki", "S02E01", "s3", "1999", "1080p", "web-dl", "hindi", "dom's", "S.W.A.T", "é", "DDP5.1", "x"]
    rows = [" ".join(r.choices(words, k=r.randint(0, 7))) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.strip_tech(F.col("x"))).collect()
    assert all(b == Q.strip_tech(a) for a, b in got)


def test_season_facet(spark):
    files = spark.createDataFrame([("a", "X S30E01", None), ("b", "X S03E05", None)], "file_id string, file_name string, caption string")
    assert [r.file_id for r in search.with_season(files, 3).collect()] == ["b"]


@pytest.mark.parametrize("said,found", [("Avengers", []), ("Hindi ESubs", []), ("Hindi Dual", ["Hindi"]), ("Tam + Eng", ["English", "Tamil"])])
def test_feed_languages(spark, said, found):
    assert value(spark, extract.feed_languages(F.lit(said))) == found


@pytest.mark.parametrize("said,want", [("pushpa 2", ("pushpa 2", None, None)), ("ironman 2003", ("ironman", "2003", None)), ("suits s02", ("suits", None, 2)), ("suits s02 2011", ("suits s02", "2011", None))])
def test_manual_query(said, want):
    assert Q.title_year_season(said) == want


def test_small_functions(spark):
    assert value(spark, text.fuzzy_normal(F.lit("moovie"))) == "movie"
    assert [value(spark, scalar.duration_seconds(F.lit(x))) for x in ("1month", "2day", "5x", "")] == [2592000, 172800, 0, 0]
    assert value(spark, scalar.size_label(F.lit(1536))) == "1.50 KB"
    assert value(spark, text.decorate(F.lit("Ab 1"), "bold")) == "\U0001d400\U0001d41b 1"
    assert value(spark, text.joined(F.array().cast("array<string>"))) == "N/A"
    assert value(spark, text.after_marker(F.lit("File: a.mkv "), "File:")) == "a.mkv"
    assert value(spark, extract.feed_season_episode(F.lit("Show EP01-04"))[1]) == "1-4"
    assert value(spark, text.drop_ignored(F.lit("Loki Hindi WEBRip 2021"))) == "Loki 2021"


def test_parse():
    q = Q.parse("Mirzapur season 2 episode 3 hindi 2020")
    assert (q.title, q.season, q.episode, q.year, q.languages, q.is_series) == ("Mirzapur", 2, 3, 2020, ("hindi",), True)
    assert Q.prepare("please!", ("please",)) is None
    assert Q.prepare("send Iron-Man movie", ("send",)).wants_movie


def test_episode_ranges(spark):
    rows = [("t", 1, e) for e in ("1", "2", "3", "5", "7-9")] + [("t", 2, "4"), ("t", None, "4"), ("t", 3, None)]
    got = rollup.episode_ranges(spark.createDataFrame(rows, "base_name string, season int, episode string")).collect()
    assert sorted(r.episodes for r in got) == ["S1: 1-3, 5, 7-9", "S2: 4"]


def test_similarity_and_suggestions(spark):
    assert fuzzy.similarity("iron man", "iron-man") == 100
    assert fuzzy.similarity("", "x") == 0
    assert fuzzy.similarity("ironman", "the ironman returns") == 100
    c = spark.createDataFrame([("Loki", 0), ("LOKI", 1), ("Zzz", 2)], "title string, place int")
    assert [tuple(r) for r in fuzzy.suggestions(c, "loki").collect()] == [("Loki", 100)]


def test_spelling(spark):
    titles = spark.createDataFrame([("shiddat", "Shiddat 2021 480p"), ("now you see me", "Now You See Me"), ("you", "You S01E01 Hindi")], "base string, original string")
    assert fuzzy.correct(titles, Q.parse("shidat")) == "Shiddat"
    assert fuzzy.correct(titles, Q.parse("yoou")) == "You"
    assert fuzzy.correct(titles, Q.parse("qqqqqq")) is None


def test_quality_tables_are_ordered():
    assert V.QUALITY_SCORES[0] == ("remux", 98) and dict(V.RESOLUTION_SCORES)["4k"] == 200


def test_media_info(spark):
    posts = spark.createDataFrame([(1, "@x Loki.S02E01.1080p.WEBRip.Hindi", "Loki S02E01 1080p WEBRip Hindi NF"), (2, "Shiddat.2021.Hindi", None)], "id int, file_name string, caption string")
    a, b = rollup.media_info(posts).orderBy("id").collect()
    assert (a.base_name, a.tag, a.season, a.episode, a.resolution, a.ott_platform, a.language) == ("Loki", "#SERIES", 2, "1", "1080p", "Netflix", "Hindi")
    assert (b.base_name, b.tag, b.year) == ("Shiddat 2021", "#MOVIE", "2021")


def test_encode_id(spark):
    import base64

    def model(s: bytes) -> str:
        out, n = b"", 0
        for i in s + bytes([22, 4]):
            if i == 0:
                n += 1
                continue
            out, n = out + (bytes([0, n]) if n else b"") + bytes([i]), 0
        return base64.urlsafe_b64encode(out).decode().rstrip("=")

    ids = [b"", b"\0\0\0", b"\1\0\0\2", bytes(range(24)), b"\xff\xfe\0\0\0\0\0\0\0\3"]
    got = spark.createDataFrame([(bytearray(x),) for x in ids], "x binary").select(extract.encode_id(F.col("x"))).collect()
    assert [r[0] for r in got] == [model(x) for x in ids]


@pytest.mark.parametrize(
    "alphabet,said,want",
    [
        ("typewriter", "Az 1", "\U0001d670\U0001d6a3 1"),
        ("serif", "Ab 1", "\U0001d400\U0001d41b \U0001d7cf"),
        ("outline", "CDh0", "\u2102\U0001d53b\U0001d559\U0001d7d8"),
        ("cool", "gh", "\U0001d454\u210e"),
        ("small_cap", "Ajx", "A\u026ax"),
        ("manga", "Ii-", "||-"),
        ("gothic_bolt", "DO", "\U0001d57a\U0001d57a"),
        ("circles", "a1", "\u24b6\ufe0e\u2460"),
        ("circle_dark", "Zz0", "\U0001f169\U0001f169\ufe0e\u24ff"),
        ("special", "a b", "\U0001f1e6\u200a \U0001f1e7\u200a"),
        ("cloud", "a1B", "a\u0361\u035c1B\u0361\u035c"),
        ("bubbles", "a", "a\u0366\u0325"),
        ("strike", "", ""),
    ],
)
def test_alphabets(spark, alphabet, said, want):
    assert value(spark, text.decorate(F.lit(said), alphabet)) == want
    assert value(spark, text.decorate(F.lit(None).cast("string"), alphabet)) is None


def test_decorating_a_small_file_is_many_tasks(spark, sf):
    from marquee.queries import QUERIES

    parts = QUERIES["decorated"](spark, sf).select("id", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in parts) == 200


def test_alphabets_are_whole():
    assert len(alphabets.NAMES) == 41
    for name in alphabets.NAMES:
        plain, fancy = alphabets.swaps(name)
        assert len(plain) == len(fancy) == len(set(plain)) or not plain
        assert plain or alphabets.marked(name)[1]
