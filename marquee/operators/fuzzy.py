"""Spelling: similarity of words, correction against the title dictionary, suggestions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import alike, text
from ..functions import vocab as V
from ..plans.query import Query, collapse, strip_tech
from .contain import grams


def common_length(word: str, other: Column) -> Column:
    """The length of the longest common subsequence with a literal word: one row of the table per letter, in the JVM."""
    letters = F.split(other, "")
    start = F.transform(F.concat(F.array(F.lit("")), letters), lambda _: F.lit(0))

    def step(row: Column, c: Column) -> Column:
        def cell(done: Column, k: Column) -> Column:
            grown = F.when(F.element_at(letters, k) == c, F.element_at(row, k) + 1).otherwise(F.greatest(F.element_at(row, k + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(grown))

        return F.aggregate(F.sequence(F.lit(1), F.size(letters)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(F.array(*[F.lit(c) for c in word]), start, step), -1)


def ratio(word: str, other: Column) -> Column:
    """Similarity in percent, 2 * common / both lengths, rounded."""
    total = F.length(other) + len(word)
    return F.when(total > 0, F.round(200 * common_length(word, other) / total).cast("int")).otherwise(0)


def per_word_score(wanted: list[str], candidate_words: Column) -> Column:
    """The mean over the wanted words of their best candidate: 100 if equal but for marks, else the ratio of words at most two letters longer or shorter."""
    if not wanted:
        return F.lit(0)

    def best(w: str) -> Column:
        alike = F.transform(
            candidate_words, lambda c: F.when(text.collapse(c) == collapse(w), 100).when(F.abs(F.length(c) - len(w)) <= 2, ratio(w, c)).otherwise(0)
        )
        return F.coalesce(F.array_max(alike), F.lit(0))

    return F.floor(sum((best(w) for w in wanted[1:]), best(wanted[0])) / len(wanted)).cast("int")


def may_score(wanted: list[str], candidate_words: Column, least: int) -> Column:
    """Whether per_word_score() can reach `least`: a word's share is bounded by its edit distance, which changes and
    removals take part in at most once each, and every other word can give 100 at most."""
    share = least * len(wanted) - 100 * (len(wanted) - 1)

    def near(w: str) -> Column:
        total = lambda c: F.length(c) + len(w)
        alike = lambda c: (F.abs(F.length(c) - len(w)) <= 2) & (100 * (total(c) - F.levenshtein(F.lit(w), c)) >= (share - 1) * total(c))
        return F.exists(candidate_words, lambda c: alike(c) | (text.collapse(c) == collapse(w)))

    return reduce(and_, [near(w) for w in wanted], F.lit(True))


def word_count_fits(wanted: list[str], candidate_words: Column) -> Column:
    return F.size(candidate_words) <= len(wanted) + 1


def spell_candidates(titles: DataFrame, q: Query, least: int = V.SPELL_LEAST, limit: int = V.SPELL_TRIED) -> DataFrame:
    """(base, original, score): titles that what was typed may mean, the likeliest first, ties by base.

    titles: (base, original). The guards of length are in a filter of their own, before any scoring.
    """
    wanted = strip_tech(q.title or q.raw).split()
    letters = collapse(" ".join(wanted))
    rows = titles.withColumn("words", text.words(F.col("base")))
    same = text.collapse(F.col("base")) == letters
    rows = rows.filter(same | word_count_fits(wanted, F.col("words")) & may_score(wanted, F.col("words"), least))
    scored = rows.withColumn("score", F.when(same, 100).otherwise(per_word_score(wanted, F.col("words"))))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "base").limit(limit).select("base", "original", "score")


def correct(titles: DataFrame, q: Query) -> str | None:
    """The corrected title: all dictionary titles are in the store, so the best candidate is the answer."""
    row = spell_candidates(titles, q, limit=1).select(text.clean_file_title(F.col("original"))).first()
    return row[0] if row else None


def similarity(a: str, b: str) -> int:
    """Of two cleaned texts: 100 if equal but for marks, else the better of the whole ratio and the best window of the longer one."""
    return int(alike.similarities(pa.array([a]), pa.array([b]))[0])


def scored_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with their similarity: the window ratio has no built-in form, so all pairs of an Arrow batch are compared at once."""
    names = [f.name for f in pairs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = alike.similarities(batch.column(names.index(a)), batch.column(names.index(b)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype("int32"))], [*names, "score"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.IntegerType())]))


# ---- all texts at once: words by what is left of them


#: Words of more letters are compared with all words of nearly the same length: they have too many parts to list.
LONGEST_LISTED = 24


def _left_out(x: Column, n: Column) -> Column:
    """All texts that are x without n of its letters."""
    one = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda k: F.concat(F.substr(v, F.lit(1), k - 1), F.substr(v, k + 1, F.length(v))))
    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(x), lambda done, _: F.array_distinct(F.flatten(F.transform(done, one))))


def word_parts(x: Column, least: int, apart: int = 2) -> Column:
    """What words of which a pair may score `least` have in common at the least: subsequences of x, of the
    lengths that x and a word of up to `apart` letters more or less must share."""
    n = F.length(x)
    needed = lambda m: F.ceil((2 * least - 1) * (n + m) / 400).cast("int")  # noqa: E731  half of the ratio's bound of both lengths
    lengths = F.filter(F.sequence(F.greatest(F.lit(1), n - apart), n + apart), lambda m: needed(m) <= F.least(n, m))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(lengths, lambda m: n - needed(m))), lambda k: _left_out(x, k))))


def near_words(words: DataFrame, dictionary: DataFrame, least: int) -> DataFrame:
    """(w, c): each word w with all dictionary words c that score `least` or more with it.

    Both are looked up by their parts, so a word meets only words that share a long subsequence with it.
    """
    w, c = words.filter("w <> ''").distinct(), dictionary.filter("c <> ''").distinct()
    listed = lambda rows, x: rows.filter(F.length(x) <= LONGEST_LISTED).select(x, F.explode(word_parts(F.col(x), least)).alias("part"))
    pairs = listed(w, "w").join(listed(c, "c"), "part").select("w", "c")
    sizes = lambda x: F.explode(F.sequence(F.length(x) - 2, F.length(x) + 2))
    long_ = w.filter(F.length("w") > LONGEST_LISTED - 2).withColumn("size", sizes("w")).join(c.filter(F.length("c") > LONGEST_LISTED - 2).withColumn("size", F.length("c")), "size").select("w", "c")
    same = w.join(c, text.collapse(F.col("w")) == text.collapse(F.col("c"))).filter(text.collapse(F.col("w")) != "").select("w", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = alike.word_scores(batch.column(0), batch.column(1)) >= least
            yield batch.filter(pa.array(good))

    return pairs.union(long_).distinct().mapInArrow(run, "w string, c string").union(same).distinct()


def corrections(asked: DataFrame, titles: DataFrame, least: int = V.SPELL_LEAST, limit: int = V.SPELL_TRIED) -> DataFrame:
    """(text, base, original, score, place): for each distinct text of asked, the titles that it may mean, as spell_candidates() finds them for one.

    asked: (text), stripped of technical words; titles: (base, original). A mean of at least `least` needs
    one word that scores so much, so a text's candidates are the titles with a near word of some of its
    words; they are looked up by word. Texts without words mean nothing.
    """
    texts = asked.select("text").filter("text <> ''").distinct().withColumn("wanted", text.words(F.col("text")))
    bases = titles.withColumn("words", text.words(F.col("base")))
    held = texts.select("text", F.size("wanted").alias("n"), F.explode("wanted").alias("w"))
    postings = bases.select("base", F.size("words").alias("m"), F.explode(F.array_distinct("words")).alias("c"))
    near = near_words(held.select("w"), postings.select("c"), least)
    by_word = held.join(near, "w").join(postings, "c").filter("m <= n + 1").select("text", "base")
    letters = texts.select("text", text.collapse(F.col("text")).alias("k")).join(bases.select("base", text.collapse(F.col("base")).alias("k")), "k").select("text", "base")
    pairs = by_word.union(letters).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(0), batch.column(1)
            split = lambda x: pc.split_pattern_regex(pc.utf8_trim(x, " "), " +")
            score = alike.mean_of_best(split(one), split(two))
            score[pc.equal(alike.collapsed(one), alike.collapsed(two)).to_numpy(zero_copy_only=False)] = 100
            good = score >= least
            yield pa.RecordBatch.from_arrays([one.filter(pa.array(good)), two.filter(pa.array(good)), pa.array(score[good].astype("int32"))], ["text", "base", "score"])

    scored = pairs.mapInArrow(run, "text string, base string, score int")
    best = Window.partitionBy("text").orderBy(F.desc("score"), "base")
    ranked = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    return ranked.join(titles, "base").select("text", "base", "original", "score", "place")


def suggestions(candidates: DataFrame, asked: str, least: int = V.SUGGEST_LEAST, limit: int = V.SUGGESTED) -> DataFrame:
    """(title, score) of outside candidates (title, place): each once whatever its case, the likeliest first."""
    once = candidates.groupBy(F.lower("title").alias("k")).agg(F.min_by("title", "place").alias("title"), F.min("place").alias("place"))
    clean = once.select("title", "place", text.strip_tech(F.col("k")).alias("a"), F.lit(strip_tech(asked)).alias("b"))
    return scored_pairs(clean, "a", "b").filter(F.col("score") >= least).orderBy(F.desc("score"), "place").limit(limit).select("title", "score")


#: Letters of the pieces by which alike texts are found.
PIECE = 4


def _pieces(x: Column, least: int, gap: int) -> Column:
    """Pieces of x of which a longer text (by `gap` letters at most) that scores `least` with x has one as it is.

    Letters of both texts outside the common subsequence are a bounded share of all; each spoils one piece at most, so there is one piece more than such letters.
    """
    n = F.length(x)
    spoiled = F.floor((2 * n + gap) * (201 - 2 * least) / 200).cast("int")
    cut = lambda i: F.floor(i * n / (spoiled + 1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), spoiled), lambda i: F.substr(x, cut(i) + 1, F.least(cut(i + 1) - cut(i), F.lit(PIECE))))
    # a text of fewer letters than pieces may have nothing in common with another one
    return F.array_distinct(each)


def _held_pieces(x: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), *[F.transform(grams(x, k), lambda g: g["gram"]) for k in range(1, PIECE + 1)]))


def alike_pairs(a: DataFrame, b: DataFrame, least: int, gap: int) -> DataFrame:
    """(a, b): all pairs of texts, of nearly the same length, that may score `least`: those of which the longer has a piece of the shorter."""
    pieces = lambda rows, x: rows.select(x, F.explode(_pieces(F.col(x), least, gap)).alias("piece"))
    held = lambda rows, x: rows.select(x, F.explode(_held_pieces(F.col(x))).alias("piece"))
    one = pieces(a, "a").join(held(b, "b"), "piece").filter((F.length("a") <= F.length("b")) & (F.length("b") - F.length("a") <= gap))
    two = held(a, "a").join(pieces(b, "b"), "piece").filter((F.length("b") < F.length("a")) & (F.length("a") - F.length("b") <= gap))
    return one.select("a", "b").union(two.select("a", "b")).distinct()


def in_store(suggested: DataFrame, titles: DataFrame, least: int = V.IN_STORE_LEAST, gap: int = V.IN_STORE_GAP) -> DataFrame:
    """The suggested titles that the dictionary has: the same letters, or alike and of nearly the same length. Distinct cleaned texts meet by their pieces."""
    s = suggested.select("title", text.strip_tech(F.regexp_replace("title", r"\s*\(\d{4}\)\s*$", "")).alias("a"))
    t = titles.select(F.col("base").alias("b")).distinct()
    same = text.collapse(F.col("a")) == text.collapse(F.col("b"))
    exact = s.join(t, same, "left_semi").select("title")
    left = s.join(t, same, "left_anti").select("a").distinct()
    good = scored_pairs(alike_pairs(left, t, least, gap), "a", "b").filter(F.col("score") >= least).select("a").distinct()
    return exact.union(s.join(good, "a", "left_semi").select("title")).distinct()
