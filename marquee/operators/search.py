"""Search: the predicate, the ranking and the page, as one plan of built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions import extract, text
from ..functions import vocab as V
from ..plans.query import Query, collapse, strip_tech
from ..sources.catalog import federate_filtered
from ..sources.index import TextIndex
from .order import placed


def quoted(x: str) -> str:
    """A literal for Java patterns."""
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in x)


def matches(x: Column, q: Query, norm: str | None = None) -> Column:
    """Whether a text has the query: its letters in a row, or all its words, or the phrase.

    A word is looked for with a plain search first, which spares most texts the pattern; texts beyond ASCII have
    letters that only the pattern equates.
    """
    norm = q.raw if norm is None else norm
    low, plain = F.lower(x), F.octet_length(x) == F.length(x)
    bounded = lambda w, pattern: (~plain | low.contains(w.lower())) & x.rlike(text.rx(pattern))
    found = low.contains(norm.lower()) if " " in norm else bounded(norm, rf"(\b|[._\-+\[\]()\s]){quoted(norm)}(\b|[._\-+\[\]()\s]|$)")
    if words := [w for w in norm.split() if len(w) > 1]:
        found = found | reduce(and_, [bounded(w, rf"\b{quoted(w)}\b") for w in words])
    if letters := collapse(q.title or norm):
        found = found | low.rlike("[^a-z0-9]*".join(letters))
    return F.coalesce(found, F.lit(False))


def phrase_gap(file_words: Column, wanted: list[str]) -> Column:
    """The least number of words between the first and the last wanted word, in their order; null if they are not there in order."""
    n = F.size(file_words)

    def step(at: Column, w: Column) -> Column:
        ahead = F.array_position(F.slice(file_words, at + 1, F.greatest(n - at, F.lit(0))), w)
        return F.when((at > 0) & (ahead > 0), at + ahead.cast("int")).otherwise(F.lit(0))

    def gap(start: Column) -> Column:
        rest = F.array(*[F.lit(w) for w in wanted[1:]]) if wanted[1:] else F.array().cast("array<string>")
        end = F.aggregate(rest, start, step)
        return F.when((F.element_at(file_words, start) == wanted[0]) & (end > 0), end - start + 1 - len(wanted))

    return F.array_min(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), gap))


def title_tier(shown: Column, q: Query) -> Column:
    """How a file's title fits the query's, from 100 (the same) to 0; by words, order, gaps and extra words."""
    typed = q.title or q.raw
    stripped = strip_tech(typed)
    wanted = stripped.split()
    if not wanted:
        return F.lit(50)
    f_stripped = text.strip_tech(shown)
    f_words = text.words(f_stripped)
    f_letters, letters, plain = text.collapse(f_stripped), collapse(stripped), collapse(typed)
    own = F.array_distinct(f_words)
    asked = F.array(*[F.lit(w) for w in sorted(set(wanted))])
    extra = F.array_except(own, F.concat(asked, F.array(*[F.lit(w) for w in V.FILLER_WORDS])))
    more, gap = F.size(extra), phrase_gap(f_words, wanted)
    inside = (
        F.when((gap == 0) & (more == 0), 90)
        .when(gap == 0, F.greatest(F.lit(35), 65 - 5 * more))
        .when(gap <= 2, F.greatest(F.lit(15), 40 - 6 * gap - 4 * more))
        .otherwise(F.greatest(F.lit(1), 8 - F.floor(F.coalesce(gap, F.lit(10)) / 3).cast("int")))
    )
    out = F.when(f_letters == letters, 100).when(text.collapse(shown) == plain, 100)
    out = out.when(F.size(own) == 0, 0).when((F.size(F.array_except(own, asked)) == 0) & (F.size(F.array_except(asked, own)) == 0), 95)
    out = out.when(F.size(F.array_except(asked, own)) == 0, inside)
    out = out.when(f_letters.startswith(letters) if letters else F.lit(False), 25).when(f_letters.contains(plain) if plain else F.lit(False), 15)
    return out.otherwise(0)


def rank_keys(q: Query) -> dict[str, Column]:
    """The thirteen keys of the ranking, the most important first; all descend."""
    shown = text.shown(F.col("file_name"), F.col("caption"))
    season, episode = extract.season_episode(shown)
    single, value = extract.episode_group(shown, season, episode)
    year = extract.latest_year(shown)
    tier = title_tier(shown, q)
    if not q.season and not q.episode and (q.wants_movie or q.year):
        other = F.lit(True) if q.wants_movie else year != q.year
        tier = F.when((season > 0) & other, F.least(tier, F.lit(20))).otherwise(tier)
    wanted = q.title_words
    held = F.size(F.array_intersect(F.array(*[F.lit(w) for w in sorted(set(wanted))]), text.words(text.strip_tech(shown)))) if wanted else None
    return {
        "title_tier": tier,
        "season_key": F.when(season == q.season, 1).otherwise(-F.abs(season - q.season)) if q.season else season,
        "episode_match": (episode == q.episode).cast("int") if q.episode else F.lit(0),
        "single": single,
        "episode_value": value,
        "year_match": (year == q.year).cast("int") if q.year else F.lit(0),
        "year": year,
        "metadata": extract.completeness(shown),
        "language": extract.language_score(shown, list(q.languages)) if q.languages else F.lit(0),
        "less_quality": -extract.quality_score(shown),
        "less_resolution": -extract.resolution_score(shown),
        "multi_audio": extract.multi_audio(shown),
        "word_ratio": held / len(set(wanted)) if wanted else F.lit(1.0),
    }


def search(files: DataFrame | TextIndex, q: Query | None, captions: bool = True) -> DataFrame:
    """The files that the query finds, with their ranking keys: filtered in the scan's stage, then one row per id. Of an index, only what its lists name is read."""
    if isinstance(files, TextIndex):
        files = files.rows(q, captions)
    if q is None:
        return files.limit(0).select(*files.columns, *[F.lit(0).alias(k) for k in ("title_tier",)])
    fits = matches(F.col("file_name"), q)
    if captions:
        fits = fits | matches(F.col("caption"), q)
    return federate_filtered(files, fits).withColumns(rank_keys(q))


def ranked(found: DataFrame, q: Query) -> DataFrame:
    """In the order of the ranking, ties by file_id. With a limit after it Spark keeps only the top rows of each task."""
    return found.orderBy(*order(q))


def order(q: Query) -> list[Column]:
    """The order of the ranking: total, since ties go by file_id."""
    return [*[F.desc(k) for k in rank_keys(q)], F.asc("file_id")]


def top(found: DataFrame, q: Query) -> DataFrame:
    """All rows with their place in the ranking, however many: no task sees more of them than a range."""
    return placed(found, order(q))


def page_after(found: DataFrame, q: Query, last: Row | None, limit: int = V.PAGE_SIZE) -> DataFrame:
    """The rows that follow the last row seen (with its ranking keys; None: from the best), in order: deep pages cost what the first one does."""
    if last is not None:
        names = list(rank_keys(q))
        keys = F.struct(*[F.col(k) for k in names])
        seen = F.struct(*[F.lit(last[k]).cast(found.schema[k].dataType).alias(k) for k in names])
        found = found.filter((keys < seen) | (keys == seen) & (F.col("file_id") > last["file_id"]))
    return ranked(found, q).limit(limit)


def page(found: DataFrame, q: Query, offset: int = 0, limit: int = V.PAGE_SIZE) -> tuple[DataFrame, int | None, int]:
    """(rows of the page, next offset or None at the end, total)."""
    return counted(found, lambda rows: ranked(rows, q), offset, limit)


def counted(found: DataFrame, ordered: Callable[[DataFrame], DataFrame], offset: int, limit: int) -> tuple[DataFrame, int | None, int]:
    """As page(), in any order: one pass counts what it orders, and reads the rows of the page, which are few."""
    seen = Observation()
    rows = ordered(found.observe(seen, F.count(F.lit(1)).alias("total"))).offset(offset).limit(limit)
    kept = found.sparkSession.createDataFrame(rows.collect(), rows.schema)
    total = seen.get["total"]
    return kept, (offset + limit if offset + limit < total else None), total


def names(lang: str) -> Column:
    return F.lower("file_name").contains(lang.lower())


def in_language(found: DataFrame, lang: str) -> DataFrame:
    """Those whose name has the language as a substring; this path is not ranked but in the order of ids."""
    return found.filter(names(lang)).orderBy("file_id")


def both_texts() -> Column:
    return F.concat(F.coalesce("file_name", F.lit("")), F.lit(" "), F.coalesce("caption", F.lit("")))


def facets(found: DataFrame) -> DataFrame:
    """(facet, value, files): every facet value of a result with the number of its files."""
    values = [_tagged(k, v) for k, v in extract.facet_values(both_texts()).items()]
    return found.select(F.explode(F.concat(*values)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("files"))


def _tagged(facet: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), x.cast("string").alias("value")))


def facet_order(rows: DataFrame) -> DataFrame:
    """Seasons and years from the greatest, languages by name, qualities from the best."""
    tier = F.array_position(F.array(*[F.lit(t) for t in V.QUALITY_TIERS]), F.col("value"))
    number = F.col("value").try_cast("int")
    return rows.orderBy("facet", F.when(F.col("facet").isin("season", "year"), -number).when(F.col("facet") == "quality", tier.cast("int")), "value")


def with_season(found: DataFrame, season: int) -> DataFrame:
    return found.filter(both_texts().rlike(text.rx(rf"\bs0*{season}(?!\d)|\bseason[\s._\-]*0*{season}\b")))


def with_quality(found: DataFrame, code: str) -> DataFrame:
    return found.filter(F.array_contains(extract.facet_values(both_texts())["quality"], code))


def with_language(found: DataFrame, lang: str) -> DataFrame:
    return found.filter(both_texts().rlike(text.rx(rf"\b{quoted(lang)}\b")))


def has_all_title_words(shown: Column, title: str) -> Column:
    """Whether every word of the title is a word of the text; a title without words fits all."""
    wanted = sorted(set(strip_tech(title).split()))
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), text.words(text.strip_tech(shown)))) == 0 if wanted else F.lit(True)


def relevance(key: Column, asked: str) -> Column:
    """How far a title key is from what was asked, 0 (the same) to 5 (no word): begins with 1, holds 2, all words 3, some words below 4."""
    asked = asked.lower()
    words = sorted(set(asked.split()))
    held = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), F.split(key, r"\s+")))
    some = F.when(held == len(words), 3.0).when(held > 0, 4 - held / len(words)).otherwise(5.0)
    return F.when(key == asked, 0.0).when(key.startswith(asked), 1.0).when(key.contains(asked), 2.0).otherwise(some)


def delete_pattern(asked: str) -> str:
    """What names to delete are matched with: one word within bounds, several with any separators between; nothing asked matches all."""
    words = [quoted(w) for w in asked.split()]
    if not words:
        return "."
    return text.rx(rf"(\b|[.+\-_]){words[0]}(\b|[.+\-_])" if len(words) == 1 else r"[\s._\-+]+".join(words))
