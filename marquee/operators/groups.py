"""Titles: cards, browsing, the season tree and the summary of one title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, text
from ..functions import vocab as V
from ..plans.query import Query
from ..sources.catalog import federate, with_keys
from ..sources.store import stored
from .order import placed
from .search import ranked


def cards(keyed: DataFrame) -> DataFrame:
    """(title_key, files, latest_id, file_name, content_type, year): a card per title, shown by its newest file, with the year of its first; rows without a title go.

    keyed: a catalog from with_keys(). One aggregation, combined before the shuffle: no files are collected.
    """
    newest = F.max_by(F.struct("file_name", "content_type"), "file_id")
    grouped = keyed.filter("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("files"), F.max("file_id").alias("latest_id"), newest.alias("rep"), F.min_by(extract.first_year(F.col("shown")), "file_id").alias("year"))
    return grouped.select("title_key", "files", "latest_id", "rep.file_name", "rep.content_type", "year")


def browse(files: DataFrame, content_type: str | None, limit: int = 40, offset: int = 0) -> DataFrame:
    """Cards of a type from the newest; exact, over all files."""
    keyed = with_keys(federate(files))
    if content_type:
        keyed = keyed.filter(F.col("content_type") == content_type)
    return cards(keyed).orderBy(F.desc("latest_id")).offset(offset).limit(limit)


def has_more(files: DataFrame, content_type: str, limit: int, offset: int = 0) -> bool:
    keyed = with_keys(federate(files)).filter(F.col("content_type") == content_type)
    return cards(keyed).count() > offset + limit


def search_cards(found: DataFrame, q: Query, rows: int = V.CARD_ROWS, n_cards: int = V.CARDS) -> DataFrame:
    """Cards of the best rows of a search."""
    top = ranked(found, q).limit(rows)
    return cards(with_keys(top)).orderBy(F.desc("latest_id")).limit(n_cards)


def season_tree(keyed: DataFrame) -> DataFrame:
    """(title_key, kind, season, episode, place, file_id): the files of each title in its tree, in long form.

    A title with a season anywhere is a series, its files by season and episode; else all are of season
    and episode 0. Within a leaf the best come first, ties by file_id. Places count over ranges of the whole
    order, less the place where the leaf begins, so a leaf with very many files is never one task's.
    """
    leaf = ["title_key", "season", "episode"]
    # written, since sampling the ranges would work the patterns out once more
    files = stored(keyed.filter("title_key <> ''").select(*leaf, extract.sort_score(F.col("shown")).alias("score"), "file_id"))
    rows = placed(files, [*(F.col(c) for c in leaf), F.desc("score"), F.asc("file_id")]).drop("range")
    leaves = rows.groupBy(*leaf).agg(F.min("place").alias("start"))
    kinds = leaves.groupBy("title_key").agg(F.when(F.max(F.col("season") > 0), "series").otherwise("movie").alias("kind"))
    # the leaves are the join's other side, so that adaptive execution can split one with very many files
    leaves = stored(leaves.join(kinds, "title_key"))
    return rows.join(leaves, leaf).select("title_key", "kind", "season", "episode", (F.col("place") - F.col("start") + 1).cast("int").alias("place"), "file_id")


def season_counts(keyed: DataFrame) -> DataFrame:
    """(title_key, season, label, episodes) of titles that are series."""
    counts = keyed.filter("title_key <> ''").groupBy("title_key", "season").agg(F.countDistinct("episode").alias("episodes"))
    series = F.max(F.col("season") > 0).over(Window.partitionBy("title_key"))
    label = F.when(F.col("season") > 0, F.concat(F.lit("Season "), F.col("season").cast("string"))).otherwise("Extras")
    return counts.withColumn("series", series).filter("series").select("title_key", "season", label.alias("label"), "episodes")


def summary(keyed: DataFrame, first: int = 8) -> DataFrame:
    """(title_key, languages, subtitles, quality, print_type): the first that are not empty among the first files of each title."""
    w = Window.partitionBy("title_key").orderBy("file_id")
    top = keyed.filter("title_key <> ''").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= first)
    said = lambda x: F.nullif(x, F.lit(""))
    values = {
        "languages": said(F.array_join(extract.languages(F.col("shown")), ", ")), "subtitles": said(extract.subtitle_label(F.col("shown"))),
        "quality": said(extract.quality_label(F.col("shown"))), "print_type": said(extract.print_label(F.col("shown"))),
    }
    top = top.withColumns(values)
    first_of = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))), F.lit("")).alias(c)
    return top.groupBy("title_key").agg(*[first_of(c) for c in values])


def pick_metadata(found: DataFrame, title: str, year: int | None) -> DataFrame:
    """The best of external candidates (title, year, poster, votes): of the year if any is, then the exact title, then with a poster and votes, then the first."""
    same = text.collapse(F.col("title")) == text.collapse(F.lit(title))
    good = F.col("poster").isNotNull() & (F.col("votes") > 5)
    of_year = (F.col("year") == year) if year else F.lit(True)
    order = [F.desc(of_year.cast("int")), F.desc(same.cast("int")), F.desc(good.cast("int")), F.asc("rank")]
    return found.orderBy(*order).limit(1)
