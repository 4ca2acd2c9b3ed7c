"""Scans of the catalog: two stores as one, points, pages and keyed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, text

#: Columns of the catalog; an absent value is null.
SCHEMA = "file_id string, file_name string, file_size bigint, caption string, category string, store string"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows, dealt by a hash of the key to as many tasks as shuffles have: a small file is one task, however much is done with each of its rows.

    The number is given, since adaptive execution makes few tasks of few bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def federate(files: DataFrame) -> DataFrame:
    """One row per id: the primary store's, else the other one's. An id is unique within its store.

    The primary store's rows pass through: only their ids are shuffled, to meet the other store's rows.
    """
    primary = F.coalesce(F.col("store") == "primary", F.lit(False))
    first, second = files.filter(primary), files.filter(~primary)
    return first.unionByName(second.join(first.select("file_id"), "file_id", "left_anti").select(*files.columns))


def federate_filtered(files: DataFrame, condition: F.Column) -> DataFrame:
    """federate() of the rows that fit. Each row is judged once, before the shuffle: only what fits meets its twin."""
    row = F.struct(*files.columns)
    hits = files.filter(condition).groupBy("file_id").agg(F.min_by(row, F.coalesce(F.col("store") != "primary", F.lit(True))).alias("r"))
    return hits.select("r.*")


def lookup(files: DataFrame, file_id: str) -> DataFrame:
    """The row of one id: the equality reaches the scan."""
    return federate(files.filter(F.col("file_id") == file_id))


def newest(files: DataFrame, limit: int) -> DataFrame:
    """The rows with the greatest ids of both stores, in one global order."""
    return federate(files).orderBy(F.desc("file_id")).limit(limit)


def page(files: DataFrame, offset: int, limit: int) -> DataFrame:
    return federate(files).orderBy(F.desc("file_id")).offset(offset).limit(limit)


def with_keys(files: DataFrame) -> DataFrame:
    """The catalog with what is worth storing beside it: with these columns written, browsing needs equality filters only, which reach the scan."""
    shown = text.shown(F.col("file_name"), F.col("caption"))
    season, episode = extract.web_season_episode(shown)
    return files.withColumns({"shown": shown, "title_key": text.title_key(shown), "season": season, "episode": episode, "content_type": extract.served_category(shown, F.col("category"))})


def by_key(files: DataFrame, key: str) -> DataFrame:
    """The files of one title. Where the key is stored (with_keys(), written), its equality reaches the scan of both stores."""
    if "title_key" in files.columns:
        return federate(files.filter(F.col("title_key") == key))
    return with_keys(federate(files)).filter(F.col("title_key") == key)


def by_loose_key(files: DataFrame, key: str) -> DataFrame:
    """The files whose repeat-free key holds the given one or is held by it."""
    loose = text.fuzzy_normal(text.title_key(text.shown(F.col("file_name"), F.col("caption"))))
    wanted = text.fuzzy_normal(F.lit(key))
    return federate(files).filter((F.length(loose) > 0) & (loose.contains(wanted) | wanted.contains(loose)))


def text_prefilter(files: DataFrame, terms: str) -> DataFrame:
    """The files that have any of the terms as a word, with the number of terms they have: no cap on candidates. Words are compared within the row."""
    wanted = F.array(*[F.lit(w) for w in sorted({w for w in terms.lower().split() if w})]).cast("array<string>")
    hits = F.size(F.array_intersect(wanted, F.split(F.lower("file_name"), "[^a-z0-9]+"))).cast("long")
    return federate(files).select("file_id", hits.alias("hits")).filter("hits > 0")


def titles(files: DataFrame) -> DataFrame:
    """(base, original): the title dictionary, each base title with its least file name; unbounded."""
    base = federate(files).select(text.base_title(F.col("file_name")).alias("base"), "file_name")
    return base.filter("base <> ''").groupBy("base").agg(F.min("file_name").alias("original"))
