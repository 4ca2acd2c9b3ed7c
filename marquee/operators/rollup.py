"""Feeds: what a posted file says, and the roll-up of a title's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, text
from ..functions import vocab as V
from .search import has_all_title_words


def media_info(posts: DataFrame) -> DataFrame:
    """(id, base_name, tag, season, episode, year, quality, resolution, ott_platform, language) of posts (id, file_name, caption).

    The base name ends before the episode mark, or after the year, or before the first quality word.
    """
    name = text.feed_normal(F.initcap(text.drop_mentions(F.col("file_name"))))
    caption = F.lower(text.drop_mentions(F.col("caption")))
    rows = posts.select("id", name.alias("name"), caption.alias("cap")).withColumn("all", F.trim(F.concat("cap", F.lit(" "), F.lower("name"))))
    season, episode = extract.feed_season_episode(F.col("name"))
    year = F.nullif(F.regexp_extract("all", rf"(?<![A-Za-z0-9])({V.FEED_YEAR})(?![A-Za-z0-9])", 1), F.lit(""))
    rows = rows.withColumns({"season": season, "episode": episode}).withColumn("year", F.when(F.col("season").isNull(), year))
    at = lambda p: F.regexp_instr("name", F.lit(text.rx(p)))
    order = (V.FEED_RANGE, V.FEED_SINGLE, V.FEED_NAMED, V.FEED_EPISODES_ONLY)
    mark = F.coalesce(*[F.nullif(at(p), F.lit(0)) for p in order])
    head = lambda n: F.substring("name", F.lit(1), n)
    year_at = F.instr("name", F.col("year"))
    quality_at = at(V.FEED_QUALITY)
    behind = F.coalesce(*[F.nullif(F.regexp_extract("name", text.rx(rf"{p}(.*)$"), g), F.lit("")) for p, g in zip(order, (4, 3, 3, 3), strict=True)])
    after = F.regexp_extract(behind, rf"(?<![A-Za-z0-9])({V.FEED_YEAR})(?![A-Za-z0-9])", 1)
    series = F.concat_ws(" ", head(mark - 1), F.nullif(after, F.lit("")))
    plain = F.when(F.col("year").isNotNull(), F.when(year_at > 0, head(year_at + 3)).otherwise(F.col("name"))).when(quality_at > 0, head(quality_at - 1)).otherwise(F.col("name"))
    base = text.feed_normal(text.drop_ignored(text.feed_normal(F.when(F.col("season").isNotNull(), series).otherwise(plain))))
    base = F.when(F.col("year").isNotNull() & (F.instr(base, F.col("year")) == 0), F.concat(base, F.lit(" "), "year")).otherwise(base)
    spoken = F.sort_array(F.array_union(extract.feed_languages(F.col("cap")), extract.feed_languages(F.lower("name"))))
    return rows.select(
        "id", base.alias("base_name"), F.when(F.col("season").isNotNull(), "#SERIES").otherwise("#MOVIE").alias("tag"), "season", "episode", "year",
        extract.feed_sources(F.col("cap")).alias("quality"), extract.feed_resolutions(F.col("cap")).alias("resolution"),
        text.joined(extract.feed_platforms(F.col("all"))).alias("ott_platform"), text.joined(spoken).alias("language"),
    )


def from_catalog(found: DataFrame, title: str) -> DataFrame:
    """Feed rows of the files that a search found and that have all of the title's words; for title_rollup() and episode_ranges()."""
    all_text = F.concat_ws(" ", "file_name", "caption")
    season, episode = extract.feed_season_episode(F.col("file_name"))
    low = F.lower(all_text)
    return found.filter(has_all_title_words(all_text, title)).select(
        F.lit(title).alias("base_name"), F.col("file_name").alias("filename"), season.alias("season"), episode.alias("episode"), extract.feed_sources(low).alias("quality"),
        extract.feed_resolutions(low).alias("resolution"), text.joined(extract.feed_languages(low)).alias("language"),
        F.coalesce(F.nullif(F.array_join(extract.feed_platforms(low), " | "), F.lit("")), F.lit("N/A")).alias("ott_platform"),
        F.when(season.isNotNull() & episode.isNotNull(), "#SERIES").otherwise("#MOVIE").alias("tag"),
    )


def _parts(x: Column, separator: str) -> Column:
    """The parts of a list in a string; none for null and N/A."""
    some = F.when(F.coalesce(x, F.lit("N/A")) == "N/A", F.array().cast("array<string>")).otherwise(F.split(x, separator))
    return F.filter(F.transform(some, lambda v: F.trim(v)), lambda v: v != "")


def once_per_name(feed: DataFrame) -> DataFrame:
    """One row of each title and filename: the least, so that a retried task picks the same."""
    others = [c for c in feed.columns if c not in ("base_name", "filename")]
    return feed.groupBy("base_name", "filename").agg(F.min(F.struct(*others)).alias("r")).select("base_name", "filename", *[f"r.{c}" for c in others])


def said_values(feed: DataFrame) -> DataFrame:
    """(base_name, filename, tag, q, r, l, p): each file with what it says of quality, resolution, languages and platforms."""
    old = F.coalesce("resolution", F.lit("N/A")) == "N/A"
    quality = F.coalesce("quality", F.lit("N/A"))
    none = F.array().cast("array<string>")
    return feed.select(
        "base_name", "filename", "tag",
        F.concat(_parts(F.col("quality"), ","), F.when(old, _parts(extract.feed_sources(quality), ",")).otherwise(none)).alias("q"),
        F.concat(_parts(F.col("resolution"), ","), F.when(old, _parts(extract.feed_resolutions(quality), ",")).otherwise(none)).alias("r"),
        _parts(F.col("language"), ",").alias("l"), _parts(F.col("ott_platform"), r"\|").alias("p"),
    )


def title_rollup(feed: DataFrame) -> DataFrame:
    """(base_name, files, tag, qualities, resolutions, languages, platforms): sorted unions over a title's files, each filename once.

    A file without a resolution gives what its quality field says, split in sources and resolutions, as
    well. The unions are sets of a bounded vocabulary: they combine before the shuffle whatever a title's size.
    """
    rows = said_values(once_per_name(feed))
    long = rows.select("base_name", F.explode(F.concat(*[_named(c) for c in ("q", "r", "l", "p")])).alias("v"))
    of = lambda k, name: F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("v.kind") == k, F.col("v.value")))), ", "), F.lit("")), F.lit("N/A")).alias(name)
    files = rows.groupBy("base_name").agg(F.count("*").alias("files"), F.max(F.col("tag") == "#SERIES").alias("series"))
    sets = long.groupBy("base_name").agg(of("q", "qualities"), of("r", "resolutions"), of("l", "languages"), of("p", "platforms"))
    said = [F.coalesce(c, F.lit("N/A")).alias(c) for c in ("qualities", "resolutions", "languages", "platforms")]
    return files.join(sets, "base_name", "left").select("base_name", "files", F.when(F.col("series"), "#SERIES").otherwise("#MOVIE").alias("tag"), *said)


def _named(kind: str) -> Column:
    return F.transform(kind, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def episode_ranges(feed: DataFrame) -> DataFrame:
    """(base_name, season, episodes): runs of single episodes, then the ranges as posted, as `S1: 1-3, 5, 7-9`."""
    said = feed.filter("season is not null and episode is not null and season > 0").select("base_name", "season", "episode").distinct()
    single = said.filter(F.col("episode").rlike("^[0-9]+$")).select("base_name", "season", F.col("episode").cast("int").alias("n")).distinct()
    island = F.col("n") - F.row_number().over(Window.partitionBy("base_name", "season").orderBy("n"))
    runs = single.withColumn("island", island).groupBy("base_name", "season", "island").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    parts = runs.select("base_name", "season", F.struct(F.lit(0).alias("kind"), F.col("a").alias("at"), shown.alias("said")).alias("p"))
    ranged = said.filter(~F.col("episode").rlike("^[0-9]+$"))
    first = F.regexp_extract("episode", "^([0-9]+)", 1).try_cast("int")
    parts = parts.union(ranged.select("base_name", "season", F.struct(F.lit(1).alias("kind"), first.alias("at"), F.col("episode").alias("said")).alias("p")))
    told = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["said"]), ", ")
    return parts.groupBy("base_name", "season").agg(F.concat(F.lit("S"), F.col("season").cast("string"), F.lit(": "), told).alias("episodes"))
