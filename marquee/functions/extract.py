"""What a file's text says: years, seasons, qualities, languages and the like, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import rx


def _int(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, rx(pattern), group), F.lit("")).cast("int")


def first_key(x: Column, table: tuple[tuple[str, object], ...], default: object) -> Column:
    """The value of the first key of the table that is a substring of the lower-cased text."""
    low, out = F.lower(x), None
    for key, value in table:
        out = F.when(low.contains(key), F.lit(value)) if out is None else out.when(low.contains(key), F.lit(value))
    return out.otherwise(F.lit(default))


def latest_year(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit(V.YEAR), F.lit(1)), lambda y: y.cast("int"))), F.lit(0))


def first_year(x: Column) -> Column:
    return F.regexp_extract(x, V.WEB_YEAR, 1)


def season_episode(x: Column) -> tuple[Column, Column]:
    """(season, episode), 0 where the text has none: sNNeNN, then NxM, then single marks."""

    def part(k: int, alone: str) -> Column:
        return F.coalesce(_int(x, V.SEASON_EPISODE, k), _int(x, V.CROSS_EPISODE, k), _int(x, alone, 1), F.lit(0))

    return part(1, V.SEASON), part(2, V.EPISODE)


def web_season_episode(x: Column) -> tuple[Column, Column]:
    """(season, episode) as the served lists have them: no separators; episode 0 when there is only a season."""
    return F.coalesce(_int(x, V.WEB_SEASON_EPISODE, 1), _int(x, V.SEASON, 1), F.lit(0)), F.coalesce(_int(x, V.WEB_SEASON_EPISODE, 2), F.lit(0))


def loose_season_episode(x: Column) -> tuple[Column, Column]:
    """As web_season_episode(), but an episode that stands alone counts too."""
    season, _ = web_season_episode(x)
    return season, F.coalesce(_int(x, V.WEB_SEASON_EPISODE, 2), _int(x, V.EPISODE, 1), F.lit(0))


def feed_season_episode(x: Column) -> tuple[Column, Column]:
    """(season int, episode string) of a feed name; episodes alone belong to season 1; null without marks."""
    alone, ranged, single, named = (x.rlike(rx(p)) for p in (V.FEED_EPISODES_ONLY, V.FEED_RANGE, V.FEED_SINGLE, V.FEED_NAMED))
    text = lambda p, k: F.regexp_extract(x, rx(p), k)
    season = F.when(alone, F.lit(1)).when(ranged, _int(x, V.FEED_RANGE, 1)).when(single, _int(x, V.FEED_SINGLE, 1)).when(named, _int(x, V.FEED_NAMED, 1))
    pair = lambda p, i, j: F.concat(text(p, i), F.lit("-"), text(p, j))
    alone_pair = F.concat(_int(x, V.FEED_EPISODES_ONLY, 1).cast("string"), F.lit("-"), _int(x, V.FEED_EPISODES_ONLY, 2).cast("string"))
    episode = F.when(alone, alone_pair).when(ranged, pair(V.FEED_RANGE, 2, 3)).when(single, text(V.FEED_SINGLE, 2)).when(named, text(V.FEED_NAMED, 2))
    return season, episode


def quality_score(x: Column) -> Column:
    return first_key(x, V.QUALITY_SCORES, 0)


def resolution_score(x: Column) -> Column:
    return first_key(x, V.RESOLUTION_SCORES, 0)


def sort_score(x: Column) -> Column:
    return first_key(x, V.SORT_SCORES, V.SORT_SCORE_DEFAULT)


def quality_label(x: Column) -> Column:
    return first_key(x, V.QUALITY_LABELS, "")


def print_label(x: Column) -> Column:
    return first_key(x, V.PRINT_LABELS, "")


def subtitle_label(x: Column) -> Column:
    return first_key(x, V.SUBTITLE_LABELS, "")


def languages(x: Column, most: int = 4) -> Column:
    """Language labels, those of longer keys first; combined audio hides the others."""
    low = F.lower(x)
    table = sorted(V.LANGUAGE_LABELS, key=lambda kv: -len(kv[0]))
    found = F.array_distinct(F.filter(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in table]), lambda v: v.isNotNull()))
    both = F.array(*[F.lit(v) for v in V.COMBINED_AUDIO])
    return F.slice(F.when(F.arrays_overlap(found, both), F.array_intersect(found, both)).otherwise(found), 1, most)


def _labels(x: Column, table: tuple[tuple[str, str], ...], behind: str = "") -> Column:
    """The sorted labels of the table's words that a text has as whole words: one pattern finds them all."""
    found = F.regexp_extract_all(x, F.lit(rx(rf"\b({'|'.join(k for k, _ in table)})\b{behind}")), F.lit(1))
    label = F.create_map(*[F.lit(v) for kv in table for v in kv])
    return F.sort_array(F.array_distinct(F.transform(found, lambda w: F.element_at(label, F.lower(w)))))


def feed_languages(x: Column) -> Column:
    """Sorted languages named as whole words, but not where the word names a subtitle; empty without any."""
    return _labels(x, V.FEED_LANGUAGES, f"(?!{V.FEED_SUBTITLE})")


def feed_platforms(x: Column) -> Column:
    return _labels(x, V.FEED_PLATFORMS)


def _first_of_each(x: Column, pattern: str) -> Column:
    """All matches, each spelling once without regard to case, in their order."""
    found = F.regexp_extract_all(x, F.lit(rx(pattern)), F.lit(0))
    keys = F.transform(found, F.lower)
    return F.filter(found, lambda w, i: F.array_position(keys, F.lower(w)) == i + 1)


def feed_sources(x: Column) -> Column:
    """`N/A`, or the source words joined."""
    return F.coalesce(F.nullif(F.array_join(_first_of_each(x, V.FEED_SOURCE), ", "), F.lit("")), F.lit("N/A"))


def feed_resolutions(x: Column) -> Column:
    found = F.transform(_first_of_each(x, V.FEED_RESOLUTION), lambda w: F.when(F.lower(w) == "4k", F.upper(w)).otherwise(w))
    return F.coalesce(F.nullif(F.array_join(found, ", "), F.lit("")), F.lit("N/A"))


def feed_qualities(x: Column) -> Column:
    """`N/A`, or all quality words joined, repeats too."""
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(x, F.lit(rx(V.FEED_QUALITY)), F.lit(0)), ", "), F.lit("")), F.lit("N/A"))


def completeness(x: Column) -> Column:
    """How many of language, quality and resolution the text names."""
    return x.rlike(rx(V.FACET_LANGUAGE)).cast("int") + (quality_score(x) > 0).cast("int") + (resolution_score(x) > 0).cast("int")


def language_score(x: Column, wanted: list[str]) -> Column:
    low, weights = F.lower(x), dict(V.LANGUAGE_WEIGHTS)
    return sum((F.when(low.contains(k), F.lit(weights.get(k, V.LANGUAGE_WEIGHT_DEFAULT))).otherwise(0) for k in wanted), F.lit(0))


def episode_group(x: Column, season: Column, episode: Column) -> tuple[Column, Column]:
    """(1 for a single episode else 0, sort value): ranges by their end, season packs 9999."""
    ranged = x.rlike(rx(V.EPISODE_RANGE))
    pack = (season > 0) & x.rlike(rx(V.SEASON_PACK))
    end = F.greatest(_int(x, V.EPISODE_RANGE, 1), _int(x, V.EPISODE_RANGE, 2))
    return F.when(ranged | pack, 0).otherwise(1), F.when(ranged, end).when(pack, 9999).otherwise(episode)


def multi_audio(x: Column) -> Column:
    return x.rlike(rx(V.MULTI_AUDIO)).cast("int")


def ingest_category(name: Column) -> Column:
    """anime, series or movie by the name alone."""
    season, _ = season_episode(name)
    return F.when(name.rlike(rx(V.ANIME_WORDS)) | name.rlike(V.ANIME_LETTERS), "anime").when(season > 0, "series").otherwise("movie")


def served_category(text: Column, stored: Column) -> Column:
    """The stored category, else anime, series or movie by the text."""
    season, _ = web_season_episode(text)
    guess = F.when(text.rlike(rx(V.ANIME_WORDS)) | text.rlike(V.ANIME_LETTERS), "anime").when(season > 0, "series").otherwise("movie")
    return F.coalesce(F.nullif(stored, F.lit("")), guess)


def facet_values(x: Column) -> dict[str, Column]:
    """Arrays of the facet values a text names: seasons, years, languages, quality codes."""
    every = lambda p, k: F.regexp_extract_all(x, F.lit(rx(p)), F.lit(k))
    ints = lambda a: F.transform(F.filter(a, lambda v: v != ""), lambda v: v.cast("int"))
    seasons = F.concat(ints(every(V.FACET_SEASON, 1)), ints(every(V.FACET_SEASON, 2)))
    codes = F.create_map(*[F.lit(s) for kv in V.QUALITY_CODES for s in kv])
    tokens = F.transform(every(V.FACET_QUALITY, 1), lambda q: F.element_at(codes, F.regexp_replace(F.lower(q), r"[-\s]", "")))
    return {
        "season": F.array_distinct(F.filter(seasons, lambda s: (s >= 1) & (s <= 50))),
        "year": F.array_distinct(ints(every(V.YEAR, 1))),
        "language": F.array_distinct(F.transform(every(V.FACET_LANGUAGE, 1), F.lower)),
        "quality": F.array_distinct(F.filter(tokens, lambda q: q.isNotNull())),
    }


def file_object(name: Column, caption: Column, size: Column, file_id: Column) -> Column:
    """The record a list shows of a file."""
    from .scalar import size_label
    from .text import caption_display, shown

    text = shown(name, caption)
    season, episode = web_season_episode(text)
    return F.struct(
        file_id.alias("id"), caption_display(text).alias("caption"), size_label(size).alias("size"), quality_label(text).alias("quality"),
        print_label(text).alias("print_type"), languages(text).alias("languages"), subtitle_label(text).alias("subtitles"), season.alias("season"), episode.alias("episode"),
    )


def file_label(text: Column, size: Column) -> Column:
    """quality · languages · SxxEyy · size, without the parts that are missing."""
    from .scalar import size_label
    from .text import pad

    season, episode = web_season_episode(text)
    mark = F.when(season > 0, F.concat(F.lit("S"), pad(season), F.when(episode > 0, F.concat(F.lit("E"), pad(episode))).otherwise(F.lit(""))))
    return F.concat_ws(" · ", F.nullif(quality_label(text), F.lit("")), F.nullif(F.array_join(languages(text), ", "), F.lit("")), mark, size_label(size))


#: The bytes that end a packed id before it is encoded.
ID_END = "1604"


def encode_id(packed: Column) -> Column:
    """A packed id (binary) as text: each run of zero bytes as a zero and its length, then base64 for urls without padding."""
    pairs = F.regexp_extract_all(F.concat(F.hex(packed), F.lit(ID_END)), F.lit("(..)"), F.lit(1))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("zeros"))

    def step(at: Column, pair: Column) -> Column:
        run = F.when(at["zeros"] > 0, F.concat(F.lit("00"), F.lpad(F.hex(at["zeros"]), 2, "0"))).otherwise("")
        zero = F.struct(at["out"].alias("out"), (at["zeros"] + 1).alias("zeros"))
        return F.when(pair == "00", zero).otherwise(F.struct(F.concat(at["out"], run, pair).alias("out"), F.lit(0).alias("zeros")))

    return F.rtrim(F.translate(F.base64(F.unhex(F.aggregate(pairs, start, step)["out"])), "+/", "-_"), F.lit("="))
