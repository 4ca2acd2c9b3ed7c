"""Free text to queries as columns: what plans.query does for one text, for tables of requests or of a search log.

Everything is built-in expressions. A null text gives null fields.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .text import rx, swap

#: Stands before a number that is still to be padded; in no text of the data.
_PAD = "\ue000"


def squeezed(x: Column) -> Column:
    return F.trim(swap(x, r"\s+"))


def marks(x: Column) -> Column:
    """All marks of seasons and episodes as sNNeNN, sNN or eNN, whatever their spelling."""
    for pattern, letters in V.QUERY_MARKS:
        if pattern == V.QUERY_APART:  # its groups have their letters
            x = swap(x, pattern, "$1$2")
        elif letters == "ss":  # one of the two groups is empty
            x = swap(x, pattern, f"s{_PAD}00$1$2")
        else:
            x = swap(x, pattern, "".join(f"{letter}{_PAD}00${k}" for k, letter in enumerate(letters, 1)))
        x = F.regexp_replace(x, f"{_PAD}0*([0-9]{{2,}})", "$1")
    return x


def normalized(x: Column) -> Column:
    return squeezed(marks(x))


def cleaned(x: Column, stop_phrases: tuple[str, ...] = ()) -> Column:
    """Without punctuation and without stop phrases as whole words."""
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    if stop_phrases:
        phrases = "|".join(map(re.escape, sorted(stop_phrases, key=lambda p: (-len(p), p))))
        x = swap(x, rf"\b(?:{phrases})\b", "")
    return squeezed(x)


def parsed(rows: DataFrame, x: str) -> DataFrame:
    """rows with (normalized, title, season, episode, year, languages, wants_movie) of the text in column x; numbers are 0 where it doesn't say."""
    java = lambda p: rx(p.replace("(?P<", "(?<"))
    number = lambda c, p, name: F.coalesce(F.nullif(F.regexp_extract(c, java(p), 1 if name == "season" or "season" not in p else 2), F.lit("")).cast("int"), F.lit(0))
    bare = swap(F.col(x), V.FACET_LANGUAGE)
    rows = rows.withColumns({
        "wants_movie": F.col(x).rlike(rx(V.MOVIE_WORD)), "languages": F.transform(F.regexp_extract_all(x, F.lit(rx(V.FACET_LANGUAGE)), F.lit(1)), F.lower),
        "year": F.coalesce(F.nullif(F.regexp_extract(bare, rx(V.YEAR), 1), F.lit("")).cast("int"), F.lit(0)),
        "normalized": squeezed(swap(marks(swap(bare, V.YEAR)), V.QUERY_FILLER, "")),
    })
    text = F.col("normalized")
    both = text.rlike(java(V.NUMBER_BOTH))
    one = {"season": V.NUMBER_SEASON, "episode": V.NUMBER_EPISODE}
    fields = {name: F.when(both, number(text, V.NUMBER_BOTH, name)).otherwise(number(text, p, name)) for name, p in one.items()}
    return rows.withColumns(fields | {"title": squeezed(swap(text, V.NUMBER_WORDS, ""))})


def requested(rows: DataFrame, x: str) -> DataFrame:
    """rows with (title, year, season) of manual requests in column x: a season only as the last word, then the first year; null where there is none."""
    text = F.trim(F.col(x))
    season = F.nullif(F.regexp_extract(text, rx(r"\bs(\d{1,2})$"), 1), F.lit(""))
    rest = F.trim(F.regexp_replace(text, rx(r"\s*\bs\d{1,2}$"), ""))
    rows = rows.withColumns({"season": season.cast("int"), "rest": rest})
    year = F.nullif(F.regexp_extract("rest", rf"(?U){V.REQUEST_YEAR}", 1), F.lit(""))
    title = F.trim(F.regexp_replace("rest", rf"(?Us)^(.*?){V.REQUEST_YEAR}(.*)$", "$1$3"))
    return rows.withColumns({"year": year, "title": title}).drop("rest")
