"""Text normalisation as Column functions: no UDF, all inside code generation.

Patterns carry (?iU): case and \\w \\d \\b follow Unicode. A null input gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabets
from . import vocab as V


def rx(pattern: str) -> str:
    """A vocabulary pattern in Java's syntax, case-insensitive and Unicode-aware."""
    return f"(?iU){pattern}"


def swap(x: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(x, rx(pattern), by)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s{2,}", " "))


def shown(name: Column, caption: Column) -> Column:
    """The caption if it has characters, else the name."""
    return F.coalesce(F.nullif(caption, F.lit("")), name)


def shown_trimmed(name: Column, caption: Column) -> Column:
    """The caption if it has more than blanks, trimmed, else the name."""
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), name)


def collapse(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def strip_tech(x: Column) -> Column:
    """Lower-cased words of a title, without episode marks, years, technical and language words."""
    t = swap(swap(F.lower(x), r"s\d{1,2}e\d{1,3}"), r"s\d{1,2}\b")
    t = swap(swap(t, r"\b(19|20)\d{2}\b"), V.TECH_WORDS)
    return squeeze(F.regexp_replace(t, "[^a-z0-9 ]", " "))


def words(stripped: Column) -> Column:
    return F.filter(F.split(stripped, " "), lambda w: w != "")


def base_title(x: Column) -> Column:
    """The lower-cased title up to the first junk word of each line."""
    return F.lower(squeeze(F.regexp_replace(swap(x, V.BASE_JUNK, ""), r"[._\-\+\[\]()'\"]+", " ")))


def clean_file_title(x: Column) -> Column:
    """The title before the first technical word, year or episode mark of a file name; the name if nothing is left."""
    name = F.trim(F.regexp_replace(x, r"(?U)\.\w{2,4}$", ""))
    at = F.regexp_instr(name, F.lit(rx(V.TITLE_CUT)))
    head = F.when(at > 0, F.trim(F.substring(name, F.lit(1), at - 1))).otherwise(name)
    return F.coalesce(F.nullif(squeeze(F.regexp_replace(head, r"[.\-_\+\[\]()]+", " ")), F.lit("")), x)


def display_title(x: Column) -> Column:
    """A readable title: cut at the episode mark, else at the season's, then at the year, without junk and language words."""
    t = F.regexp_replace(swap(x, V.WEB_EXTENSION, ""), V.WEB_PUNCTUATION, " ")
    # one pattern with a branch for each mark, so that the text is one expression however often plans repeat it
    t = F.regexp_replace(t, rf"(?isU)^(?:(.*?){V.WEB_SEASON_EPISODE}.*|(.*?){V.SEASON}.*)$", "$1$4")
    t = F.regexp_replace(t, rf"(?isU){V.WEB_YEAR}.*$", "")
    return squeeze(swap(swap(t, V.WEB_JUNK, ""), V.WEB_LANGUAGES, ""))


def title_key(x: Column) -> Column:
    """The key that files of one title share."""
    return F.trim(F.lower(display_title(x)))


def caption_display(x: Column) -> Column:
    t = F.regexp_replace(swap(x, V.WEB_EXTENSION, ""), r"(?U)@\w+", "")
    return squeeze(F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), V.WEB_PUNCTUATION, " "))


def ingest_normal(x: Column) -> Column:
    """Mentions dropped, each of - _ . + a blank; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)@\w+", ""), r"[_\-.+]", " ")


def fuzzy_normal(x: Column) -> Column:
    """Repeated characters once; only a-z, 0-9 and what is not ASCII stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"(.)\1+", "$1"), r"[^a-z0-9\x{80}-\x{10FFFF}]", "")


def drop_mentions(x: Column) -> Column:
    """Feed cleaning: mentions and www links go."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"(?U){V.FEED_MENTION}", ""))


def feed_normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, V.FEED_SEPARATORS, " "), r"\s+", " "))


def drop_ignored(x: Column) -> Column:
    """Words of the feed without those that name sources, languages and the like."""
    ignored = F.array(*[F.lit(w) for w in V.FEED_IGNORED])
    return F.array_join(F.filter(F.split(F.trim(x), r"\s+"), lambda w: ~F.array_contains(ignored, F.lower(w))), " ")


def file_words(x: Column) -> Column:
    """A file name without words that begin with [, @ or www."""
    return F.array_join(F.filter(F.split(x, r"\s+"), lambda w: ~w.startswith("[") & ~w.startswith("@") & ~w.startswith("www.") & (w != "")), " ")


def person_name(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)@\w+", "")


def short_label(x: Column, most: int = 35, head: int = 32) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, head), F.lit("..."))).otherwise(x)


def after_marker(x: Column, marker: str) -> Column:
    """What stands after the marker, trimmed; null without it."""
    return F.when(F.instr(x, marker) > 0, F.trim(F.substring_index(x, marker, -1)))


def joined(x: Column) -> Column:
    """A list as text, `N/A` if it is null or empty."""
    return F.coalesce(F.nullif(F.array_join(x, ", "), F.lit("")), F.lit("N/A"))


def pad(n: Column, width: int = 2) -> Column:
    return F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} for values, null ones empty; {{ and }} are braces."""
    said = [F.coalesce(values[name].cast("string"), F.lit("")) if name else F.lit(plain.replace("{{", "{").replace("}}", "}")) for plain, name in re.findall(r"((?:\{\{|\}\}|[^{}])+)|\{(\w+)\}", template)]
    return F.concat(*said) if said else F.lit("")


def decorate(x: Column, alphabet: str) -> Column:
    """Letters, and digits where it has them, in a decorative alphabet; other characters stay."""
    (plain, fancy), (letters, mark) = alphabets.swaps(alphabet), alphabets.marked(alphabet)
    out = F.regexp_replace(x, letters, f"$1{mark}") if mark else x
    return F.translate(out, plain, fancy) if plain else out
