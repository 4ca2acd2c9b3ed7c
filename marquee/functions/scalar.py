"""Numbers, durations and times as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes, and seconds of each unit of a duration.
SIZE_UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")
DURATION_SECONDS = (("s", 1), ("min", 60), ("hour", 3600), ("day", 86400), ("month", 30 * 86400), ("year", 365 * 86400))


def size_label(n: Column) -> Column:
    """A size in steps of 1024, with two decimals; null counts as 0."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    # ties go to the even digit, as in C's printf
    said = lambda k: F.concat(F.bround((n / float(1024**k)).cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string"), F.lit(f" {SIZE_UNITS[k]}"))
    out = said(len(SIZE_UNITS) - 1)
    for k in range(len(SIZE_UNITS) - 2, -1, -1):
        out = F.when(n < float(1024 ** (k + 1)), said(k)).otherwise(out)
    return out


def duration_seconds(x: Column) -> Column:
    """Seconds of `1month`, `2day` and the like; 0 for anything else."""
    number, unit = F.regexp_extract(x, r"^(\d+)\s*(\S.*)$", 1), F.regexp_extract(x, r"^(\d+)\s*(\S.*)$", 2)
    table = F.create_map(*[F.lit(v) for kv in DURATION_SECONDS for v in kv])
    return F.coalesce(F.nullif(number, F.lit("")).cast("long") * F.element_at(table, unit), F.lit(0).cast("long"))


def readable_time(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, parts that are 0 left out."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    s = seconds.cast("long")
    return F.concat_ws("", part(F.floor(s / 86400), "days"), part(F.floor(s / 3600) % 24, "hour"), part(F.floor(s / 60) % 60, "min"), part(s % 60, "sec"))


def time_left(expiry: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(days, hours, minutes) from as_of to expiry."""
    s = F.unix_timestamp(expiry) - F.unix_timestamp(as_of)
    return F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60


def greeting(at: Column) -> Column:
    h = F.hour(at)
    return F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 18), "afternoon").otherwise("evening")


def pages(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def page_of(offset: Column, size: int) -> Column:
    return F.floor(offset / size) + 1


def code_hash(code: Column) -> Column:
    return F.sha2(code, 256)


def rating(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f", x)).otherwise("N/A")
