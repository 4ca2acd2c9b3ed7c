"""Line dedup by site-relative frequency (operator 4), with DataFrame functions only.

A line is boilerplate of a host if the share of the host's pages that contain it exceeds a ratio.
Only 64-bit line keys are exploded and counted, combined before the shuffle; texts are never
shuffled while the table of boilerplate is small. A host has at most (mean lines of its pages) /
ratio such lines, so they fit in one array per host; the table of these arrays is broadcast only if
its written size allows it, else it is joined by host, where adaptive execution splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small, free_name, written

#: A line goes if more than this share of its host's pages contain it ...
RATIO = 0.05
#: ... and at least so many of them do, on hosts with at least so many pages.
MIN_PAGES_WITH_LINE = 3
MIN_HOST_PAGES = 20


def line_keys(text: Column) -> Column:
    """Keys of the \\n-split lines of a text, in order; 0 for lines without a word."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return F.transform(trimmed, lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_with: int = MIN_PAGES_WITH_LINE, min_pages: int = MIN_HOST_PAGES) -> DataFrame:
    """(host, bad): the keys of each host's boilerplate lines; hosts without any have no row."""
    sited = docs.filter(F.col(host).isNotNull())
    keys = sited.select(F.col(host).alias("host"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key")).filter("key <> 0")
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_with)
    totals = sited.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total")).filter(F.col("total") >= min_pages)
    found = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("total"))
    return found.groupBy("host").agg(F.collect_list("key").alias("bad"))


def drop_boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_with: int = MIN_PAGES_WITH_LINE, min_pages: int = MIN_HOST_PAGES, n_lines: str | None = None, n_dropped: str | None = None, spare_whole: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of text; all rows and all columns stay.

    Lines are split at \\n and compared without blanks at their ends; lines without a word are neither
    counted nor dropped. A line counts once per page. A text of nothing but boilerplate loses all its
    lines that have a word, unless spare_whole leaves such texts as they are. Null or empty text, null host, hosts
    under min_pages pages: unchanged. Repeated rows are pages of their own; ids are not looked at. An empty table gives no rows.
    A very long text is handled whole, in time that follows its length. n_lines, n_dropped: names
    of two columns to add, lines of the text that have a word and those dropped (null text: 0).
    """
    bad, keys, kept, site, was = (free_name(docs, x) for x in ("bad", "line_keys", "kept_lines", "site", "has_kept"))
    table = broadcast_if_small(written(boilerplate(docs, host, text, ratio, min_with, min_pages)))
    joined = docs.join(table.select(F.col("host").alias(site), F.col("bad").alias(bad)), F.col(f"`{host}`") == F.col(site), "left")
    empty = F.array().cast("array<long>")
    joined = joined.withColumn(keys, F.coalesce(line_keys(F.col(text)), empty))
    # hashed once for each text: then a line is looked for only among the text's own boilerplate
    joined = joined.withColumn(bad, F.array_intersect(F.col(keys), F.coalesce(F.col(bad), empty)))
    drop = lambda k: F.array_contains(F.col(bad), k)
    worded = F.filter(F.col(keys), lambda k: k != 0)
    joined = joined.withColumn(was, F.size(worded)).withColumn(kept, F.size(F.filter(F.col(keys), lambda k: (k != 0) & ~drop(k))))
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~drop(F.element_at(F.col(keys), i + 1))), "\n")
    changes = F.col(kept) < F.col(was)
    if spare_whole:
        changes &= F.col(kept) > 0
    out = {text: F.when(changes, left).otherwise(F.col(text))}
    if n_lines:
        out[n_lines] = F.col(was).cast("long")
    if n_dropped:
        out[n_dropped] = F.when(changes, F.col(was) - F.col(kept)).otherwise(0).cast("long")
    return joined.withColumns(out).drop(bad, keys, kept, site, was)


#: DuckDB SQL of the query op4_line_dedup.
LINE_DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, string_split(text, chr(10)) AS ls FROM d),
x AS (SELECT r, source, ls, unnest(generate_series(1, len(ls))) AS i FROM l),
k AS (SELECT r, source, i, ls[i] AS line, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM x),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT k.source, k.k FROM k JOIN t ON k.source = t.source WHERE k.k <> '' GROUP BY k.source, k.k, t.total
      HAVING count(DISTINCT r) >= 3 AND t.total >= 20 AND count(DISTINCT r) > 0.05 * t.total),
m AS (SELECT k.r, k.i, k.line, k.k, b.k IS NOT NULL AS bad FROM k LEFT JOIN b ON k.source = b.source AND k.k = b.k),
a AS (SELECT r, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (k <> '' AND bad) AS n_bad,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_bad, 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN a.n_bad > 0 THEN coalesce(a.kept, '') ELSE d.text END) AS text_sha256
FROM d LEFT JOIN a ON d.r = a.r
"""
