"""Mixing sources to target weights (operator 1).

Every document gets a hash-random key. The keys of a source are cut into ranges; sums of the ranges
and running sums within them give each document's position in its source's shuffled order, with no
task that holds a whole source. A source is repeated for as many whole epochs as fit in its budget,
and the rest of the budget is cut from the front of the order at the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import n_words, written

#: Fixed values of the contract: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Ranges of keys per source: 4096 of a third of 10**10 documents have under a million rows each.
RANGES = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row per source.

    The total of all sizes is shared by weight; a source stops at max_epochs times its size and its
    excess is reshared by weight. The fixed point is a water level: target = min(cap, level * weight).
    Sources in the order of cap / weight are capped first, so prefix sums give the level.
    The windows without a key run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    every, by = Window.partitionBy(), Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    ranked = ranked.withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if all before this one are capped; the first source whose cap is not below it sets it
    ranked = ranked.withColumn("level", (F.col("total") - F.col("gone")) / (F.col("all_w") - F.col("gone_w")))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return ranked.withColumn("at", level).select("source", "source_size", F.least("cap", F.col("at") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, text, source).

    taken: words that the mix takes of the row, repeats counted, at most max_epochs times its size;
    the sum over a source is the whole part of its target. Null text has size 0 and takes nothing; a
    null source is a source of its own, the last one; null or repeated ids are rows like others (of
    rows that tie in key, id and size, any may be the one that is cut); an empty table gives no rows.
    Other columns are ignored. Runs agree, whatever the partitions. Of a very long text only its number of words is kept;
    rows of one id meet in one task, as numbers.
    """
    # rows without an id are dealt by their text, so that they don't meet in one range
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    rows = rows.withColumn("rng", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int"))
    rows = written(rows)  # the texts are read once
    parts = rows.groupBy("source", "rng").agg(F.sum("size").alias("part"))
    plan = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_epochs)
    upto = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("base", F.coalesce(F.sum("part").over(upto), F.lit(0)))
    same = lambda x, *keys: [F.col(f"r.{k}").eqNullSafe(F.col(f"{x}.{k}")) for k in keys]
    starts = starts.alias("r").join(plan.alias("p"), same("p", "source")).select("r.source", "rng", "base", "source_size", "target")
    within = Window.partitionBy("source", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("prior", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = placed.alias("r").join(starts.alias("s"), same("s", "source", "rng"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("base") - F.col("prior")
    return out.select("r.doc_id", "r.size", "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("long").alias("taken"))


#: DuckDB SQL of mix(documents); `level` is found as in targets().
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (source_size * 3)::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s),
r AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w FROM w),
g AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0.0)) / (all_w - coalesce(sum(w) OVER o, 0.0)) AS level FROM r
      WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level AS lvl FROM g WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, least(cap, lvl * w) AS target FROM g, l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       (CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END * p.size
        + greatest(0, least(p.size, floor(t.target) - CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END * t.source_size - p.prior)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
