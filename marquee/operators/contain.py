"""Which of many asked texts a name holds, or is held by, through grams instead of all pairs.

A gram is up to GRAM letters with its place. For each asked text, the rarest of its grams are looked up among the names' grams;
a name that holds the text has all of them, as far apart as the text has them. For the other direction
each name has one gram, its rarest, that is looked up among the grams of the texts. Candidates are
compared letter by letter. What a text costs is what its rarest gram brings, not the number of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram, and the grams of an asked text that are looked up.
GRAM, LOOKED_UP = 3, 2


def grams(x: Column, size: int) -> Column:
    """All (gram, at) of the size."""
    at = F.when(F.length(x) >= size, F.sequence(F.lit(1), F.length(x) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.struct(F.substr(x, k, F.lit(size)).alias("gram"), k.alias("at")))


def _all_grams(x: Column) -> Column:
    return F.concat(*[grams(x, k) for k in range(1, GRAM + 1)])


def _own_grams(x: Column) -> Column:
    """The grams that stand for a text: those of GRAM letters, of a shorter text itself."""
    return F.when(F.length(x) >= GRAM, grams(x, GRAM)).otherwise(F.array(F.struct(x.alias("gram"), F.lit(1).alias("at"))))


def _rarest(texts: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(text, gram, at, picked): the n grams of each text that fewest names have, ties by gram and place; none for a text with a gram that no name has."""
    own = texts.select("text", F.explode(_own_grams(F.col("text"))).alias("g")).select("text", "g.gram", "g.at")
    own = own.join(counts, "gram", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    best = own.groupBy("text").agg(F.slice(F.array_sort(F.collect_list(F.struct("names", "gram", "at"))), 1, n).alias("g"))
    return best.filter(F.col("g")[0]["names"] > 0).select("text", F.size("g").alias("picked"), F.explode("g").alias("g")).select("text", "g.gram", "g.at", "picked")


def contained(asked: DataFrame, names: DataFrame, ask: str, name: str) -> DataFrame:
    """(ask, name, in_name, in_ask) of all pairs in which one text holds the other: each distinct text once.

    Null and empty texts hold nothing and are held by nothing.
    """
    texts = asked.select(F.col(ask).alias("text")).filter("text <> ''").distinct()
    held = names.select(F.col(name).alias("text")).filter("text <> ''").distinct()
    of_names = held.select(F.col("text").alias("name"), F.explode(_all_grams(F.col("text"))).alias("g")).select("name", "g.gram", "g.at")
    counts = of_names.groupBy("gram").agg(F.countDistinct("name").alias("names"))
    picked = _rarest(texts, counts, LOOKED_UP)
    meet = picked.join(of_names.withColumnRenamed("at", "there"), "gram").groupBy("text", "name", "picked", F.col("there") - F.col("at")).agg(F.countDistinct("at").alias("n"))
    larger = meet.filter("n = picked").select("text", "name")
    anchors = _rarest(held, counts, 1).select(F.col("text").alias("name"), "gram")
    of_texts = texts.select("text", F.explode(F.array_distinct(F.transform(_all_grams(F.col("text")), lambda g: g["gram"]))).alias("gram"))
    smaller = of_texts.join(anchors, "gram").select("text", "name")
    pairs = larger.union(smaller).distinct()
    out = pairs.select(F.col("text").alias(ask), F.col("name").alias(name), F.contains("name", "text").alias("in_name"), F.contains("text", "name").alias("in_ask"))
    return out.filter("in_name or in_ask")
