"""The corpus pipeline: five stages over documents, each one of the corpus operators at work.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next stage's docs. All but the last return the columns of
documents. An empty table of documents goes through all stages and comes out empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.decontaminate import find_contamination
from marquee.llm.frames import broadcast_if_small, free_name, made, release, table, written
from marquee.llm.langid import held_out, identify, train
from marquee.llm.line_dedup import drop_boilerplate_lines
from marquee.llm.mixing import mix
from marquee.llm.shingle_join import link_components

#: A text is rejected if its most frequent language labels a smaller share of its words: it has no main language, or one that isn't learned.
MIN_LANG_SCORE = 1 / 2
#: The languages whose texts are kept; None: all that are learned.
KEEP_LANGS: tuple[str, ...] | None = None
#: Near copies: texts whose sets of shingles of so many words have a Jaccard similarity of at least NUM / DEN. The query op10 has limits of its own.
SHINGLE_WORDS, SHINGLE_NUM, SHINGLE_DEN = 5, 80, 100


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _plainly_named(stage: Stage) -> Stage:
    """The stage over docs whose columns with a dot or a backtick in their names have other names meanwhile: in most calls such names would name fields."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        meanwhile: dict[str, str] = {}
        for name in docs.columns:
            if "." in name or "`" in name:
                meanwhile[name] = free_name(docs, f"renamed_{len(meanwhile)}")
        if not meanwhile:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.toDF(*[meanwhile.get(c, c) for c in docs.columns]), sf_dir)
        own = {v: k for k, v in meanwhile.items()}
        return out.toDF(*[own.get(c, c) for c in out.columns])

    return run


@_plainly_named
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, without a language that labels half of their words, or of a language that isn't kept, go.

    Those that stay without lang get the language found. The model learns from the labelled rows of
    docs itself, without those that op7 holds out; if no row is labelled, all rows stay as they are.
    Null and empty texts have no letter. Repeated rows are judged each, very long texts whole.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs
    lang, score, spans = names = tuple(free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_spans"))
    out = identify(docs, model, tuple(docs.columns), "text", names)
    out = out.filter((F.col(lang) != "und") & (F.col(score) >= MIN_LANG_SCORE))
    if KEEP_LANGS is not None:
        out = out.filter(F.col(lang).isin(*KEEP_LANGS))
    return out.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


@_plainly_named
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from the texts; n_chars, if it is there, is the new length.

    All rows stay, also those whose text is empty now. Null texts and sources stay as they are; repeated rows are pages each.
    """
    dropped = free_name(docs, "n_dropped")
    out = drop_boilerplate_lines(docs, host="source", text="text", n_dropped=dropped)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_plainly_named
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays: the one with the least doc_id. Texts without words are linked with nothing and stay.

    Rows with one doc_id are one document: one of them stays, chosen by a hash of its values. Rows without doc_id all stay.
    """
    classes = written(link_components(docs.select("doc_id", "text"), width=SHINGLE_WORDS, num=SHINGLE_NUM, den=SHINGLE_DEN))
    gone = written(classes.filter("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    again = written(classes.filter("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(broadcast_if_small(again), "doc_id", "left_semi").select(*docs.columns)
    one = one.groupBy(F.col("doc_id").alias("of_id")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return kept.join(broadcast_if_small(again), "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


@_plainly_named
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule finds go: null and empty texts never do. Repeated rows are judged each, very long texts whole; without a benchmark all rows stay."""
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), tuple(docs.columns), prefix=prefix)
    return found.filter(~F.col(f"{prefix}contaminated")).select(*docs.columns)


@_plainly_named
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each row of docs; null and empty texts have size 0. Other odd cases are as in mix()."""
    return mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the language model of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's own tables, and its input, are removed once its result is written; the last stage's stay, since the result reads them."""
    docs, first = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        release(spark, first, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
