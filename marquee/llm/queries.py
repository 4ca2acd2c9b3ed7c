"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CHAT_SQL, TRICKY, digests, format_conversations
from .decontaminate import DECONTAMINATION_SQL, find_contamination
from .frames import table
from .golden import GOLDEN_SQL, golden_records
from .langid import held_out, identify, train
from .line_dedup import LINE_DEDUP_SQL, drop_boilerplate_lines
from .minmax import MINMAX_SQL, near_duplicates
from .mixing import MIX_SQL, mix
from .pii import KINDS, find_personal_data, learn
from .quality import QUALITY_SQL, judge_quality
from .shingle_join import SHINGLE_SQL, link_components
from .substring_dedup import SUBSTRING_SQL, remove_repeats
from .url_rules import MIRROR_SQL, URL_SQL, judge, mirror_edges
from .vector_codes import CODES_SQL, codebooks_digest, encode_vectors


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, learn(docs))
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_boilerplate_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-1, 0, 'user', :said), (-1, 1, 'assistant', :said) AS v(conv_id, turn, role, text)", {"said": TRICKY})
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    return digests(format_conversations(rows.unionByName(extra)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op11_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "clients"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def url_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over classes that the table itself has: pages that share a path carry each other's decisions."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mirror_edges(pages))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_personal_data, op3_quality, op4_line_dedup, op5_url_rules, op6_chat, op7_langid, op8_decontamination, op9_substring_dedup, op10_shingle_join, op11_minmax_hash, op12_golden_record, op13_vector_codes, url_mirrors)}
ORACLES = {
    "op1_mixing": MIX_SQL, "op3_quality": QUALITY_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op5_url_rules": URL_SQL, "op6_chat": CHAT_SQL, "op8_decontamination": DECONTAMINATION_SQL,
    "op9_substring_dedup": SUBSTRING_SQL, "op10_shingle_join": SHINGLE_SQL, "op11_minmax_hash": MINMAX_SQL, "op12_golden_record": GOLDEN_SQL, "op13_vector_codes": CODES_SQL, "url_mirrors": MIRROR_SQL,
}
