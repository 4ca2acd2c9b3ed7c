"""A stored inverted index of names and captions, so that a search reads the lists of its terms and not the catalog.

Terms are the words of a text, and the three-letter grams of its letters (all else left out), each for
names and captions. Documents are numbered within shards of their ids, and each shard's list of a term is one
row of delta-packed numbers. Lists are partitioned by a hash of the term, so a search opens the buckets of
its terms only; it intersects the lists of each shard, from the shortest, and reads the documents of the shards hit.

The index gives candidates: all rows that the predicate of a search can find, and others. The predicate
decides on the rows themselves, so what comes out is what a scan of the whole catalog gives. A query
without a word or three letters in a-z and 0-9 has no lists and is answered by the scan.

Changes are appended as segments of their own. Of the rows of one id and store the last segment's is
alive; a deletion is a segment's row without terms. A segment counts once its documents are written, and
writing it again replaces what an interrupted run left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.query import Query, collapse
from .catalog import dealt

#: Documents of a shard: an upper bound of a list's length is about twice this.
SHARD_ROWS = 1 << 16
#: Rows of the catalog whose terms share a bucket of lists.
BUCKET_ROWS = 1 << 20
GRAM = 3
FIELDS = {"name": "file_name", "caption": "caption"}
#: Letters beyond ASCII that case-insensitive patterns take for one of ASCII.
ALIKE = ("ſıİ", "sii")


def pack(numbers: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Ascending lists numbers[first[k]:first[k + 1]] as bytes: differences, seven bits a byte, the last byte of each below 128."""
    delta = np.diff(numbers, prepend=0)
    starts = first[:-1][np.diff(first) > 0]
    delta[starts] = numbers[starts]
    size = 1 + sum((delta >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = delta[some] >> 7 * k & 127 | (size[some] > k + 1) << 7
    return [out[x:y].tobytes() for x, y in zip(at[first[:-1]].tolist(), at[first[1:]].tolist(), strict=True)]


def unpack(raw: bytes) -> np.ndarray:
    """The list that pack() made."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    start = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    place = np.arange(len(b)) - np.repeat(start, np.diff(start, append=len(b)))
    return np.cumsum(np.add.reduceat((b & 127) << 7 * place, start)) if len(last) else last


def intersect(lists: list[np.ndarray]) -> np.ndarray:
    """Numbers that all ascending lists have: those of the shortest are searched in the next longer one, and so on."""
    out, *longer = sorted(lists, key=len)
    for x in longer:
        at = np.searchsorted(x, out)
        out = out[(at < len(x)) & (x[np.minimum(at, len(x) - 1)] == out)]
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column("docs").combine_chunks() if isinstance(batch.column("docs"), pa.ChunkedArray) else batch.column("docs")
        first = np.concatenate([[0], np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        lists = pack(docs.flatten().to_numpy().astype(np.int64), first)
        kept = [batch.column(c) for c in ("kind", "bucket", "term", "shard")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first).astype(np.int32)), pa.array(lists, pa.binary())], ["kind", "bucket", "term", "shard", "n", "packed"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def words_of(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.translate(x, *ALIKE)), F.lit("[a-z0-9]+"), F.lit(0)))


def grams_of(x: Column, size: int = GRAM) -> Column:
    at = lambda y: F.when(F.length(y) >= size, F.sequence(F.lit(1), F.length(y) - (size - 1))).otherwise(F.array().cast("array<int>"))
    of = lambda y: F.transform(at(y), lambda k: F.substr(y, k, F.lit(size)))
    # the letters as an array of one, so that they are made once for a text and not for each of its grams
    return F.array_distinct(F.flatten(F.transform(F.array(text.collapse(x)), of)))


def _pieces(x: str) -> list[str]:
    return re.findall("[a-z0-9]+", x.translate(str.maketrans(*ALIKE)).lower())


def _grams(x: str) -> list[str]:
    return sorted({x[k : k + GRAM] for k in range(len(x) - GRAM + 1)})


def term_groups(q: Query, norm: str | None = None) -> list[list[tuple[str, str]]] | None:
    """Groups of (word or gram, term): a text that search.matches() finds has all terms of some group. None: it can't be told by terms."""
    norm = q.raw if norm is None else norm
    groups = [[("gram", g) for g in _grams(collapse(norm))] if " " in norm else [("word", w) for w in _pieces(norm)]]
    if words := [w for w in norm.split() if len(w) > 1]:
        groups.append([("word", x) for w in words for x in _pieces(w)])
    if letters := collapse(q.title or norm):
        groups.append([("gram", g) for g in _grams(letters)])
    return [sorted(set(g)) for g in groups] if all(groups) else None


@dataclass(frozen=True)
class TextIndex:
    """The index at path; shards and buckets are fixed when it is built."""

    spark: SparkSession
    path: str
    shards: int
    buckets: int

    @staticmethod
    def build(files: DataFrame, path: str, shard_rows: int = SHARD_ROWS, bucket_rows: int = BUCKET_ROWS) -> TextIndex:
        """The index of files (file_id, store, file_name, caption, and others, which are kept). One row for each id and store."""
        spark, n = files.sparkSession, files.count()
        made = TextIndex(spark, path, n // shard_rows + 1, n // bucket_rows + 4)
        made.append(files, segment=0)
        spark.createDataFrame([(json.dumps({"shards": made.shards, "buckets": made.buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sizes")
        return made

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(spark, path, **json.loads(spark.read.text(f"{path}/sizes").first()[0]))

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def postings(self) -> DataFrame:
        """(segment, kind, bucket, term, shard, n, packed)."""
        return self.spark.read.parquet(f"{self.path}/postings")

    def append(self, rows: DataFrame, deleted: DataFrame | None = None, segment: int | None = None) -> int:
        """A segment of new and changed rows, and of the deleted ones (file_id, store); its number."""
        if segment is None:
            segment = self.documents().agg(F.max("segment")).first()[0] + 1
        rows = rows.withColumn("deleted", F.lit(False))
        if deleted is not None:
            rows = rows.unionByName(deleted.select("file_id", "store", F.lit(True).alias("deleted")), allowMissingColumns=True)
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("file_id"), F.lit(self.shards)).cast("int"))
        # shards have a bounded number of rows
        numbered = rows.withColumn("doc", F.row_number().over(Window.partitionBy("shard").orderBy("file_id", "store")))
        terms = lambda kind, values: F.transform(values, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
        each = [terms(f"{f}_{what}", of(F.coalesce(c, F.lit("")))) for f, c in FIELDS.items() for what, of in (("word", words_of), ("gram", grams_of))]
        # shards are few: terms are made by all tasks
        texts = dealt(numbered.filter(~F.col("deleted")).select("shard", "doc", *FIELDS.values()), "doc")
        lists = texts.select("shard", "doc", F.explode(F.concat(*each)).alias("t"))
        lists = lists.groupBy("t.kind", "t.term", "shard").agg(F.sort_array(F.collect_list("doc")).alias("docs")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        packed = lists.select("kind", "bucket", "term", "shard", "docs").mapInArrow(_packed, "kind string, bucket int, term string, shard int, n int, packed binary")
        packed = packed.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "term", "shard")
        packed.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.path}/postings/segment={segment}")
        numbered.sortWithinPartitions("shard", "doc").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/documents/segment={segment}")
        return segment

    def candidates(self, groups: list[list[tuple[str, str]]], fields: list[str]) -> DataFrame:
        """(segment, shard, doc) of the documents that have all terms of some group in one of the fields."""
        wanted = {(f"{f}_{what}", term) for f in fields for g in groups for what, term in g}
        kinds, terms = sorted({k for k, _ in wanted}), sorted({t for _, t in wanted})
        lists = self.postings().filter(F.col("kind").isin(kinds) & F.col("bucket").isin([_bucket(F.lit(t), self.buckets) for t in terms]) & F.col("term").isin(terms))

        def run(rows: pa.Table) -> pa.Table:
            held = dict(zip(zip(rows.column("kind").to_pylist(), rows.column("term").to_pylist(), strict=True), rows.column("packed").to_pylist(), strict=True))
            found = [np.zeros(0, dtype=np.int64)]
            for f in fields:
                for g in groups:
                    keys = [(f"{f}_{what}", term) for what, term in g]
                    if all(k in held for k in keys):
                        found.append(intersect([unpack(held[k]) for k in keys]))
            docs = np.unique(np.concatenate(found))
            same = lambda c: pa.array(np.full(len(docs), rows.column(c)[0].as_py()), pa.int32())
            return pa.Table.from_arrays([same("segment"), same("shard"), pa.array(docs.astype(np.int32))], ["segment", "shard", "doc"])

        return lists.groupBy("segment", "shard").applyInArrow(run, "segment int, shard int, doc int")

    def alive(self, rows: DataFrame) -> DataFrame:
        """Those of the documents that no later segment has replaced or deleted."""
        shards = rows.select("shard").distinct()
        later = self.documents().filter("segment > 0").join(shards, "shard", "left_semi").groupBy("file_id", "store").agg(F.max("segment").alias("last"))
        rows = rows.join(later, ["file_id", "store"], "left").filter("(last is null or last <= segment) and not deleted")
        return rows.drop("last", "deleted", "segment", "shard", "doc")

    def rows(self, q: Query | None, captions: bool = True) -> DataFrame:
        """The catalog's rows among which all are that the query finds."""
        documents = self.documents()
        if q is None:
            return self.alive(documents.limit(0))
        groups = term_groups(q)
        if groups is None:
            return self.alive(documents)
        found = self.candidates(groups, list(FIELDS) if captions else ["name"])
        # the shards hit: at most as many numbers as there are shards, and far fewer for rare terms
        hit = [r[0] for r in found.select("shard").distinct().collect()]
        return self.alive(documents.filter(F.col("shard").isin(hit)).join(found, ["segment", "shard", "doc"], "left_semi"))
