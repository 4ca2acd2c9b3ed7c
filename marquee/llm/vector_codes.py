"""Vector code compression: product codes learned in integers, with exponion search (operator 13).

Each vector becomes n_parts bytes, the nearest codebook entry of each of its parts. A part's search
starts at the entry a that it had in the round before. An entry j that is no farther than a lies within twice
the distance to a around a, so only the neighbours of a within that radius are scanned, along a list of
a's neighbours sorted by their distance to it. All distances are squared 64-bit integers, and
d(a, j) <= 4 * d(x, a) is exact in them; ties go to the lower index.

Codebooks are of a fixed size, so they travel with the tasks and are updated on the driver from sums
that are combined per task. Vectors and their codes are a table in the shared folder after each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import broadcast_if_small, give_back, release_one, small_batches, written

N_PARTS, N_ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components lie below this, so that squared distances of a part stay exact in 64 bits; vectors beyond are dropped.
LIMIT = 1 << 28
#: Vectors whose parts are searched at once.
ROWS_AT_ONCE = 4096


class Codebook:
    """The entries of one part position, and for each entry all entries by their distance to it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def distances(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((parts - self.entries[entry]) ** 2).sum(axis=1)

    def nearest(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower index, and its squared distance; start: the entries where the searches begin."""
        best, least = start.copy(), self.distances(parts, start)
        radius, left = 4 * least, np.arange(len(parts))
        for k in range(self.order.shape[1]):
            left = left[self.apart[start[left], k] <= radius[left]]
            if not len(left):
                break
            entry = self.order[start[left], k]
            apart = self.distances(parts[left], entry)
            better = (apart < least[left]) | ((apart == least[left]) & (entry < best[left]))
            best[left[better]], least[left[better]] = entry[better], apart[better]
        return best, least


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, each of dim integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), dim)


def _coded(books: list[np.ndarray], dim: int, names: list[str], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (..., v, code) or, at first, (..., v) with the code of each vector, found from the one before, and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, width = len(books), dim // len(books)
        searched = [Codebook(b) for b in books]
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                n = batch.num_rows
                v = _vectors(batch.column("v"), dim)
                code = np.zeros((n, parts), dtype=np.int64) if first else np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64)
                error = np.zeros(n, dtype=np.int64)
                for k, book in enumerate(searched):
                    code[:, k], apart = book.nearest(np.ascontiguousarray(v[:, k * width : (k + 1) * width]), code[:, k])
                    error += apart
                codes = pa.array([row.tobytes() for row in code.astype(np.uint8)], pa.binary())
                kept = [batch.column(c) for c in names if c not in ("code", "error")]
                yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(error)], names)
        give_back()

    return run


def _sums(parts: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (v, code), for each part position and entry that occur in the task: slot, count and sums of the components."""
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * 256, width), dtype=np.int64), np.zeros(parts * 256, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
            slot = (code + np.arange(parts) * 256).ravel()
            np.add.at(total, slot, _vectors(batch.column("v"), dim).reshape(n * parts, width))
            count += np.bincount(slot, minlength=len(count))
        some = np.flatnonzero(count)
        columns = [pa.array(some.astype(np.int32)), pa.array(count[some]), *[pa.array(total[some, k]) for k in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "n", *[f"s{k}" for k in range(width)]])
        give_back()

    return run


def _updated(books: list[np.ndarray], rows: DataFrame, dim: int) -> list[np.ndarray]:
    """Each entry that has parts becomes the componentwise floor of their mean; at most len(books) * 256 sums reach the driver."""
    parts, width = len(books), dim // len(books)
    sums = rows.select("v", "code").mapInArrow(_sums(parts, dim), ", ".join(["slot int, n long", *[f"s{k} long" for k in range(width)]]))
    sums = sums.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r["slot"] // 256][r["slot"] % 256] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def _scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = N_PARTS, n_entries: int = N_ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks): one row for each vector that isn't dropped.

    Component x counts as floor(scale * x). Each part position has a codebook, first that part of the
    n_entries vectors of the least ids; each round assigns all parts to their nearest entries and replaces
    each used entry by the componentwise floor of its parts' mean; codes and errors are of a last
    assignment. code: two hex digits for each part; error: squared distances, summed; label_error: the
    error of all rows of the label, where rows without label count as one.

    Dropped: vectors that are null or empty, hold null or non-finite components, or integer components
    of LIMIT or more; then vectors whose length is no multiple of n_parts, or not that of the first vector
    left. Rows without id come after all ids; rows of one id are ordered by their components, and equal
    rows are vectors each. With fewer vectors than n_entries the codebooks are smaller, and an empty
    table gives no rows and no codebooks. Other columns are ignored.
    """
    if not 1 <= n_entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = rows.sparkSession
    small_batches(spark)
    x = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("x"))
    # magnitudes are judged before anything is cast to an integer
    fine = F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT / scale, F.lit(False)))
    x = x.filter((F.size("x") > 0) & (F.size("x") % n_parts == 0) & fine).select("id", "label", _scaled(F.col("x"), scale).cast("array<int>").alias("v"))
    order = [F.col("id").asc_nulls_last(), "v"]
    head = x.select("id", "v").orderBy(*order).limit(1).collect()
    dim = len(head[0]["v"]) if head else n_parts
    x = x.filter(F.size("v") == dim)
    seeds = np.array([r["v"] for r in x.select("id", "v").orderBy(*order).limit(n_entries).collect()], dtype=np.int64).reshape(-1, dim)
    width = dim // n_parts
    books = [seeds[:, k * width : (k + 1) * width].copy() for k in range(n_parts)] if len(seeds) else []
    schema = T.StructType([*x.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    now = x
    for k in range(rounds + 1):
        before = now
        # without any vector there is no codebook, and no row to search for
        coded = now.mapInArrow(_coded(books, dim, schema.names, k == 0), schema) if books else now.select("id", "label", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).limit(0)
        now = written(coded)
        if k:
            release_one(spark, before)
        if k < rounds and books:
            books = _updated(books, now, dim)
    by_label = written(now.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = now.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(vec_id), F.col("label").alias(label), F.lower(F.hex("code")).alias("code"), "error", "label_error"), books


#: DuckDB SQL of op13.
def _codes_sql() -> str:
    nearest = "SELECT vec_id, part, any_value(x) AS x, min(d * 64 + e) AS m FROM (SELECT p.vec_id, p.part, p.x, c.e, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {c} c ON p.part = c.part) GROUP BY vec_id, part"
    mean = "SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM {c} c LEFT JOIN (SELECT part, e, list(q ORDER BY i) AS c FROM (SELECT part, m % 64 AS e, i, floor_div(sum(x[i])::BIGINT, count(*)) AS q FROM {a}, range(1, (SELECT max(len(x)) FROM p) + 1) r(i) GROUP BY ALL) GROUP BY part, e) m ON c.part = m.part AND c.e = m.e"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1 : part * w + w] AS x FROM v, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64),
a1 AS MATERIALIZED ({nearest.format(c="c0")}), c1 AS MATERIALIZED ({mean.format(c="c0", a="a1")}),
a2 AS MATERIALIZED ({nearest.format(c="c1")}), c2 AS MATERIALIZED ({mean.format(c="c1", a="a2")}),
a3 AS MATERIALIZED ({nearest.format(c="c2")}),
r AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a3 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
""".replace("floor_div(sum(x[i])::BIGINT, count(*))", "(sum(x[i])::BIGINT - ((sum(x[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)")


CODES_SQL = _codes_sql()
