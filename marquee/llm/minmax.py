"""Min-max near-duplicate detection (operator 11).

A set of shingles is hashed by PERMUTATIONS functions, and of each both the least and the greatest value
stay: two signature values, each equal in two sets with the probability of their Jaccard similarity, for one
hash evaluation. Least and greatest elements are mostly different ones, which makes the estimate's variance
smaller than that of as many repeated draws. The values are cut into bands, in which no function occurs
twice; documents meet in the list of each band's values.

Lists are handled as those of the n-gram join are: documents with equal sets are one first, neighbours in
a list are candidates, then only pairs of a list from different components. Candidates are confirmed on
full sets, so no pair links that shouldn't. A pair at the limit shares no band with a probability of
(1 - s ** ROWS) ** bands: 6e-9 at 0.85, less for pairs above it.

Signatures are taken from the text once; bands are posted from the table written then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small, give_back, written
from .kernel import BLANK, key_order, slices, splitmix
from .shingle_join import BUCKET_BYTES, LONG_LIST, MAX_BUCKETS, MAX_CELLS, MIN_CELLS, POSTING, SCANNED, SHINGLE_SQL, SLICE, SLICE_ROWS, _counted, _level, _meet, _one_of_equals, linked, list_levels, member_rows, sketches, slice_sets

WIDTH, NUM, DEN = 3, 85, 100
#: Hash functions, and signature values in a band: 2 * 120 / 6 bands.
PERMUTATIONS, ROWS = 120, 6
#: Bits of a band's token.
BAND_BITS = 46

_U = np.uint64


def signatures(token: np.ndarray, first: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(sets x 2 * permutations) the least value of each function, then the greatest ones; set k is token[first[k]:first[k + 1]] and not empty."""
    x, start = splitmix(token), first[:-1]
    out = np.empty((2 * permutations, len(start)), dtype=np.uint64)
    # products with odd numbers permute the 64-bit integers
    for k, factor in enumerate(splitmix(np.arange(permutations, dtype=np.uint64) + _U(0x3C6EF372)) | _U(1)):
        with np.errstate(over="ignore"):
            h = x * factor
        out[k], out[permutations + k] = np.minimum.reduceat(h, start), np.maximum.reduceat(h, start)
    return out.T


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets x bands) a token of BAND_BITS for each band of values."""
    sets, values = signature.shape
    cut, out = signature.reshape(sets, values // rows, rows), np.zeros((sets, values // rows), dtype=np.uint64)
    out += np.arange(values // rows, dtype=np.uint64)[None, :]
    for k in range(rows):
        with np.errstate(over="ignore"):
            out = splitmix(out ^ cut[:, :, k])
    return out >> _U(64 - BAND_BITS)


def _scan(cells: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (id, t, text): one row of each document (id, t, n, a, b: digest, sketch, bands), and the parts of the task's count-min table of bands."""
    shift = _U(BAND_BITS - (cells.bit_length() - 1))
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.binary()), ("bands", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for low, w in slices(batch.column(2), BLANK, lower=True, max_bytes=SLICE, max_rows=SLICE_ROWS):
                token, row, first = slice_sets(w, width)
                n = np.diff(first)
                a, b, some = np.zeros(w.rows, dtype=np.uint64), np.zeros(w.rows, dtype=np.uint64), np.flatnonzero(n)
                posted: list[bytes | None] = [None] * w.rows
                if len(some):
                    a[some], b[some] = np.add.reduceat(splitmix(token), first[some]), np.bitwise_xor.reduceat(splitmix(token ^ _U(0x5851F42D4C957F2D)), first[some])
                    band = bands(signatures(token, np.append(first[some], len(token))))
                    np.add.at(table, (band.ravel() >> shift).astype(np.int64), 1)
                    for k, x in zip(some.tolist(), band, strict=True):
                        posted[k] = x.tobytes()
                none = pa.nulls(w.rows)
                own = [none.cast(pa.int32()), none.cast(pa.binary()), batch.column(0).slice(low, w.rows), batch.column(1).slice(low, w.rows), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sketches(token, row, n), pa.binary()), pa.array(posted, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, schema=schema)
        small = _level(table).reshape(-1, min(cells, 1 << 15))
        none = pa.nulls(len(small))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small)), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary()), *(none.cast(f.type) for f in list(schema)[2:])], schema=schema)
        give_back()

    return run


def _post(levels: Callable[[], np.ndarray], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed postings (key: bucket; token, id, n, place) of rows (id, n, bands). Lists estimated as very long are split over buckets and marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels()
        shift = _U(BAND_BITS - (len(level).bit_length() - 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            band = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            token = band.ravel()
            ids, n = (np.repeat(batch.column(k).to_numpy(), band.shape[1]) for k in (0, 1))
            pieces = np.maximum(1, np.ceil((1 + _counted(level[(token >> shift).astype(np.int64)])) / LONG_LIST)).astype(np.int64)
            mixed = splitmix(token) + np.where(pieces > 1, splitmix(ids) % pieces.astype(np.uint64), 0).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            key = (splitmix(mixed) >> _U(32)).astype(np.int64) * buckets >> 32
            at = key_order(key)
            cuts = np.flatnonzero(np.append(True, key[at][1:] != key[at][:-1]))
            token = token | (pieces > 1).astype(np.uint64) << _U(BAND_BITS)
            rows = [(int(key[part[0]]), token[part].tobytes(), ids[part].tobytes(), n[part].astype(np.int32).tobytes(), np.zeros(len(part), dtype=np.int32).tobytes()) for part in np.split(at, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], ["key", "token", "id", "n", "place"])
        give_back()

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; doc_id must be an integer column, other columns are ignored.

    Two documents link when den * (shingles they share) >= num * (shingles of either); component_id is
    the least doc_id that links reach, and kept tells whether it is the row's own. A-Z are lower-cased. A
    text of fewer than width words is one shingle; null text, or one without words, has none and
    links with nothing. Rows with the same doc_id are one document, with all their links. A row with null
    doc_id gets null component_id, links with nothing and is kept. An empty table gives no rows.
    For limits well below 0.85, bands of fewer ROWS are needed.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))  # tells rows of one id apart
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(size // bucket_bytes + 1, MAX_BUCKETS)
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (size // 4096).bit_length()))
    scanned = written(rows.select("id", "t", "text").mapInArrow(_scan(cells, width), f"{SCANNED}, bands binary"))
    shared = docs.sparkSession.sparkContext.broadcast(list_levels(scanned))
    documents = scanned.filter("part is null")
    equal, others = _one_of_equals(documents)
    others = broadcast_if_small(written(others))
    posting = documents.filter("id is not null and n > 0").select("id", "t", "n", "bands").join(others, ["id", "t"], "left_anti")
    posted = posting.select("id", "n", "bands").mapInArrow(_post(lambda: shared.value, buckets), "key int, token binary, id binary, n binary, place binary")
    posts = written(posted.groupBy("key").applyInArrow(_meet(num, den), POSTING))
    own = rows.filter("id is not null and text is not null").join(others, ["id", "t"], "left_anti")
    out = member_rows(docs, doc_id, documents, linked(posts, documents, own, equal, width, num, den))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL of op11: that of the n-gram join with its own limit.
MINMAX_SQL = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({SHINGLE_SQL.replace('>= 90 *', '>= 85 *')})"
