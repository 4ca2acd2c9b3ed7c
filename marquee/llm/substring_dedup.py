"""Exact substring dedup by fixed-block anchors (operator 9).

Any WINDOW consecutive words hold a whole non-overlapping reference block of BLOCK words of their
document, whatever its alignment. So every rolling block of every document probes an index of the
reference blocks, by hash; a hit marks the windows around it as candidates. Hits are extended to
maximal exact repeats by the hashes of the candidate windows: a window goes on being a repeat as long as
the next one has an earlier twin too. That decides each window by the earliest start of its
sequence and never pairs documents, so a passage in very many documents costs rows, not pairs.

Rows between the steps are packed arrays, one for each slice of text and hash bucket. A hash that
repeats within a slice is sent once (its other places are known hits), so a hot passage adds at most
one entry a slice to a bucket. Buckets and document groups have a bounded size: their numbers follow
the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written
from .kernel import BLANK, Words, buffers, cut, hash_order, key_order, slices, window_hashes

WINDOW, BLOCK = 20, 10
SLICE = 2 << 20
#: Text bytes of a group of documents, and of the text whose probes share a hash bucket.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
#: Beyond it (8 TB) buckets grow: at 100 TB one holds the probes of 24 MB of text.
MAX_BUCKETS = 1 << 22
#: Sorts before every id: stands for null.
NO_ID = np.iinfo(np.int64).min


#: A Lehmer generator's modulus and factor: products stay within 64 bits, in Spark as in NumPy.
MODULUS, FACTOR = (1 << 31) - 1, 48271


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(np.where(ids == NO_ID, 0, ids), MODULUS) * FACTOR % MODULUS % groups


def _group(doc_id: Column, groups: int) -> Column:
    """_group_of() as a column."""
    return F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(MODULUS)) * FACTOR % MODULUS, F.lit(groups)).cast("int")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all: their leading zeros compress away."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1).astype(np.int64)


class Packer:
    """Rows (key, hash, ids, counts, places): the entries of one key with the places of one document together."""

    FIELDS = ("key", "hash", "ids", "counts", "places")
    SCHEMA = "key int, hash binary, ids binary, counts binary, places binary"

    def __init__(self) -> None:
        self.rows: list[tuple[int, bytes | None, bytes, bytes, bytes]] = []

    def add(self, key: np.ndarray, ids: np.ndarray, places: np.ndarray, hashes: np.ndarray | None = None) -> Packer:
        """Entries in the order of their documents; hashes: rows of bytes, if any."""
        order = key_order(key - key.min(initial=0))
        key, ids, places = key[order], ids[order], places[order]
        hashes = None if hashes is None else hashes[order]
        at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key))
        for low, high in zip(at[:-1], at[1:], strict=True):
            new = np.flatnonzero(np.append(True, ids[low + 1 : high] != ids[low : high - 1]))
            packed = None if hashes is None else hashes[low:high].tobytes()
            self.rows.append((int(key[low]), packed, ids[low:high][new].tobytes(), np.diff(new, append=high - low).astype(np.uint32).tobytes(), _planes(places[low:high])))
        return self

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], self.FIELDS)

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def _unpack(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, places and hashes (entries x width bytes; width 0: none) of packed rows."""
    ids, places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros((0, width), dtype=np.uint8)]
    for _, h, i, n, p in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        ids.append(np.repeat(np.frombuffer(i, dtype=np.int64), np.frombuffer(n, dtype=np.uint32)))
        places.append(_unplaned(p))
        if width:
            hashes.append(np.frombuffer(h, dtype=np.uint8).reshape(-1, width))
    return np.concatenate(ids), np.concatenate(places), np.concatenate(hashes)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _probes(buckets: int, groups: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every rolling block as an entry of its hash's bucket (place * 2, plus 1 for a reference block), known hits under the key -1 - group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, out = _ids(batch.column(0)), Packer()
            for low, w in slices(batch.column(1), max_bytes=SLICE):
                at, row = w.windows(block)
                if not len(at):
                    continue
                h, ids, place = window_hashes(w.hashes(), at, block), all_ids[low + row], at - w.first[row]
                index = place % block == 0
                order = hash_order(h)
                same = h[order][1:] == h[order][:-1]
                start = np.flatnonzero(np.append(True, ~same))
                index = np.logical_or.reduceat(index[order], start)
                rep = order[start]
                many = np.zeros(len(h), dtype=bool)
                many[order[1:][same]] = many[order[:-1][same]] = True
                if many.any():
                    out.add(-1 - _group_of(all_ids, groups)[low + row[many]], ids[many], place[many])
                by_place = key_order(rep)
                rep, index, h = rep[by_place], index[by_place], h[rep[by_place]]
                key = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
                out.add(key, ids[rep], place[rep] * 2 + index, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.uint8).reshape(-1, 4))
                yield out.batch()

    return run


def _match(groups: int) -> Callable[[pa.Table], pa.Table]:
    """Hits of a bucket, by group: the entries of hashes with a reference block and another entry."""

    def run(rows: pa.Table) -> pa.Table:
        key = rows.column(0)[0].as_py()
        if key < 0:
            ids, place, _ = _unpack(rows, 0)
        else:
            ids, place, h = _unpack(rows, 4)
            order = key_order(h := h.copy().view(np.uint32).reshape(-1))
            start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            size = np.diff(start, append=len(h))
            hit = order[np.repeat((size > 1) & np.logical_or.reduceat((place & 1)[order] > 0, start), size)]
            ids, place = ids[hit], place[hit] >> 1
        return _by_group(ids, place, groups)

    return run


def _by_group(ids: np.ndarray, place: np.ndarray, groups: int) -> pa.Table:
    order = np.lexsort((place, ids))
    ids, place = ids[order], place[order]
    new = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    return Packer().add(_group_of(ids[new], groups)[np.cumsum(new) - 1], ids, place).table()


def _text(docs: pa.Table) -> tuple[np.ndarray, Words]:
    texts = docs.column("text").combine_chunks()
    raw, at = buffers(texts)
    return _ids(docs.column("id").combine_chunks()), cut(raw, at, BLANK, False)


def _marked(ids: np.ndarray, w: Words, packed: pa.Table) -> np.ndarray:
    """The words at the packed places of the packed ids, for all rows that have the id."""
    of, place, _ = _unpack(packed, 0)
    if not len(of):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((place, of))
    of, place = of[order], place[order]
    low, high = np.searchsorted(of, ids, side="left"), np.searchsorted(of, ids, side="right")
    n = high - low
    entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(w.first[:-1], n) + place[entry]


def _later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have the sequence of an earlier (id, place), and one first entry of each sequence."""
    later, first = np.zeros(len(h1), dtype=bool), np.ones(len(h1), dtype=bool)
    order = hash_order(h1)
    same = h1[order][1:] == h1[order][:-1]
    twice = np.zeros(len(h1), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    # only hashes that repeat need the full order
    some = np.flatnonzero(twice)
    some = some[np.lexsort((place[some], ids[some], h2[some], h1[some]))]
    a, b, i, p = h1[some], h2[some], ids[some], place[some]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    start = np.flatnonzero(new)
    least = np.repeat(start, np.diff(start, append=len(a)))
    later[some] = (i != i[least]) | (p != p[least])
    first[some] = new
    return later, np.flatnonzero(first)


def _candidates(buckets: int, window: int, block: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The windows around the hits of a group's documents, the first of each sequence, as entries of their hash's bucket."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        ids, w = _text(docs)
        at = _marked(ids, w, hits)
        row = np.searchsorted(w.first, at, side="right") - 1
        change = np.zeros(len(w.start) + 1, dtype=np.int64)
        low, high = np.maximum(at - (window - block), w.first[row]), np.minimum(at, w.first[row + 1] - window) + 1
        fits = low < high
        np.add.at(change, low[fits], 1)
        np.add.at(change, high[fits], -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(at):
            return Packer().table()
        row = np.searchsorted(w.first, at, side="right") - 1
        h1, h2 = window_hashes(w.hashes(), at, window), window_hashes(w.hashes(second=True), at, window, second=True).astype(np.uint32)
        _, first = _later(h1, h2, ids[row], at - w.first[row])
        key = (h1[first] >> np.uint64(32)).astype(np.int64) * buckets >> 32
        packed = np.concatenate([h1[first].view(np.uint8).reshape(-1, 8), h2[first].view(np.uint8).reshape(-1, 4)], axis=1)
        return Packer().add(key, ids[row[first]], (at - w.first[row])[first], packed).table()

    return run


def _decide(groups: int) -> Callable[[pa.Table], pa.Table]:
    """The windows of a bucket whose sequence starts earlier too, by group."""

    def run(rows: pa.Table) -> pa.Table:
        ids, place, h = _unpack(rows, 12)
        later, _ = _later(h[:, :8].copy().view(np.uint64).reshape(-1), h[:, 8:].copy().view(np.uint32).reshape(-1), ids, place)
        return _by_group(ids[later], place[later], groups)

    return run


def _remove(window: int, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        ids, w = _text(docs)
        at, row = w.windows(window)
        h1, h2 = window_hashes(w.hashes(), at, window), window_hashes(w.hashes(second=True), at, window, second=True).astype(np.uint32)
        later, _ = _later(h1, h2, ids[row], at - w.first[row])
        change = np.zeros(len(w.start) + 1, dtype=np.int64)
        for begin in (at[later], _marked(ids, w, flags)):
            np.add.at(change, begin, 1)
            np.add.at(change, begin + window, -1)
        gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edge = np.zeros(len(w.start) + 2, dtype=bool)
        edge[w.first + 1] = True
        start = np.flatnonzero(gone[1:-1] & (~gone[:-2] | edge[1:-1]))
        end = np.flatnonzero(gone[1:-1] & (~gone[2:] | edge[2:])) + 1
        span_row = np.searchsorted(w.first, start, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(start - w.first[span_row], pa.int64()), pa.array(end - w.first[span_row], pa.int64())], ["start", "end"])
        offsets = np.searchsorted(span_row, np.arange(len(ids) + 1))
        raw, kept = w.buf.tobytes(), []
        for r in range(len(ids)):
            words = raw[w.row_at[r] : w.row_at[r + 1]].split()
            # the spans of a row cut its words from behind
            for k in range(offsets[r + 1] - 1, offsets[r] - 1, -1):
                del words[start[k] - w.first[r] : end[k] - w.first[r]]
            kept.append(b" ".join(words).decode())
        out = [docs.column("id").combine_chunks(), pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(kept, pa.string())]
        return pa.Table.from_arrays([out[0].cast(id_type), *out[1:]], ["doc_id", "n_words", "removed", "kept"])

    return run


def _packed(rows: pa.Table) -> pa.Table:
    return rows.select(list(Packer.FIELDS))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, removed, kept) of every row of docs; doc_id must be an integer column, other columns are ignored.

    removed: the maximal spans of words covered by a window whose sequence also starts earlier (a smaller
    doc_id, or the same with an earlier start), array of (start, end) in words, end exclusive; kept: the
    other words, joined by one space. Null or empty text has no words. A null doc_id comes before all
    others. Rows with the same doc_id are the same document: neither starts earlier at equal places,
    and both lose the same windows; all rows of one id (or without one) are in one task. Texts shorter than a window lose
    nothing; an empty table gives no rows. A very long text is handled whole, by one task in each step.
    block must be at most half of window + 1, so that every window holds a whole reference block.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole reference block at any alignment")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = size // group_bytes + 1, min(size // bucket_bytes + 1, MAX_BUCKETS)
    grouped = rows.withColumn("key", _group(F.col("id"), groups)).groupBy("key")
    probes = rows.mapInArrow(_probes(buckets, groups, block), Packer.SCHEMA)
    hits = written(probes.groupBy("key").applyInArrow(_match(groups), Packer.SCHEMA))
    candidates = grouped.cogroup(hits.groupBy("key")).applyInArrow(_candidates(buckets, window, block), Packer.SCHEMA)
    flags = written(candidates.groupBy("key").applyInArrow(_decide(groups), Packer.SCHEMA))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, removed array<struct<start:bigint,end:bigint>>, kept string"
    id_type = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(docs.schema[doc_id].dataType.simpleString(), pa.int64())
    return grouped.cogroup(flags.groupBy("key")).applyInArrow(_remove(window, id_type), schema)


#: DuckDB SQL of op9.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM i),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM x),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1) y),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
