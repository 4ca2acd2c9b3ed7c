"""N-gram Jaccard join by T-occurrence search (operator 10).

Documents are sets of distinct word shingles. A partner of a set of n shingles shares at least
ceil(s * n) of them, so it is found in the lists of the n - ceil(s * n) + 1 shortest inverted lists: these
are the lists DivideSkip merges, all others are the long ones that it probes. A fixed-size count-min
table of all shingles orders the lists by length.

1. One scan counts the shingles and describes each document: size, digest and parity sketch of its set.
   Documents with equal sets are linked by digest; only one of each class goes on.
2. Each of these posts its short-list shingles; postings meet by hash bucket, and shingles that
   no other document has go.
3. In each list, neighbours by set size are candidates. Those that the sketches allow are checked against the
   full sets by divide_skip(), and connected components of the links found.
4. Only pairs of a list from different components are candidates now, first the two nearest of
   each two components, then all that are left and not refuted before. After the last check no pair that
   could link is unchecked, so the components are exact; a group of m near copies costs about m checks.

A parity sketch has about as many bits as its set has shingles and excludes pairs exactly (an odd bit of two
sketches' difference needs a shingle that one set lacks). Full sets are made only of documents that a pair
still names then. Lists that the table estimates as very long are split over several buckets in step 2 and
into blocks of pairs in step 4.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import broadcast_if_small, give_back, written
from .kernel import BLANK, Words, key_order, sequence_hashes, slices, splitmix, window_hashes

WIDTH, NUM, DEN = 3, 90, 100
SLICE, SLICE_ROWS = 1 << 20, 1 << 10
#: Cells of the count-min table: a bound of its size in tasks, shuffles and the broadcast.
MIN_CELLS, MAX_CELLS = 1 << 18, 1 << 24
#: Text bytes whose postings share a bucket.
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 1 << 20
#: A list estimated longer than this is split over buckets of about so many postings.
LONG_LIST = 1 << 18
#: Postings of a list in a block of pairs.
BLOCK = 1 << 10
#: Postings compared in one call, pairs at once, and the partners of a posting that are looked at before its whole list stays.
ROWS_AT_ONCE, PAIRS, WIDEST = 1 << 15, 1 << 19, 256
#: Bits of the least sketch, and of the largest that goes with each posting.
SKETCH_BITS, POSTED_BITS = 256, 4096

_U = np.uint64
TOKEN_BITS = 54  # of a shingle's hash, beside 10 bits for the row in a slice


def least_overlap(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of sets of n and m elements with den * intersection >= num * union."""
    return -(-num * (n + m) // (num + den))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words, or of all words of a row that has fewer, and their rows."""
    words = w.hashes()
    at, row = w.windows(width)
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    h = np.concatenate([window_hashes(words, at, width), sequence_hashes(words, w.first[few], w.first[few + 1])])
    return h, np.concatenate([row, few])


def slice_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, first): the distinct tokens of each row, in their order; first: where rows begin."""
    h, row = shingles(w, width)
    both = np.sort(row.astype(np.uint64) << _U(TOKEN_BITS) | h >> _U(64 - TOKEN_BITS))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    row = (both >> _U(TOKEN_BITS)).astype(np.int64)
    return both & _U((1 << TOKEN_BITS) - 1), row, np.searchsorted(row, np.arange(w.rows + 1))


#: Levels of a count for each doubling: a count goes as a byte, its logarithm.
LEVELS = 8
SCANNED = "part int, counts binary, id long, t long, n int, a long, b long, sketch binary"


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(LEVELS * np.log2(1 + counts))).astype(np.uint8)


def _counted(levels: np.ndarray) -> np.ndarray:
    return 2.0 ** (levels.astype(np.float64) / LEVELS) - 1


def sketches(token: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches of the sets of n tokens each: a power of two of bits, n at least. Half of a larger one's bits, each combined with the other half's, are a smaller one."""
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    odd = (np.bincount(at[row] + (token & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=at[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[x // 8 : y // 8].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows x 64-bit words) cut to `size` words, if they have more."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, size), axis=1) if sketch.shape[1] > size else sketch


def _scan(cells: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (id, t, text): one row of each document (id, t, n, a, b: digest, sketch), and the parts of the task's count-min table."""
    shift = _U(TOKEN_BITS - (cells.bit_length() - 1))
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for low, w in slices(batch.column(2), BLANK, lower=True, max_bytes=SLICE, max_rows=SLICE_ROWS):
                token, row, first = slice_sets(w, width)
                np.add.at(table, (token >> shift).astype(np.int64), 1)
                n = np.diff(first)
                a, b, some = np.zeros(w.rows, dtype=np.uint64), np.zeros(w.rows, dtype=np.uint64), np.flatnonzero(n)
                if len(some):
                    a[some], b[some] = np.add.reduceat(splitmix(token), first[some]), np.bitwise_xor.reduceat(splitmix(token ^ _U(0x5851F42D4C957F2D)), first[some])
                none = pa.nulls(w.rows)
                own = [none.cast(pa.int32()), none.cast(pa.binary()), batch.column(0).slice(low, w.rows), batch.column(1).slice(low, w.rows), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sketches(token, row, n), pa.binary())]
                yield pa.RecordBatch.from_arrays(own, schema=schema)
        # a logarithm of each cell fits in a byte, so that long lists stay long in the sum
        small = _level(table).reshape(-1, min(cells, 1 << 15))
        none = pa.nulls(len(small))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small)), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary()), *(none.cast(f.type) for f in list(schema)[2:])], schema=schema)
        give_back()

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tables' parts in a partition: what a task holds is one table at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = _counted(np.frombuffer(raw, dtype=np.uint8))
            sums[part] = sums[part] + x if part in sums else x
    levels = {k: _level(x).tobytes() for k, x in sums.items()}
    yield pa.RecordBatch.from_arrays([pa.array(levels.keys(), pa.int32()), pa.array(levels.values(), pa.binary())], ["part", "levels"])


def list_levels(scanned: DataFrame) -> np.ndarray:
    """For each cell, LEVELS * log2(1 + shingles that fall in it), over all documents: an order of the lists by length, of a fixed size."""
    parts = scanned.filter("part is not null").select("part", "counts")
    found = parts.repartition("part").mapInArrow(_sum_counts, "part int, levels binary").collect()
    # a table without partitions runs no task, and counts nothing
    return np.concatenate([np.frombuffer(r[1], dtype=np.uint8) for r in sorted(found)]) if found else np.zeros(MIN_CELLS, dtype=np.uint8)


def _post(levels: Callable[[], np.ndarray], buckets: int, width: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed postings (key: bucket; token, id, n, place) of rows (id, text) with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels()
        shift = _U(TOKEN_BITS - (len(level).bit_length() - 1))
        for batch in batches:
            ids = _ids(batch.column(0))
            for low, w in slices(batch.column(1), BLANK, lower=True, max_bytes=SLICE, max_rows=SLICE_ROWS):
                own = ids[low : low + w.rows]
                token, row, first = slice_sets(w, width)
                n = np.diff(first)
                # the order of lists: level, then token; the low 8 bits of a token don't matter for it
                order = np.sort(row.astype(np.uint64) << _U(54) | level[(token >> shift).astype(np.int64)].astype(np.uint64) << _U(46) | token >> _U(8))
                row = (order >> _U(54)).astype(np.int64)
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(w.rows))[row]
                short = place <= n[row] + (-num * n[row] // den)
                order, row, place = order[short], row[short], place[short]
                token, estimate = order & _U((1 << 46) - 1), 1 + _counted(order >> _U(46) & _U(255))
                pieces = np.maximum(1, np.ceil(estimate / LONG_LIST)).astype(np.int64)
                mixed = splitmix(token) + np.where(pieces > 1, splitmix(own[row]) % pieces.astype(np.uint64), 0).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
                key = (splitmix(mixed) >> _U(32)).astype(np.int64) * buckets >> 32
                at = key_order(key)
                cuts = np.flatnonzero(np.append(True, key[at][1:] != key[at][:-1])[: len(at)])
                rows = []
                for part in np.split(at, cuts[1:]) if len(at) else []:
                    long_list = (pieces[part] > 1).astype(np.uint64) << _U(46)
                    rows.append((int(key[part[0]]), (token[part] | long_list).tobytes(), own[row[part]].tobytes(), n[row[part]].astype(np.int32).tobytes(), place[part].astype(np.int32).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], ["key", "token", "id", "n", "place"])
        give_back()

    return run


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


POSTING = "token long, id long, n int, place int, other long"


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j in [low[i], high[i]), about PAIRS at once."""
    n = np.maximum(high - low, 0)
    for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        m = n[rows]
        yield np.repeat(rows, m), np.repeat(low[rows], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def _meet(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """The postings whose list has another one that could be a partner (all postings of lists that are split or very long);
    other: the next of these by set size, or null."""

    def run(rows: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=kind)
        token, ids, n, place = join("token", np.uint64), join("id", np.int64), join("n", np.int32).astype(np.int64), join("place", np.int32).astype(np.int64)
        order = np.argsort(token)
        same = np.append(False, token[order][1:] == token[order][:-1])[: len(order)]
        shared = same | np.append(same[1:], False)[: len(order)]
        order = order[shared | (token[order] >> _U(46) > 0)]
        order = order[np.lexsort((place[order], ids[order], n[order], token[order]))]
        token, ids, n, place = token[order], ids[order], n[order], place[order]
        # repeated rows post alike
        new = np.append(True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1]) | (place[1:] != place[:-1]))[: len(token)]
        token, ids, n, place = token[new], ids[new], n[new], place[new]
        list_ = np.cumsum(np.append(True, token[1:] != token[:-1])[: len(token)])
        high = np.searchsorted(list_ << 32 | n, list_ << 32 | n * den // num, side="right")
        at = np.arange(len(ids))
        very_long = np.bincount(list_, weights=high - at > WIDEST)[list_] > 0 if len(ids) else at > 0
        kept, other = very_long | (token >> _U(46) > 0), np.full(len(ids), -1)
        for i, j in _ranges(at + 1, np.minimum(high, at + 1 + WIDEST)):
            ok = (ids[i] != ids[j]) & fits(n[i], n[j], place[i], place[j], num, den)
            i, j = i[ok][::-1], j[ok][::-1]
            kept[i] = kept[j] = True
            other[i] = j  # the last write, hence the first j, stays
        at = np.flatnonzero(kept)
        columns = [pa.array(token[at].astype(np.int64)), pa.array(ids[at]), pa.array(n[at].astype(np.int32)), pa.array(place[at].astype(np.int32)), pa.array(ids[other[at]], mask=other[at] < 0)]
        return pa.Table.from_arrays(columns, ["token", "id", "n", "place", "other"])

    return run


def fits(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m elements that share the i-th and j-th in the order of lists can link, by what comes after these."""
    return np.minimum(n - i, m - j) >= least_overlap(n, m, num, den) if len(n) else np.zeros(0, dtype=bool)


def may_link(n: np.ndarray, m: np.ndarray, one: list[bytes], two: list[bytes], num: int, den: int) -> np.ndarray:
    """Whether sets of n and m elements with the sketches one and two can link."""
    out, size = np.zeros(len(n), dtype=bool), np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)]).reshape(-1, 2) // 8
    for k, l in np.unique(size, axis=0).tolist():  # noqa: E741
        at = np.flatnonzero((size[:, 0] == k) & (size[:, 1] == l))
        x = folded(np.frombuffer(b"".join(one[i] for i in at), dtype=np.uint64).reshape(len(at), k), min(k, l))
        y = folded(np.frombuffer(b"".join(two[i] for i in at), dtype=np.uint64).reshape(len(at), l), min(k, l))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        out[at] = (n[at] + m[at] - apart) // 2 >= least_overlap(n[at], m[at], num, den)
    return out


def _near(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (a, b) of (a, b, n, m, one, two) that their sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            at = pa.array(np.flatnonzero(may_link(n, m, batch.column(4).to_pylist(), batch.column(5).to_pylist(), num, den)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def allowed(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that sketches allow; written."""
    of = lambda x, n, sketch: heads.select(F.col("id").alias(x), F.col("n").alias(n), F.col("sketch").alias(sketch))
    both = pairs.join(of("a", "n", "one"), "a").join(of("b", "m", "two"), "b").select("a", "b", "n", "m", "one", "two")
    return written(both.mapInArrow(_near(num, den), "a long, b long").distinct())


def _bags(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, bag) of rows (id, text): the sorted hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, w in slices(batch.column(1), BLANK, lower=True, max_bytes=SLICE):
                h, row = shingles(w, width)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
                h, row = h[new], row[new]
                first = np.searchsorted(row, np.arange(w.rows + 1)).tolist()
                bags = [h[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, w.rows), pa.array(bags, pa.binary())], ["id", "bag"])
        give_back()

    return run


def divide_skip(query: np.ndarray, bags: list[np.ndarray], least: list[int]) -> list[int]:
    """The places of the bags that share at least least[k] elements with query; all are sorted arrays.

    The inverted lists of the query's elements over the bags are divided: the L longest are put aside,
    the others merged by a heap with the threshold T - L (T: the least needed overlap of any bag),
    and what reaches it is searched in the long lists by binary probes.
    """
    lists: dict[int, list[int]] = {}
    for k, bag in enumerate(bags):
        at = np.searchsorted(query, bag)
        inside = at < len(query)
        for e in at[inside][query[at[inside]] == bag[inside]].tolist():
            lists.setdefault(e, []).append(k)
    by_length = sorted(lists.values(), key=len)
    needed = min(least, default=1)
    n_long = min(max(0, needed - 1), len(by_length))
    short, long_ = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
    out = []
    for k, hits in groupby(heapq.merge(*short)):
        count = sum(1 for _ in hits)
        if count < needed - n_long:
            continue
        for j, probed in enumerate(long_):
            if count >= least[k] or count + len(long_) - j < least[k]:
                break
            at = bisect_left(probed, k)
            count += at < len(probed) and probed[at] == k
        if count >= least[k]:
            out.append(k)
    return out


def _verify(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (a, b) of (a, b, bag_a, bag_b) that link: rows of one a that come together are one search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)]).tolist()
            kept: list[int] = []
            for low, high in zip(starts, [*starts[1:], len(a)], strict=True):
                query = np.frombuffer(batch.column(2)[low].as_py(), dtype=np.uint64)
                bags = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(3).slice(low, high - low).to_pylist()]
                kept += [low + k for k in divide_skip(query, bags, [-(-num * (len(query) + len(x)) // (num + den)) for x in bags])]
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])
        give_back()

    return run


def _checked(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The links among written pairs (a, b); written. Sets are made only of texts that a pair names, and go once to each pair's b and once to each a."""

    def of(x: str) -> DataFrame:
        named = broadcast_if_small(written(pairs.select(F.col(x).alias("id")).distinct()))
        bags = rows.select("id", "text").join(named, "id", "left_semi").mapInArrow(_bags(width), "id long, bag binary")
        return bags.select(F.col("id").alias(x), F.col("bag").alias(f"bag_{x}"))

    both = of("b").join(broadcast_if_small(pairs), "b").join(of("a"), "a").select("a", "b", "bag_a", "bag_b")
    return written(both.mapInArrow(_verify(num, den), "a long, b long"))


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch) with sketches of POSTED_BITS at most."""
    most = POSTED_BITS // 64
    for batch in batches:
        cut_ = lambda x: x if len(x) <= 8 * most else folded(np.frombuffer(x, dtype=np.uint64)[None, :], most).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cut_(x) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "sketch"])


def _differences(sketches: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that counts the bits in which the sketches of i and j differ, after the larger is folded."""
    size = np.array([len(x) for x in sketches]) // 8
    levels, place = {}, {}
    for k in np.unique(size).tolist():
        mine = np.flatnonzero(size >= k)
        at = np.zeros(len(sketches), dtype=np.int64)
        at[mine] = np.arange(len(mine))
        out = np.empty((len(mine), k), dtype=np.uint64)
        for of in np.unique(size[mine]).tolist():
            some = np.flatnonzero(size[mine] == of)
            out[some] = folded(np.frombuffer(b"".join(sketches[x] for x in mine[some].tolist()), dtype=np.uint64).reshape(len(some), of), k)
        levels[k], place[k] = out, at

    def count(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least, out = np.minimum(size[i], size[j]), np.zeros(len(i), dtype=np.int64)
        for k in np.unique(least).tolist():
            which = np.flatnonzero(least == k)
            for low in range(0, len(which), max(1, PAIRS * 4 // k)):
                now = which[low : low + max(1, PAIRS * 4 // k)]
                out[now] = np.bitwise_count(levels[k][place[k][i[now]]] ^ levels[k][place[k][j[now]]]).sum(axis=1, dtype=np.int64)
        return out

    return count


def _cross(num: int, den: int, nearest: int | None) -> Callable[[pa.Table], pa.Table]:
    """Candidates of some blocks of lists: pairs of different components that all bounds allow; nearest: so many of each two components."""

    def run(rows: pa.Table) -> pa.Table:
        number = lambda c: rows.column(c).to_numpy().astype(np.int64)
        order = np.lexsort([number(c) for c in ("id", "n", "side", "y", "x", "kind", "token")])
        token, kind, x, y, side, ids, comp, n, place = (number(c)[order] for c in ("token", "kind", "x", "y", "side", "id", "component", "n", "place"))
        raw = rows.column("sketch").to_pylist()
        differences = _differences([raw[k] for k in order.tolist()])
        new = np.append(True, (token[1:] != token[:-1]) | (kind[1:] != kind[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        half = np.cumsum(new) * 2
        # a row of the main component meets the other side of its block, one of the rest all later rows: both are sorted by size
        meets = (half + (kind == 0)) << 32
        place_of = (half + side) << 32 | n
        low = np.where(kind == 0, np.searchsorted(place_of, meets | -(-num * n // den), side="left"), np.arange(len(ids)) + 1)
        high = np.where(side == 1, 0, np.searchsorted(place_of, meets | n * den // num, side="right"))
        found = [np.zeros((3, 0), dtype=np.int64)]
        for i, j in _ranges(low, high):
            ok = (comp[i] != comp[j]) & fits(n[i], n[j], place[i], place[j], num, den)
            i, j = i[ok], j[ok]
            apart = differences(i, j)
            near = (n[i] + n[j] - apart) // 2 >= least_overlap(n[i], n[j], num, den)
            found.append(np.stack([i[near], j[near], apart[near]]))
        i, j, apart = np.concatenate(found, axis=1)
        if nearest:
            one, two = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            best = np.lexsort((ids[j], ids[i], apart, two, one))
            start = np.flatnonzero(np.append(True, (one[best][1:] != one[best][:-1]) | (two[best][1:] != two[best][:-1]))[: len(best)])
            best = best[np.arange(len(best)) - np.repeat(start, np.diff(start, append=len(best))) < nearest]
            i, j = i[best], j[best]
        pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _candidates(posts: DataFrame, heads: DataFrame, found: DataFrame, num: int, den: int, nearest: int | None) -> DataFrame:
    """Pairs of a list whose documents are in different components, by blocks: the list's largest component against the others, and these against each other."""
    component = found.select(F.col("node").alias("id"), "component")
    member = written(posts.select("token", "id", "n", "place").join(component, "id", "left").withColumn("component", F.coalesce("component", "id")))
    sizes = member.groupBy("token", "component").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("m_main"), F.sum("m").alias("m_all"), F.count("*").alias("components"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    sizes = sizes.filter("components > 1").select("token", "main", blocks(F.col("m_main")).alias("b_main"), F.greatest(F.lit(1), blocks(F.col("m_all") - F.col("m_main"))).alias("b_rest"), "m_all")
    sizes = written(sizes)  # a table of its own, so that adaptive execution can split a very long list in the join
    rows = member.join(sizes, "token").join(heads.select("id", "sketch").mapInArrow(_folds, "id long, sketch binary"), "id")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    key = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    in_main, rest = own(F.col("b_main")), own(F.col("b_rest"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    main_keys = each(F.col("b_rest"), lambda y: key(0, in_main, y, 0))
    rest_keys = F.concat(
        each(F.col("b_main"), lambda x: key(0, x, rest, 1)),
        each(F.col("b_rest"), lambda y: key(1, F.least(rest, y), F.greatest(rest, y), 0)),
    )
    # in a block of two different blocks of the others, side doesn't matter: all its rows are compared with all
    keyed = rows.withColumn("k", F.explode(F.when(F.col("component") == F.col("main"), main_keys).otherwise(rest_keys)))
    flat = keyed.select("token", "k.kind", "k.x", "k.y", "k.side", "id", "component", "n", "place", "sketch")
    tasks = F.lit((sizes.agg(F.sum("m_all")).first()[0] or 0) // ROWS_AT_ONCE + 1)
    flat = flat.withColumn("part", F.pmod(F.xxhash64("token", "kind", "x", "y"), tasks))
    return flat.groupBy("part").applyInArrow(_cross(num, den, nearest), "a long, b long").distinct()


def _one_of_equals(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of documents with equal sets, by digest: (a, b) links of each to the least, and (id, t) of the rows that needn't post."""
    key = ["n", "a", "b"]
    several = written(scanned.filter("id is not null and n > 0").groupBy(*key).agg(F.min("id").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    # the classes are a table of their own: adaptive execution can split one with very many documents
    others = written(scanned.filter("id is not null and n > 0").join(broadcast_if_small(several), key).filter("id <> least").select("id", "t", "least"))
    return others.select(F.col("id").alias("a"), F.col("least").alias("b")), others.select("id", "t").distinct()


def linked(posts: DataFrame, documents: DataFrame, own: DataFrame, equal: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, component) of all documents with links: the links `equal` (a, b), and those among documents that meet in a list of posts (POSTING).

    documents: (id, n, sketch); own: (id, text) of those that post. No pair is asked for twice.
    """
    seen = written(posts.filter("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    links = equal.union(_checked(allowed(seen, documents, num, den), own, width, num, den))
    found = components(links)
    for nearest in (2, None):
        pairs = written(_candidates(posts, documents, found, num, den, nearest).join(broadcast_if_small(seen), ["a", "b"], "left_anti"))
        more = _checked(allowed(pairs, documents, num, den), own, width, num, den)
        if not more.isEmpty():
            links = found.selectExpr("node as a", "component as b").union(more)
            found = components(links)
        seen = seen.union(pairs)
    return found


def member_rows(docs: DataFrame, doc_id: str, documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (id, n), by the components found; doc_id as in docs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    out = documents.join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(F.col("id").cast(kind).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; doc_id must be an integer column, other columns are ignored.

    Two documents link when den * (shingles they share) >= num * (shingles of either); component_id is
    the least doc_id that links reach. A-Z are lower-cased. A text of fewer than width words is one
    shingle; null text, or one without words, has none and links with nothing. Rows with the same
    doc_id are one document, with all their links. A row with null doc_id gets null component_id and
    links with nothing. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))  # tells rows of one id apart
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(size // bucket_bytes + 1, MAX_BUCKETS)
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (size // 512).bit_length()))
    scanned = written(rows.select("id", "t", "text").mapInArrow(_scan(cells, width), SCANNED))
    shared = docs.sparkSession.sparkContext.broadcast(list_levels(scanned))
    documents = scanned.filter("part is null")
    equal, others = _one_of_equals(documents)
    own = rows.filter("id is not null and text is not null").join(broadcast_if_small(written(others)), ["id", "t"], "left_anti")
    posted = own.select("id", "text").mapInArrow(_post(lambda: shared.value, buckets, width, num, den), "key int, token binary, id binary, n binary, place binary")
    posts = written(posted.groupBy("key").applyInArrow(_meet(num, den), POSTING))
    return member_rows(docs, doc_id, documents, linked(posts, documents, own, equal, width, num, den))


#: DuckDB SQL of op10.
SHINGLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON d.doc_id = r.a LEFT JOIN n ON d.doc_id = n.doc_id
"""
