"""Benchmark decontamination by an FM-index per training shard (operator 8).

A shard is about SLICE bytes of whole documents, cut where it exceeds SHARD_SYMBOLS. Its words are
mapped to the benchmark's alphabet; a word outside it can be in no match, so it separates runs, and
runs shorter than the shortest window go (no occurrence is lost). All benchmark windows are searched
backwards in the shard's index, their occurrences located by sampled suffix positions, and the spans
merged. Tasks build blocks of the benchmark, of about BLOCK_BYTES of text each, and write them to the
shared folder. One pass over the documents searches as many blocks as PASS_BYTES allow, which is all
that the driver reads and broadcasts at once; a larger benchmark takes further passes, each of which
adds to the spans and items of the last. A shard has one block decoded at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .frames import free_name, give_back, small_batches, written
from .kernel import NOT_ALNUM, slices, window_hashes

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
BLOCK_BYTES, PASS_BYTES = 4 << 20, 128 << 20
SHARD_SYMBOLS = 1 << 20
SLICE = 4 << 20
#: Occurrences located at once.
LOCATE = 1 << 18
#: Patterns searched at once.
PATTERNS = 1 << 16


@dataclass
class Block:
    """Some benchmark items: sorted word hashes (symbol = place + 1), their texts as symbols, and by length of the windows where each different one begins, and its items."""

    alphabet: np.ndarray
    symbols: np.ndarray
    windows: dict[int, np.ndarray]
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length: offsets by window, item numbers
    names: list[str]

    def patterns(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length, number of the first, windows as rows of symbols), some windows at a time."""
        for k, at in self.windows.items():
            for low in range(0, len(at), PATTERNS):
                yield k, low, self.symbols[at[low : low + PATTERNS, None] + np.arange(k)]


def make_block(names: list[str], texts: list[str | None], width: int) -> Block:
    hashes, lengths = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for _, w in slices(pa.array(texts, pa.string()), NOT_ALNUM, lower=True):
        hashes.append(w.hashes())
        lengths.append(w.counts)
    words, counts = np.concatenate(hashes), np.concatenate(lengths)
    alphabet, symbols = np.unique(words, return_inverse=True)
    begin, size = np.cumsum(counts) - counts, np.minimum(counts, width)
    windows, items = {}, {}
    for k in np.unique(size[size > 0]).tolist():
        mine = np.flatnonzero(size == k)
        n = counts[mine] - k + 1
        owner = np.repeat(mine, n)
        at = np.repeat(begin[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        _, first, which = np.unique(window_hashes(words, at, k), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), owner]), axis=1)
        windows[k], items[k] = at[first].astype(np.int32), (np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1].astype(np.int32))
    return Block(alphabet, (symbols + 1).astype(np.int32), windows, items, names)


def build_blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, pickled) of the benchmark (item_id, text); written. Rows with null item_id or text are left out, equal rows count once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def build(group: pa.Table) -> pa.Table:
        pairs = sorted(set(zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True)))
        raw = pickle.dumps(make_block([i for i, _ in pairs], [t for _, t in pairs], width))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int64()), "size": pa.array([len(raw)], pa.int64()), "pickled": pa.array([raw], pa.binary())})

    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(size // block_bytes + 1)))
    return written(dealt.groupBy("block").applyInArrow(build, "block long, size long, pickled binary"))


def _hits(block: Block, symbols: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(first word, length, window) of all occurrences of a block's windows in documents' words; first: where documents begin."""
    begins = np.zeros(len(symbols) + 1, dtype=bool)
    begins[first] = True
    known = symbols > 0
    head = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]])[: len(known)] | begins[:-1]))
    # a run ends before the next unknown word or document
    stop = np.append(np.flatnonzero(~known | begins[:-1]), len(symbols))
    tail = stop[np.searchsorted(stop, head, side="right")]
    long_enough = tail - head >= min(block.windows, default=1)
    head, tail = head[long_enough], tail[long_enough]
    done = 0
    while done < len(head):
        size = np.cumsum(tail[done:] - head[done:] + 1)
        n = max(1, int(np.searchsorted(size, SHARD_SYMBOLS, side="right")))
        h, length = head[done : done + n], (tail - head)[done : done + n]
        done += n
        at = np.cumsum(length + 1) - length - 1  # where runs begin in the shard's text
        text = np.zeros(int((length + 1).sum()), dtype=np.int64)
        inside = np.arange(len(text)) - np.repeat(at, length + 1)
        word = np.repeat(h, length + 1) + inside
        within = inside < np.repeat(length, length + 1)
        text[within] = symbols[word[within]]
        index = FMIndex(text, len(block.alphabet) + 1)
        for k, number, patterns in block.patterns():
            low, high = index.search(patterns)
            which = np.flatnonzero(high > low)
            n_rows = (high - low)[which]
            for group in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(n_rows) // LOCATE)) + 1):
                if len(group):
                    n = n_rows[group]
                    rows = np.repeat(low[which[group]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield word[index.locate(rows)], k, number + np.repeat(which[group], n)


def _pass(docs: DataFrame, keep: Sequence[str], text: str, names: tuple[str, str, str], load: Callable[[], list[bytes]]) -> DataFrame:
    """The columns keep of docs, and the spans and items found so far (names; null at first), to which the blocks of load() are added."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    spans, items, counted = names
    started = spans in docs.columns
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(f"`{spans}` array<struct<start:bigint,end:bigint>>, `{items}` array<string>, `{counted}` long").fields])
    out_names, n_kept = [f.name for f in schema.fields], len(keep)

    def shard(words: np.ndarray, n_words: np.ndarray, before: tuple[list, list] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        first = np.concatenate([[0], np.cumsum(n_words)])
        change = np.zeros(len(words) + 1, dtype=np.int64)
        found: dict[int, set[str]] = {}
        if before is not None:
            for row, (ranges, own) in enumerate(zip(*before, strict=True)):
                for x in ranges:
                    change[first[row] + x["start"]] += 1
                    change[first[row] + x["end"]] -= 1
                if own:
                    found[row] = set(own)
        for raw in load():
            block = pickle.loads(raw)
            place = np.searchsorted(block.alphabet, words)
            known = block.alphabet[np.minimum(place, len(block.alphabet) - 1)] == words if len(block.alphabet) else np.zeros(len(words), dtype=bool)
            for at, k, window in _hits(block, np.where(known, place + 1, 0), first):
                np.add.at(change, at, 1)
                np.add.at(change, at + k, -1)
                offsets, owner = block.items[k]
                pairs = np.unique((np.searchsorted(first, at, side="right") - 1) * len(offsets) + window)
                for row, x in zip(*divmod(pairs, len(offsets)), strict=True):
                    found.setdefault(int(row), set()).update(block.names[i] for i in owner[offsets[x] : offsets[x + 1]])
        hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edge = np.zeros(len(words) + 2, dtype=bool)
        edge[first + 1] = True  # spans end where documents do
        start = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[1:-1]))
        end = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[2:])) + 1
        row = np.searchsorted(first, start, side="right") - 1
        return start - first[row], end - first[row], np.bincount(row, minlength=len(n_words)), [sorted(found.get(r, ())) for r in range(len(n_words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done, n_words = [], []
            for low, w in slices(batch.column(n_kept), NOT_ALNUM, lower=True, max_bytes=SLICE):
                before = tuple(batch.column(n_kept + k).slice(low, w.rows).to_pylist() for k in (1, 2)) if started else None
                n_words.append(w.counts)
                done.append(shard(w.hashes(), w.counts, before))
            start, end, n_spans = (np.concatenate(c) for c in list(zip(*done, strict=True))[:3])
            ranges = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
            found = [ranges, pa.array([x for d in done for x in d[3]], pa.list_(pa.string()))]
            found[0] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), ranges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *found, pa.array(np.concatenate(n_words), pa.int64())], out_names)
        give_back()

    more = [F.col(f"`{spans}`"), F.col(f"`{items}`")] if started else []
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("the text"), *more).mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, prefix: str = "", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The columns keep of every row of docs, and (n_words, n_hit, n_items, items_sha256, contaminated, spans), their names after prefix.

    spans: the merged hit words, array of (start, end), in words, end exclusive. Null or empty text has
    no words and isn't contaminated; benchmark items with null id are ignored, with null or empty text
    match nothing; an id that is repeated counts once; an empty benchmark hits nothing. Repeated rows
    of docs are judged each. Very long texts are handled whole, in shards of their runs.
    """
    context = docs.sparkSession.sparkContext
    blocks = build_blocks(benchmark, width, block_bytes)
    passes: list[list[int]] = [[]]
    room = pass_bytes
    for number, size in blocks.select("block", "size").orderBy("block").collect():
        if passes[-1] and size > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(number)
        room -= size
    names = (free_name(docs, "hit_spans"), free_name(docs, "hit_items"), free_name(docs, "hit_words"))
    state, columns = docs, list(dict.fromkeys([*keep, text]))
    for k, numbers in enumerate(passes):
        raw = [bytes(r[0]) for r in blocks.filter(F.col("block").isin(numbers)).orderBy("block").select("pickled").collect()] if numbers else []
        shared = context.broadcast(raw)
        load = lambda shared=shared: shared.value
        if k == len(passes) - 1:
            state = _pass(state, keep, text, names, load)
        else:
            state = written(_pass(state, columns, text, names, load).drop(names[2]))
            shared.unpersist()
    n_hit = F.aggregate(names[0], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = {
        "n_words": F.col(names[2]), "n_hit": n_hit, "n_items": F.size(names[1]).cast("long"), "items_sha256": F.sha2(F.array_join(names[1], ","), 256),
        "contaminated": (n_hit > 0) & (n_hit * ONE_IN >= F.col(names[2])), "spans": F.col(names[0]),
    }
    return state.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(f"{prefix}{k}") for k, v in out.items()])


#: DuckDB SQL of op8.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bk AS (SELECT item_id, w, least(len(w), 13)::BIGINT AS k FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM bi),
dk AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM bw) x WHERE len(w) >= k),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dk),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM di),
h AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) x GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
