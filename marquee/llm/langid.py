"""Language identification of mixed-language text (operator 7).

Script ranges narrow the candidates: a text is scored only in languages that use a script of its letters, and a
word counts against those that don't use its own. Byte trigrams give each word a score per candidate;
Viterbi with a penalty for each switch labels the words, and runs of one label are the spans. The
trigram counts are learned from a bounded, hash-chosen sample of labelled rows (SAMPLE_PER_LANG).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import appended, broadcast_if_small, give_back, written
from .kernel import BLANK, SLICE_BYTES, Words, slices

BUCKETS = 1 << 15
#: Bound of the training sample: about so many documents of a language.
SAMPLE_PER_LANG = 4000
#: Log-probability lost at a switch of language, and by a word whose script its language doesn't use.
SWITCH_PENALTY, SCRIPT_PENALTY = 12.0, 30.0
#: A language uses a script if at least this share of its training words do.
SCRIPT_SHARE = 0.01
SLICE = 8 << 20

#: First code points of script ranges and the script's number (0: no letter).
#: 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Devanagari, 8 other Indic, 9 Thai and Lao, 10 Georgian, 11 Hangul, 12 kana, 13 Han, 14 other
SCRIPT_RANGES = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 2), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0),
    (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x250, 14), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 14), (0x900, 7), (0x980, 8),
    (0xE00, 9), (0xF00, 14), (0x10A0, 10), (0x1100, 11), (0x1200, 14), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 14), (0x2DE0, 3), (0x2E00, 0), (0x3040, 12),
    (0x3100, 14), (0x3130, 11), (0x3190, 0), (0x3400, 13), (0x4DC0, 0), (0x4E00, 13), (0xA000, 14), (0xAC00, 11), (0xD800, 0), (0xF900, 13), (0xFB00, 14), (0x1F000, 0), (0x20000, 13),
)
SCRIPTS = 15
_FROM, _SCRIPT = (np.array(x) for x in zip(*SCRIPT_RANGES, strict=True))


def scripts(w: Words) -> np.ndarray:
    """The script of each byte that begins a letter; 0 for all other bytes."""
    b = np.concatenate([w.buf, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
    at = np.flatnonzero(w.buf >= 0xC0)
    one, two, three = b[at + 1] & 0x3F, b[at + 2] & 0x3F, b[at + 3] & 0x3F
    lead = b[at]
    code = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
    out = _ASCII[w.buf]
    out[at] = _SCRIPT[np.searchsorted(_FROM, code, side="right") - 1]
    return out


_ASCII = np.where(np.arange(256) < 128, _SCRIPT[np.searchsorted(_FROM, np.arange(256), side="right") - 1], 0).astype(np.int8)


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams centred on the bytes of words, blanks beyond a word's ends; the first one of each word."""
    b = np.full(len(w.buf) + 2, 32, dtype=np.uint32)
    b[1:-1] = np.where(BLANK[w.buf], 32, w.buf)
    before, after = b[:-2].copy(), b[2:].copy()
    before[w.row_at[:-1][w.row_at[:-1] < len(w.buf)]] = 32
    after[w.row_at[1:][w.row_at[1:] > 0] - 1] = 32
    inside = ~BLANK[w.buf]
    mixed = (before[inside] << np.uint32(16) | b[1:-1][inside] << np.uint32(8) | after[inside]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - 15)).astype(np.int64), np.concatenate([[0], np.cumsum(w.end - w.start)])[:-1]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


class Model:
    """Log-probabilities of trigram buckets by language, and the scripts each language uses."""

    def __init__(self, counts: dict[str, np.ndarray], script_words: dict[str, np.ndarray]) -> None:
        self.langs = sorted(counts)
        x = np.array([counts[k] for k in self.langs], dtype=np.float64).reshape(len(self.langs), BUCKETS) + 0.5
        logs = np.log(x / x.sum(axis=1, keepdims=True)).T
        self.logs = np.ascontiguousarray(logs - logs.max(axis=1, keepdims=True) if self.langs else logs, dtype=np.float32)
        share = np.array([script_words[k] / max(script_words[k].sum(), 1) for k in self.langs]).reshape(len(self.langs), SCRIPTS)
        uses = (share >= SCRIPT_SHARE).T
        self.uses = uses.copy()
        self.known = uses.any(axis=1) if self.langs else np.zeros(SCRIPTS, dtype=bool)
        uses[~uses.any(axis=1)] = True  # a script that no language uses tells nothing
        uses[0] = True
        self.barred = np.where(uses, 0, -SCRIPT_PENALTY).astype(np.float32)

    def candidates(self, scripts_seen: int) -> tuple[int, ...]:
        """The languages that use one of the scripts, given as bits; all languages if none does."""
        seen = [k for k in range(1, SCRIPTS) if scripts_seen >> k & 1]
        found = np.flatnonzero(self.uses[seen].any(axis=0)) if seen and self.langs else np.zeros(0, dtype=np.int64)
        return tuple(found.tolist()) or tuple(range(len(self.langs)))

    def narrowed(self, langs: tuple[int, ...]) -> Model:
        """The model of some of its languages only."""
        if len(langs) == len(self.langs):
            return self
        out = object.__new__(Model)
        out.langs, out.known, at = [self.langs[k] for k in langs], self.known, list(langs)
        out.logs, out.uses, out.barred = np.ascontiguousarray(self.logs[:, at]), self.uses[:, at], np.ascontiguousarray(self.barred[:, at])
        return out


def scripts_seen(texts: pa.Array) -> np.ndarray:
    """For each text, the scripts of its letters as bits."""
    out = [np.zeros(0, dtype=np.int64)]
    for _, w in slices(texts):
        bits = np.append(np.int64(1) << scripts(w).astype(np.int64), 0)
        out.append(np.where(np.diff(w.row_at) > 0, np.bitwise_or.reduceat(bits, w.row_at[:-1]), 0) & ~1 if w.rows else out[0])
    return np.concatenate(out)


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model from the rows of docs (doc_id, text, lang) with text and lang; about per_lang rows of a language, chosen by a hash of doc_id."""
    labelled = docs.filter("lang is not null and text is not null")
    sizes = docs.filter("lang is not null").groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("of_size"))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("of_size"))
    sized = labelled.select("doc_id", "lang", "text").join(broadcast_if_small(written(sizes)), F.col("lang") == F.col("of_lang"))
    chosen = sized.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sums = np.array(batch.column(0).to_pylist(), dtype=object), {}
            for low, w in slices(pc.utf8_lower(batch.column(1))):
                grams, first = trigrams(w)
                word = np.repeat(np.arange(len(w.start)), w.end - w.start)
                kind = np.maximum.reduceat(scripts(w)[~BLANK[w.buf]], first) if len(first) else first
                row, own = w.row_of_word(), langs[low : low + w.rows]
                for lang in sorted(set(own)):
                    mine = (own == lang)[row]
                    x = sums.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, dtype=np.int64))
                    x[:BUCKETS] += np.bincount(grams[mine[word]], minlength=BUCKETS)
                    x[BUCKETS:] += np.bincount(kind[mine], minlength=SCRIPTS)
            for lang, x in sums.items():
                k = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array(x[k], pa.int64())], ["lang", "at", "n"])
        give_back()

    rows = chosen.select("lang", "text").mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, at, n in rows.toLocalIterator():
        found.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, dtype=np.int64))[at] = n
    for x in found.values():
        x[BUCKETS] = 0  # words without a letter
    return Model({k: x[:BUCKETS] for k, x in found.items()}, {k: x[BUCKETS:] for k, x in found.items()})


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best path of labels through score (words x labels), for all rows at once, a word of each row at a time."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")  # rows longer than t
    kind = np.min_scalar_type(max(score.shape[1] - 1, 0))  # wide enough for all labels
    labels = np.arange(score.shape[1], dtype=kind)
    came, at, best = np.empty(score.shape, dtype=kind), first[:-1][order], np.zeros((len(order), score.shape[1]), dtype=np.float64)
    for t, n in enumerate(active):
        now, v = at[:n] + t, best[:n]
        top = v.argmax(axis=1)
        move = v[np.arange(n), top][:, None] - (penalty if t else 0)
        came[now] = np.where(v >= move, labels, top[:, None])
        best[:n] = np.maximum(v, move) + score[now]
    path, label = np.empty(len(score), dtype=kind), best.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        now = at[:n] + t
        path[now] = label[:n]
        label[:n] = came[now, label[:n]]
    return path


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """The columns keep of every row of docs, and (lang_pred, score, spans) under the given names.

    lang_pred has most of the words with a letter (ties: the first in code-point order); score is its
    share of them, where words in a script that it doesn't use count for no language. spans: array of (lang, start, end), in words, end exclusive. Null text, or text
    without a letter, is `und` with score 0 and no spans; so is all text if the model has no language.
    Repeated rows are labelled each; an empty table gives no rows. A very long text is labelled whole: time follows its
    length, memory its words times its candidate languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(texts: pa.Array, m: Model) -> list[pa.Array]:
        known, n_langs = np.array([*m.langs, "und"], dtype=object), len(m.langs)
        langs, scores, n_spans, parts = [], [], [], []
        for low, w in slices(texts, max_bytes=max(1 << 16, SLICE * 32 // max(n_langs, 32))):
            has = np.zeros(w.rows, dtype=bool)
            by_word, kind = np.zeros((len(w.start), n_langs), dtype=np.float32), np.zeros(len(w.start), dtype=np.int64)
            # scored in parts of some rows, to hold little at once; labelled all together
            for at, part in w.parts(max(1 << 12, SLICE_BYTES // 2 * 32 // max(n_langs, 32))):
                letter = scripts(part)
                has[at + np.searchsorted(part.row_at[1:], np.flatnonzero((letter > 0) & (part.buf < 128)), side="right")] = True
                if n_langs and len(part.start):
                    grams, begin = trigrams(part)
                    words = slice(w.first[at], w.first[at + part.rows])
                    kind[words] = np.maximum.reduceat(letter[~BLANK[part.buf]], begin)
                    by_word[words] = np.add.reduceat(m.logs[grams], begin, axis=0)
            for r in np.flatnonzero(~has & (np.diff(w.row_at) > 0)):
                has[r] = any(c.isalpha() for c in texts[low + int(r)].as_py() or "")
            if not n_langs or not len(w.start):
                langs.append(np.full(w.rows, n_langs))
                scores.append(np.zeros(w.rows))
                n_spans.append(np.zeros(w.rows, dtype=np.int64))
                continue
            by_word[kind == 0] = 0
            by_word += m.barred[kind]
            path, row = viterbi(by_word, w.first), w.row_of_word()
            count = lambda which: np.bincount(row[which] * n_langs + path[which].astype(np.int64), minlength=w.rows * n_langs).reshape(w.rows, n_langs)  # noqa: B023, E731
            held = count(kind > 0)
            # letters outside the script ranges: all words of the text vote
            held = np.where(held.any(axis=1, keepdims=True), held, count(kind >= 0))
            top = held.argmax(axis=1)
            langs.append(np.where(has, top, n_langs))
            own = count(m.known[kind] & (m.barred[kind, path] == 0))[np.arange(w.rows), top]
            scores.append(np.where(has, own / np.maximum(held.sum(axis=1), 1), 0.0))
            new = np.ones(len(path), dtype=bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new & has[row])
            end = np.minimum(np.append(at[1:], len(path)), w.first[row[at] + 1])
            n_spans.append(np.bincount(row[at], minlength=w.rows))
            parts.append((path[at].astype(np.int64), at - w.first[row[at]], end - w.first[row[at]]))
        label, start, end = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
        flat = pa.StructArray.from_arrays([pa.array(known[label], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["lang", "start", "end"])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(n_spans))])
        return [pa.array(known[np.concatenate(langs)], pa.string()), pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]

    def compute(texts: pa.Array) -> list[pa.Array]:
        texts, m = pc.utf8_lower(texts), shared.value
        seen = scripts_seen(texts)
        of = {int(x): m.candidates(int(x)) for x in np.unique(seen)}
        if len(set(of.values())) < 2:
            return labelled(texts, m.narrowed(next(iter(of.values()))) if of else m)
        parts, rows = [], []
        for langs in sorted(set(of.values())):
            mine = np.flatnonzero(np.isin(seen, [x for x, own in of.items() if own == langs]))
            rows.append(mine)
            parts.append(labelled(texts.take(pa.array(mine)), m.narrowed(langs)))
        back = pa.array(np.argsort(np.concatenate(rows)))
        return [pa.concat_arrays(c).take(back) for c in zip(*parts, strict=True)]

    return appended(docs, keep, text, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` array<struct<lang:string,start:bigint,end:bigint>>", compute)
