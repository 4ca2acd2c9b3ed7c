"""Quality rules by distribution divergence (operator 3).

Two histograms of a document, of character classes and of common words, are compared with those of
each language by the Jensen-Shannon distance. The references are counts over all labelled documents:
a language's common words are those that make up at least COMMON_SHARE of its words, found by counting
bins of word hashes first, which bounds the candidates, and then the words of the common bins each.
A document is rejected if it is far from every language; texts under the minimum lengths are not
judged by distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import appended, written
from .kernel import BLANK, LOWER, Words, hash_order, slices, splitmix, window_hashes
from .langid import SCRIPT_RANGES, SCRIPTS, scripts

BINS = 1 << 12
COMMON_SHARE = 0.004
#: Minimum lengths: characters in words for the class distance, words for the word distance.
MIN_CHARS, MIN_WORDS = 200, 50
#: A text is far from a language beyond this class distance, or beyond this share of the word distance that a text without any of its common words has.
#: Set with the labels of three small tables in view; README has what they do there and on a table that was not looked at before.
MAX_CLASS_DISTANCE, MAX_WORD_SHARE = 0.28, 0.97
#: The base rules.
MIN_KEPT_WORDS, MAX_REPEAT_PERCENT = 50, 50

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

#: Character classes: ASCII lower and upper case, digits, blanks, common punctuation and the rest of ASCII; beyond ASCII, one for each script of letters (OTHER + its number), and OTHER for what is no letter.
ASCII_CLASS = np.full(256, 5)
ASCII_CLASS[ord("a") : ord("z") + 1] = 0
ASCII_CLASS[ord("A") : ord("Z") + 1] = 1
ASCII_CLASS[ord("0") : ord("9") + 1] = 2
ASCII_CLASS[BLANK] = 3
ASCII_CLASS[list(b".,;:!?'\"()-")] = 4
OTHER = 6
CLASSES = OTHER + SCRIPTS

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _by_row(flags: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[row_at])


def _groups(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items are equal to another one of their row, and which are the first of theirs."""
    keys = splitmix(row) ^ hashes
    order = hash_order(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice, first = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first[order[1:][same]] = False
    return twice, first


def base_stats(w: Words) -> dict[str, np.ndarray]:
    """The contract's counts of each row."""
    raw, n = w.buf, len(w.buf)
    inside = ~BLANK[raw]
    out = {"n_words": w.counts, "word_chars": _by_row(inside & ((raw & 0xC0) != 0x80), w.row_at), "n_symbols": _by_row(SYMBOLS[raw], w.row_at)}
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(w.row_at[:-1], breaks + 1)
    starts = starts[starts < n]
    # a line ends at the next line break or the next row, whichever comes first
    ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], w.row_at[1:][np.searchsorted(w.row_at[1:], starts, side="right")] if n else starts)
    words = np.concatenate([[0], np.cumsum(inside)])
    worded = words[ends] > words[starts]
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(w.row_at[1:], starts, side="right")
    _, first = _groups(row, w.byte_ranges(starts, ends))
    out["n_dup_lines"] = np.bincount(row[~first], minlength=w.rows)
    at, row = w.windows(3)
    twice, _ = _groups(row, window_hashes(w.hashes(), at, 3))
    at = at[twice]
    covered = np.zeros(len(w.start), dtype=bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = np.bincount(w.row_of_word()[covered], minlength=w.rows)
    return out


def histograms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of each row (rows x CLASSES), and the hash of each word in lower case."""
    row = np.repeat(np.arange(w.rows), np.diff(w.row_at))
    first = (w.buf & 0xC0) != 0x80
    kind = np.where(w.buf < 0x80, ASCII_CLASS[w.buf], OTHER + scripts(w).astype(np.int64))
    classes = np.bincount(row[first] * CLASSES + kind[first], minlength=w.rows * CLASSES).reshape(w.rows, CLASSES)
    return classes, w.byte_ranges(w.start, w.end, LOWER)


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BINS)).astype(np.int64)


def _summed(docs: DataFrame, counter: Callable[[Words], Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(lang, at, n): the sums of what counter(words)(language, rows of the language) finds, (at, n), over all rows with text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for low, w in slices(batch.column(1)):
                own, count = langs[low : low + w.rows], counter(w)
                for lang in sorted(set(own)):
                    at, n = count(lang, own == lang)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["lang", "at", "n"])

    rows = docs.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(run, "lang string, at long, n long")
    return rows.groupBy("lang", "at").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Language: (class counts, hashes of its common words, their counts after that of all other words), over all rows with text and lang.

    Every language has one, however few its rows; its size is bounded by 1 / COMMON_SHARE words.
    """

    def binned(w: Words) -> Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        classes, hashes = histograms(w)
        bins, row = _bin(hashes), w.row_of_word()

        def count(lang: str, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = np.concatenate([classes[mine].sum(axis=0), np.bincount(bins[mine[row]], minlength=BINS)])
            at = np.flatnonzero(x)
            return at, x[at]

        return count

    table = written(_summed(docs, binned))
    words = table.filter(F.col("at") >= CLASSES).groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("total"))
    common = table.join(words, F.col("lang") == F.col("of_lang"), "left").filter((F.col("at") < CLASSES) | (F.col("n") >= COMMON_SHARE * F.col("total")))
    totals: dict[str, int] = {}
    classes: dict[str, np.ndarray] = {}
    bins: dict[str, np.ndarray] = {}
    for lang, at, n, total in common.select("lang", "at", "n", "total").toLocalIterator():
        totals[lang] = total or 0
        if at < CLASSES:
            classes.setdefault(lang, np.zeros(CLASSES, dtype=np.int64))[at] = n
        else:
            bins.setdefault(lang, np.zeros(BINS, dtype=bool))[at - CLASSES] = True
    shared = docs.sparkSession.sparkContext.broadcast(bins)

    def each_word(w: Words) -> Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        hashes = w.byte_ranges(w.start, w.end, LOWER)
        bins, row = _bin(hashes), w.row_of_word()

        def count(lang: str, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = mine[row] & shared.value[lang][bins] if lang in shared.value else np.zeros(len(hashes), dtype=bool)
            at, n = np.unique(hashes[own], return_counts=True)
            return at.view(np.int64), n

        return count

    least = docs.sparkSession.createDataFrame([(k, COMMON_SHARE * n) for k, n in totals.items()], "of_lang string, least double")
    found = _summed(docs, each_word).join(F.broadcast(least), F.col("lang") == F.col("of_lang")).filter("n >= least")
    counts: dict[str, dict[int, int]] = {}
    for lang, at, n in found.select("lang", "at", "n").toLocalIterator():
        counts.setdefault(lang, {})[at] = n
    out = {}
    for lang in sorted(totals):
        own = counts.get(lang, {})
        hashes = np.sort(np.array(list(own), dtype=np.int64).view(np.uint64))
        n = np.array([own[k] for k in hashes.view(np.int64).tolist()], dtype=np.int64)
        out[lang] = classes.get(lang, np.zeros(CLASSES, dtype=np.int64)), hashes, np.append(totals[lang] - n.sum(), n)
    return out


def _term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What shares a and b of one value add to the Jensen-Shannon divergence (base 2)."""
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.where(a > 0, a * np.log2(a / m), 0) + np.where(b > 0, b * np.log2(b / m), 0)) / 2


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row of counts p to the counts q; 0 for a row without counts."""
    total = p.sum(axis=1, keepdims=True)
    part = _term(p / np.maximum(total, 1), (q / max(q.sum(), 1))[None, :])
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(part.sum(axis=1), 0, 1)), 0.0)


def distances(w: Words, refs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's class and word distance to the language nearest to it by their sum, and the word distance that a text without a common word of it has; 0 without references.

    Only pairs of a row and a common word that occur are kept: what this holds follows the words, not rows times languages.
    """
    classes, hashes = histograms(w)
    best, row = [np.zeros(w.rows) for _ in range(3)], w.row_of_word()
    common = np.unique(np.concatenate([x[1] for x in refs.values()])) if refs else np.zeros(0, dtype=np.uint64)
    at = np.searchsorted(common, hashes)
    known = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == hashes) if len(common) else np.zeros(0, dtype=np.int64)
    pair, times = np.unique(row[known] * max(len(common), 1) + at[known], return_counts=True)
    row, word = np.divmod(pair, max(len(common), 1))
    share = times / np.maximum(w.counts, 1)[row]
    summed = lambda which, x: np.bincount(row[which], x, w.rows)
    for k, (class_ref, own, word_ref) in enumerate(refs.values()):
        b = np.zeros(len(common))
        total = max(word_ref.sum(), 1)
        b[np.searchsorted(common, own)] = word_ref[1:] / total
        mine = np.flatnonzero(b[word] > 0)
        ours, theirs = share[mine], b[word[mine]]
        # common words that a row lacks add half of their shares; all words that aren't common are one value
        lacked = b.sum() - summed(mine, theirs)
        others = np.clip(1 - summed(mine, ours), 0, 1)
        apart = summed(mine, _term(ours, theirs)) + lacked / 2 + _term(others, np.full(w.rows, word_ref[0] / total))
        by_word = np.where(w.counts > 0, np.sqrt(np.clip(apart, 0, 1)), 0.0)
        none = js_distance(np.eye(1, len(word_ref)), word_ref)
        now = [js_distance(classes, class_ref), by_word, np.repeat(none, w.rows)]
        nearer = np.ones(w.rows, dtype=bool) if k == 0 else now[0] + now[1] < best[0] + best[1]
        best = [np.where(nearer, x, y) for x, y in zip(now, best, strict=True)]
    return best[0], best[1], best[2]


def judge_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance) of every row.

    docs: doc_id, text, lang; other columns are ignored. Null or empty text has no words and fails the
    base. Rows with null lang are judged but are no part of a reference; without any reference (an
    empty table, no labels) nothing is rejected by distance. Repeated rows are judged each. A very long
    text is counted whole, in time and memory that follow its length. Distances are those to the
    nearest language (by their sum; ties: the first in code-point order), to six decimals.
    """
    refs = docs.sparkSession.sparkContext.broadcast(references(docs))

    def compute(texts: pa.Array) -> list[pa.Array]:
        done = []
        for _, w in slices(texts):
            x = base_stats(w)
            failed = (x["n_words"] < MIN_KEPT_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
            by_class, by_word, none = distances(w, refs.value)
            odd = (by_class > MAX_CLASS_DISTANCE) & (x["word_chars"] >= MIN_CHARS) | (by_word > MAX_WORD_SHARE * none) & (x["n_words"] >= MIN_WORDS)
            done.append([*(x[k] for k in STATS), failed, ~failed & ~odd, by_class.round(6), by_word.round(6)])
        return [pa.array(np.concatenate(c)) for c in zip(*done, strict=True)]

    fields = f"{', '.join(f'{k} long' for k in STATS)}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return appended(docs, ["doc_id"], "text", fields, compute)


def _class_sql(code: str) -> str:
    """The class of a code point, as SQL: the tables above, range by range."""
    ascii_ = ASCII_CLASS[:128].tolist()
    starts = [0, *[k for k in range(1, 128) if ascii_[k] != ascii_[k - 1]]]
    ranges = [(k, ascii_[k]) for k in starts] + [(max(k, 128), OTHER + x) for (k, x), (end, _) in zip(SCRIPT_RANGES, [*SCRIPT_RANGES[1:], (1 << 21, 0)], strict=True) if end > 128]
    return "CASE " + " ".join(f"WHEN {code} >= {k} THEN {x}" for k, x in reversed(ranges)) + " END"


#: A term of the Jensen-Shannon divergence of shares a and b.
_TERM = "(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2"

#: DuckDB SQL of the query op3_quality.
QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, text IS NOT NULL AS has, lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS m FROM (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2) x) y),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM win WHERE m > 1) x GROUP BY r),
base AS (SELECT w.r, doc_id, has, lang, w, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN dup ON w.r = dup.r LEFT JOIN rep ON w.r = rep.r),
ch AS (SELECT r, {_class_sql("u")} AS k, count(*) AS n FROM (SELECT r, unicode(unnest(regexp_extract_all(text, '(?s).'))) AS u FROM d) x GROUP BY ALL),
cr AS (SELECT lang, k, sum(n) AS n FROM ch JOIN d ON ch.r = d.r WHERE lang IS NOT NULL AND has GROUP BY ALL),
cs AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS b FROM cr),
langs AS (SELECT DISTINCT lang FROM cr),
ca AS (SELECT r, k, n / sum(n) OVER (PARTITION BY r) AS a FROM ch),
ck AS (SELECT r, lang, k FROM ch, langs UNION SELECT r, lang, k FROM cs, (SELECT DISTINCT r FROM ch) x),
cd AS (SELECT r, lang, sqrt(greatest(sum({_TERM}), 0)) AS c FROM (SELECT ck.r, ck.lang, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM ck LEFT JOIN ca ON ck.r = ca.r AND ck.k = ca.k LEFT JOIN cs ON ck.lang = cs.lang AND ck.k = cs.k) x GROUP BY r, lang),
words AS (SELECT r, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM (SELECT r, lang, unnest(w) AS x FROM base) y),
wc AS (SELECT r, x, count(*) AS n FROM words GROUP BY r, x),
tot AS (SELECT lang, count(*) AS total FROM words WHERE lang IS NOT NULL GROUP BY lang),
common AS (SELECT lang, x, n / total AS b FROM (SELECT lang, x, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang, x) y JOIN tot USING (lang) WHERE n >= {COMMON_SHARE}::DOUBLE * total),
other AS (SELECT tot.lang, 1 - coalesce(sum(b), 0) AS b FROM tot LEFT JOIN common ON tot.lang = common.lang GROUP BY tot.lang),
none AS (SELECT lang, sqrt(greatest(sum({_TERM}), 0)) AS none FROM (SELECT lang, 0 AS a, b FROM common UNION ALL SELECT lang, 1 AS a, b FROM other) x GROUP BY lang),
seen AS (SELECT r, common.lang, n, b FROM wc JOIN common ON wc.x = common.x),
part AS (SELECT r, lang, sum(n) AS n, sum(b) AS b, sum(s) AS s FROM (SELECT seen.r, seen.lang, n, b, {_TERM} AS s FROM (SELECT seen.r, seen.lang, seen.n, b, seen.n / n_words AS a FROM seen JOIN base ON seen.r = base.r) seen) x GROUP BY r, lang),
wd AS (SELECT r, lang, sqrt(greatest(coalesce(s, 0) + (1 - o - coalesce(pb, 0)) / 2 + {_TERM}, 0)) AS w
       FROM (SELECT base.r, other.lang, part.s, part.b AS pb, other.b AS o, other.b AS b, (n_words - coalesce(part.n, 0)) / n_words AS a
             FROM base JOIN other ON n_words > 0 LEFT JOIN part ON base.r = part.r AND other.lang = part.lang) x),
best AS (SELECT cd.r, arg_min(struct_pack(c := c, w := coalesce(w, 0), none := coalesce(none, 0)), struct_pack(s := c + coalesce(w, 0), l := cd.lang)) AS m
         FROM cd LEFT JOIN wd ON cd.r = wd.r AND cd.lang = wd.lang LEFT JOIN none ON cd.lang = none.lang GROUP BY cd.r),
judged AS (SELECT base.*, n_words < {MIN_KEPT_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(m.c, 0)::DOUBLE AS c, coalesce(m.w, 0)::DOUBLE AS w_, coalesce(m.none, 0)::DOUBLE AS none
           FROM base LEFT JOIN best ON base.r = best.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (c > {MAX_CLASS_DISTANCE}::DOUBLE AND word_chars >= {MIN_CHARS} OR w_ > {MAX_WORD_SHARE}::DOUBLE * none AND n_words >= {MIN_WORDS}) AS kept,
       round(c, 6) AS class_distance, round(w_, 6) AS word_distance
FROM judged
"""
