"""Similarity of many pairs of texts at once: longest common subsequences by bits, in NumPy.

A text of up to 64 letters is one 64-bit word, a longer one several with carries between them. All pairs of a batch take
each step together, so the cost is the letters of the longest text and not the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of the tables held at once: bit masks of letters, and letters of windows.
CELLS = 1 << 21
_U = np.uint64
_ONE, _ALL = _U(1), ~_U(0)


def letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins (one more than texts)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size)])


def _padded(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows flat[start:start + size], filled up with -1."""
    at = np.arange(max(1, size.max(initial=0)))
    inside = at[None, :] < size[:, None]
    out = np.full(inside.shape, -1, dtype=np.int64)
    out[inside] = flat[(start[:, None] + at[None, :])[inside]]
    return out


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row, the longest common subsequence of a and b (padded letters); size: letters of a's rows."""
    _, code = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    pad = int(min(a.min(initial=0), b.min(initial=0)) < 0)  # the padding is the least code then
    code_a, code_b = code[: a.size].reshape(a.shape), code[a.size :].reshape(b.shape)
    n, words, row = len(a), -(-a.shape[1] // 64), np.arange(len(a))
    mask = np.zeros((n, int(code.max(initial=0)) + 1, words), dtype=np.uint64)
    for k in range(a.shape[1]):
        some = row[size > k]
        mask[some, code_a[some, k], k // 64] |= _ONE << _U(k % 64)
    if pad:
        mask[:, 0] = 0
    left = np.full((n, words), _ALL)
    with np.errstate(over="ignore"):
        for k in range(b.shape[1]):
            hit = mask[row, code_b[:, k]]
            carry = np.zeros(n, dtype=np.uint64)
            for w in range(words):
                both = left[:, w] & hit[:, w]
                part = left[:, w] + both
                total = part + carry
                carry = ((part < both) | (total < carry)).astype(np.uint64)
                left[:, w] = total | (left[:, w] & ~hit[:, w])
    bits = np.clip(size[:, None] - 64 * np.arange(words)[None, :], 0, 64)
    inside = np.where(bits == 64, _ALL, (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
    return size - np.bitwise_count(left & inside).sum(axis=1, dtype=np.int64)


def _in_parts(flat_a: np.ndarray, start_a: np.ndarray, size_a: np.ndarray, flat_b: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """_common() of ranges of two rows of letters, alike in size where they are done together, and CELLS at once."""
    out, order = np.zeros(len(size_a), dtype=np.int64), np.lexsort((size_b, size_a))
    low = 0
    while low < len(order):
        width = int(size_a[order[min(low + 4095, len(order) - 1)]]) + 1
        part = order[low : low + max(1, min(4096, CELLS // (64 * -(-width // 64))))]
        out[part] = _common(_padded(flat_a, start_a[part], size_a[part]), _padded(flat_b, start_b[part], size_b[part]), size_a[part])
        low += len(part)
    return out


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Similarity in percent of each pair: 2 * common / both lengths, before rounding; 0 of two empty texts."""
    (flat_a, at_a), (flat_b, at_b) = letters(a), letters(b)
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    common = _in_parts(flat_a, at_a[:-1], size_a, flat_b, at_b[:-1], size_b)
    return 200 * common / np.maximum(size_a + size_b, 1)


def window_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The greatest similarity, in percent, of the shorter text of each pair with any window of the longer one that is as long."""
    swap = [len(x) > len(y) for x, y in zip(a, b, strict=True)]
    short, long_ = ([y if s else x for x, y, s in zip(a, b, swap, strict=True)], [x if s else y for x, y, s in zip(a, b, swap, strict=True)])
    (flat_s, at_s), (flat_l, at_l) = letters(short), letters(long_)
    size = np.diff(at_s)
    windows = np.where(size > 0, np.diff(at_l) - size + 1, 0)
    out, done = np.zeros(len(size)), 0
    upto = np.cumsum(windows)
    while done < len(size):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + (CELLS >> 4), side="right")))
        n = windows[done:stop]
        pair = np.repeat(np.arange(done, stop), n)
        shift = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        common = _in_parts(flat_s, at_s[pair], size[pair], flat_l, at_l[pair] + shift, size[pair])
        np.maximum.at(out, pair, 100 * common / np.maximum(size[pair], 1))
        done = stop
    return out


def _distinct(a: pa.Array, b: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
    """The distinct pairs of two string arrays without nulls, and each row's place among them."""
    both = pc.dictionary_encode(pa.concat_arrays([a.cast(pa.large_string()), b.cast(pa.large_string())]))
    code, n = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(a)
    pairs, at = np.unique(code[:n] << 32 | code[n:], return_inverse=True)
    take = lambda x: both.dictionary.take(pa.array(x)).to_pylist()
    return take(pairs >> 32), take(pairs & 0xFFFFFFFF), at


def collapsed(x: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(x, "[^a-z0-9]", "")


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of cleaned texts: 100 if equal but for marks, else the better of the whole ratio and the best window of the longer one; 0 with an empty or null text."""
    a, b = (pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(x, ""))) for x in (a, b))
    one, two, at = _distinct(a, b)
    score = np.maximum(np.rint(ratios(one, two)), np.rint(window_ratios(one, two))).astype(np.int64)
    one, two = pa.array(one, pa.string()), pa.array(two, pa.string())
    score[pc.equal(collapsed(one), collapsed(two)).to_numpy(zero_copy_only=False)] = 100
    score[pc.or_(pc.equal(one, ""), pc.equal(two, "")).to_numpy(zero_copy_only=False)] = 0
    return score[at]


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def word_scores(a: pa.Array, b: pa.Array, most_apart: int = 2) -> np.ndarray:
    """Of words: 100 if equal but for marks, else the rounded ratio of words of nearly the same length, else 0."""
    one, two, at = _distinct(a, b)
    size = lambda x: np.fromiter(map(len, x), dtype=np.int64, count=len(x))
    score = np.where(np.abs(size(one) - size(two)) <= most_apart, half_up(ratios(one, two)), 0)
    one, two = pa.array(one, pa.string()), pa.array(two, pa.string())
    score[pc.equal(collapsed(one), collapsed(two)).to_numpy(zero_copy_only=False)] = 100
    return score[at]


def mean_of_best(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each pair of lists of words, the mean over a's words of their best score with any word of b, rounded down; 0 without words."""
    na, nb = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    each, fa, fb = na * nb, np.cumsum(na) - na, np.cumsum(nb) - nb
    pair = np.repeat(np.arange(len(a)), each)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    i, j = fa[pair] + k // np.maximum(nb[pair], 1), fb[pair] + k % np.maximum(nb[pair], 1)
    score = word_scores(a.flatten().take(pa.array(i)), b.flatten().take(pa.array(j)))
    best = np.zeros(int(na.sum()), dtype=np.int64)
    np.maximum.at(best, i, score)
    total = np.bincount(np.repeat(np.arange(len(a)), na), weights=best, minlength=len(a))
    return (total // np.maximum(na, 1)).astype(np.int64)
