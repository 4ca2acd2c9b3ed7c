"""Operator 3 with very many languages: the same distances as by whole histograms, in bounded memory."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from marquee.llm import quality
from marquee.llm.kernel import slices


def many(languages: int, common: int, texts: int, words: int):
    """Texts of common words of random languages and of rare words, and a reference of each language made of its own text."""
    r = random.Random(9)
    vocabulary = {k: [f"l{k}w{j}" for j in range(common)] for k in range(languages)}
    of = [r.randrange(languages) for _ in range(texts)]
    rows = [" ".join(r.choice(vocabulary[k]) if r.random() < 0.6 else f"x{r.randrange(5000)}" for _ in range(words)) for k in of]
    refs = {}
    for k in range(languages):
        _, w = next(slices(pa.array([" ".join(vocabulary[k])])))
        classes, hashes = quality.histograms(w)
        refs[f"l{k}"] = classes.sum(axis=0), np.sort(hashes), np.append(3 * common, r.choices(range(1, 9), k=common))
    return rows, refs


def test_distances_are_those_of_whole_histograms():
    rows, refs = many(5, 8, 30, 40)
    rows += ["", "x1 x2", "l0w1"]
    refs["none"] = refs["l0"][0], np.zeros(0, dtype=np.uint64), np.array([0])
    _, w = next(slices(pa.array(rows)))
    got = quality.distances(w, refs)
    classes, hashes = quality.histograms(w)
    row = w.row_of_word()
    for k in range(w.rows):
        want = []
        for class_ref, own, word_ref in refs.values():
            counts = [int((hashes[row == k] == x).sum()) for x in own]
            whole = np.array([[w.counts[k] - sum(counts), *counts]])
            want.append((quality.js_distance(classes[k : k + 1], class_ref)[0], quality.js_distance(whole, word_ref)[0], quality.js_distance(np.eye(1, len(word_ref)), word_ref)[0]))
        best = min(want, key=lambda x: x[0] + x[1])
        assert np.allclose([got[0][k], got[1][k], got[2][k]], best, atol=1e-9)


def test_many_languages_take_little_memory():
    """150 languages of 60 common words: under 100 MB for a slice, where rows times common words took three times as much."""
    rows, refs = many(150, 60, 4000, 40)
    _, w = next(slices(pa.array(rows)))
    tracemalloc.start()
    quality.distances(w, refs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.rows > 2000 and peak < 100 << 20
