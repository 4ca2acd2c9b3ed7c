"""Operator 7 as a whole against a plain version: trigram counts, scripts, candidates, paths, labels, scores and spans of each document."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from marquee.llm import langid
from marquee.llm.frames import table
from pyspark.sql import functions as F

from .data import documents
from .test_operators_llm import WORD


def script(c: str) -> int:
    return [s for low, s in langid.SCRIPT_RANGES if low <= ord(c)][-1]


def grams(word: str) -> list[int]:
    b = [32, *word.encode(), 32]
    return [((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 17 for x, y, z in zip(b, b[1:], b[2:], strict=False)]


class PlainModel:
    def __init__(self, rows: list[tuple[str, str]]) -> None:
        counts, kinds = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in WORD.findall(text.lower()):
                counts[lang].update(grams(w))
                kinds[lang][max(map(script, w))] += 1
        self.langs = sorted(counts)
        total = {k: sum(counts[k].values()) + langid.BUCKETS / 2 for k in self.langs}
        logs = lambda g: [math.log((counts[k][g] + 0.5) / total[k]) for k in self.langs]
        self.logs = {g: [x - max(row) for x in row] for g in range(langid.BUCKETS) for row in [logs(g)]}
        share = lambda k, s: kinds[k][s] / max(1, sum(n for x, n in kinds[k].items() if x))
        self.uses = {s: [share(k, s) >= langid.SCRIPT_SHARE for k in self.langs] for s in range(1, langid.SCRIPTS)}

    def identify(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        text = (text or "").lower()
        words = WORD.findall(text)
        if not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0, []
        seen = {script(c) for c in text} - {0}
        some = [k for k in range(len(self.langs)) if any(self.uses[s][k] for s in seen)] or list(range(len(self.langs)))
        kinds = [max(map(script, w)) for w in words]
        used = lambda s, k: self.uses[s][k] or not any(self.uses[s])
        scores = [[0.0 if not s else sum(self.logs[g][k] for g in grams(w)) - (0 if used(s, k) else langid.SCRIPT_PENALTY) for k in some] for w, s in zip(words, kinds, strict=True)]
        best, came = [0.0] * len(some), []
        for t, now in enumerate(scores):
            top = best.index(max(best))
            move = best[top] - (langid.SWITCH_PENALTY if t else 0)
            came.append([k if best[k] >= move else top for k in range(len(some))])
            best = [max(b, move) + x for b, x in zip(best, now, strict=True)]
        label, path = best.index(max(best)), []
        for step in reversed(came):
            path.append(label)
            label = step[label]
        path.reverse()
        voters = [p for p, s in zip(path, kinds, strict=True) if s] or path
        n = Counter(voters)
        top = max(sorted(n), key=lambda k: n[k])
        own = sum(1 for p, s in zip(path, kinds, strict=True) if p == top and s and self.uses[s][some[p]])
        spans, at = [], 0
        for k in range(1, len(path) + 1):
            if k == len(path) or path[k] != path[at]:
                spans.append((self.langs[some[path[at]]], at, k))
                at = k
        return self.langs[some[top]], own / len(voters), spans


@pytest.mark.parametrize("given", [True, False])
def test_identify_is_the_plain_version(spark, sf, given):
    if given:
        docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    else:
        r, rows = random.Random(1), [x[:3] for x in documents()[0]]
        mixed = ["the cat и кот sat на ковре", "να ένα παιδί and the end", "日本 の 本", "ҐҐҐ", "ⴰⴱ", "1 2 3 a", "ß é ñ", "abc " * 700]
        rows += [(1000 + k, t, r.choice(["en", "ru", "el", None])) for k, t in enumerate(mixed * 3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    rows = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("out")).collect()
    plain = PlainModel([(x.text, x.lang) for x in rows if x.lang is not None and x.text is not None and x.doc_id is not None and not x.out])
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    assert model.langs == plain.langs
    assert np.allclose(model.logs, [plain.logs[g] for g in range(langid.BUCKETS)], atol=1e-4)
    got = Counter(str((x.doc_id, x.lang_pred, round(x.score, 9), [tuple(s) for s in x.spans])) for x in langid.identify(docs, model).collect())
    want = Counter()
    for x in rows:
        lang, score, spans = plain.identify(x.text)
        want[str((x.doc_id, lang, round(score, 9), spans))] += 1
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
