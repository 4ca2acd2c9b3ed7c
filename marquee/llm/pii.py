"""Personal data by a skip-chain conditional random field (operator 2).

Patterns with checks give the base spans, which are observed labels. Other mentions that might be
personal data (numbers, handles, incomplete addresses) are the free nodes of a random field over the
document: neighbours in the text share chain potentials, and mentions that repeat or resemble each
other share skip potentials, however far apart. Loopy sum-product message passing labels the free
nodes; those not labelled O are added spans.

The potentials are learned on a bounded, hash-chosen sample of documents (SAMPLE). Each base span is hidden and shown
as it looks when it has lost what makes it match (its +, its domain, its separators), beside a whole copy of
itself: a right twin. Free mentions and names with digits or marks that have no twin are shown as they are, and also beside a
base span that they merely resemble: wrong twins, of which WRONG says how often they occur. A regression learns from
what they look like, the words around them, their neighbours and each kind of twin to tell the labels. Nothing
bounds what looks, words or twins may count for.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import appended, free_name
from .kernel import buffers

#: Fixed values of the contract: kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Documents that the potentials are learned from, about; kinds of examples among them, the most frequent first.
SAMPLE, EXAMPLES = 20000, 50000
#: Steps of the regression, its rate, and the weight of the prior that keeps potentials small.
STEPS, RATE, PRIOR = 300, 0.1, 1.0
#: Log-odds against O that a free mention needs to become a span: 9 to 1.
LEAST_ODDS = 2.2
#: Keeps sums of potentials within what exp() takes; far beyond any learned sum, so it decides nothing.
NODE_CLIP = 40.0
#: The skip potential of a kind of twins where a sample has nothing to learn it from, and the mean of its prior.
DEFAULT_SKIP = 4.0
#: Kinds of twins: the same number (a phone with or without its country), a number with the same last digits, the same address, the same name.
TWINS = ("same", "tail", "ip", "name")
#: The share of wrong ones among the twins of the examples.
WRONG = 0.05
ROUNDS, DAMPING = 12, 0.3
#: Digits that two numbers must share at their ends to be alike, and the least length of a handle.
ALIKE_DIGITS, HANDLE = 9, 5
#: Kinds of words around a mention, by hash.
WORD_KINDS = 256

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LABEL = re.compile(r"[A-Za-z0-9-]+")
# a number that fails from its first digit fails from all others: looking back keeps the scan linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![0-9])[0-9][0-9().\x20-]*[0-9]")
NAME = re.compile(r"[A-Za-z0-9._%+-]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
NEXT_WORD = re.compile(r"[^A-Za-z\n]{0,4}([A-Za-z]+)")
LAST_WORD = re.compile(r"([A-Za-z]+)[^A-Za-z\n]{0,4}$")

#: Bytes without which a text has no base span and no free node.
HINTS = np.isin(np.arange(256), list(b"0123456789@"))


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


@dataclass
class Mention:
    start: int
    end: int
    label: int  # of LABELS; for a base span
    base: bool
    features: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


@dataclass
class Weights:
    """Potentials: of a feature for each label, of labels of neighbours, and of twins having one label: skips by kind of twins, skip for kinds that it lacks."""

    node: dict[str, np.ndarray] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    skip: float = DEFAULT_SKIP
    skips: dict[str, float] = field(default_factory=lambda: {"tail": 0.0})

    def twin(self, kind: str) -> float:
        return self.skips.get(kind, self.skip)


def _at_signs(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of what stands around each @: whole if it is an email, else a name and one label."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            if m := DOMAIN.match(text, at + 1):
                yield start, m.end(), True
                done = m.end()
            elif m := LABEL.match(text, at + 1):
                yield start, m.end(), False
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the base kinds, by kind and start."""
    out = [(1, s, e) for s, e, whole in _at_signs(text) if whole]
    out += [(2, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((3, *m.span()))
    out += [(4, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _word(m: re.Match | None) -> object:
    return zlib.crc32(m[1].lower().encode()) % WORD_KINDS if m else "none"


def _features(text: str, start: int, end: int, seen: str) -> tuple[str, ...]:
    """What a mention of text[start:end] looks like if it reads `seen`, and the words around it."""
    digits = NOT_DIGIT.sub("", seen)
    return (
        "any", f"digits {min(len(digits) // 4, 5)}", f"marks {''.join(sorted(set(seen) & set('@. -()')))}", f"letters {any(c.isalpha() for c in seen)}", f"plus {seen[:1] == '+'}",
        f"luhn {len(digits) >= 13 and luhn(digits)}", f"after {_word(LAST_WORD.search(text, max(0, start - 24), start))}", f"then {_word(NEXT_WORD.match(text, end, end + 24))}",
    )


def _keys(said: str) -> tuple[str, ...]:
    """What a mention shares with its twins: each key begins with their kind."""
    digits = NOT_DIGIT.sub("", said)
    parts = [x for x in NOT_DIGIT.split(said) if x]
    if "@" in said:
        return ("name " + said.partition("@")[0].lower(),)
    if len(digits) >= ALIKE_DIGITS and len(digits) * 2 > len(said):
        # a phone is also said without its country, which has three digits at most
        whole = {digits[k:].lstrip("0") for k in range(4 if said[0] == "+" else 1) if len(digits) - k >= ALIKE_DIGITS}
        return (*(f"same {x}" for x in sorted(whole)), "tail " + digits[-ALIKE_DIGITS:])
    if len(parts) == 4 and not any(c.isalpha() for c in said) and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts):
        return ("ip " + ".".join(str(int(x)) for x in parts),)
    return ("name " + said.lower(),)


def mentions(text: str) -> list[Mention]:
    """Base spans and free nodes of a text, in the order of their starts."""
    base = [Mention(s, e, k, True) for k, s, e in base_spans(text)]
    taken = sorted((m.start, m.end) for m in base)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, dtype=np.int64)
    starts = np.array([s for s, _ in taken], dtype=np.int64)

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(starts, e)) - 1
        return k < 0 or ends[k] <= s

    spans = {(s, e) for s, e, whole in _at_signs(text) if not whole}
    spans |= {m.span() for m in NUMBER.finditer(text) if m.end() - m.start() >= 7}
    handles = {h for m in base if m.label == 1 if len(h := text[m.start : text.index("@", m.start)].lower()) >= HANDLE and not h.isalpha()}
    if handles:
        spans |= {m.span() for m in NAME.finditer(text) if m[0].lower().rstrip(".") in handles}
    out, last = [], -1
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= last and free(s, e):
            out.append(Mention(s, e, 0, False))
            last = e
    out = sorted(base + out, key=lambda m: (m.start, m.end, m.label))
    if any(not m.base for m in out):
        for m in out:
            said = text[m.start : m.end]
            m.features, m.keys = _features(text, m.start, m.end, said), _keys(said)
    return out


def _broken(said: str, label: int) -> list[str]:
    """Forms of a base span that no pattern finds."""
    if label == 1:
        name, _, domain = said.partition("@")
        return [name, f"{name}@{domain.partition('.')[0]}"]
    digits = NOT_DIGIT.sub("", said)
    if label == 2:
        return [said.replace(".", "-")]
    if label == 3:
        return [".".join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    return [said.lstrip("+"), digits[2:], f"({digits[2:5]}) {digits[5:8]}-{digits[8:]}"]


#: Twins that a whole copy of a base span of each label is to its broken form.
WHOLE_COPY = {1: ("name",), 2: ("ip",), 3: ("same", "tail"), 4: ("same", "tail")}


def examples(text: str) -> Iterator[tuple[int, tuple[str, ...], tuple[tuple[str, int], ...], int, int]]:
    """(label, features, twins (kind, label), label before, label after) of a text's base spans in broken forms, and of mentions and names that have no twin among them."""
    nodes = mentions(text)
    known = {k for m in nodes if m.base for k in _keys(text[m.start : m.end])}
    starts = [m.start for m in nodes]
    near = lambda k: tuple(nodes[j].label if 0 <= j < len(nodes) else 0 for j in k)
    for k, m in enumerate(nodes):
        if m.base:
            for seen in _broken(text[m.start : m.end], m.label):
                yield m.label, _features(text, m.start, m.end, seen), tuple((kind, m.label) for kind in WHOLE_COPY[m.label]), *near((k - 1, k + 1))
        elif not known & set(m.keys):
            yield 0, m.features, (), *near((k - 1, k + 1))
            if m.keys[-1].startswith("tail"):
                yield 0, m.features, (("tail", 3 + m.start % 2),), *near((k - 1, k + 1))
    for t in NAME.finditer(text):
        said = t[0].rstrip(".")
        if len(said) < HANDLE or said.isalpha() or not any(c.isalpha() for c in said) or f"name {said.lower()}" in known:
            continue
        k = bisect_left(starts, t.end())
        # what overlaps a mention is part of it
        if k == 0 or nodes[k - 1].end <= t.start():
            yield 0, _features(text, t.start(), t.start() + len(said), said), (("name", 1),), *near((k - 1, k))


def fit(rows: list[tuple[int, tuple[str, ...], tuple[tuple[str, int], ...], int, int, int]]) -> Weights:
    """Weights that maximise the likelihood of the examples' labels (each with its number at the end), with a Gaussian prior. Wrong twins weigh WRONG of all twins."""
    out, n_labels = Weights(), len(LABELS)
    if not any(r[0] for r in rows):
        return out
    names = sorted({f for r in rows for f in r[1]})
    place = {f: k for k, f in enumerate(names)}
    x = np.array([[place[f] for f in r[1]] for r in rows])
    label, before, after, n = (np.array([r[k] for r in rows]) for k in (0, 3, 4, 5))
    twins = np.zeros((len(rows), len(TWINS), n_labels))
    for k, r in enumerate(rows):
        for kind, of in r[2]:
            twins[k, TWINS.index(kind), of] = 1
    weight = n.astype(np.float64)
    for kind in ("tail", "name"):
        has = twins[:, TWINS.index(kind)].any(axis=1)
        right, wrong = weight[has & (label > 0)].sum(), weight[has & (label == 0)].sum()
        if right and wrong:
            weight[has & (label == 0)] *= WRONG / (1 - WRONG) * right / wrong
    eye = np.eye(n_labels)
    prev, next_ = eye[before] * (before > 0)[:, None], eye[after] * (after > 0)[:, None]
    start = np.array([0.0 if kind == "tail" else DEFAULT_SKIP for kind in TWINS])
    now = [np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels)), start.copy()]
    mean, square = [np.zeros_like(p) for p in now], [np.zeros_like(p) for p in now]
    flat = x.ravel()
    for step in range(1, STEPS + 1):
        score = now[0][x].sum(axis=1) + prev @ now[1] + next_ @ now[1].T + np.einsum("k,rkl->rl", now[2], twins)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        gap = weight[:, None] * (eye[label] - p / p.sum(axis=1, keepdims=True))
        of_features = np.stack([np.bincount(flat, np.repeat(g, x.shape[1]), len(names)) for g in gap.T], axis=1)
        slope = [of_features - PRIOR * now[0], prev.T @ gap + gap.T @ next_ - PRIOR * now[1], np.einsum("rl,rkl->k", gap, twins) - PRIOR * (now[2] - start)]
        for k, g in enumerate(slope):  # Adam
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
            now[k] = now[k] + RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    # a label's potential is what it has over O
    theta = now[0] - now[0][:, :1]
    out.node, out.chain, out.skips = dict(zip(names, theta, strict=True)), now[1], {k: max(0.0, float(v)) for k, v in zip(TWINS, now[2], strict=True)}
    return out


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, most: int = EXAMPLES) -> Weights:
    """Weights from about `sample` rows of docs with text, chosen by a hash of the text; repeated texts are chosen together. Of their kinds of examples the `most` frequent count."""
    rows = docs.select(F.col(f"`{text}`").alias("text")).filter("text is not null")
    share = min(1.0, sample / max(docs.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n.update(json.dumps(e) for e in examples(x))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["what", "n"])

    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    kinds = chosen.filter(F.col("text").rlike("[0-9@]")).mapInArrow(count, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    found = kinds.orderBy(F.desc("n"), "what").limit(most).collect()
    return fit([(e[0], tuple(e[1]), tuple((k, x) for k, x in e[2]), e[3], e[4], n) for e, n in ((json.loads(w), n) for w, n in found)])


def edges(nodes: list[Mention]) -> list[tuple[int, int, str]]:
    """Chain edges between neighbours, of kind ""; skip edges of a kind of twins from each mention to the last one and the first one of its key: as many as mentions, not pairs."""
    out = [(k - 1, k, "") for k in range(1, len(nodes))]
    seen: dict[str, tuple[int, int]] = {}
    skips: dict[tuple[int, int, str], None] = {}
    for k, m in enumerate(nodes):
        for key in m.keys:
            first, last = seen.get(key, (k, k))
            skips |= {(x, k, key.partition(" ")[0]): None for x in (first, last) if x != k}
            seen[key] = (first, k)
    return out + list(skips)


def beliefs(nodes: list[Mention], w: Weights) -> np.ndarray:
    """For each node, the log-beliefs of its labels after loopy sum-product message passing; base labels are observed. Exact where the graph has no loop."""
    n, none = len(LABELS), np.zeros(len(LABELS))
    own = np.array([np.clip(sum((w.node.get(f, none) for f in m.features), none), -NODE_CLIP, NODE_CLIP) for m in nodes])
    for k, m in enumerate(nodes):
        if m.base:
            own[k] = -50.0
            own[k, m.label] = 0.0
    links = edges(nodes)
    if not links:
        return own
    a, b = (np.array([x[k] for x in links]) for k in (0, 1))
    kinds = sorted({kind for *_, kind in links})
    pairs = np.stack([np.eye(n) * w.twin(kind) if kind else w.chain for kind in kinds])
    forward = pairs[[kinds.index(kind) for *_, kind in links]]
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.concatenate([forward, forward.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), n))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + pair
        top = out.max(axis=1, keepdims=True)
        new = top[:, 0] + np.log(np.exp(out - top).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - message).max() < 1e-4:
            break
        message = DAMPING * message + (1 - DAMPING) * new
    belief = own.copy()
    np.add.at(belief, target, message)
    return belief


def message_passing(nodes: list[Mention], w: Weights) -> np.ndarray:
    """The label of each node: a free one's best if it beats O by LEAST_ODDS, else O."""
    belief = beliefs(nodes, w)
    best = belief.argmax(axis=1)
    sure = belief[np.arange(len(nodes)), best] - belief[:, 0] >= LEAST_ODDS
    return np.where([m.base for m in nodes], [m.label for m in nodes], np.where(sure, best, 0))


def label(text: str, w: Weights) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all spans of a text, by kind and start."""
    nodes = mentions(text)
    free = any(not m.base for m in nodes)
    labels = message_passing(nodes, w) if free else [m.label for m in nodes]
    out = [(int(k), m.start, m.end, m.base) for k, m in zip(labels, nodes, strict=True) if k]
    return [(LABELS[k], s, e, b) for k, s, e, b in sorted(out)]


def find_personal_data(docs: DataFrame, weights: Weights, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep of every row of docs, and spans: array of (kind, start, end, base), by kind and start.

    start and end (exclusive) are code points of the text; base: found by a pattern, all of which stay.
    Added spans overlap no base span. If keep has a column spans, the new one gets underscores before its name. Null or empty text has no spans; repeated rows are handled each;
    an empty table gives no rows. Very long texts are one field of their mentions, linear in their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(texts: pa.Array) -> list[pa.Array]:
        raw, at = buffers(texts)
        hits = np.concatenate([[0], np.cumsum(HINTS[raw], dtype=np.int64)])[at]
        n, flat = np.zeros(len(texts) + 1, dtype=np.int64), []
        for r in np.flatnonzero(np.diff(hits)).tolist():
            found = label(texts[r].as_py(), shared.value)
            flat += found
            n[r + 1] = len(found)
        columns = list(zip(*flat, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        spans = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "start", "end", "base"])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), spans)]

    name = free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "spans")
    return appended(docs, keep, text, f"{name} array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", compute)
