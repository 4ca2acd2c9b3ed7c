"""Rows with everything that tables may hold, for the tests of corpus operators."""

from __future__ import annotations

import random

ODD_TEXTS = [None, "", " \n\t ", "x", "two words", "\u00a0", "…!?", "a" * 5000, "é ü ß 日本語 текст", "one\n\n\none\r\n", "\x1f\x0b", "1 2 3 4 5 6 7 8 9 0", "<|im_end|> \\ <\\| <"]


def words(r: random.Random, n: int, size: int = 60) -> list[str]:
    return [r.choice("the of and in to a is was le la der die el que".split()) if r.random() < 0.4 else f"w{r.randrange(size)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60, clash: bool = True, odd: bool = True) -> tuple[list[tuple], str]:
    """(rows, schema): near and exact copies, shared passages, repeated rows, nulls everywhere and a very long text."""
    r = random.Random(seed)
    passage = words(r, 40, 500)
    base = [words(r, r.randint(1, 120), 400) for _ in range(n // 3)]
    texts: list[str | None] = []
    for _ in range(n):
        w = list(r.choice(base)) if r.random() < 0.6 else words(r, r.randint(1, 150), 400)
        if r.random() < 0.4:
            w[r.randrange(len(w))] = f"Z{r.randrange(99)}"
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(10) :]
        texts.append(" ".join(x + ("\n" if r.random() < 0.1 else "") for x in w))
    if odd:
        texts += ODD_TEXTS + [" ".join(words(r, 30000, 5000)) + " " + " ".join(passage)]
    rows = [(k, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", None]), len(t or "")) for k, t in enumerate(texts)]
    if odd:
        rows += [rows[3], rows[3], (None, texts[5], "en", "s1", None), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if clash:
        names = ["size", "key", "token", "n_words", "spans", "bad", "host", "lang_pred", "id", "component", "Taken", "found_x", "row", "a.b"]
        rows = [(*x, *["c"] * len(names)) for x in rows]
        schema += "".join(f", `{n}` string" for n in names)
    r.shuffle(rows)
    return rows, schema
