"""Operator 2: what the field learns, with wrong twins among the right ones."""

from __future__ import annotations

import random

from marquee.llm import pii


def said(r: random.Random) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """A text with base spans, broken forms of them, mentions that only resemble them, and some that resemble nothing: (text, right twins, wrong twins)."""
    d = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: f"{r.choice(['ann', 'lee', 'kim', 'zoe'])}.{r.choice(['ray', 'fox', 'oak'])}{d(2)}"
    filler = lambda: " ".join(r.choices(["river", "stone", "lamp", "green", "walk", "quiet"], k=r.randint(2, 6)))
    out, right, wrong = "", [], []

    def say(before: str, x: str, after: str, to: list | None = None) -> None:
        nonlocal out
        out += f"{filler()}. {before} "
        if to is not None:
            to.append((len(out), len(out) + len(x)))
        out += f"{x} {after} "

    n, phone, digits = name(), r.choice("123456789") + d(11), d(15)
    card = digits + next(c for c in "0123456789" if pii.luhn(digits + c))
    if r.random() < 0.6:
        say(r.choice(["mail", "write"]), f"{n}@mail.example.org", "please")
        say(r.choice(["mail", "write"]), n, "please", right) if r.random() < 0.6 else say(r.choice(["file", "folder"]), n, "opened", wrong)
    if r.random() < 0.6:
        say("call", f"+{phone[:2]} {phone[2:5]} {phone[5:]}", "today")
        say("call", f"({phone[2:5]}) {phone[5:8]}-{phone[8:]}", "today", right) if r.random() < 0.6 else say(r.choice(["order", "parcel"]), f"88{d(2)}{phone[1:]}", "shipped", wrong)
    if r.random() < 0.4:
        say("card", " ".join(card[k : k + 4] for k in range(0, 16, 4)), "charged")
        say("card", ".".join(card[k : k + 4] for k in range(0, 16, 4)), "charged", right) if r.random() < 0.6 else say("parcel", f"{d(3)}{card[-9:]}", "shipped", wrong)
    # what resembles no base span: the contexts of wrong twins are learned here
    say(r.choice(["file", "folder"]), f"{r.choice(['draft', 'notes', 'plan'])}.v{d(2)}", "opened")
    say(r.choice(["order", "parcel"]), d(r.choice([10, 12, 14])), "shipped")
    return out, right, wrong


def learned(spark):
    r = random.Random(23)
    made = [said(r) for _ in range(600)]
    frame = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(made)], "doc_id int, text string")
    return made, frame, pii.learn(frame.filter("doc_id < 300"))


def test_wrong_twins_are_outvoted(spark):
    made, frame, weights = learned(spark)
    # what is learned moves away from its priors: numbers that share their last digits only are worth less than equal ones
    assert weights.skips["same"] - pii.DEFAULT_SKIP > 0.5 and weights.skips["tail"] < weights.skips["same"] - 2
    got = {row.doc_id: {(s.start, s.end) for s in row.spans if not s.base} for row in pii.find_personal_data(frame.filter("doc_id >= 300"), weights).collect()}
    meets = lambda a, spans: any(a[0] < e and s < a[1] for s, e in spans)
    right = [meets(x, got[k]) for k in got for x in made[k][1]]
    wrong = [meets(x, got[k]) for k in got for x in made[k][2]]
    added = [meets(x, made[k][1]) for k in got for x in got[k]]
    print("recall", sum(right) / len(right), "wrong twins taken", sum(wrong), "of", len(wrong), "precision", sum(added) / len(added), weights.skips)
    assert len(right) > 150 and len(wrong) > 100
    assert sum(right) >= 0.9 * len(right) and sum(wrong) <= 0.1 * len(wrong) and sum(added) >= 0.9 * len(added)


def test_context_decides_between_equal_twins(spark):
    """The same two names, once where addresses stand and once where files do; a number with a phone's last digits is none."""
    weights = learned(spark)[2]
    of = lambda t: [(k, t[s:e]) for k, s, e, base in pii.label(t, weights) if not base]
    assert of("write ann.ray7@mail.example.org please, or write ann.ray7 please") == [("email", "ann.ray7")]
    assert of("mail ann.ray7@mail.example.org or see file ann.ray7 in folder") == []
    assert of("call +44 20 7946 0958 now. order no 88442079460958 shipped") == []
    assert of("call +44 20 7946 0958 now, or 020 7946 0958") == [("phone", "020 7946 0958")]


def test_wrong_twin_between_right_ones(spark):
    """Numbers that merely share digits don't stand between a phone and its other forms."""
    text = "call 0088442079460958 x call +44 20 7946 0958 x call 77442079460958 x call 020 7946 0958"
    found = [text[s:e] for _, s, e, base in pii.label(text, pii.Weights()) if not base]
    assert found == ["020 7946 0958"]


def test_kept_column_of_the_same_name(spark):
    rows = spark.createDataFrame([(1, "mail a1@b.org", "x"), (2, None, None)], "doc_id int, text string, spans string")
    got = pii.find_personal_data(rows, pii.Weights(), ("doc_id", "spans", "text"))
    assert got.columns == ["doc_id", "spans", "text", "_spans"]
    assert [(r.doc_id, r.spans, len(r["_spans"])) for r in got.orderBy("doc_id").collect()] == [(1, "x", 1), (2, None, 0)]
