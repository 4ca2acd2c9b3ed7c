"""From free text to a query: a frozen record made on the driver, since a query is a scalar."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from ..functions import vocab as V

_I = re.IGNORECASE


def _compiled(*patterns: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p, _I) for p in patterns)


#: Rules of the standard form: a pattern, and the letter that goes before the number of each of its groups.
_MARKS = [(re.compile(pattern, _I), letters) for pattern, letters in V.QUERY_MARKS]
#: One scan finds both kinds of hints that a title doesn't need.
_HINTS = re.compile(rf"(?P<language>{V.FACET_LANGUAGE})|(?P<year>{V.YEAR})", _I)
#: Forms of season and episode numbers; those of the first line with a hit count.
_NUMBERS = (_compiled(V.NUMBER_BOTH), _compiled(V.NUMBER_SEASON, V.NUMBER_EPISODE))
_MOVIE, _FILLER, _NUMBER_WORDS = _compiled(V.MOVIE_WORD, V.QUERY_FILLER, V.NUMBER_WORDS)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def normalize_tokens(text: str) -> str:
    """All marks of seasons and episodes as sNNeNN, sNN or eNN, whatever their spelling."""

    def said(m: re.Match, letters: str) -> str:
        numbers = zip(letters, m.groups(), strict=True)
        return "".join(f"{letter}{int(n):02d}" if n.isdigit() else n for letter, n in numbers if n)

    return reduce(lambda t, rule: rule[0].sub(lambda m: said(m, rule[1]), t), _MARKS, text)


def normalize(text: str) -> str:
    return _squeezed(normalize_tokens(text))


def clean(text: str, stop_phrases: tuple[str, ...] = ()) -> str:
    """Without punctuation and without stop phrases as whole words."""
    text = re.sub(r"[^\w\s]", " ", text or "")
    phrases = "|".join(map(re.escape, sorted(stop_phrases, key=lambda x: (-len(x), x))))
    return _squeezed(re.sub(rf"\b(?:{phrases})\b", "", text, flags=_I) if phrases else text)


def collapse(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def strip_tech(text: str) -> str:
    """The driver's form of functions.text.strip_tech(): both must agree on every text."""
    text = text.lower()
    for pattern in (r"s\d{1,2}e\d{1,3}", r"s\d{1,2}\b", r"\b(19|20)\d{2}\b"):
        text = re.sub(pattern, " ", text)
    text = re.sub(V.TECH_WORDS, " ", text, flags=_I)
    return _squeezed(re.sub("[^a-z0-9 ]", " ", text))


@dataclass(frozen=True)
class Query:
    """What a text asks for; season, episode and year are 0 where it doesn't say."""

    raw: str
    normalized: str
    title: str
    season: int
    episode: int
    year: int
    languages: tuple[str, ...]
    wants_movie: bool

    @property
    def title_words(self) -> list[str]:
        return strip_tech(self.title or self.normalized).split()

    @property
    def is_series(self) -> bool:
        return self.season > 0 or bool(re.search(r"\bs\d{1,2}e\d{1,3}\b", self.normalized, _I))


def _numbers(text: str) -> dict[str, int]:
    for forms in _NUMBERS:
        hits = [m.groupdict() for m in (form.search(text) for form in forms) if m]
        if hits:
            return {"season": 0, "episode": 0} | {name: int(n) for hit in hits for name, n in hit.items()}
    return {"season": 0, "episode": 0}


def parse(text: str) -> Query:
    """What a text asks for. functions.parse.parsed() is the same for columns."""
    hints: dict[str, list[str]] = {"language": [], "year": []}

    def take(m: re.Match) -> str:
        hints[m.lastgroup].append(m[0].lower())
        return " "

    normalized = _squeezed(_FILLER.sub("", normalize_tokens(_HINTS.sub(take, text))))
    return Query(
        raw=text, normalized=normalized, title=_squeezed(_NUMBER_WORDS.sub("", normalized)), **_numbers(normalized),
        year=int(next(iter(hints["year"]), 0)), languages=tuple(hints["language"]), wants_movie=bool(_MOVIE.search(text)),
    )


def prepare(text: str, stop_phrases: tuple[str, ...] = ()) -> Query | None:
    """The query of what a user typed; None if nothing is left of it, which finds no rows."""
    norm = clean(normalize(str(text)), stop_phrases)
    return parse(norm) if norm else None


def title_year_season(text: str) -> tuple[str, str | None, int | None]:
    """(title, year, season) of a manual request: a season only as the last word, then the first year."""
    m = re.fullmatch(V.REQUEST_SEASON, text.strip())
    before, *year_and_rest = re.split(V.REQUEST_YEAR, m["rest"], maxsplit=1)
    title = "".join([before, *year_and_rest[1:]]).strip()
    return title, (year_and_rest or [None])[0], int(m["season"]) if m["season"] else None
