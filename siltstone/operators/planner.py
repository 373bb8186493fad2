"""Reading a search line: filters for format, folder and time are taken out of it, the rest is searched for.

A word is tried as an operator, as the start of a two-word time, as a time, as a folder (behind a filler word) and as a format,
in this order. Fillers beside what was taken go too, and in lines of four words or more so do the words of mere grammar.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from siltstone.functions import fixed

FILLERS = frozenset(fixed.FILLERS.split())
STOPWORDS = FILLERS | frozenset(fixed.STOPWORDS.split())
MONTH = {w: i + 1 for i, both in enumerate(fixed.MONTHS) for w in both.split()}


@dataclass(frozen=True)
class QueryPlan:
    text: str
    original: str
    extensions: tuple[str, ...] = ()
    folder: str = ""
    after: datetime | None = None
    before: datetime | None = None

    @property
    def has_filters(self) -> bool:
        return bool(self.extensions or self.folder or self.after or self.before)


def _midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def _year(year: int) -> tuple[datetime, datetime]:
    return datetime(year, 1, 1), datetime(year + 1, 1, 1)


def _spans(now: datetime) -> dict[str, tuple[datetime | None, datetime | None]]:
    """Times by their words; None leaves an earlier bound as it was."""
    today = _midnight(now)
    monday, before = today - timedelta(days=today.weekday()), today.replace(day=1) - timedelta(days=1)
    spans = {
        ("settimana scorsa", "last week"): (monday - timedelta(days=7), monday),
        ("questa settimana", "this week"): (monday, None),
        ("mese scorso", "last month"): _month(before.year, before.month),
        ("questo mese", "this month"): _month(now.year, now.month),
        ("anno scorso", "l'anno scorso", "last year"): _year(now.year - 1),
        ("questo anno", "this year"): _year(now.year),
        ("oggi", "today"): (today, None),
        ("ieri", "yesterday"): (today - timedelta(days=1), today),
        ("recente", "recenti", "recent", "recently"): (today - timedelta(days=30), None),
    }
    out = {word: span for words, span in spans.items() for word in words}
    out |= {w: _month(now.year - (m > now.month), m) for w, m in MONTH.items()}
    return out | {str(y): _year(y) for y in range(1990, 2100)}


def words_of(line: str) -> list[str]:
    cut = [w for w in line.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return [w.strip(fixed.EDGE_PUNCTUATION) or w for w in cut]


@dataclass
class _Reading:
    words: list[str]
    taken: list[bool]
    plan: dict = field(default_factory=dict)

    def formats(self, names: str) -> None:
        have = self.plan.setdefault("extensions", [])
        have.extend(x for x in dict.fromkeys(names.split()) if x not in have)


def plan_query(line: str, now: datetime) -> QueryPlan:
    """now: local time; bounds are local times too."""
    words = words_of(line)
    r, spans = _Reading(words, [False] * len(words)), _spans(now)

    def time(i: int, n: int) -> bool:
        span = spans.get(" ".join(words[i : i + n]))
        if span is None or i + n > len(words):
            return False
        r.plan |= {k: t for k, t in zip(("after", "before"), span) if t}
        r.taken[i : i + n] = [True] * n
        return True

    i = 0
    while i < len(words):
        word = words[i]
        key, colon, value = word.partition(":")
        if colon and value and key in fixed.OPERATORS:
            r.formats(value)
            r.taken[i] = True
        elif time(i, 2):
            i += 1
        elif time(i, 1):
            pass
        elif i and words[i - 1] in FILLERS and word in fixed.FOLDERS:
            r.plan["folder"] = fixed.FOLDERS[word]
            r.taken[i - 1] = r.taken[i] = True
        elif word in fixed.FORMATS:
            r.formats(fixed.FORMATS[word])
            r.taken[i] = True
        i += 1

    fillers = [i for i, w in enumerate(words) if w in FILLERS]
    for order in (fillers, fillers[::-1]):  # a run of fillers goes from either end
        for i in order:
            r.taken[i] = r.taken[i] or any(r.taken[j] for j in (i - 1, i + 1) if 0 <= j < len(words))
    if len(words) >= 4:
        for i, w in enumerate(words):
            if w in STOPWORDS and r.taken.count(False) > 1:
                r.taken[i] = True
    rest = " ".join(w for w, t in zip(words, r.taken) if not t)
    plan = {k: tuple(v) if k == "extensions" else v for k, v in r.plan.items()}
    return QueryPlan(rest or line, line, **plan)


def refine(plan: QueryPlan, ask: Callable[[str], dict | None], now: datetime) -> QueryPlan:
    """Filters that a model reads out of a question: ask(question) -> {subject, format, when} or None.

    The answer counts as a whole or not at all: its format and time must be known ones, and its subject made of words that were
    asked, more than one where four or more were. What the plan has already is kept.
    """
    answer = ask(plan.original)
    if not answer:
        return plan
    asked, subject = words_of(plan.text), words_of(answer.get("subject", ""))
    kind, when = answer.get("format", "none"), answer.get("when", "none")
    spans = _spans(now)
    known = (kind == "none" or kind in fixed.FORMATS) and (when == "none" or when in spans)
    if not known or not subject or not set(subject) <= set(asked) or (len(asked) >= 4 and len(subject) == 1):
        return plan
    new: dict = {"text": " ".join(subject)}
    if kind != "none" and not plan.extensions:
        new["extensions"] = tuple(fixed.FORMATS[kind].split())
    if when != "none" and plan.after is None and plan.before is None:
        new["after"], new["before"] = spans[when]
    return replace(plan, **new)
