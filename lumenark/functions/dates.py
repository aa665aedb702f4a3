"""Date phrases of a question as an inclusive range of epoch seconds (UTC).

Rules are tried in order and the first that fires decides; phrases are plain
substrings, so "recently" is "recent". The clock is a parameter."""

from __future__ import annotations

import datetime as dt
import re

Range = tuple[int, int]
_DAY = dt.timedelta(days=1)
_MONTHS = "january february march april may june july august september october november december".split()


def _seconds(day: dt.date, last: bool = False) -> int:
    at = dt.datetime.combine(day, dt.time(23, 59, 59) if last else dt.time(), dt.timezone.utc)
    return int(at.timestamp())


def days(first: dt.date, last: dt.date) -> Range:
    return _seconds(first), _seconds(last, True)


def months(year: int, first: int, last: int) -> Range:
    """From the first day of one month to the last of another of the year."""
    after = dt.date(year + last // 12, last % 12 + 1, 1)
    return days(dt.date(year, first, 1), after - _DAY)


def _month(word: str) -> int | None:
    return next((i for i, m in enumerate(_MONTHS, 1) if word in (m, m[:3])), None)


def parse_range(question: str, now: dt.datetime) -> Range | None:
    q, today = question.lower(), now.astimezone(dt.timezone.utc).date() if now.tzinfo else now.date()
    monday = today - today.weekday() * _DAY
    before = today.replace(day=1) - _DAY
    phrases = (
        (("today", "this morning"), lambda: days(today, today)),
        (("yesterday",), lambda: days(today - _DAY, today - _DAY)),
        (("last week",), lambda: days(monday - 7 * _DAY, monday - _DAY)),
        (("this week",), lambda: days(monday, monday + 6 * _DAY)),
        (("last month",), lambda: months(before.year, before.month, before.month)),
        (("this month",), lambda: months(today.year, today.month, today.month)),
        (("recent",), lambda: days(today - 6 * _DAY, today)),
    )
    for words, span in phrases:
        if any(w in q for w in words):
            return span()
    for m in re.finditer(r"(?=(\d{4}-\d{2}-\d{2}))", q):
        try:
            day = dt.date.fromisoformat(m[1])
        except ValueError:
            continue
        return days(day, day)
    # the first separator that occurs decides, by its first occurrence
    for sep in (" to ", " - ", " through "):
        left, found, right = q.partition(sep)
        if found:
            a, b = left.split()[-1:], right.split()[:1]
            first, last = _month(a[0]) if a else None, _month(b[0]) if b else None
            if first and last:
                return months(today.year, first, last)
            break
    words = q.split()
    for word, following in zip(words, [*words[1:], ""]):
        if month := _month(word):
            year = int(following) if re.fullmatch(r"\d{4}", following) and 1900 <= int(following) <= 2100 else today.year
            return months(year, month, month)
    return None
