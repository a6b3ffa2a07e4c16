"""Dates as people write them: a small grammar for texts that no fixed format claims.

Parts may stand in any order: names of months and weekdays, days with endings, years of two or four digits, clocks of twelve or
twenty-four hours, zones (which are dropped).  Parts that are missing come from a given date.
"""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])} | {"sept": 9}
WEEKDAYS = {name.lower(): i for i in range(7) for name in (calendar.day_name[i], calendar.day_abbr[i])} | {"tues": 1, "thur": 3, "thurs": 3, "wednes": 2}
#: Words that say nothing, and names of zones.
JOINING, ZONES = {"at", "on", "of", "and", "ad", "t", "st", "nd", "rd", "th"}, {"z", "utc", "gmt"}
_HALF = r"\s*(?P<half>[ap])\.?m\b\.?"
_CLOCK = re.compile(rf"(?<![\d:])(?P<hour>\d{{1,2}}):(?P<minute>\d{{2}})(?::(?P<second>\d{{2}})(?:[.,](?P<part>\d{{1,9}}))?)?(?:{_HALF})?(?![\d:])")
_HOUR = re.compile(rf"(?<![\d:./-])(?P<hour>\d{{1,2}}){_HALF}")
_OFFSET = re.compile(r"\s*(?:\b(?:utc|gmt)\s*)?[+-]\s?\d{1,2}:?\d{2}\s*(?:\([a-z ]+\))?\s*$|\s*\([a-z]{2,5}\)\s*$")
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|\s+|_")


def _clock(found: re.Match) -> tuple[int, int, int, int] | None:
    part = found.groupdict()
    hour, minute, second = (int(part.get(x) or 0) for x in ("hour", "minute", "second"))
    if part.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (part["half"] == "p")
    return (hour, minute, second, int((part.get("part") or "0").ljust(6, "0")[:6])) if hour < 24 and minute < 60 and second < 60 else None


def _full_year(year: int, digits: int, default: datetime) -> int:
    """A year of two digits is the one within 50 years of the default's."""
    if digits > 2:
        return year
    year += default.year // 100 * 100
    return year - 100 if year >= default.year + 50 else year + 100 if year < default.year - 50 else year


def _resolve(numbers: list[tuple[int, int]], month: int | None, month_first: bool) -> tuple | None:
    """(year, digits of the year), month, day out of (value, digits) in the order in which they stand; None for a part that is missing."""
    is_year = [digits > 2 or value > 31 for value, digits in numbers]
    if sum(is_year) > 1 or any(digits > 4 for _, digits in numbers):
        return None
    year = next((n for n, y in zip(numbers, is_year, strict=True) if y), None)
    rest = [n for n, y in zip(numbers, is_year, strict=True) if not y]
    if month is not None:
        if len(numbers) > 2:
            return None
        if year is None and len(rest) == 2:  # the day is next to the month: before it, or after it if the month comes first
            day, year = rest
        else:
            day = rest[0] if rest else None
        return year, month, day[0] if day else None
    if len(numbers) > 3 or len(rest) == 0 and year is None:
        return None
    if year is None and len(rest) == 3:
        *rest, year = rest
    if len(rest) == 1:
        return (year, rest[0][0], None) if year else (None, None, rest[0][0])
    if not rest:
        return year, None, None
    (one, _), (two, _) = rest
    return (year, two, one) if one > 12 else (year, one, two)  # a month first, unless it can't be one


def parse_text(text: str, default: datetime) -> datetime | None:
    """The date and time that a text gives, or None; a zone is dropped, not converted."""
    low = text.lower().strip()
    clock = None
    found = _CLOCK.search(low) or _HOUR.search(low)
    if found:
        clock = _clock(found)
        if clock is None:
            return None
        low = low[: found.start()] + " " + _OFFSET.sub("", low[found.end() :])
    numbers, month, weekday, month_first, known = [], None, None, False, clock is not None
    for token in _TOKEN.findall(low):
        if token.isdecimal():
            if len(token) in (8, 12, 14) and not numbers:  # all in one
                numbers = [(int(token[:4]), 4), (int(token[4:6]), 2), (int(token[6:8]), 2)]
                if len(token) > 8:
                    clock = (int(token[8:10]), int(token[10:12]), int(token[12:] or 0), 0)
            else:
                numbers.append((int(token), len(token)))
        elif token in MONTHS and month is None:
            month, month_first = MONTHS[token], not numbers
        elif token in WEEKDAYS and weekday is None:
            weekday = WEEKDAYS[token]
        elif not (token in JOINING or token in ZONES or token.isspace() or token in ",.;/-'"):
            return None
    known = known or bool(numbers) or month is not None or weekday is not None
    parts = _resolve(numbers, month, month_first) if numbers else (None, month, None)
    if not known or parts is None:
        return None
    year, month, day = parts
    try:
        year = _full_year(*year, default) if year else default.year
        month = month or default.month
        given = day is not None
        day = day if given else min(default.day, calendar.monthrange(year, month)[1])
        out = datetime(year, month, day, *(clock or (0, 0, 0, 0)))
    except (ValueError, calendar.IllegalMonthError):
        return None
    if weekday is not None and not given:
        out += timedelta(days=(weekday - out.weekday()) % 7)
    return out
