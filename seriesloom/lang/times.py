"""Intervals and points in time as requests write them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Seconds per unit; a month has 30 days, a year 365 (fixed values).
UNITS = {
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
    "mon": 2592000, "month": 2592000, "months": 2592000,
    "y": 31536000, "year": 31536000, "years": 31536000,
}
_PART = re.compile(r"(\d+)([a-z]+)")


def interval(text: str, sign: int = 1) -> int:
    """Seconds of '1h', '-1d', '2min30s'; `sign` holds where the text has none."""
    t = text.strip().lower()
    if t[:1] in "+-" and t:
        sign = -1 if t[0] == "-" else 1
        t = t[1:]
    total, at = 0, 0
    for m in _PART.finditer(t):
        if m.start() != at or m.group(2) not in UNITS:
            break
        total += int(m.group(1)) * UNITS[m.group(2)]
        at = m.end()
    if not t or at != len(t):
        raise ValueError(f"no interval: {text!r}")
    if total > 2**31 - 1:
        raise ValueError(f"the interval is too long: {text!r}")
    return sign * total


_CLOCKS = {"midnight": 0, "noon": 12 * 3600, "teatime": 16 * 3600}
_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1}


def _clock(t: str) -> int:
    if t in _CLOCKS:
        return _CLOCKS[t]
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(am|pm)?", t) or re.fullmatch(r"(\d{1,2})()(am|pm)", t)
    if not m:
        raise ValueError(f"no time of day: {t!r}")
    h, mi = int(m.group(1)), int(m.group(2) or 0)
    if m.group(3):
        h = h % 12 + (12 if m.group(3) == "pm" else 0)
    if h > 23 or mi > 59:
        raise ValueError(f"no time of day: {t!r}")
    return h * 3600 + mi * 60


def _date(t: str, today: datetime) -> datetime:
    if t in _DAYS:
        return today + timedelta(days=_DAYS[t])
    for form in ("%m/%d/%y", "%m/%d/%Y", "%Y%m%d", "%Y-%m-%d"):
        try:
            return datetime.strptime(t, form).replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    raise ValueError(f"no date: {t!r}")


def at_time(text: str | int, now: int, default: int | None = None) -> int:
    """Epoch seconds of an at-time in UTC; the default, if there is one, where the text is none."""
    try:
        return _at_time(str(text), now)
    except ValueError:
        if default is None:
            raise
        return default


def _at_time(text: str, now: int) -> int:
    t = text.strip().lower().replace(" ", "")
    if not t:
        raise ValueError("no time")
    if re.fullmatch(r"\d{9,}", t) or (t.isdigit() and len(t) != 8):
        return int(t)
    offset = 0
    m = re.search(r"[-+](?:\d+[a-z]+)+\Z", t)
    if m:
        offset, t = interval(m.group()), t[: m.start()]
    if t in ("", "now"):
        return now + offset
    today = datetime.fromtimestamp(now, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    clock, _, day = t.rpartition("_")
    if clock:
        base = _date(day, today) + timedelta(seconds=_clock(clock))
    elif day in _CLOCKS or ":" in day or re.fullmatch(r"\d{1,2}(am|pm)", day):
        base = today + timedelta(seconds=_clock(day))
    else:
        for word in _CLOCKS:
            if day.startswith(word) and len(day) > len(word):
                base = _date(day[len(word) :], today) + timedelta(seconds=_CLOCKS[word])
                break
        else:
            base = _date(day, today)
    return int(base.timestamp()) + offset


def align_start(ts: int, unit: str) -> int:
    """The start of the unit that holds a time: years, months, weeks<weekday>, days, hours, minutes, seconds (UTC).

    A leading count is ignored; of weeks the digit names the day they begin on, Sunday being 0 or 7.
    """
    m = re.fullmatch(r"\d*([a-z]+)(\d?)", unit.strip().lower())
    if not m:
        raise ValueError(f"no unit of time: {unit!r}")
    word, digit = m.groups()
    dt = datetime.fromtimestamp(ts, timezone.utc)
    day = dt.replace(hour=0, minute=0, second=0, microsecond=0)
    if word in ("w", "week", "weeks"):
        if not digit:
            raise ValueError("weeks need the day they begin on")
        return int((day - timedelta(days=(day.isoweekday() - int(digit)) % 7)).timestamp())
    if digit or word not in UNITS:
        raise ValueError(f"no unit of time: {unit!r}")
    size = UNITS[word]
    if size == UNITS["y"]:
        return int(day.replace(month=1, day=1).timestamp())
    if size == UNITS["mon"]:
        return int(day.replace(day=1).timestamp())
    return ts - ts % size
