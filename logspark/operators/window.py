"""Time windows: user selectors to a pair of UTC bounds, resolved once on the driver."""

from __future__ import annotations

import re
from datetime import UTC, date as Date, datetime, timedelta, tzinfo
from zoneinfo import ZoneInfo


def zone(tz: str | tzinfo) -> tzinfo:
    return tz if isinstance(tz, tzinfo) else UTC if tz == "UTC" else ZoneInfo(tz)


def utc(moment: datetime, default_tz: str | tzinfo = UTC) -> datetime:
    """The instant in UTC; a time without zone is read in `default_tz`."""
    return (moment if moment.tzinfo else moment.replace(tzinfo=zone(default_tz))).astimezone(UTC)


def parse_iso(text: str) -> datetime:
    return utc(datetime.fromisoformat(text.replace("Z", "+00:00")))


def _numbers(shape: str, text: str, example: str) -> list[int]:
    found = re.fullmatch(shape, text, re.ASCII)
    if found is None:
        raise ValueError(f"cannot read {text!r}, expected something like {example}")
    return [int(n) for n in found.groups()]


def _midnight(day: Date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=UTC)


def _day(text: str):
    start = _midnight(Date.fromisoformat(text))
    return start, start + timedelta(days=1)


def _hour(text: str):
    start = utc(datetime.fromisoformat(text)).replace(minute=0, second=0, microsecond=0)
    return start, start + timedelta(hours=1)


def _week(text: str):
    start = _midnight(Date.fromisocalendar(*_numbers(r"(\d{4})-W(\d{2})", text, "2025-W52"), 1))
    return start, start + timedelta(weeks=1)


def _month(text: str):
    year, month = _numbers(r"(\d{4})-(\d{2})", text, "2025-12")
    return datetime(year, month, 1, tzinfo=UTC), datetime(year + month // 12, month % 12 + 1, 1, tzinfo=UTC)


def _year(text: str):
    (year,) = _numbers(r"(\d{4})", text, "2025")
    return datetime(year, 1, 1, tzinfo=UTC), datetime(year + 1, 1, 1, tzinfo=UTC)


def resolve_window(
    *,
    since: str | None = None,
    until: str | None = None,
    date: str | None = None,
    hour: str | None = None,
    week: str | None = None,
    month: str | None = None,
    year: str | None = None,
    days_lookback: int | None = None,
    hours_lookback: int | None = None,
    as_of: datetime | None = None,
) -> tuple[datetime | None, datetime | None]:
    """Half-open UTC window; date beats hour, week, month, year, lookback and since/until in that order."""
    for reader, text in ((_day, date), (_hour, hour), (_week, week), (_month, month), (_year, year)):
        if text:
            return reader(text)
    if days_lookback is not None and hours_lookback is not None:
        raise ValueError("give days_lookback or hours_lookback, not both")
    for name, amount in (("days", days_lookback), ("hours", hours_lookback)):
        if amount is not None:
            if amount < 0:
                raise ValueError(f"{name}_lookback must not be negative")
            end = utc(as_of) if as_of else datetime.now(UTC)
            return end - timedelta(**{name: amount}), end
    return (parse_iso(since) if since else None), (parse_iso(until) if until else None)


def checked(
    since: datetime | None, until: datetime | None, default_tz: str | tzinfo = UTC
) -> tuple[datetime | None, datetime | None]:
    """Both bounds in UTC; an empty or inverted window is an error."""
    since = utc(since, default_tz) if since else None
    until = utc(until, default_tz) if until else None
    if since and until and since >= until:
        raise ValueError("since must be before until")
    return since, until
