"""Date phrases, named ranges and business days."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date phrases, in order of precedence.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
EXPLICIT = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{1,2})(?:st|nd|rd|th)?\b"
TOMORROW = r"(?i)\btomorrow\b"
WEEKDAY = r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
HOURS = r"(?i)\bin\s+(\d+)\s+(hour|hours|minute|minutes)\b"
DAYS = r"(?i)\bin\s+(\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)\s+(day|days|week|weeks)\b"
VAGUE = r"(?i)\bnext month\b|\bnext week\b|\bsometime\b|\bend of (?:the )?month\b"
PHRASES = [EXPLICIT, TOMORROW, WEEKDAY, HOURS, DAYS, VAGUE]
COUNT_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# Clock times, durations and their defaults.
CLOCK = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
DURATION = r"(?i)\bfor\s+(\d+)\s*(minutes?|mins?|hours?|hrs?)\b"
RECENT_DAYS, DEFAULT_MINUTES = 7, 30

# The named ranges.
KINDS = ["today", "tomorrow", "yesterday", "this_week", "next_week", "last_week", "this_month", "next_month", "between", "before", "after", "upcoming", "overdue", "recent", "latest", "all_time"]


def date_range(kind: str, now: datetime, zone: str = "UTC", start: datetime | None = None, end: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """Half-open bounds of a named range; None is an open side."""
    local = now.astimezone(ZoneInfo(zone))
    midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
    days = {"today": 0, "tomorrow": 1, "yesterday": -1}
    weeks = {"this_week": 0, "next_week": 1, "last_week": -1}
    months = {"this_month": 0, "next_month": 1}
    if kind in days:
        first = midnight + timedelta(days=days[kind])
        return first, first + timedelta(days=1)
    if kind in weeks:
        first = midnight + timedelta(days=7 * weeks[kind] - local.weekday())
        return first, first + timedelta(days=7)
    if kind in months:
        at = lambda k: midnight.replace(year=local.year + (local.month - 1 + k) // 12, month=(local.month - 1 + k) % 12 + 1, day=1)
        return at(months[kind]), at(months[kind] + 1)
    if kind in ("between", "before", "after"):
        if kind != "before" and start is None or kind != "after" and end is None:
            raise ValueError(f"{kind} needs its bounds")
        return (start if kind != "before" else None), (end if kind != "after" else None)
    if kind == "recent":
        return now - timedelta(days=RECENT_DAYS), now
    if kind in ("upcoming", "overdue"):
        return (now, None) if kind == "upcoming" else (None, now)
    if kind in ("latest", "all_time"):
        return None, None
    raise ValueError(f"unknown range {kind}")


def in_range(c: Column, kind: str, bounds: tuple[datetime | None, datetime | None]) -> Column:
    """all_time takes every row, null dates too; any other kind needs a date within [start, end). Bounds are UTC."""
    if kind == "all_time":
        return F.lit(True)
    out = c.isNotNull()
    for bound, less in zip(bounds, (False, True), strict=True):
        if bound is not None:
            at = F.lit(bound.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)).cast("timestamp_ntz")
            out = out & (c < at if less else c >= at)
    return out


def lenient_time(c: Column) -> Column:
    """Text as a timestamp, null where it is none; without an offset it is UTC."""
    return c.try_cast("timestamp")


def date_phrase(c: Column) -> Column:
    """The first date phrase of a text, verbatim, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in PHRASES))


def next_weekday(c: Column, day: Column) -> Column:
    """The same time of day on the next such weekday, a week on if that is today."""
    return c + F.make_dt_interval(F.date_diff(F.call_function("next_day", c.cast("date"), day), c.cast("date")))


def resolved_phrase(phrase: Column, now: Column) -> Column:
    """struct(at, kind): stated, inferred or window; both null without a phrase. now is a timestamp without zone."""
    day = F.regexp_extract(phrase, EXPLICIT, 2)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(phrase, EXPLICIT, 1), 1, 3)))
    on = lambda year: F.format_string("%04d-%02d-%02d", year, month.cast("int"), day.try_cast("int")).try_cast("date")
    this_year, next_year = on(F.year(now)), on(F.year(now) + 1)
    explicit = F.when(this_year.isNotNull() & (this_year < now.cast("date")), next_year).otherwise(this_year)
    count_word = F.lower(F.regexp_extract(phrase, DAYS, 1))
    words = F.create_map(*[F.lit(x) for pair in COUNT_WORDS.items() for x in pair])
    count = F.coalesce(count_word.try_cast("int"), F.try_element_at(words, count_word))
    n_days = F.when(F.lower(F.regexp_extract(phrase, DAYS, 2)).startswith("week"), count * 7).otherwise(count)
    n_hours = F.regexp_extract(phrase, HOURS, 1).try_cast("int")
    is_hour = F.lower(F.regexp_extract(phrase, HOURS, 2)).startswith("hour")
    zero = F.lit(0)
    at = (
        F.when(phrase.rlike(EXPLICIT), explicit.cast("timestamp_ntz"))
        .when(phrase.rlike(TOMORROW), now + F.make_dt_interval(F.lit(1)))
        .when(phrase.rlike(WEEKDAY), next_weekday(now, F.substring(F.regexp_extract(phrase, WEEKDAY, 1), 1, 3)))
        .when(phrase.rlike(HOURS), now + F.make_dt_interval(zero, F.when(is_hour, n_hours).otherwise(0), F.when(is_hour, 0).otherwise(n_hours)))
        .when(phrase.rlike(DAYS), now + F.make_dt_interval(n_days))
    )
    kind = F.when(phrase.isNull() | (phrase == ""), F.lit(None)).when(at.isNull(), "window").when(phrase.rlike(EXPLICIT), "stated").otherwise("inferred")
    return F.struct(at.alias("at"), kind.alias("kind"))


def business_days_after(c: Column, n: int) -> Column:
    """n weekdays later at the same time of day; no holidays."""
    days = F.filter(F.sequence(F.date_add(c.cast("date"), 1), F.date_add(c.cast("date"), 2 * n + 5)), lambda d: F.weekday(d) < 5)
    return c + F.make_dt_interval(F.date_diff(F.get(days, F.lit(n - 1)), c.cast("date")))


def follow_up_timing(kind: Column, date_type: Column, committed: Column, internal: Column) -> Column:
    """struct(audience, earliest, latest) of a commitment owed to me; nulls for others."""
    mine = kind == "owed_to_me"
    fixed = ~internal & committed.isNotNull() & ~date_type.eqNullSafe(F.lit("window"))
    audience = F.when(mine & internal, "internal").when(mine & fixed, "client_fixed_date").when(mine, "client_open_window")
    after = lambda d, b: F.when(mine & internal, committed + F.make_dt_interval(F.lit(d))).when(mine & fixed, business_days_after(committed, b))
    return F.struct(audience.alias("audience"), after(1, 2).alias("earliest"), after(2, 3).alias("latest"))


def clock(c: Column) -> Column:
    """Minutes after midnight of the first clock time in a text; null without one or past 23 h."""
    hour, minute = F.regexp_extract(c, CLOCK, 1).try_cast("int"), F.coalesce(F.regexp_extract(c, CLOCK, 2).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(c, CLOCK, 3))
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def duration(c: Column) -> Column:
    n = F.regexp_extract(c, DURATION, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(c, DURATION, 2))
    return F.coalesce(F.when(unit.startswith("h"), n * 60).otherwise(n), F.lit(DEFAULT_MINUTES))


def escalated(level: Column) -> Column:
    """The next escalation level, at most 4; null out of 1..4."""
    return F.when(level.between(1, 4), F.least(level + 1, F.lit(4)))
