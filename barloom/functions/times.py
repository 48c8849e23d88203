"""Calendar fields, timestamps, timeframes and sessions. Times are milliseconds since 1970, UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import ordered

from .values import col

DAY = 86_400
#: Nominal seconds of a month (a fixed value of the language).
MONTH = 2_628_003


def local(ms, zone: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(col(ms)), zone)


def year(ms, zone: str = "UTC") -> Column:
    return F.year(local(ms, zone))


def month(ms, zone: str = "UTC") -> Column:
    return F.month(local(ms, zone))


def dayofmonth(ms, zone: str = "UTC") -> Column:
    return F.dayofmonth(local(ms, zone))


def dayofweek(ms, zone: str = "UTC") -> Column:
    """1 is Sunday."""
    return F.dayofweek(local(ms, zone))


def weekofyear(ms, zone: str = "UTC") -> Column:
    return F.weekofyear(local(ms, zone))


def hour(ms, zone: str = "UTC") -> Column:
    return F.hour(local(ms, zone))


def minute(ms, zone: str = "UTC") -> Column:
    return F.minute(local(ms, zone))


def second(ms, zone: str = "UTC") -> Column:
    return F.second(local(ms, zone))


def timestamp(year, month, day, hour=0, minute=0, second=0, zone: str = "UTC") -> Column:
    """Parts outside their range carry over: month 13 is next January."""
    y, mo, d, h, mi, s = (col(x).cast("int") for x in (year, month, day, hour, minute, second))
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    at = F.unix_seconds(F.date_add(first, d - 1).cast("timestamp")) + h.cast("long") * 3600 + mi.cast("long") * 60 + s
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_seconds(at), zone))


def parse_timeframe(tf: str) -> tuple[int, str]:
    """(count, unit): S seconds, "" minutes, D, W, M."""
    m = re.fullmatch(r"(\d*)([SDWM]?)", tf)
    if not m or not tf:
        raise ValueError(f"not a timeframe: {tf!r}")
    return int(m[1] or 1), m[2]


def in_seconds(tf: str) -> int:
    n, unit = parse_timeframe(tf)
    return n * {"S": 1, "": 60, "D": DAY, "W": 7 * DAY, "M": MONTH}[unit]


#: The timeframes of seconds that there are.
SECOND_STEPS = (1, 5, 10, 15, 30, 45)


def from_seconds(seconds: int) -> str:
    """A supported timeframe: a step of seconds, whole months or weeks, else days or minutes rounded up; a year at most."""
    if seconds <= SECOND_STEPS[-1]:
        return f"{next(s for s in SECOND_STEPS if seconds <= s)}S"
    if seconds >= 365 * DAY:
        return "12M"
    for size, unit in ((MONTH, "M"), (7 * DAY, "W")):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{-(-seconds // DAY)}D" if seconds >= DAY else str(-(-seconds // 60))


def bucket(ms, tf: str, zone: str = "UTC") -> Column:
    """Opening of the timeframe's bucket that holds the time; weeks begin on Monday."""
    n, unit = parse_timeframe(tf)
    at = local(ms, zone)
    if unit in ("S", ""):
        size = n * (1000 if unit == "S" else 60_000)
        return (F.floor(col(ms) / size) * size).cast("long")
    if unit == "M":
        months = F.year(at) * 12 + F.month(at) - 1
        start = F.add_months(F.make_date(F.lit(1970), F.lit(1), F.lit(1)), (F.floor((months - 1970 * 12) / n) * n).cast("int"))
    else:
        days = F.unix_date(at.cast("date"))
        size, first = (n, 0) if unit == "D" else (7 * n, 4)  # weeks count from Monday, 1970-01-05
        start = F.date_from_unix_date((F.floor((days - first) / size) * size + first).cast("int"))
    return F.unix_millis(F.to_utc_timestamp(start.cast("timestamp"), zone))


def bucket_close(ms, tf: str, zone: str = "UTC") -> Column:
    """End of the bucket that holds the time."""
    n, unit = parse_timeframe(tf)
    if unit in ("S", ""):
        return bucket(ms, tf) + n * (1000 if unit == "S" else 60_000)
    start = local(bucket(ms, tf, zone), zone).cast("date")
    after = F.add_months(start, n) if unit == "M" else F.date_add(start, n * (7 if unit == "W" else 1))
    return F.unix_millis(F.to_utc_timestamp(after.cast("timestamp"), zone))


def parse_session(session: str) -> tuple[list[tuple[int, int]], set[int]]:
    """(ranges of minutes of the day, days with 1 for Sunday)."""
    if session == "24x7":
        return [(0, 1440)], set(range(1, 8))
    spans, _, days = session.partition(":")
    out = []
    for span in spans.split(","):
        m = re.fullmatch(r"(\d\d)(\d\d)-(\d\d)(\d\d)", span)
        if not m:
            raise ValueError(f"not a session: {session!r}")
        a, b, c, d = map(int, m.groups())
        out.append((a * 60 + b, c * 60 + d))
    return out, {int(c) for c in days} if days else set(range(1, 8))


def in_session(ms, session: str, zone: str = "UTC") -> Column:
    """A span whose end isn't after its begin runs on into the next day, which belongs to the day that it began on."""
    spans, days = parse_session(session)
    at = local(ms, zone)
    now, day = F.hour(at) * 60 + F.minute(at), F.dayofweek(at)
    before = F.when(day == 1, 7).otherwise(day - 1)
    test = F.lit(False)
    for a, b in spans:
        if a < b:
            test = test | ((now >= a) & (now < b) & day.isin(*days))
        else:
            test = test | ((now >= a) & day.isin(*days)) | ((now < b) & before.isin(*days))
    return test


def time(ms, tf: str, session: str | None = None, zone: str = "UTC") -> Column:
    opened = bucket(ms, tf, zone)
    return opened if session is None else F.when(in_session(ms, session, zone), opened)


def time_close(ms, tf: str, session: str | None = None, zone: str = "UTC") -> Column:
    closed = bucket_close(ms, tf, zone)
    return closed if session is None else F.when(in_session(ms, session, zone), closed)


def change(b: DataFrame, tf: str, out: str, zone: str = "UTC") -> DataFrame:
    """True on the first bar of a new bucket, not on the first bar of all."""
    here = bucket("time", tf, zone)
    b = b.withColumn("__bucket", here)
    return b.withColumn(out, F.coalesce(F.col("__bucket") != F.lag("__bucket").over(ordered()), F.lit(False))).drop("__bucket")
