"""str.*; formats of numbers and messages go through an Arrow-batched function, all else stays in the engine."""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

#: Longest text, in code points (a fixed value of the language).
LONGEST = 40_960
_BLANKS = r"[ \t\n\x0B\f\r]"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _capped(c: Column) -> Column:
    return F.when(F.length(c) > LONGEST, F.raise_error(F.lit(f"texts have at most {LONGEST} characters")).cast("string")).otherwise(c)


def length(s) -> Column:
    return F.coalesce(F.length(col(s)), F.lit(0))


def upper(s) -> Column:
    """ASCII only."""
    return F.translate(col(s), _LOWER, _UPPER)


def lower(s) -> Column:
    return F.translate(col(s), _UPPER, _LOWER)


def contains(s, part) -> Column:
    return F.contains(col(s), part if isinstance(part, Column) else F.lit(part))


def startswith(s, part: str) -> Column:
    return col(s).startswith(part)


def endswith(s, part: str) -> Column:
    return col(s).endswith(part)


def pos(s, part: str) -> Column:
    """From 0; na if absent, 0 for an empty part."""
    if not part:
        return F.when(col(s).isNotNull(), F.lit(0))
    return F.nullif(F.locate(part, col(s)), F.lit(0)) - 1


def substring(s, begin: int, end: int | None = None) -> Column:
    """[begin, end) in code points; a begin outside the text or behind the end is an error."""
    c, size = col(s), F.length(col(s))
    stop = size if end is None else F.least(size, F.lit(end))
    bad = (F.lit(begin) < 0) | (F.lit(begin) > size) | (F.lit(begin) > stop)
    return F.when(bad, F.raise_error(F.lit("substring out of range")).cast("string")).otherwise(F.substr(c, F.lit(begin + 1), F.greatest(stop - begin, F.lit(0))))


def trim(s) -> Column:
    return F.regexp_replace(F.coalesce(col(s), F.lit("")), rf"^{_BLANKS}+|{_BLANKS}+$", "")


def repeat(s, n: int, separator: str = "") -> Column:
    if n < 0:
        raise ValueError("a text cannot be repeated less than 0 times")
    return _capped(F.when(col(s).isNotNull(), F.array_join(F.array_repeat(col(s), n), separator)))


def replace(s, target: str, replacement: str, occurrence: int = 0) -> Column:
    """The occurrence-th (from 0) of the places where the target stands; an empty target stands between all characters."""
    if not target:
        at = F.lit(occurrence)
        return F.when(F.length(col(s)) >= at, F.concat(F.substr(col(s), F.lit(1), at), F.lit(replacement), F.substr(col(s), at + 1))).otherwise(col(s))
    parts = F.split(col(s), "\\Q" + target.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    k = occurrence + 1
    joined = lambda a: F.array_join(a, target)
    cut = F.concat(joined(F.slice(parts, 1, k)), F.lit(replacement), joined(F.slice(parts, k + 1, F.greatest(F.size(parts), F.lit(1)))))
    return F.when(F.size(parts) > k, cut).otherwise(col(s))


def replace_all(s, target: str, replacement: str) -> Column:
    if not target:
        spread = F.array_join(F.split(col(s), ""), replacement)
        return F.concat(F.lit(replacement), F.when(F.length(col(s)) > 0, F.concat(spread, F.lit(replacement))).otherwise(F.lit("")))
    return _capped(F.replace(col(s), F.lit(target), F.lit(replacement)))


def tonumber(s) -> Column:
    return F.when(col(s).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), col(s).try_cast("double"))


def match(s, pattern: str) -> Column:
    return F.regexp_extract(col(s), pattern, 0)


def split(s, separator: str) -> Column:
    return F.split(col(s), "\\Q" + separator + "\\E") if separator else F.split(col(s), "")


def number_text(x: float | None, pattern: str = "#.########") -> str:
    """A number by a pattern of 0 (a digit), # (a digit that may lack), a comma (groups of three) and a closing %."""
    if x is None or x != x:
        return "NaN"
    percent = pattern.endswith("%")
    whole, _, fraction = pattern.rstrip("%").partition(".")
    least, most = fraction.count("0"), len(fraction)
    value = Decimal(repr(float(x))) * (100 if percent else 1)
    digits = f"{abs(value).quantize(Decimal(1).scaleb(-most), ROUND_HALF_UP):f}"
    head, _, tail = digits.partition(".")
    tail = tail.rstrip("0").ljust(least, "0") if len(tail.rstrip("0")) < least else tail.rstrip("0")
    need = whole.replace(",", "").count("0")
    head = head.lstrip("0").rjust(need, "0") or ("" if tail and "#" in whole and not need and False else "0")
    if "," in whole:
        head = f"{int(head):,}".rjust(need, "0") if head else head
    sign = "-" if value < 0 and (head.strip("0") or tail.strip("0")) else ""
    return sign + head + ("." + tail if tail else "") + ("%" if percent else "")


def _named(x: float, pattern: str, tick: float) -> str:
    if x is None or x != x:
        return "NaN"
    if pattern == "mintick":
        places = max(0, -Decimal(repr(tick)).as_tuple().exponent)
        return number_text(math.floor(x / tick + 0.5) * tick, "0." + "0" * places)
    if pattern == "percent":
        return number_text(x, "#.##") + "%"
    if pattern == "volume":
        for size, mark in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(x) >= size:
                return number_text(x / size, "#.###") + mark
        return number_text(x, "#.###")
    return number_text(x, pattern)


def tostring(x, pattern: str = "#.########", tick: float = 0.01) -> Column:
    """A pattern, or mintick, percent, volume by name; na is NaN."""

    @F.pandas_udf("string")
    def write(v: pd.Series) -> pd.Series:
        return v.map(lambda n: _named(None if n is None or n != n else n, pattern, tick)).where(lambda s: s.notna(), "NaN")

    return write(col(x).cast("double"))


_MARK = re.compile(r"'([^']*)'|\{(\d+)(?:,(\w+)(?:,([^}]*))?\}|\})|([{}])")


def message_text(template: str, values: tuple) -> str:
    """Placeholders {i}, {i,number,pattern}, {i,date,pattern}; quotes escape and a doubled quote is one; an unknown index stays."""

    def one(m: re.Match) -> str:
        quoted, index, kind, style, stray = m.groups()
        if stray:
            raise ValueError("unmatched brace in a message")
        if index is None:
            return quoted or "'"
        if int(index) >= len(values):
            return m.group(0)
        v = values[int(index)]
        if isinstance(v, bool) or isinstance(v, str):
            return str(v).lower() if isinstance(v, bool) else v
        if kind in ("date", "time"):
            moment = dt.datetime.fromtimestamp(v / 1000, dt.UTC)
            return moment.strftime(_strftime(style or ("yyyy-MM-dd" if kind == "date" else "HH:mm:ss")))
        style = {"integer": "#,###", "percent": "#%", "currency": "$#,##0.00", None: "#,###.###"}.get(style, style)
        return "$" + number_text(v, style[1:]) if style.startswith("$") else number_text(v, style)

    return _MARK.sub(one, template)


def _strftime(pattern: str) -> str:
    for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        pattern = pattern.replace(a, b)
    return pattern


def format_(template: str, *args) -> Column:
    @F.pandas_udf("string")
    def write(*columns: pd.Series) -> pd.Series:
        return pd.Series([message_text(template, row) for row in zip(*columns, strict=True)])

    return write(*[col(a) for a in args])


def format_time(ms, pattern: str = "yyyy-MM-dd'T'HH:mm:ssZ", zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(col(ms)), zone), pattern)
