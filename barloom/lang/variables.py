"""Variables that the language gives: of the timeframe, the symbol, the session, the chart and the strategy."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from barloom.functions.times import in_seconds, parse_session, parse_timeframe

#: What a symbol is taken for if its metadata does not say.
SYMBOL = {
    "prefix": "", "description": "", "sector": None, "industry": None, "country": None, "type": "stock", "currency": "USD", "basecurrency": None, "session": "24x7", "timezone": "UTC", "root": None, "volumetype": "base",
    "mintick": 0.01, "mincontract": 1.0, "pointvalue": 1.0, "minmove": 1, "pricescale": 100,
}
_CHARTS = ("is_heikinashi", "is_kagi", "is_linebreak", "is_pnf", "is_range", "is_renko")


def timeframe(name: str, tf: str):
    n, unit = parse_timeframe(tf)
    known = {
        "period": tf, "main_period": tf, "multiplier": n, "isticks": False, "isseconds": unit == "S", "isminutes": unit == "", "isintraday": unit in ("", "S"), "isdaily": unit == "D", "isweekly": unit == "W", "ismonthly": unit == "M", "isdwm": unit in ("D", "W", "M"),
    }
    return known[name]


def symbol(name: str, ticker: str, about: dict):
    known = SYMBOL | about
    prefix, _, own = ticker.rpartition(":")
    if name in ("tickerid", "main_tickerid"):
        return ticker
    if name == "ticker":
        return own
    if name == "prefix":
        return prefix or known["prefix"]
    if name == "root":
        return known["root"] or own
    return known[name]


def inside(millis: int, session: str, zone: str) -> int | None:
    """The day (as a number) of the session's span that holds the time, else none; 24x7 is one span a day."""
    spans, days = parse_session(session)
    t = dt.datetime.fromtimestamp(millis / 1000, ZoneInfo(zone))
    minute, day = t.hour * 60 + t.minute, t.isoweekday() % 7 + 1
    for a, b in spans:
        if (a <= minute < b if a < b else minute >= a) and day in days:
            return t.toordinal()
        if a >= b and minute < b and (day + 5) % 7 + 1 in days:
            return t.toordinal() - 1
    return None


def session(name: str, bar: dict, before: dict | None, after: int | None, about: dict):
    """Regular hours are the symbol's session; what the metadata calls premarket and postmarket are sessions too."""
    known = SYMBOL | about
    zone = known["timezone"]
    at = lambda t, s: None if t is None or not s else inside(t, s, zone)
    now = at(bar["time"], known["session"])
    if name == "ismarket":
        return now is not None
    if name in ("ispremarket", "ispostmarket"):
        return at(bar["time"], about.get(name[2:])) is not None
    was, will = at(before and before["time"], known["session"]), at(after, known["session"])
    if name in ("isfirstbar", "isfirstbar_regular"):
        return now is not None and now != was
    return now is not None and now != will if after is not None else False


def chart(name: str, first: int, last: int, about: dict):
    kind = about.get("chart", "standard")
    if name in _CHARTS:
        return name == f"is_{kind}"
    known = {"left_visible_bar_time": first, "right_visible_bar_time": last, "is_standard": kind == "standard", "bg_color": 0x0F0F0F, "fg_color": 0xDBDBDB}
    return known[name]


def millis_of(tf: str) -> int:
    return in_seconds(tf) * 1000
