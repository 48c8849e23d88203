"""Indicators whose value follows from their own previous one.

All recurrences of a script run in one pass per symbol: the symbol's bars come as Arrow columns in bar order, and every
recurrence adds its columns. A symbol needs its bars whole, so symbols run in parallel and one symbol is one task; other
columns are carried along untouched. Nulls come as NaN inside and go back as nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAN = math.nan
Series = list


class Ema:
    """Exponential mean; seeded by the mean of the first n values, or by the first one."""

    def __init__(self, n: int, first: bool = False):
        self.alpha, self.n, self.first, self.value, self.seed = 2 / (n + 1), n, first, NAN, []

    def __call__(self, x: float) -> float:
        if x != x:
            return NAN
        if self.value == self.value:
            self.value += self.alpha * (x - self.value)
            return self.value
        if self.first:
            self.value = x
            return x
        self.seed.append(x)
        if len(self.seed) == self.n:
            self.value = sum(self.seed) / self.n
        return self.value


class Rma(Ema):
    """Wilder's mean: alpha is 1 / n."""

    def __init__(self, n: int):
        super().__init__(n)
        self.alpha = 1 / n


def run(x: Series, step: Callable[[float], float]) -> Series:
    return [step(v) for v in x]


def ema(c: dict, x: str, n: int) -> list[Series]:
    return [run(c[x], Ema(n))]


def dema(c: dict, x: str, n: int) -> list[Series]:
    e1 = run(c[x], Ema(n, True))
    e2 = run(e1, Ema(n, True))
    return [[2 * a - b for a, b in zip(e1, e2, strict=True)]]


def tema(c: dict, x: str, n: int) -> list[Series]:
    e1 = run(c[x], Ema(n, True))
    e2 = run(e1, Ema(n, True))
    e3 = run(e2, Ema(n, True))
    return [[3 * a - 3 * b + d for a, b, d in zip(e1, e2, e3, strict=True)]]


def rma(c: dict, x: str, n: int) -> list[Series]:
    return [run(c[x], Rma(n))]


def _changes(x: Series) -> Series:
    return [NAN, *(b - a for a, b in zip(x[:-1], x[1:], strict=True))]


def rsi(c: dict, x: str, n: int) -> list[Series]:
    dx = _changes(c[x])
    up = run([max(d, 0.0) if d == d else NAN for d in dx], Rma(n))
    down = run([max(-d, 0.0) if d == d else NAN for d in dx], Rma(n))

    def one(u: float, d: float) -> float:
        if u != u or d != d:
            return NAN
        return 100.0 if d == 0 else 0.0 if u == 0 else 100 - 100 / (1 + u / d)

    return [[one(u, d) for u, d in zip(up, down, strict=True)]]


def macd(c: dict, x: str, fast: int, slow: int, signal: int) -> list[Series]:
    line = [a - b for a, b in zip(run(c[x], Ema(fast)), run(c[x], Ema(slow)), strict=True)]
    mean = run(line, Ema(signal))
    return [line, mean, [a - b for a, b in zip(line, mean, strict=True)]]


def tsi(c: dict, x: str, short: int, long: int) -> list[Series]:
    dx = _changes(c[x])
    top = run(run(dx, Ema(long, True)), Ema(short, True))
    bottom = run(run([abs(d) for d in dx], Ema(long, True)), Ema(short, True))
    return [[a / b if b else NAN for a, b in zip(top, bottom, strict=True)]]


def true_range(c: dict) -> Series:
    h, lo, cl = c["high"], c["low"], c["close"]
    out = [a - b for a, b in zip(h, lo, strict=True)]
    for i in range(1, len(out)):
        if cl[i - 1] == cl[i - 1]:
            out[i] = max(out[i], abs(h[i] - cl[i - 1]), abs(lo[i] - cl[i - 1]))
    return out


def kc(c: dict, x: str, n: int, mult: float, use_range: bool = True) -> list[Series]:
    basis = run(c[x], Ema(n, True))
    span = run(true_range(c) if use_range else [a - b for a, b in zip(c["high"], c["low"], strict=True)], Ema(n, True))
    return [basis, [b + mult * s for b, s in zip(basis, span, strict=True)], [b - mult * s for b, s in zip(basis, span, strict=True)]]


def kcw(c: dict, x: str, n: int, mult: float, use_range: bool = True) -> list[Series]:
    basis, upper, lower = kc(c, x, n, mult, use_range)
    return [[(u - d) / b if b else NAN for b, u, d in zip(basis, upper, lower, strict=True)]]


def atr(c: dict, n: int) -> list[Series]:
    return [run(true_range(c), Rma(n))]


def supertrend(c: dict, factor: float, n: int) -> list[Series]:
    (span,), line, way = atr(c, n), [], []
    upper = lower = last = NAN
    for i, (h, lo, cl, a) in enumerate(zip(c["high"], c["low"], c["close"], span, strict=True)):
        if a != a:
            line.append(NAN)
            way.append(1.0)
            continue
        mid, before = (h + lo) / 2, c["close"][i - 1] if i else NAN
        up, down = mid + factor * a, mid - factor * a
        old_up, old_down = upper, lower
        if old_up == old_up:
            up = up if up < old_up or before > old_up else old_up
            down = down if down > old_down or before < old_down else old_down
        if old_up != old_up:
            d = 1.0
        elif last == old_up:
            d = -1.0 if cl > up else 1.0
        else:
            d = 1.0 if cl < down else -1.0
        upper, lower = up, down
        last = down if d < 0 else up
        line.append(last)
        way.append(d)
    return [line, way]


def dmi(c: dict, n: int, smooth: int) -> list[Series]:
    h, lo = c["high"], c["low"]
    plus, minus = [NAN], [NAN]
    for i in range(1, len(h)):
        up, down = h[i] - h[i - 1], lo[i - 1] - lo[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)
    ranges = true_range(c)
    ranges[:1] = [NAN] * min(1, len(ranges))
    span, up, down = run(ranges, Rma(n)), run(plus[: len(h)], Rma(n)), run(minus[: len(h)], Rma(n))
    pdi = [NAN if s != s else 100 * u / s if s else 0.0 for u, s in zip(up, span, strict=True)]
    mdi = [NAN if s != s else 100 * d / s if s else 0.0 for d, s in zip(down, span, strict=True)]
    dx = [NAN if p != p else abs(p - m) / (p + m if p + m else 1) for p, m in zip(pdi, mdi, strict=True)]
    return [pdi, mdi, [100 * v for v in run(dx, Rma(smooth))]]


def sar(c: dict, start: float, step: float, most: float) -> list[Series]:
    h, lo, cl = c["high"], c["low"], c["close"]
    out, below, extreme, speed, value = [NAN] * min(1, len(h)), False, NAN, start, NAN
    for i in range(1, len(h)):
        turned = False
        if i == 1:
            below = cl[1] > cl[0]
            extreme, value, turned = (h[1], lo[0], True) if below else (lo[1], h[0], True)
            speed = start
        value += speed * (extreme - value)
        if below and value > lo[i]:
            turned, below, value, extreme, speed = True, False, max(h[i], extreme), lo[i], start
        elif not below and value < h[i]:
            turned, below, value, extreme, speed = True, True, min(lo[i], extreme), h[i], start
        if not turned:
            if below and h[i] > extreme:
                extreme, speed = h[i], min(speed + step, most)
            elif not below and lo[i] < extreme:
                extreme, speed = lo[i], min(speed + step, most)
        back = range(i - 1, max(-1, i - 3), -1)
        value = min([value, *(lo[k] for k in back)]) if below else max([value, *(h[k] for k in back)])
        out.append(value)
    return [out]


def volume_index(c: dict, rising: bool) -> list[Series]:
    out, value = [], 1.0
    for i, (cl, v) in enumerate(zip(c["close"], c["volume"], strict=True)):
        if i and (v > c["volume"][i - 1] if rising else v < c["volume"][i - 1]) and c["close"][i - 1]:
            value *= cl / c["close"][i - 1]
        out.append(value)
    return [out]


def random(c: dict, low: float, high: float, seed: int) -> list[Series]:
    """A linear congruential stream (Knuth's MMIX constants) whose start is mixed as splitmix64 does."""
    n = len(c["close"])
    if low >= high:
        return [[NAN] * n]
    mask = (1 << 64) - 1
    s = (seed + 0x9E3779B97F4A7C15) & mask
    s = (s ^ s >> 30) * 0xBF58476D1CE4E5B9 & mask
    s = (s ^ s >> 27) * 0x94D049BB133111EB & mask
    s ^= s >> 31
    out = []
    for _ in range(n):
        s = (s * 6364136223846793005 + 1442695040888963407) & mask
        out.append(low + (s >> 11) / (1 << 53) * (high - low))
    return [out]


KINDS: dict[str, tuple[Callable, int]] = {
    "ema": (ema, 1), "dema": (dema, 1), "tema": (tema, 1), "rma": (rma, 1), "rsi": (rsi, 1), "macd": (macd, 3), "tsi": (tsi, 1), "kc": (kc, 3), "kcw": (kcw, 1),
    "atr": (atr, 1), "supertrend": (supertrend, 2), "dmi": (dmi, 3), "sar": (sar, 1),
    "nvi": (lambda c: volume_index(c, False), 1), "pvi": (lambda c: volume_index(c, True), 1), "random": (random, 1),
}


def recur(b: DataFrame, calls: list[tuple]) -> DataFrame:
    """``b`` with the columns of all ``calls``: (names of the results, kind, arguments...), in one pass per symbol.

    A later call may read an earlier one's result.
    """
    kinds = {f.name: f.dataType for f in b.schema.fields}
    schema = T.StructType([*b.schema.fields, *(T.StructField(n, T.DoubleType()) for names, *_ in calls for n in _names(names))])
    numeric = [k for k, t in kinds.items() if isinstance(t, T.NumericType)]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_index")
        columns = {k: [NAN if v is None else float(v) for v in table.column(k).to_pylist()] for k in numeric}
        for names, kind, *args in calls:
            step, width = KINDS[kind]
            found = step(columns, *args)
            for name, values in zip(_names(names), found[:width], strict=True):
                columns[name] = values
                a = np.array(values, np.float64)
                table = table.append_column(name, pa.array(a, mask=~np.isfinite(a)))
        return table

    return b.groupBy("sym").applyInArrow(one, schema)


def _names(names: str | tuple) -> tuple:
    return (names,) if isinstance(names, str) else tuple(names)
