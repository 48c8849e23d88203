"""Indicators over trailing frames, as window expressions.

Every function takes a table of bars, the names of its inputs and of its result, and returns the table with that column.
A frame of length n is ready when it holds n bars and, where not said otherwise, no null among the input. All frames of a
script share one partitioning and order, so Spark sorts once for all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.bars import ordered

_TMP = "__t"


def w(n: int, lag: int = 0):
    """The last n bars, ending ``lag`` bars ago."""
    return ordered().rowsBetween(-(n - 1) - lag, -lag)


def all_so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prev(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(ordered())


def full(x: str, n: int) -> Column:
    return F.count(x).over(w(n)) == n


def bars_seen(n: int) -> Column:
    return F.col("bar_index") >= n - 1


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def listed(x: str, n: int) -> Column:
    return F.collect_list(x).over(w(n))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _weighted(x: str, n: int, weights: list[float]) -> Column:
    given = F.array(*[F.lit(float(v)) for v in weights])
    return F.when(full(x, n), _sum(F.zip_with(listed(x, n), given, lambda v, k: v * k)))


def sma(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, F.when(full(x, n), F.avg(x).over(w(n))) if n > 0 else F.lit(None).cast("double"))


def wma(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, _weighted(x, n, [2 * (i + 1) / (n * (n + 1)) for i in range(n)]))


def hma(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    half, root = max(1, n // 2), math.floor(math.sqrt(n) + 0.5)
    b = wma(wma(b, x, half, _TMP + "1"), x, n, _TMP + "2")
    b = b.withColumn(_TMP, 2 * F.col(_TMP + "1") - F.col(_TMP + "2"))
    return wma(b, _TMP, root, out).drop(_TMP, _TMP + "1", _TMP + "2")


def swma(b: DataFrame, x: str, out: str) -> DataFrame:
    return b.withColumn(out, (F.col(x) + 2 * prev(x) + 2 * prev(x, 2) + prev(x, 3)) / 6)


def alma(b: DataFrame, x: str, n: int, offset: float, sigma: float, out: str, floor: bool = False) -> DataFrame:
    centre = offset * (n - 1)
    centre, s = math.floor(centre) if floor else centre, n / sigma
    weights = [math.exp(-((i - centre) ** 2) / (2 * s * s)) for i in range(n)]
    return b.withColumn(out, _weighted(x, n, [v / sum(weights) for v in weights]))


def vwma(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    b = b.withColumn(_TMP, F.col(x) * F.col("volume"))
    return b.withColumn(out, F.when(full(_TMP, n), ratio(F.sum(_TMP).over(w(n)), F.sum("volume").over(w(n))))).drop(_TMP)


def linreg(b: DataFrame, x: str, n: int, offset: int, out: str) -> DataFrame:
    """Least squares over places 0..n-1, at n - 1 - offset."""
    mid = (n - 1) / 2
    spread = n * (n * n - 1) / 12
    slope = _sum(F.transform(listed(x, n), lambda v, i: v * (i - mid))) / spread if n > 1 else F.lit(0.0)
    return b.withColumn(out, F.when(full(x, n), F.avg(x).over(w(n)) + slope * (n - 1 - offset - mid)))


def variance(b: DataFrame, x: str, n: int, out: str, biased: bool = True) -> DataFrame:
    if not biased and n < 2:
        return b.withColumn(out, F.lit(None).cast("double"))
    return b.withColumn(out, F.when(full(x, n), (F.var_pop if biased else F.var_samp)(x).over(w(n))))


def stdev(b: DataFrame, x: str, n: int, out: str, biased: bool = True) -> DataFrame:
    return variance(b, x, n, out, biased).withColumn(out, F.sqrt(out))


def bb(b: DataFrame, x: str, n: int, mult: float, out: str) -> DataFrame:
    """``out``_basis, ``out``_upper and ``out``_lower."""
    b = stdev(sma(b, x, n, f"{out}_basis"), x, n, _TMP)
    return b.withColumns({f"{out}_upper": F.col(f"{out}_basis") + mult * F.col(_TMP), f"{out}_lower": F.col(f"{out}_basis") - mult * F.col(_TMP)}).drop(_TMP)


def bbw(b: DataFrame, x: str, n: int, mult: float, out: str) -> DataFrame:
    b = stdev(sma(b, x, n, _TMP + "1"), x, n, _TMP + "2")
    return b.withColumn(out, ratio(2 * mult * F.col(_TMP + "2"), F.col(_TMP + "1"))).drop(_TMP + "1", _TMP + "2")


def range_(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, F.when(full(x, n), F.max(x).over(w(n)) - F.min(x).over(w(n))))


def dev(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Mean absolute deviation from the frame's mean."""
    b = b.withColumns({_TMP + "1": listed(x, n), _TMP + "2": F.avg(x).over(w(n)), _TMP + "3": full(x, n)})
    distance = _sum(F.transform(_TMP + "1", lambda v: F.abs(v - F.col(_TMP + "2")))) / n
    return b.withColumn(out, F.when(F.col(_TMP + "3"), distance)).drop(_TMP + "1", _TMP + "2", _TMP + "3")


def cci(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    b = dev(sma(b, x, n, _TMP + "4"), x, n, _TMP + "5")
    return b.withColumn(out, ratio(F.col(x) - F.col(_TMP + "4"), 0.015 * F.col(_TMP + "5"))).drop(_TMP + "4", _TMP + "5")


def cog(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    weighted = _sum(F.transform(listed(x, n), lambda v, i: v * (n - i)))
    return b.withColumn(out, F.when(full(x, n), ratio(-weighted, F.sum(x).over(w(n)))))


def cmo(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    b = b.withColumn(_TMP, F.col(x) - prev(x))
    b = b.withColumns({_TMP + "u": F.when(F.col(_TMP).isNotNull(), F.greatest(_TMP, F.lit(0.0))), _TMP + "d": F.when(F.col(_TMP).isNotNull(), F.greatest(-F.col(_TMP), F.lit(0.0)))})
    up, down = F.sum(_TMP + "u").over(w(n)), F.sum(_TMP + "d").over(w(n))
    return b.withColumn(out, F.when(full(_TMP, n), ratio(100 * (up - down), up + down))).drop(_TMP, _TMP + "u", _TMP + "d")


def mfi(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    b = b.withColumn(_TMP, F.col(x) - prev(x))
    flow = F.col(x) * F.col("volume")
    b = b.withColumns({_TMP + "u": F.when(F.col(_TMP) > 0, flow).when(F.col(_TMP).isNotNull(), 0.0), _TMP + "d": F.when(F.col(_TMP) < 0, flow).when(F.col(_TMP).isNotNull(), 0.0)})
    up, down = F.sum(_TMP + "u").over(w(n)), F.sum(_TMP + "d").over(w(n))
    value = F.when((up == 0) & (down == 0), None).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(down != 0, down)))
    return b.withColumn(out, F.when(full(_TMP, n), value)).drop(_TMP, _TMP + "u", _TMP + "d")


def ao(b: DataFrame, out: str) -> DataFrame:
    b = b.withColumn(_TMP, (F.col("high") + F.col("low")) / 2)
    b = sma(sma(b, _TMP, 5, _TMP + "1"), _TMP, 34, _TMP + "2")
    return b.withColumn(out, F.col(_TMP + "1") - F.col(_TMP + "2")).drop(_TMP, _TMP + "1", _TMP + "2")


def bop(b: DataFrame, out: str) -> DataFrame:
    return b.withColumn(out, ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low")))


def highest(b: DataFrame, n: int, out: str, x: str = "high") -> DataFrame:
    """Nulls are passed over; the frame must hold n bars."""
    return b.withColumn(out, F.when(bars_seen(n), F.max(x).over(w(n))))


def lowest(b: DataFrame, n: int, out: str, x: str = "low") -> DataFrame:
    return b.withColumn(out, F.when(bars_seen(n), F.min(x).over(w(n))))


def highestbars(b: DataFrame, n: int, out: str, x: str = "high") -> DataFrame:
    """Minus the distance to the highest value of the bars there are; of equal ones the latest."""
    at = F.max(F.when(F.col(x).isNotNull(), F.struct(x, "bar_index"))).over(w(n))
    return b.withColumn(out, F.when(F.col(x).isNotNull(), at["bar_index"] - F.col("bar_index")))


def lowestbars(b: DataFrame, n: int, out: str, x: str = "low") -> DataFrame:
    at = F.min(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("v"), (-F.col("bar_index")).alias("i")))).over(w(n))
    return b.withColumn(out, F.when(F.col(x).isNotNull(), -at["i"] - F.col("bar_index")))


def stoch(b: DataFrame, x: str, high: str, low: str, n: int, out: str) -> DataFrame:
    top, bottom = F.max(high).over(w(n)), F.min(low).over(w(n))
    return b.withColumn(out, F.when(bars_seen(n), ratio(100 * (F.col(x) - bottom), top - bottom)))


def wpr(b: DataFrame, n: int, out: str) -> DataFrame:
    top, bottom = F.max("high").over(w(n)), F.min("low").over(w(n))
    return b.withColumn(out, F.when(bars_seen(n), ratio(-100 * (top - F.col("close")), top - bottom)))


def _paired(x: str, y: str, n: int) -> Column:
    return F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w(n)) == n


def covariance(b: DataFrame, x: str, y: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, F.when(_paired(x, y, n), F.covar_pop(x, y).over(w(n))))


def correlation(b: DataFrame, x: str, y: str, n: int, out: str) -> DataFrame:
    flat = (F.max(x).over(w(n)) == F.min(x).over(w(n))) | (F.max(y).over(w(n)) == F.min(y).over(w(n)))
    return b.withColumn(out, F.when(_paired(x, y, n) & ~flat, F.corr(x, y).over(w(n))))


def median(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, F.when(full(x, n), F.percentile(x, F.lit(0.5)).over(w(n))))


def mode(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the smallest."""
    b = b.withColumns({_TMP: F.sort_array(listed(x, n)), _TMP + "f": full(x, n)})
    # runs of equal neighbours: (longest first, then the smaller value) as a struct that max() orders
    step = F.aggregate(
        _TMP,
        F.struct(F.lit(0).alias("best"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("run"), F.lit(None).cast("double").alias("last")),
        lambda s, v: F.transform(F.array(F.when(s["last"] == v, s["run"] + 1).otherwise(1)), lambda r: F.struct(F.greatest(s["best"], r).alias("best"), F.when(r > s["best"], v).otherwise(s["value"]).alias("value"), r.alias("run"), v.alias("last")))[0],
        lambda s: s["value"],
    )
    return b.withColumn(out, F.when(F.col(_TMP + "f"), step)).drop(_TMP, _TMP + "f")


def percentile_nearest_rank(b: DataFrame, x: str, n: int, p: float, out: str) -> DataFrame:
    place = max(1, math.ceil(p / 100 * n))
    value = F.when(full(x, n), F.element_at(F.sort_array(listed(x, n)), place)) if 0 <= p <= 100 else F.lit(None).cast("double")
    return b.withColumn(out, value)


def percentile_linear_interpolation(b: DataFrame, x: str, n: int, p: float, out: str) -> DataFrame:
    """Over n bars; nulls among them are passed over."""
    value = F.when(bars_seen(n), F.percentile(x, F.lit(p / 100)).over(w(n))) if 0 <= p <= 100 else F.lit(None).cast("double")
    return b.withColumn(out, value)


def percentrank(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    b = b.withColumns({_TMP: listed(x, n), _TMP + "f": full(x, n)})
    return b.withColumn(out, F.when(F.col(_TMP + "f"), 100.0 * F.size(F.filter(_TMP, lambda v: v <= F.col(x))) / n)).drop(_TMP, _TMP + "f")


def rci(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Spearman's rank correlation with time, in hundredths; ties share the mean of their ranks."""
    if n < 2:
        return b.withColumn(out, F.lit(None).cast("double"))
    b = b.withColumns({_TMP: listed(x, n), _TMP + "f": full(x, n)})
    rank = lambda v: F.size(F.filter(_TMP, lambda o: o < v)) + (F.size(F.filter(_TMP, lambda o: o == v)) + 1) / 2
    squares = _sum(F.transform(_TMP, lambda v, i: (rank(v) - (i + 1)) * (rank(v) - (i + 1))))
    return b.withColumn(out, F.when(F.col(_TMP + "f"), 100 * (1 - 6 * squares / (n * (n * n - 1))))).drop(_TMP, _TMP + "f")


def tr(b: DataFrame, out: str, handle_na: bool = True) -> DataFrame:
    before = prev("close")
    whole = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return b.withColumn(out, whole if handle_na else F.when(before.isNotNull(), whole))


def change(b: DataFrame, x: str, out: str, n: int = 1) -> DataFrame:
    if dict(b.dtypes)[x] == "boolean":
        return b.withColumn(out, F.col(x) != prev(x, n))
    return b.withColumn(out, F.col(x) - prev(x, n))


mom = change


def roc(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, ratio(100 * (F.col(x) - prev(x, n)), prev(x, n)))


def rising(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Above each of the n values before."""
    return b.withColumn(out, F.coalesce((F.col(x) > F.max(x).over(w(n, 1))) & (F.count(x).over(w(n, 1)) == n), F.lit(False)))


def falling(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return b.withColumn(out, F.coalesce((F.col(x) < F.min(x).over(w(n, 1))) & (F.count(x).over(w(n, 1)) == n), F.lit(False)))


def barssince(b: DataFrame, condition: str, out: str) -> DataFrame:
    return b.withColumn(out, F.col("bar_index") - F.last(F.when(F.col(condition), F.col("bar_index")), ignorenulls=True).over(all_so_far()))


def valuewhen(b: DataFrame, condition: str, x: str, occurrence: int, out: str) -> DataFrame:
    """The value on the occurrence-th last bar (0: the last) where the condition held."""
    held = F.when(F.col(condition), F.struct(F.col(x).alias("v")))
    if occurrence == 0:
        return b.withColumn(out, F.last(held, ignorenulls=True).over(all_so_far())["v"])
    # number the bars that hold, and carry the value of the bar so many before within these
    b = b.withColumn(_TMP, F.count(F.when(F.col(condition), 1)).over(all_so_far()))
    at = Window.partitionBy("sym", F.coalesce(F.col(condition), F.lit(False))).orderBy("bar_index")
    b = b.withColumn(_TMP + "v", F.when(F.col(condition), F.struct(F.lag(x, occurrence).over(at).alias("v"))))
    return b.withColumn(out, F.last(_TMP + "v", ignorenulls=True).over(all_so_far())["v"]).drop(_TMP, _TMP + "v")


def _crossed(x: str, y: str, over: bool) -> Column:
    now = F.col(x) > F.col(y) if over else F.col(x) < F.col(y)
    then = prev(x) <= prev(y) if over else prev(x) >= prev(y)
    return F.coalesce(now & then, F.lit(False))


def crossover(b: DataFrame, x: str, y: str, out: str) -> DataFrame:
    return b.withColumn(out, _crossed(x, y, True))


def crossunder(b: DataFrame, x: str, y: str, out: str) -> DataFrame:
    return b.withColumn(out, _crossed(x, y, False))


def cross(b: DataFrame, x: str, y: str, out: str) -> DataFrame:
    return b.withColumn(out, _crossed(x, y, True) | _crossed(x, y, False))


def cum(b: DataFrame, x: str, out: str) -> DataFrame:
    """A running sum that a null ends and the next value begins anew."""
    b = b.withColumn(_TMP, F.count(F.when(F.col(x).isNull(), 1)).over(all_so_far()))
    inside = Window.partitionBy("sym", _TMP).orderBy("bar_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumn(out, F.when(F.col(x).isNotNull(), F.sum(x).over(inside))).drop(_TMP)


def max_(b: DataFrame, x: str, out: str) -> DataFrame:
    return b.withColumn(out, F.max(x).over(all_so_far()))


def min_(b: DataFrame, x: str, out: str) -> DataFrame:
    return b.withColumn(out, F.min(x).over(all_so_far()))


def _pivot(b: DataFrame, x: str, left: int, right: int, out: str, high: bool) -> DataFrame:
    """The value ``right`` bars ago if it isn't beaten on its left, nor reached on its right; each side is looked at up to
    its nearest null."""
    b = b.withColumn(_TMP, F.collect_list(F.struct(F.col(x).alias("v"))).over(w(left + right + 1)))
    candidate = F.element_at(_TMP, left + 1)["v"]
    loses_left = (lambda v: v > candidate) if high else (lambda v: v < candidate)
    loses_right = (lambda v: v >= candidate) if high else (lambda v: v <= candidate)

    def beaten(side: Column, loses) -> Column:
        # nearest first; a null stops the scan
        return F.aggregate(side, F.struct(F.lit(False).alias("hit"), F.lit(False).alias("end")), lambda s, e: F.struct((s["hit"] | (~s["end"] & F.coalesce(loses(e["v"]), F.lit(False)))).alias("hit"), (s["end"] | e["v"].isNull()).alias("end")), lambda s: s["hit"])

    before = F.reverse(F.slice(_TMP, 1, left)) if left else None
    after = F.slice(_TMP, left + 2, right) if right else None
    ok = candidate.isNotNull()
    if before is not None:
        ok = ok & ~beaten(before, loses_left)
    if after is not None:
        ok = ok & ~beaten(after, loses_right)
    return b.withColumn(out, F.when(F.size(_TMP) == left + right + 1, F.when(ok, candidate))).drop(_TMP)


def pivothigh(b: DataFrame, left: int, right: int, out: str, x: str = "high") -> DataFrame:
    return _pivot(b, x, left, right, out, True)


def pivotlow(b: DataFrame, left: int, right: int, out: str, x: str = "low") -> DataFrame:
    return _pivot(b, x, left, right, out, False)


def vwap(b: DataFrame, x: str, out: str, anchor: str | None = None, mult: float | None = None) -> DataFrame:
    """Volume-weighted mean since the anchor (a boolean column; by default the UTC day); with ``mult`` also ``out``_upper and _lower."""
    day = F.floor(F.col("time") / 86_400_000) if anchor is None else F.count(F.when(F.col(anchor), 1)).over(all_so_far())
    b = b.withColumn(_TMP, day)
    since = Window.partitionBy("sym", _TMP).orderBy("bar_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.sum("volume").over(since)
    b = b.withColumn(out, ratio(F.sum(F.col(x) * F.col("volume")).over(since), q))
    if mult is not None:
        spread = F.sqrt(F.greatest(ratio(F.sum(F.col(x) * F.col(x) * F.col("volume")).over(since), q) - F.col(out) * F.col(out), F.lit(0.0)))
        b = b.withColumns({f"{out}_upper": F.col(out) + mult * spread, f"{out}_lower": F.col(out) - mult * spread})
    return b.drop(_TMP)


def pivot_point_levels(b: DataFrame, kind: str, anchor: str, out: str) -> DataFrame:
    """Eleven levels (P, R1, S1, ..., R5, S5) from the period before the last anchor."""
    b = b.withColumn(_TMP, F.count(F.when(F.col(anchor), 1)).over(all_so_far()))
    period = b.where(F.col(_TMP) > 0).groupBy(F.col("sym").alias("_sym"), F.col(_TMP).alias("_p")).agg(F.min_by("open", "bar_index").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_index").alias("c"))
    o, h, l, c = (F.col(k) for k in "ohlc")  # noqa: E741
    r = h - l
    none = F.lit(None).cast("double")
    if kind in ("Traditional", "Classic"):
        p = (h + l + c) / 3
        levels = [p, 2 * p - l, 2 * p - h, p + r, p - r]
        levels += [2 * p + h - 2 * l, 2 * p - (2 * h - l), 3 * p + h - 3 * l, 3 * p - (3 * h - l), 4 * p + h - 4 * l, 4 * p - (4 * h - l)] if kind == "Traditional" else [p + 2 * r, p - 2 * r, p + 3 * r, p - 3 * r, none, none]
    elif kind == "Fibonacci":
        p = (h + l + c) / 3
        levels = [p, p + 0.382 * r, p - 0.382 * r, p + 0.618 * r, p - 0.618 * r, p + r, p - r] + [none] * 4
    elif kind == "Camarilla":
        p = (h + l + c) / 3
        levels = [p] + [x for k in (12, 6, 4, 2) for x in (c + 1.1 * r / k, c - 1.1 * r / k)]
        r5 = ratio(h, l) * c
        levels += [r5, c - (r5 - c)]
    elif kind == "DM":
        x = F.when(o == c, h + l + 2 * c).when(c > o, 2 * h + l + c).otherwise(2 * l + h + c)
        levels = [x / 4, x / 2 - l, x / 2 - h] + [none] * 8
    else:
        raise ValueError(f"no such kind of levels: {kind}")
    period = period.select("_sym", (F.col("_p") + 1).alias("_p"), F.array(*levels).alias(out))
    return b.join(period, (F.col("sym") == F.col("_sym")) & (F.col(_TMP) == F.col("_p")), "left").drop("_sym", "_p", _TMP)


def accdist(b: DataFrame, out: str) -> DataFrame:
    b = b.withColumn(_TMP + "x", ratio((2 * F.col("close") - F.col("low") - F.col("high")) * F.col("volume"), F.col("high") - F.col("low")))
    return cum(b, _TMP + "x", out).drop(_TMP + "x")


def obv(b: DataFrame, out: str) -> DataFrame:
    b = b.withColumn(_TMP, F.signum(F.col("close") - prev("close")) * F.col("volume"))
    return b.withColumn(out, F.sum(_TMP).over(all_so_far())).drop(_TMP)


def pvt(b: DataFrame, out: str) -> DataFrame:
    b = b.withColumn(_TMP, ratio(F.col("close") - prev("close"), prev("close")) * F.col("volume"))
    return b.withColumn(out, F.sum(_TMP).over(all_so_far())).drop(_TMP)


def wad(b: DataFrame, out: str) -> DataFrame:
    c, before = F.col("close"), prev("close")
    b = b.withColumn(_TMP, F.when(c > before, c - F.least("low", before)).when(c < before, c - F.greatest("high", before)).when(before.isNotNull(), 0.0))
    return b.withColumn(out, F.sum(_TMP).over(all_so_far())).drop(_TMP)


def iii(b: DataFrame, out: str) -> DataFrame:
    return b.withColumn(out, ratio(2 * F.col("close") - F.col("high") - F.col("low"), (F.col("high") - F.col("low")) * F.col("volume")))


def wvad(b: DataFrame, out: str) -> DataFrame:
    return b.withColumn(out, ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low")) * F.col("volume"))


def fixnan(b: DataFrame, x: str, out: str) -> DataFrame:
    return b.withColumn(out, F.last(x, ignorenulls=True).over(all_so_far()))


def history(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """The value n bars ago; null before the first bar."""
    if n < 0:
        raise ValueError("history reaches back, not ahead")
    return b.withColumn(out, F.col(x) if n == 0 else prev(x, n))


def sum_(b: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Sum of the last n values that aren't null; nulls take no place."""
    at = Window.partitionBy("sym", F.col(x).isNull()).orderBy("bar_index").rowsBetween(-(n - 1), 0)
    b = b.withColumn(_TMP, F.when(F.col(x).isNotNull() & (F.count(x).over(at) == n), F.sum(x).over(at)))
    return b.withColumn(out, F.last(_TMP, ignorenulls=True).over(all_so_far())).drop(_TMP)
