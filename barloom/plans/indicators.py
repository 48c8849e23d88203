"""Indicator queries over hourly bars of the events, with their SQL.

Values are rounded to six digits after a shift by a thousandth of the last one, so that means of prices with two digits
don't stand on the edge between two roundings; the shift also makes a negative zero positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import recursive, ta
from barloom.sources.bars import HOUR, bars_sql, event_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(c: Column) -> Column:
    """Six digits, as double arithmetic: Spark's own round goes through decimals, row by row."""
    return F.rint((c + 1e-9) * 1e6) / 1e6


def tidy(b: DataFrame, *names: str) -> DataFrame:
    kinds = dict(b.dtypes)
    return b.select("sym", "bar_index", *[rounded(F.col(n)).alias(n) if kinds[n] == "double" else F.col(n) for n in names])


def tidy_sql(names: list[str], source: str = "v") -> str:
    return f"SELECT sym, bar_index, {', '.join(f'round({n} + 1e-9, 6) AS {n}' for n in names)} FROM {source}"


def _window(n: int, lag: int = 0) -> str:
    return f"(PARTITION BY sym ORDER BY bar_index ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"


SO_FAR = "(PARTITION BY sym ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORDER = "(PARTITION BY sym ORDER BY bar_index)"


def ready(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_window(n)} = {n} THEN {value} END"


def add(name: str, build: Callable[[DataFrame], DataFrame], expressions: dict[str, str] | None = None, steps: str = "", raw: bool = False, source: str = "bars") -> None:
    """A query that adds columns to the bars; ``expressions`` is their SQL over ``source``, ``steps`` further tables before."""
    columns = list(expressions or {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = build(event_bars(spark, sf_dir, HOUR))
        return b.select("sym", "bar_index", *columns) if raw else tidy(b, *columns)

    QUERIES[name] = run
    body = ", ".join(f"{e} AS {n}" for n, e in expressions.items())
    last = f"SELECT sym, bar_index, {body} FROM {source}"
    SQL[name] = f"WITH RECURSIVE {bars_sql()} {steps}, v AS ({last}) " + (f"SELECT sym, bar_index, {', '.join(columns)} FROM v" if raw else tidy_sql(columns))


def listed(x: str, n: int) -> str:
    return f"list({x}) OVER {_window(n)}"


def _weighted(x: str, weights: list[float]) -> str:
    return ready(x, len(weights), f"list_sum(list_transform(list_zip({listed(x, len(weights))}, {weights}), lambda p: p[1] * p[2]))")


def _wma_weights(n: int) -> list[float]:
    return [2 * (i + 1) / (n * (n + 1)) for i in range(n)]


def windows() -> None:
    n = 14
    w = _window(n)
    add("ta_sma", lambda b: ta.sma(b, "close", n, "value"), {"value": ready("close", n, f"avg(close) OVER {w}")})
    add("ta_wma", lambda b: ta.wma(b, "close", n, "value"), {"value": _weighted("close", _wma_weights(n))})
    hma = f", h AS (SELECT *, 2 * {_weighted('close', _wma_weights(8))} - {_weighted('close', _wma_weights(16))} AS d FROM bars)"
    add("ta_hma", lambda b: ta.hma(b, "close", 16, "value"), {"value": _weighted("d", _wma_weights(4))}, hma, source="h")
    add("ta_swma", lambda b: ta.swma(b, "close", "value"), {"value": f"(close + 2 * lag(close) OVER {ORDER} + 2 * lag(close, 2) OVER {ORDER} + lag(close, 3) OVER {ORDER}) / 6"})
    import math

    weights = [math.exp(-((i - 0.85 * 8) ** 2) / (2 * (9 / 6) ** 2)) for i in range(9)]
    add("ta_alma", lambda b: ta.alma(b, "close", 9, 0.85, 6, "value"), {"value": _weighted("close", [x / sum(weights) for x in weights])})
    add("ta_vwma", lambda b: ta.vwma(b, "close", n, "value"), {"value": ready("close", n, f"sum(close * volume) OVER {w} / sum(volume) OVER {w}")})
    add("ta_linreg", lambda b: ta.linreg(b, "close", n, 2, "value"), {"value": ready("close", n, f"regr_intercept(close, bar_index) OVER {w} + regr_slope(close, bar_index) OVER {w} * (bar_index - 2)")})
    sd = f"stddev_pop(close) OVER {w}"
    add("ta_bb", lambda b: ta.bb(b, "close", n, 2.0, "bb"), {"bb_basis": ready("close", n, f"avg(close) OVER {w}"), "bb_upper": ready("close", n, f"avg(close) OVER {w} + 2 * {sd}"), "bb_lower": ready("close", n, f"avg(close) OVER {w} - 2 * {sd}")})
    add("ta_bbw", lambda b: ta.bbw(b, "close", n, 2.0, "value"), {"value": ready("close", n, f"4 * {sd} / nullif(avg(close) OVER {w}, 0)")})
    add("ta_stdev", lambda b: ta.stdev(ta.stdev(b, "close", n, "value"), "close", n, "sample", False), {"value": ready("close", n, sd), "sample": ready("close", n, f"stddev_samp(close) OVER {w}")})
    add("ta_variance", lambda b: ta.variance(ta.variance(b, "close", n, "value"), "close", n, "sample", False), {"value": ready("close", n, f"var_pop(close) OVER {w}"), "sample": ready("close", n, f"var_samp(close) OVER {w}")})
    add("ta_range", lambda b: ta.range_(b, "close", n, "value"), {"value": ready("close", n, f"max(close) OVER {w} - min(close) OVER {w}")})
    steps = f", l AS (SELECT *, {listed('close', n)} AS xs, avg(close) OVER {w} AS m, count(close) OVER {w} AS k FROM bars), d AS (SELECT *, CASE WHEN k = {n} THEN list_avg(list_transform(xs, lambda x: abs(x - m))) END AS dv FROM l)"
    add("ta_dev", lambda b: ta.dev(b, "close", n, "value"), {"value": "dv"}, steps, source="d")
    add("ta_cci", lambda b: ta.cci(b, "close", n, "value"), {"value": "(close - m) / nullif(0.015 * dv, 0)"}, steps, source="d")
    add("ta_cog", lambda b: ta.cog(b, "close", 10, "value"), {"value": "CASE WHEN k = 10 THEN -list_sum(list_transform(xs, lambda x, i: x * (11 - i))) / nullif(list_sum(xs), 0) END"}, f", d AS (SELECT *, {listed('close', 10)} AS xs, count(close) OVER {_window(10)} AS k FROM bars)", source="d")
    dx = f", d AS (SELECT *, close - lag(close) OVER {ORDER} AS dx FROM bars)"
    up, down = f"sum(greatest(dx, 0)) OVER {w}", f"sum(greatest(-dx, 0)) OVER {w}"
    add("ta_cmo", lambda b: ta.cmo(b, "close", n, "value"), {"value": ready("dx", n, f"100 * ({up} - {down}) / nullif({up} + {down}, 0)")}, dx, source="d")
    up, down = f"sum(CASE WHEN dx > 0 THEN close * volume ELSE 0 END) OVER {w}", f"sum(CASE WHEN dx < 0 THEN close * volume ELSE 0 END) OVER {w}"
    add("ta_mfi", lambda b: ta.mfi(b, "close", n, "value"), {"value": ready("dx", n, f"CASE WHEN {up} = 0 AND {down} = 0 THEN NULL WHEN {down} = 0 THEN 100 ELSE 100 - 100 / (1 + {up} / {down}) END")}, dx, source="d")
    hl = ", d AS (SELECT *, (high + low) / 2 AS x FROM bars)"
    add("ta_ao", lambda b: ta.ao(b, "value"), {"value": f"{ready('x', 5, f'avg(x) OVER {_window(5)}')} - {ready('x', 34, f'avg(x) OVER {_window(34)}')}"}, hl, source="d")
    add("ta_bop", lambda b: ta.bop(b, "value"), {"value": "(close - open) / nullif(high - low, 0)"})
    add("ta_highest", lambda b: ta.highest(b, 20, "value"), {"value": f"CASE WHEN bar_index >= 19 THEN max(high) OVER {_window(20)} END"})
    add("ta_lowest", lambda b: ta.lowest(b, 20, "value"), {"value": f"CASE WHEN bar_index >= 19 THEN min(low) OVER {_window(20)} END"})
    add("ta_highestbars", lambda b: ta.highestbars(b, 20, "value"), {"value": f"(max({{'v': high, 'i': bar_index}}) OVER {_window(20)}).i - bar_index"}, raw=True)
    add("ta_lowestbars", lambda b: ta.lowestbars(b, 20, "value"), {"value": f"-((min({{'v': low, 'i': -bar_index}}) OVER {_window(20)}).i) - bar_index"}, raw=True)
    top, bottom = f"max(high) OVER {w}", f"min(low) OVER {w}"
    add("ta_stoch", lambda b: ta.stoch(b, "close", "high", "low", n, "value"), {"value": f"CASE WHEN bar_index >= {n - 1} THEN 100 * (close - {bottom}) / nullif({top} - {bottom}, 0) END"})
    add("ta_wpr", lambda b: ta.wpr(b, n, "value"), {"value": f"CASE WHEN bar_index >= {n - 1} THEN -100 * ({top} - close) / nullif({top} - {bottom}, 0) END"})
    add("ta_correlation", lambda b: ta.correlation(b, "close", "open", n, "value"), {"value": ready("close", n, f"corr(close, open) OVER {w}")})
    add("ta_covariance", lambda b: ta.covariance(b, "close", "open", n, "value"), {"value": ready("close", n, f"covar_pop(close, open) OVER {w}")})
    add("ta_median", lambda b: ta.median(b, "close", n, "value"), {"value": ready("close", n, f"quantile_cont(close, 0.5) OVER {w}")})
    mode = f", d AS (SELECT *, count(close) OVER {w} AS k, {listed('volume', n)} AS xs FROM bars)"
    add("ta_mode", lambda b: ta.mode(b, "volume", n, "value"), {"value": f"CASE WHEN k = {n} THEN list_min(list_filter(xs, lambda x: len(list_filter(xs, lambda y: y = x)) = list_max(list_transform(xs, lambda z: len(list_filter(xs, lambda y: y = z)))))) END"}, mode, source="d")
    add("ta_percentile_nearest_rank", lambda b: ta.percentile_nearest_rank(b, "close", n, 30, "value"), {"value": f"CASE WHEN count(close) OVER {w} = {n} THEN list_sort({listed('close', n)})[{math.ceil(0.3 * n)}] END"})
    add("ta_percentile_linear_interpolation", lambda b: ta.percentile_linear_interpolation(b, "close", n, 30, "value"), {"value": f"CASE WHEN bar_index >= {n - 1} THEN quantile_cont(close, 0.3) OVER {w} END"})
    ranked = f", d AS (SELECT *, {listed('close', n)} AS xs, count(close) OVER {w} AS k FROM bars)"
    add("ta_percentrank", lambda b: ta.percentrank(b, "close", n, "value"), {"value": f"CASE WHEN k = {n} THEN 100.0 * len(list_filter(xs, lambda x: x <= close)) / {n} END"}, ranked, source="d")
    rank = "(len(list_filter(xs, lambda o: o < x)) + (len(list_filter(xs, lambda o: o = x)) + 1) / 2)"
    add("ta_rci", lambda b: ta.rci(b, "close", n, "value"), {"value": f"CASE WHEN k = {n} THEN 100 * (1 - 6 * list_sum(list_transform(xs, lambda x, i: ({rank} - i) * ({rank} - i))) / {n * (n * n - 1)}) END"}, ranked, source="d")
    true_range = f"greatest(high - low, abs(high - lag(close) OVER {ORDER}), abs(low - lag(close) OVER {ORDER}))"
    add("ta_tr", lambda b: ta.tr(ta.tr(b, "value"), "strict", False), {"value": true_range, "strict": f"CASE WHEN bar_index > 0 THEN {true_range} END"})
    add("ta_change", lambda b: ta.change(b, "close", "value", 3), {"value": f"close - lag(close, 3) OVER {ORDER}"})
    add("ta_mom", lambda b: ta.mom(b, "close", "value", 10), {"value": f"close - lag(close, 10) OVER {ORDER}"})
    add("ta_roc", lambda b: ta.roc(b, "close", 5, "value"), {"value": f"100 * (close - lag(close, 5) OVER {ORDER}) / nullif(lag(close, 5) OVER {ORDER}, 0)"})
    for name, op, most in (("rising", ">", "max"), ("falling", "<", "min")):
        add(f"ta_{name}", lambda b, f=getattr(ta, name): f(b, "close", 2, "value"), {"value": f"coalesce(close {op} {most}(close) OVER {_window(2, 1)} AND count(close) OVER {_window(2, 1)} = 2, false)"}, raw=True)
    held = lambda b: b.withColumn("hit", F.col("close") > F.col("open"))
    add("ta_barssince", lambda b: ta.barssince(held(b), "hit", "value").withColumn("value", F.col("value").cast("double")), {"value": f"bar_index - last_value(CASE WHEN close > open THEN bar_index END IGNORE NULLS) OVER {SO_FAR}"})
    add("ta_valuewhen", lambda b: ta.valuewhen(ta.valuewhen(held(b), "hit", "close", 0, "latest"), "hit", "close", 2, "third"), {"latest": f"list(close) FILTER (close > open) OVER {SO_FAR}[-1]", "third": f"list(close) FILTER (close > open) OVER {SO_FAR}[-3]"})
    SQL["ta_valuewhen"] = f"WITH {bars_sql()}, d AS (SELECT *, list(close) FILTER (WHERE close > open) OVER {SO_FAR} AS xs FROM bars) SELECT sym, bar_index, round(xs[-1] + 1e-9, 6) AS latest, round(xs[-3] + 1e-9, 6) AS third FROM d"
    mean = f", d AS (SELECT *, {ready('close', 5, f'avg(close) OVER {_window(5)}')} AS m FROM bars), e AS (SELECT *, lag(close) OVER {ORDER} AS c1, lag(m) OVER {ORDER} AS m1 FROM d)"
    over, under = "coalesce(close > m AND c1 <= m1, false)", "coalesce(close < m AND c1 >= m1, false)"
    crosses = lambda b: ta.cross(ta.crossunder(ta.crossover(ta.sma(b, "close", 5, "m"), "close", "m", "over"), "close", "m", "under"), "close", "m", "either")
    add("ta_cross", crosses, {"over": over, "under": under, "either": f"({over} OR {under})"}, mean, raw=True, source="e")
    gaps = lambda b: b.withColumn("x", F.when(F.col("bar_index") % 7 != 3, F.col("close")))
    holes = f", g AS (SELECT *, CASE WHEN bar_index % 7 <> 3 THEN close END AS x FROM bars), d AS (SELECT *, sum((x IS NULL)::INT) OVER {SO_FAR} AS grp FROM g)"
    add("ta_cum", lambda b: ta.cum(gaps(b), "x", "value"), {"value": "CASE WHEN x IS NOT NULL THEN sum(x) OVER (PARTITION BY sym, grp ORDER BY bar_index ROWS UNBOUNDED PRECEDING) END"}, holes, source="d")
    add("ta_max_min", lambda b: ta.min_(ta.max_(gaps(b), "x", "top"), "x", "bottom"), {"top": f"max(x) OVER {SO_FAR}", "bottom": f"min(x) OVER {SO_FAR}"}, holes, source="d")
    add("fixnan", lambda b: ta.fixnan(gaps(b), "x", "value"), {"value": f"last_value(x IGNORE NULLS) OVER {SO_FAR}"}, holes, source="d")
    add("history", lambda b: ta.history(gaps(b), "x", 2, "value"), {"value": f"lag(x, 2) OVER {ORDER}"}, holes, source="d")
    dense = holes + ", s AS (SELECT sym, bar_index, CASE WHEN count(x) OVER (PARTITION BY sym ORDER BY bar_index ROWS 4 PRECEDING) = 5 THEN sum(x) OVER (PARTITION BY sym ORDER BY bar_index ROWS 4 PRECEDING) END AS t FROM g WHERE x IS NOT NULL), j AS (SELECT g.*, s.t FROM g LEFT JOIN s USING (sym, bar_index))"
    add("math_sum", lambda b: ta.sum_(gaps(b), "x", 5, "value"), {"value": f"last_value(t IGNORE NULLS) OVER {SO_FAR}"}, dense, source="j")
    full = f", d AS (SELECT *, list(high) OVER {_window(8)} AS hs, list(low) OVER {_window(8)} AS ls FROM bars)"
    pivots = {"top": "CASE WHEN len(hs) = 8 AND hs[5] >= list_max(hs[1:4]) AND hs[5] > list_max(hs[6:8]) THEN hs[5] END", "bottom": "CASE WHEN len(ls) = 8 AND ls[5] <= list_min(ls[1:4]) AND ls[5] < list_min(ls[6:8]) THEN ls[5] END"}
    add("ta_pivots", lambda b: ta.pivotlow(ta.pivothigh(b, 4, 3, "top"), 4, 3, "bottom"), pivots, full, source="d")
    day = "(PARTITION BY sym, time // 86400000 ORDER BY bar_index ROWS UNBOUNDED PRECEDING)"
    mean = f"sum(close * volume) OVER {day} / sum(volume) OVER {day}"
    spread = f"sqrt(greatest(sum(close * close * volume) OVER {day} / sum(volume) OVER {day} - ({mean}) * ({mean}), 0))"
    add("ta_vwap", lambda b: ta.vwap(b, "close", "value"), {"value": mean})
    add("ta_vwap_bands", lambda b: ta.vwap(b.withColumn("a", F.col("bar_index") % 24 == 0), "close", "band", "a", 1.5), {"band": "0.0", "band_upper": "0.0", "band_lower": "0.0"})
    anchor = "(PARTITION BY sym, bar_index // 24 ORDER BY bar_index ROWS UNBOUNDED PRECEDING)"
    SQL["ta_vwap_bands"] = f"WITH {bars_sql()}, v AS (SELECT sym, bar_index, sum(close * volume) OVER {anchor} / sum(volume) OVER {anchor} AS m, sum(close * close * volume) OVER {anchor} / sum(volume) OVER {anchor} AS q FROM bars), s AS (SELECT *, CASE WHEN q - m * m > 0 THEN sqrt(q - m * m) ELSE 0 END AS sd FROM v) SELECT sym, bar_index, round(m + 1e-9, 6) AS band, round(m + 1.5 * sd + 1e-9, 6) AS band_upper, round(m - 1.5 * sd + 1e-9, 6) AS band_lower FROM s"
    # where the spread is a rounding error of zero, its root is not comparable: the bands are compared to three digits
    bands = QUERIES["ta_vwap_bands"]
    QUERIES["ta_vwap_bands"] = lambda spark, sf: bands(spark, sf).withColumns({k: F.round(F.col(k) + 1e-5, 3) for k in ("band_upper", "band_lower")})
    SQL["ta_vwap_bands"] = f"SELECT sym, bar_index, band, round(band_upper + 1e-5, 3) AS band_upper, round(band_lower + 1e-5, 3) AS band_lower FROM ({SQL['ta_vwap_bands']})"
    levels = {
        "Traditional": ["(h + l + c) / 3", "2 * p - l", "2 * p - h", "p + (h - l)", "p - (h - l)", "2 * p + h - 2 * l", "2 * p - 2 * h + l", "3 * p + h - 3 * l", "3 * p - 3 * h + l", "4 * p + h - 4 * l", "4 * p - 4 * h + l"],
        "Fibonacci": ["(h + l + c) / 3", "p + 0.382 * (h - l)", "p - 0.382 * (h - l)", "p + 0.618 * (h - l)", "p - 0.618 * (h - l)", "p + (h - l)", "p - (h - l)"],
        "Classic": ["(h + l + c) / 3", "2 * p - l", "2 * p - h", "p + (h - l)", "p - (h - l)", "p + 2 * (h - l)", "p - 2 * (h - l)", "p + 3 * (h - l)", "p - 3 * (h - l)"],
        "DM": [f"(CASE WHEN o = c THEN h + l + 2 * c WHEN c > o THEN 2 * h + l + c ELSE 2 * l + h + c END){t}" for t in (" / 4", " / 2 - l", " / 2 - h")],
        "Camarilla": ["(h + l + c) / 3", "c + 1.1 * (h - l) / 12", "c - 1.1 * (h - l) / 12", "c + 1.1 * (h - l) / 6", "c - 1.1 * (h - l) / 6", "c + 1.1 * (h - l) / 4", "c - 1.1 * (h - l) / 4", "c + 1.1 * (h - l) / 2", "c - 1.1 * (h - l) / 2", "h / l * c", "c - (h / l * c - c)"],
    }
    for kind, exprs in levels.items():
        def points(spark: SparkSession, sf_dir: str, kind: str = kind, k: int = len(exprs)) -> DataFrame:
            b = ta.pivot_point_levels(event_bars(spark, sf_dir, HOUR).withColumn("a", F.col("bar_index") % 24 == 0), kind, "a", "levels")
            return b.select("sym", "bar_index", *[rounded(F.col("levels")[i]).alias(f"level{i}") for i in range(k)])

        QUERIES[f"ta_pivot_points_{kind.lower()}"] = points
        body = ", ".join(f"round({e} + 1e-9, 6) AS level{i}" for i, e in enumerate(exprs))
        SQL[f"ta_pivot_points_{kind.lower()}"] = f"WITH {bars_sql()}, g AS (SELECT sym, bar_index // 24 + 1 AS grp, arg_min(open, bar_index) AS o, max(high) AS h, min(low) AS l, arg_max(close, bar_index) AS c FROM bars GROUP BY sym, bar_index // 24), k AS (SELECT *, (h + l + c) / 3 AS p FROM g) SELECT b.sym, b.bar_index, {body} FROM bars b LEFT JOIN k ON b.sym = k.sym AND b.bar_index // 24 = k.grp"
    add("ta_accdist", lambda b: ta.accdist(b, "value"), {"value": "CASE WHEN x IS NOT NULL THEN sum(x) OVER (PARTITION BY sym, grp ORDER BY bar_index ROWS UNBOUNDED PRECEDING) END"}, f", g AS (SELECT *, (2 * close - low - high) * volume / nullif(high - low, 0) AS x FROM bars), d AS (SELECT *, sum((x IS NULL)::INT) OVER {SO_FAR} AS grp FROM g)", source="d")
    add("ta_obv", lambda b: ta.obv(b, "value"), {"value": f"sum(sign(dx) * volume) OVER {SO_FAR}"}, dx, source="d")
    add("ta_pvt", lambda b: ta.pvt(b, "value"), {"value": f"sum(r) OVER {SO_FAR}"}, f", d AS (SELECT *, (close - lag(close) OVER {ORDER}) / nullif(lag(close) OVER {ORDER}, 0) * volume AS r FROM bars)", source="d")
    add("ta_wad", lambda b: ta.wad(b, "value"), {"value": f"sum(CASE WHEN close > c1 THEN close - least(low, c1) WHEN close < c1 THEN close - greatest(high, c1) WHEN c1 IS NOT NULL THEN 0 END) OVER {SO_FAR}"}, f", d AS (SELECT *, lag(close) OVER {ORDER} AS c1 FROM bars)", source="d")
    add("ta_iii", lambda b: ta.iii(b, "value"), {"value": "(2 * close - high - low) / nullif((high - low) * volume, 0)"})
    add("ta_wvad", lambda b: ta.wvad(b, "value"), {"value": "(close - open) / nullif(high - low, 0) * volume"})


def ema_sql(name: str, source: str, x: str, n: int, alpha: str | None = None, begin: int = 0, first: bool = False) -> str:
    """A table (sym, bar_index, y) of an exponential mean whose first value stands at bar ``begin`` of its input."""
    a = alpha or f"(2.0 / {n + 1})"
    at = begin if first else begin + n - 1
    seed = f"(SELECT sym, avg({x}) AS s FROM {source} WHERE bar_index BETWEEN {begin} AND {at} GROUP BY sym HAVING count({x}) = {at - begin + 1})"
    return f"""{name} AS (SELECT i.sym, i.bar_index, any_value(s.s) * power(1 - {a}, i.bar_index - {at}) + coalesce(sum({a} * power(1 - {a}, i.bar_index - k.bar_index) * k.{x}) FILTER (k.bar_index > {at}), 0) AS y
      FROM {source} i JOIN {seed} s USING (sym) LEFT JOIN {source} k ON k.sym = i.sym AND k.bar_index <= i.bar_index AND k.bar_index > {at} WHERE i.bar_index >= {at} GROUP BY i.sym, i.bar_index)""".replace("FILTER (k.bar_index", "FILTER (WHERE k.bar_index")


def recurrences() -> None:
    def one(name: str, calls: list[tuple], columns: list[str], tables: list[str], final: str) -> None:
        QUERIES[name] = lambda spark, sf_dir: tidy(recursive.recur(event_bars(spark, sf_dir, HOUR), calls), *columns)
        SQL[name] = f"WITH RECURSIVE {bars_sql()}, {', '.join(tables)} SELECT b.sym, b.bar_index, {final} FROM bars b"

    def joined(tables: list[str]) -> str:
        return "".join(f" LEFT JOIN {t} ON {t}.sym = b.sym AND {t}.bar_index = b.bar_index" for t in tables)

    def value(e: str, name: str = "value") -> str:
        return f"round({e} + 1e-9, 6) AS {name}"

    def put(name: str, calls: list[tuple], columns: dict[str, str], tables: list[str], use: list[str]) -> None:
        one(name, calls, list(columns), tables, ", ".join(value(e, k) for k, e in columns.items()))
        SQL[name] += joined(use)

    changes = f"dx AS (SELECT sym, bar_index, close - lag(close) OVER {ORDER} AS d FROM bars)"
    up, down = "up AS (SELECT sym, bar_index, greatest(d, 0) AS x FROM dx)", "dn AS (SELECT sym, bar_index, greatest(-d, 0) AS x FROM dx)"
    tr = f"rng AS (SELECT sym, bar_index, greatest(high - low, abs(high - lag(close) OVER {ORDER}), abs(low - lag(close) OVER {ORDER})) AS x FROM bars)"
    put("ta_ema", [("value", "ema", "close", 14)], {"value": "e.y"}, [ema_sql("e", "bars", "close", 14)], ["e"])
    put("ta_rma", [("value", "rma", "close", 14)], {"value": "e.y"}, [ema_sql("e", "bars", "close", 14, "(1.0 / 14)")], ["e"])
    put("ta_dema", [("value", "dema", "close", 9)], {"value": "2 * e.y - f.y"}, [ema_sql("e", "bars", "close", 9, first=True), ema_sql("f", "e", "y", 9, first=True)], ["e", "f"])
    put("ta_tema", [("value", "tema", "close", 9)], {"value": "3 * e.y - 3 * f.y + g.y"}, [ema_sql("e", "bars", "close", 9, first=True), ema_sql("f", "e", "y", 9, first=True), ema_sql("g", "f", "y", 9, first=True)], ["e", "f", "g"])
    r = "(1.0 / 14)"
    put("ta_rsi", [("value", "rsi", "close", 14)], {"value": "CASE WHEN q.y = 0 THEN 100 WHEN p.y = 0 THEN 0 ELSE 100 - 100 / (1 + p.y / q.y) END"}, [changes, up, down, ema_sql("p", "up", "x", 14, r, 1), ema_sql("q", "dn", "x", 14, r, 1)], ["p", "q"])
    line = "ln AS (SELECT f.sym, f.bar_index, f.y - s.y AS x FROM f JOIN s USING (sym, bar_index))"
    put("ta_macd", [(("macd", "signal", "hist"), "macd", "close", 12, 26, 9)], {"macd": "ln.x", "signal": "m.y", "hist": "ln.x - m.y"}, [ema_sql("f", "bars", "close", 12), ema_sql("s", "bars", "close", 26), line, ema_sql("m", "ln", "x", 9, begin=25)], ["ln", "m"])
    steps = [changes, "ab AS (SELECT sym, bar_index, abs(d) AS x FROM dx)", ema_sql("a1", "dx", "d", 13, begin=1, first=True), ema_sql("a2", "a1", "y", 5, begin=1, first=True), ema_sql("b1", "ab", "x", 13, begin=1, first=True), ema_sql("b2", "b1", "y", 5, begin=1, first=True)]
    put("ta_tsi", [("value", "tsi", "close", 5, 13)], {"value": "a2.y / nullif(b2.y, 0)"}, steps, ["a2", "b2"])
    put("ta_kc", [(("basis", "upper", "lower"), "kc", "close", 20, 1.5)], {"basis": "e.y", "upper": "e.y + 1.5 * s.y", "lower": "e.y - 1.5 * s.y"}, [tr, ema_sql("e", "bars", "close", 20, first=True), ema_sql("s", "rng", "x", 20, first=True)], ["e", "s"])
    put("ta_kcw", [("value", "kcw", "close", 20, 1.5)], {"value": "3 * s.y / nullif(e.y, 0)"}, [tr, ema_sql("e", "bars", "close", 20, first=True), ema_sql("s", "rng", "x", 20, first=True)], ["e", "s"])
    put("ta_atr", [("value", "atr", 14)], {"value": "e.y"}, [tr, ema_sql("e", "rng", "x", 14, r)], ["e"])
    moves = f"mv AS (SELECT sym, bar_index, high - lag(high) OVER {ORDER} AS u, lag(low) OVER {ORDER} - low AS d FROM bars)"
    pm, mm = "pm AS (SELECT sym, bar_index, CASE WHEN u > d AND u > 0 THEN u WHEN u IS NOT NULL THEN 0 END AS x FROM mv)", "mm AS (SELECT sym, bar_index, CASE WHEN d > u AND d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS x FROM mv)"
    di = "di AS (SELECT sym, bar_index, CASE WHEN t.y = 0 THEN 0 ELSE 100 * p.y / t.y END AS p, CASE WHEN t.y = 0 THEN 0 ELSE 100 * m.y / t.y END AS m FROM t JOIN p USING (sym, bar_index) JOIN m USING (sym, bar_index)), dd AS (SELECT *, abs(p - m) / CASE WHEN p + m = 0 THEN 1 ELSE p + m END AS x FROM di)"
    put("ta_dmi", [(("plus", "minus", "adx"), "dmi", 14, 10)], {"plus": "dd.p", "minus": "dd.m", "adx": "100 * ad.y"}, [tr, moves, pm, mm, ema_sql("t", "rng", "x", 14, r, 1), ema_sql("p", "pm", "x", 14, r, 1), ema_sql("m", "mm", "x", 14, r, 1), di, ema_sql("ad", "dd", "x", 10, "(1.0 / 10)", 14)], ["dd", "ad"])
    for name, op in (("nvi", "<"), ("pvi", ">")):
        ratio = f"rt AS (SELECT sym, bar_index, CASE WHEN volume {op} lag(volume) OVER {ORDER} AND lag(close) OVER {ORDER} <> 0 THEN close / lag(close) OVER {ORDER} ELSE 1 END AS x FROM bars), pr AS (SELECT sym, bar_index, product(x) OVER {SO_FAR} AS y FROM rt)"
        put(f"ta_{name}", [("value", name)], {"value": "pr.y"}, [ratio], ["pr"])
        # a running product of returns spans many magnitudes: its logarithm is compared
        QUERIES[f"ta_{name}"] = lambda spark, sf_dir, name=name: recursive.recur(event_bars(spark, sf_dir, HOUR), [("v", name)]).select("sym", "bar_index", rounded(F.log("v")).alias("value"))
        SQL[f"ta_{name}"] = SQL[f"ta_{name}"].replace("round(pr.y + 1e-9, 6)", "round(ln(pr.y) + 1e-9, 6)")
    band = [tr, ema_sql("a", "rng", "x", 10, "(1.0 / 10)")]
    walk = """c0 AS (SELECT b.sym, b.bar_index, b.close, lag(b.close) OVER (PARTITION BY b.sym ORDER BY b.bar_index) AS c1, (b.high + b.low) / 2 + 3 * a.y AS bu, (b.high + b.low) / 2 - 3 * a.y AS bl FROM bars b LEFT JOIN a ON a.sym = b.sym AND a.bar_index = b.bar_index),
    st AS (SELECT sym, bar_index, bu AS up, bl AS dn, CASE WHEN bu IS NULL THEN NULL ELSE bu END AS line, 1 AS way FROM c0 WHERE bar_index = 0
      UNION ALL
      SELECT sym, bar_index, up, dn, CASE WHEN way < 0 THEN dn ELSE up END, way FROM (
        SELECT sym, bar_index, up, dn, CASE WHEN pu IS NULL OR bu IS NULL THEN 1 WHEN pline = pu THEN CASE WHEN close > up THEN -1 ELSE 1 END ELSE CASE WHEN close < dn THEN 1 ELSE -1 END END AS way FROM (
          SELECT c0.sym, c0.bar_index, c0.close, c0.bu, st.up AS pu, st.line AS pline,
            CASE WHEN st.up IS NULL OR c0.bu < st.up OR c0.c1 > st.up THEN c0.bu ELSE st.up END AS up,
            CASE WHEN st.dn IS NULL OR c0.bl > st.dn OR c0.c1 < st.dn THEN c0.bl ELSE st.dn END AS dn
          FROM st JOIN c0 ON c0.sym = st.sym AND c0.bar_index = st.bar_index + 1)))"""
    put("ta_supertrend", [(("line", "way"), "supertrend", 3.0, 10)], {"line": "st.line", "way": "st.way::DOUBLE"}, [*band, walk], ["st"])
    turn = """s0 AS (SELECT sym, bar_index, high, low, close, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(close) OVER w AS c1 FROM bars WINDOW w AS (PARTITION BY sym ORDER BY bar_index)),
    sr AS (SELECT sym, 0::BIGINT AS bar_index, NULL::DOUBLE AS value, NULL::BOOLEAN AS below, NULL::DOUBLE AS ext, NULL::DOUBLE AS af FROM s0 WHERE bar_index = 0
      UNION ALL
      SELECT sym, bar_index, CASE WHEN below THEN least(v, l1, l2) ELSE greatest(v, h1, h2) END, below, ext2, af2 FROM (
        SELECT *, CASE WHEN turned THEN ext WHEN below AND high > ext THEN high WHEN NOT below AND low < ext THEN low ELSE ext END AS ext2,
               CASE WHEN turned THEN af WHEN below AND high > ext OR NOT below AND low < ext THEN least(af + 0.02, 0.2) ELSE af END AS af2 FROM (
          SELECT sym, bar_index, high, low, h1, l1, h2, l2, started OR flip AS turned, CASE WHEN flip THEN NOT below ELSE below END AS below,
                 CASE WHEN NOT flip THEN v WHEN below THEN greatest(high, ext) ELSE least(low, ext) END AS v,
                 CASE WHEN NOT flip THEN ext WHEN below THEN low ELSE high END AS ext, CASE WHEN flip THEN 0.02 ELSE af END AS af FROM (
            SELECT *, (below AND v > low) OR (NOT below AND v < high) AS flip FROM (
              SELECT *, v0 + af * (ext - v0) AS v FROM (
                SELECT s0.*, s0.bar_index = 1 AS started, CASE WHEN s0.bar_index = 1 THEN s0.close > s0.c1 ELSE sr.below END AS below,
                       CASE WHEN s0.bar_index = 1 THEN CASE WHEN s0.close > s0.c1 THEN s0.high ELSE s0.low END ELSE sr.ext END AS ext,
                       CASE WHEN s0.bar_index = 1 THEN CASE WHEN s0.close > s0.c1 THEN s0.l1 ELSE s0.h1 END ELSE sr.value END AS v0,
                       CASE WHEN s0.bar_index = 1 THEN 0.02 ELSE sr.af END AS af
                FROM sr JOIN s0 ON s0.sym = sr.sym AND s0.bar_index = sr.bar_index + 1))))))"""
    put("ta_sar", [("value", "sar", 0.02, 0.02, 0.2)], {"value": "sr.value"}, [turn], ["sr"])


windows()
recurrences()
