"""Alignment of other bars, rates and intervals with the chart's bars, as unions in time order.

A union of both sides, sorted once by (symbol, time), carries the last value forward by a window; there is no range join
that could blow up, and each side is shuffled once. What stands for all symbols, as rates do, is carried inside days, and
from day to day by a table of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nominal_close(requested: DataFrame, millis: int) -> DataFrame:
    """``requested`` with ``close_time``: its nominal end, or the next bar's opening if that is sooner."""
    after = F.lead("time").over(Window.partitionBy("sym").orderBy("time"))
    return requested.withColumn("close_time", F.least(F.col("time") + millis, after))


def asof(chart: DataFrame, other: DataFrame, stamp: Column, at: Column, value: Column, out: str, gaps: bool = False, keys: list[str] | None = None) -> DataFrame:
    """``chart`` with ``out``: the ``value`` of the last row of ``other`` whose ``stamp`` isn't after ``at``.

    With ``gaps`` only on the first chart bar that sees it. Rows match on ``keys`` (by default the symbol).
    """
    keys = ["sym"] if keys is None else keys
    left = chart.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], at.alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast("long").alias("_stamp"), F.lit(None).cast(other.select(value.alias("v")).schema["v"].dataType).alias("_value"))
    right = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], stamp.alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), stamp.alias("_stamp"), value.alias("_value"))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at", "_side")
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_stamp", "_value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = left.unionByName(right).withColumn("_seen", seen)
    rows = both.where("_side = 1")
    found = F.col("_seen._value")
    if gaps:
        # a bar sees what was stamped after the bar before it
        before = F.lag("_at").over(order)
        found = F.when(before.isNull() | (F.col("_seen._stamp") > before), found)
    return rows.select("_row.*", found.alias(out))


def security(chart: DataFrame, requested: DataFrame, value: str, out: str, chart_millis: int, millis: int, lookahead: bool = False, gaps: bool = False) -> DataFrame:
    """A higher timeframe's ``value`` on the chart: of the last bar that had closed by the chart bar's close, or, with
    ``lookahead`` or on equal timeframes, that had opened by its opening."""
    if lookahead or chart_millis == millis:
        return asof(chart, requested, F.col("time"), F.col("time"), F.col(value), out, gaps)
    closed = nominal_close(requested, millis)
    ends = nominal_close(chart, chart_millis)
    stamp = F.coalesce("close_time", F.col("time") + millis)
    return asof(ends.withColumn("_end", F.coalesce("close_time", F.col("time") + chart_millis)), closed, stamp, F.col("_end"), F.col(value), out, gaps).drop("close_time", "_end")


def lower_tf(chart: DataFrame, lower: DataFrame, value: str, out: str) -> DataFrame:
    """``chart`` with the array of ``value`` over the lower bars that open in [its opening, the next bar's opening)."""
    left = chart.select(F.col("sym").alias("_sym"), F.col("time").alias("_at"), F.lit(0).alias("_side"))
    right = lower.select(F.col("sym").alias("_sym"), F.col("time").alias("_at"), F.lit(1).alias("_side"), F.struct("time", F.col(value).alias("v")).alias("_bar"))
    order = Window.partitionBy("_sym").orderBy("_at", "_side")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_open", F.last(F.when(F.col("_side") == 0, F.col("_at")), ignorenulls=True).over(order))
    grouped = both.where("_side = 1 AND _open IS NOT NULL").groupBy("_sym", "_open").agg(F.sort_array(F.collect_list("_bar")).alias("_bars"))
    joined = chart.join(grouped, (F.col("sym") == F.col("_sym")) & (F.col("time") == F.col("_open")), "left")
    empty = F.array().cast(f"array<{dict(lower.dtypes)[value]}>")
    return joined.withColumn(out, F.coalesce(F.transform("_bars", lambda x: x["v"]), empty)).drop("_sym", "_open", "_bars")


def collapse(chart: DataFrame, lower: DataFrame, value: str, out: str, lookahead: bool = False, gaps: bool = False) -> DataFrame:
    """One lower-timeframe value a chart bar: the last inside it (the first with ``lookahead``); without any and without
    ``gaps``, the last before."""
    b = lower_tf(chart, lower, value, "_inside")
    own = F.when(F.size("_inside") > 0, F.element_at("_inside", 1 if lookahead else -1))
    if gaps:
        return b.withColumn(out, own).drop("_inside")
    b = b.withColumn("_own", own).withColumn("_last", F.when(F.size("_inside") > 0, F.element_at("_inside", -1)))
    before = Window.partitionBy("sym").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn(out, F.coalesce("_own", F.last("_last", ignorenulls=True).over(before))).drop("_inside", "_own", "_last")


DAY = 86_400_000


def carried(bars: DataFrame, quotes: DataFrame, value: str, out: str) -> DataFrame:
    """``bars`` of all symbols with ``out``: the ``value`` of the last quote (``time``, ``value``) at or before each bar."""
    rows = bars.select((F.col("time") / DAY).cast("long").alias("_day"), F.col("time").alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    given = quotes.select((F.col("time") / DAY).cast("long").alias("_day"), F.col("time").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_quote"))
    both = rows.unionByName(given, allowMissingColumns=True)
    inside = Window.partitionBy("_day").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    # one row a day: the last quote of all days before it
    days = both.groupBy(F.col("_day").alias("_d")).agg(F.max_by("_quote", F.when(F.col("_quote").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_d", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    seen = both.withColumn("_seen", F.last("_quote", ignorenulls=True).over(inside)).where("_side = 1")
    return seen.join(days, F.col("_day") == F.col("_d")).select("_row.*", F.coalesce("_seen", "_before")["v"].alias(out))


def currency_rate(bars: DataFrame, quotes: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """The latest quote (``from``, ``to``, ``effective_time``, ``rate``) at or before each bar; its inverse where only
    that is quoted; 1 for one currency."""
    if source == target:
        return bars.withColumn(out, F.lit(1.0))
    straight = (F.col("from") == source) & (F.col("to") == target)
    turned = (F.col("from") == target) & (F.col("to") == source)
    # whether the pair itself is quoted at all is one row, known when the plan runs
    pair = quotes.where(straight | turned).select(F.col("effective_time").alias("time"), F.when(straight, F.struct(F.lit(True).alias("own"), F.col("rate").alias("r"))).otherwise(F.struct(F.lit(False).alias("own"), F.when(F.col("rate") != 0, 1 / F.col("rate")).alias("r"))).alias("q"))
    own = carried(bars, pair.where("q.own").select("time", F.col("q.r").alias("r")), "r", "_straight")
    both = carried(own, pair.where("NOT q.own").select("time", F.col("q.r").alias("r")), "r", "_turned")
    return both.withColumn(out, F.coalesce("_straight", "_turned")).drop("_straight", "_turned")


def _in_interval(bars: DataFrame, intervals: DataFrame, fields: list[str]) -> DataFrame:
    """``bars`` with ``_in``: the fields of the (sym, open, close) interval that holds their opening, else null."""
    seen = asof(bars, intervals, F.col("open"), F.col("time"), F.struct("close", *fields), "_in")
    return seen.withColumn("_in", F.when(F.col("time") < F.col("_in.close"), F.col("_in")))


def calendar(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """``bars`` with ``trading_day`` of the (sym, open, close, trading_day) interval that holds their opening, else null.

    A symbol's intervals don't overlap."""
    return _in_interval(bars, intervals, ["trading_day"]).withColumn("trading_day", F.col("_in.trading_day")).drop("_in")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Currency quotes from JSON lines: from, to, effective_time, rate; a quote marked ``unavailable`` has no rate."""
    rows = spark.read.schema("from string, to string, effective_time long, rate double, unavailable boolean").json(path)
    return rows.withColumn("rate", F.when(~F.coalesce("unavailable", F.lit(False)), F.col("rate"))).drop("unavailable")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Intervals from JSON lines: sym, timezone, timeframe, and intervals of open, close and trading_day."""
    rows = spark.read.schema("sym string, timezone string, timeframe string, intervals array<struct<open:long,close:long,trading_day:long>>").json(path)
    return rows.select("sym", "timezone", "timeframe", F.inline("intervals"))


def session_windows(bars: DataFrame, inside: Column, day: Column) -> DataFrame:
    """``bars`` with ``window_id``, the number of the session that holds the bar (null outside), and ``trading_day``, the
    ``day`` of the session's first bar; a session is a run of bars for which ``inside`` holds."""
    order = Window.partitionBy("sym").orderBy("bar_index")
    b = bars.withColumn("_inside", F.coalesce(inside, F.lit(False))).withColumn("_day", day)
    opens = F.col("_inside") & (~F.coalesce(F.lag("_inside").over(order), F.lit(False)) | (F.lag("_day").over(order) != F.col("_day")))
    b = b.withColumn("_n", F.count(F.when(opens, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.last(F.when(opens, F.col("_day")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumns({"window_id": F.when(F.col("_inside"), F.col("_n") - 1), "trading_day": F.when(F.col("_inside"), first)}).drop("_inside", "_day", "_n")


def magnified(chart: DataFrame, lower: DataFrame) -> DataFrame:
    """``chart`` with ``intrabars``: its lower bars in order, as (time, open, high, low, close); itself where it has none."""
    prices = F.struct("time", "open", "high", "low", "close")
    found = lower_tf(chart, lower.withColumn("_prices", prices), "_prices", "intrabars")
    return found.withColumn("intrabars", F.when(F.size("intrabars") > 0, F.col("intrabars")).otherwise(F.array(prices)))


def standard_prices(chart: DataFrame, standard: DataFrame) -> DataFrame:
    """A chart of non-standard bars with ``std_open`` to ``std_close``, the standard bar's prices at the same time: what
    orders are filled at. Null where there is none."""
    own = standard.select("sym", "time", *[F.col(c).alias(f"std_{c}") for c in ("open", "high", "low", "close")])
    return chart.join(own, ["sym", "time"], "left")


def with_metadata(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """``bars`` with their symbol's constants (sym, mintick, qty_step, point_value, currency); a symbol without any has
    0.01, 1, 1 and USD."""
    known = bars.join(symbols, "sym", "left")
    return known.withColumns({"mintick": F.coalesce("mintick", F.lit(0.01)), "qty_step": F.coalesce("qty_step", F.lit(1.0)), "point_value": F.coalesce("point_value", F.lit(1.0)), "currency": F.coalesce("currency", F.lit("USD"))})


def provider_bars(updates: DataFrame) -> DataFrame:
    """A provider's bars as its updates (sym, tf, seq, kind, time, prices) leave them: a forming bar is replaced by what
    follows, a confirmed one stays. ``confirmed`` tells them apart."""
    rank = F.struct((F.col("kind") == "confirmed").cast("int").alias("c"), "seq")
    prices = ["open", "high", "low", "close", "volume"]
    last = updates.groupBy("sym", "tf", "time").agg(F.max_by(F.struct(*prices), rank).alias("_b"), F.max(F.col("kind") == "confirmed").alias("confirmed"))
    return last.select("sym", "tf", "time", "_b.*", "confirmed")


def feedback(passes: DataFrame, frames: DataFrame) -> DataFrame:
    """Each pass (sym, bar_index, pass, time) with its account's frame (position, equity, fills); reading it fails where a
    frame is missing or of another time."""
    given = frames.withColumnRenamed("time", "_time")
    joined = passes.join(given, ["sym", "bar_index", "pass"], "left")
    bad = F.col("_time").isNull() | (F.col("_time") != F.col("time"))
    return joined.withColumn("time", F.when(bad, F.raise_error(F.lit("an account frame is missing or of another time")).cast("long")).otherwise(F.col("time"))).drop("_time")
