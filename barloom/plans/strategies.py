"""Back-tests and outputs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import outputs, ta
from barloom.operators.strategy import LONG, SHORT, Broker, Settings, backtest
from barloom.plans import indicators
from barloom.sources.bars import HOUR, bars_sql, event_bars

QUERIES: dict = {}
SQL: dict = {}


_r = indicators.rounded


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ta.sma(ta.sma(event_bars(spark, sf_dir, HOUR), "close", 5, "fast"), "close", 20, "slow")
    return ta.crossunder(ta.crossover(b, "fast", "slow", "up"), "fast", "slow", "down")


def reversing(bar: dict, broker: Broker) -> None:
    if bar["up"]:
        broker.entry("long", LONG)
    if bar["down"]:
        broker.entry("short", SHORT)


def bracketed(bar: dict, broker: Broker) -> None:
    """Long on a crossing, out at a profit or a loss in ticks, or behind a trailing stop."""
    if bar["up"] and not broker.position_size:
        broker.entry("long", LONG)
    broker.exit("out", "long", profit=4000, loss=3000, trail_points=1500, trail_offset=800)


def breakout(bar: dict, broker: Broker) -> None:
    """Both sides by stop orders around the bar, one cancels the other; flat on the opposite crossing."""
    if not broker.position_size:
        broker.entry("up", LONG, stop=bar["high"], oca="side", oca_type="cancel")
        broker.entry("down", SHORT, stop=bar["low"], oca="side", oca_type="cancel")
    elif bar["up"] or bar["down"]:
        broker.cancel_all()
        broker.close_all()


def _trades(script, settings: Settings) -> callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = backtest(crossing(spark, sf_dir), script, settings).where("row = 'trade'")
        return t.select("sym", "number", "entry_id", "side", *[_r(F.col(c)).alias(c) for c in ("size", "entry_price", "exit_price", "profit", "commission")], "entry_bar", "exit_bar")

    return run


QUERIES["strategy_reversing"] = _trades(reversing, Settings(commission=0.1))
_SIGNALS = f"""WITH {bars_sql()}, m AS (SELECT *, CASE WHEN bar_index >= 4 THEN avg(close) OVER (PARTITION BY sym ORDER BY bar_index ROWS 4 PRECEDING) END AS fast,
  CASE WHEN bar_index >= 19 THEN avg(close) OVER (PARTITION BY sym ORDER BY bar_index ROWS 19 PRECEDING) END AS slow, lead(open) OVER (PARTITION BY sym ORDER BY bar_index) AS nxt FROM bars),
c AS (SELECT *, lag(fast) OVER (PARTITION BY sym ORDER BY bar_index) AS f1, lag(slow) OVER (PARTITION BY sym ORDER BY bar_index) AS s1 FROM m),
s AS (SELECT sym, bar_index + 1 AS bar, nxt AS price, CASE WHEN fast > slow THEN 1 ELSE -1 END AS side FROM c WHERE nxt IS NOT NULL AND ((fast > slow AND f1 <= s1) OR (fast < slow AND f1 >= s1))),
d AS (SELECT * FROM (SELECT *, lag(side) OVER (PARTITION BY sym ORDER BY bar) AS was FROM s) WHERE was IS NULL OR was <> side),
t AS (SELECT sym, side, bar, price, lead(bar) OVER w AS exit_bar, lead(price) OVER w AS exit_price, row_number() OVER w - 1 AS number FROM d WINDOW w AS (PARTITION BY sym ORDER BY bar)),
p AS (SELECT *, (price + exit_price) * 0.001 AS commission, side * (exit_price - price) - (price + exit_price) * 0.001 AS profit FROM t WHERE exit_bar IS NOT NULL)"""
SQL["strategy_reversing"] = f"""{_SIGNALS}
SELECT sym, number, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS entry_id, side::BIGINT AS side, 1.0::DOUBLE AS size, round(price + 1e-9, 6) AS entry_price, round(exit_price + 1e-9, 6) AS exit_price,
       round(profit + 1e-9, 6) AS profit, round(commission + 1e-9, 6) AS commission, bar AS entry_bar, exit_bar FROM p"""


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = backtest(crossing(spark, sf_dir), reversing, Settings(commission=0.1)).where("row = 'trade'")
    p = outputs.performance(trades, ["sym"])
    return p.select("sym", "closedtrades", "wintrades", "losstrades", "eventrades", *[_r(F.col(c)).alias(c) for c in ("netprofit", "grossprofit", "grossloss", "avg_trade", "avg_winning_trade", "avg_losing_trade")])


QUERIES["strategy_statistics"] = statistics
SQL["strategy_statistics"] = f"""{_SIGNALS}
SELECT sym, count(*) AS closedtrades, count(*) FILTER (WHERE profit > 0) AS wintrades, count(*) FILTER (WHERE profit < 0) AS losstrades, count(*) FILTER (WHERE profit = 0) AS eventrades, round(sum(profit) + 1e-9, 6) AS netprofit,
       round(coalesce(sum(profit) FILTER (WHERE profit > 0), 0) + 1e-9, 6) AS grossprofit, round(coalesce(-sum(profit) FILTER (WHERE profit < 0), 0) + 1e-9, 6) AS grossloss, round(avg(profit) + 1e-9, 6) AS avg_trade,
       round(avg(profit) FILTER (WHERE profit > 0) + 1e-9, 6) AS avg_winning_trade, round(avg(profit) FILTER (WHERE profit < 0) + 1e-9, 6) AS avg_losing_trade FROM p GROUP BY sym"""


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = backtest(crossing(spark, sf_dir), reversing, Settings()).where("row = 'equity'")
    return rows.select("sym", "bar_index", "position", _r(F.col("equity")).alias("equity"))


QUERIES["strategy_equity"] = equity
SQL["strategy_equity"] = f"""{_SIGNALS.replace('0.001', '0.0')}, h AS (SELECT b.sym, b.bar_index, b.close, t.side, t.price, t.number FROM bars b ASOF LEFT JOIN t ON b.sym = t.sym AND b.bar_index >= t.bar),
n AS (SELECT h.*, coalesce((SELECT sum(profit) FROM p WHERE p.sym = h.sym AND p.exit_bar <= h.bar_index), 0) AS net FROM h)
SELECT sym, bar_index, coalesce(side, 0)::DOUBLE AS position, round(1000000 + net + coalesce(side * (close - price), 0) + 1e-9, 6) AS equity FROM n"""
QUERIES["strategy_bracketed"] = _trades(bracketed, Settings(slippage=2))
QUERIES["strategy_breakout"] = _trades(breakout, Settings(qty_type="percent_of_equity", qty=10, commission_type="cash_per_order", commission=1.0))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = crossing(spark, sf_dir)
    up = outputs.marks(b, F.col("up"), "plotshape", "triangleup", "belowbar", "up", 0x4CAF50)
    return up.unionByName(outputs.marks(b, F.col("down"), "plotchar", "x", "abovebar", "down", 0xF23645))


_CROSSED = _SIGNALS[: _SIGNALS.index("\ns AS")].rstrip(",")
QUERIES["plot_marks"] = shapes
SQL["plot_marks"] = f"""{_CROSSED}
SELECT sym, bar_index, time, 'plotshape' AS kind, 'triangleup' AS style, 'belowbar' AS location, 'up' AS text, 5025616::BIGINT AS color FROM c WHERE fast > slow AND f1 <= s1
UNION ALL SELECT sym, bar_index, time, 'plotchar', 'x', 'abovebar', 'down', 15873605 FROM c WHERE fast < slow AND f1 >= s1"""
QUERIES["alert_condition"] = lambda s, d: outputs.alertcondition(crossing(s, d), F.col("up"), "crossed", "{{ticker}} crossed on volume {{volume}} ({{nothing}})").select("sym", "bar_index", "title", "message")
SQL["alert_condition"] = f"{_CROSSED} SELECT sym, bar_index, 'crossed' AS title, sym || ' crossed on volume ' || format('{{:.1f}}', volume) || ' ({{{{nothing}}}})' AS message FROM c WHERE fast > slow AND f1 <= s1"
QUERIES["plot_fill"] = lambda s, d: outputs.fill(crossing(s, d), "fast", "slow", 1).select("sym", "bar_index", _r(F.col("low")).alias("low"), _r(F.col("high")).alias("high"))
SQL["plot_fill"] = f"{_CROSSED} SELECT sym, bar_index, round(least(fast, slow) + 1e-9, 6) AS low, round(greatest(fast, slow) + 1e-9, 6) AS high FROM c WHERE slow IS NOT NULL"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label on every crossing, moved to the bar's low one bar later if the bar falls, deleted on every tenth bar."""
    b = crossing(spark, sf_dir)
    new = b.where("up OR down").select("sym", F.col("bar_index").alias("id"), (F.col("bar_index") * 10).alias("seq"), F.lit("new").alias("op"), F.col("high").alias("y"), F.when(F.col("up"), "up").otherwise("down").alias("text"))
    moved = b.where("(up OR down) AND close < open").select("sym", F.col("bar_index").alias("id"), (F.col("bar_index") * 10 + 1).alias("seq"), F.lit("set").alias("op"), F.col("low").alias("y"), F.lit(None).cast("string").alias("text"))
    gone = b.where("(up OR down) AND bar_index % 10 = 0").select("sym", F.col("bar_index").alias("id"), (F.col("bar_index") * 10 + 2).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("text"))
    return outputs.drawings(new.unionByName(moved).unionByName(gone), ["y", "text"], 20).select("sym", "id", _r(F.col("y")).alias("y"), "text")


QUERIES["drawing_labels"] = labels
SQL["drawing_labels"] = f"""{_CROSSED}, x AS (SELECT sym, bar_index AS id, CASE WHEN close < open THEN low ELSE high END AS y, CASE WHEN fast > slow THEN 'up' ELSE 'down' END AS text FROM c WHERE ((fast > slow AND f1 <= s1) OR (fast < slow AND f1 >= s1)) AND bar_index % 10 <> 0)
SELECT sym, id, round(y + 1e-9, 6) AS y, text FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY id DESC) AS k FROM x) WHERE k <= 20"""


def _fill_messages(s: SparkSession, d: str) -> DataFrame:
    fills = backtest(crossing(s, d), reversing, Settings()).where("row = 'fill'")
    return outputs.fill_alerts(fills.withColumn("n", F.col("size").cast("int")), "{{ticker}} {{strategy.order.action}} {{strategy.order.id}} {{nothing}}").select("sym", "number", "message")


QUERIES["order_fill_alerts"] = _fill_messages
SQL["order_fill_alerts"] = _SIGNALS + " SELECT sym, number, sym || CASE WHEN side > 0 THEN ' buy long ' ELSE ' sell short ' END || '{{nothing}}' AS message FROM t"


def _running(s: SparkSession, d: str) -> DataFrame:
    alerts = outputs.alertcondition(crossing(s, d), F.col("up"), "crossed", "x")
    config = s.createDataFrame([("click", "crossed", 30, None), ("view", "crossed", 0, 60), ("view", "other", 0, None)], "sym string, title string, since long, until long")
    return outputs.running_alerts(alerts, config).select("sym", "bar_index", "title")


QUERIES["running_alerts"] = _running
SQL["running_alerts"] = f"{_CROSSED} SELECT sym, bar_index, 'crossed' AS title FROM c WHERE fast > slow AND f1 <= s1 AND (sym = 'click' AND bar_index >= 30 OR sym = 'view' AND bar_index < 60)"


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    b = crossing(s, d).select("sym", "bar_index", "close", "slow")
    return outputs.from_json(outputs.to_json(b, ["sym"]), ["sym"], "bar_index: long, close: double, slow: double").select("sym", "bar_index", _r(F.col("close")).alias("close"), _r(F.col("slow")).alias("slow"))


QUERIES["json_round_trip"] = _round_trip
SQL["json_round_trip"] = f"{_CROSSED} SELECT sym, bar_index, round(close + 1e-9, 6) AS close, round(slow + 1e-9, 6) AS slow FROM c"


def _deltas(s: SparkSession, d: str) -> DataFrame:
    b = event_bars(s, d, HOUR).select("sym", "bar_index", "close")
    new = b.where("bar_index > 4").withColumn("close", F.when(F.col("bar_index") % 10 == 0, F.col("close") + 1).otherwise(F.col("close")))
    found = outputs.changes(b.where("bar_index < 60"), new, ["sym", "bar_index"], 7)
    return found.select("sym", "bar_index", "op", "revision", _r(F.col("close")).alias("close"))


QUERIES["result_changes"] = _deltas
SQL["result_changes"] = f"""WITH {bars_sql()} SELECT sym, bar_index, CASE WHEN bar_index <= 4 THEN 'delete' WHEN bar_index >= 60 THEN 'insert' ELSE 'update' END AS op, 7::BIGINT AS revision,
CASE WHEN bar_index > 4 THEN round(close + CASE WHEN bar_index % 10 = 0 THEN 1 ELSE 0 END + 1e-9, 6) END AS close FROM bars WHERE bar_index <= 4 OR bar_index >= 60 OR bar_index % 10 = 0"""
QUERIES["output_retention"] = lambda s, d: outputs.retained(event_bars(s, d, HOUR).select("sym", "bar_index", "time"), 30)
SQL["output_retention"] = f"WITH {bars_sql()} SELECT sym, bar_index, time FROM (SELECT *, max(bar_index) OVER (PARTITION BY sym) AS top FROM bars) WHERE bar_index > top - 30"
