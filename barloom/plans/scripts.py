"""Scripts as queries, with the SQL of the same indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.lang.run import run_script, run_strategy
from barloom.plans import indicators, strategies
from barloom.sources.bars import HOUR, bars_sql, event_bars

QUERIES: dict = {}
SQL: dict = {}

SCRIPTS = {
    "script_sma": ('//@version=6\nindicator("mean")\nlength = input.int(14, "length")\nplot(ta.sma(close, length), "value")\n', "ta_sma"),
    "script_macd": ('//@version=6\nindicator("macd")\n[line, sig, hist] = ta.macd(close, 12, 26, 9)\nplot(line, "macd")\nplot(sig, "signal")\nplot(hist, title = "hist")\n', "ta_macd"),
    "script_rsi": ('//@version=5\nindicator("rsi")\nf(src, n) =>\n    ta.rsi(src, n)\nplot(f(close, 14), "value")\n', "ta_rsi"),
    "script_hma": ('//@version=6\nindicator("hull")\nhull(float x, simple int n) =>\n    d = 2 * ta.wma(x, n / 2 >= 1 ? int(n / 2) : 1) - ta.wma(x, n)\n    ta.wma(d, 4)\nplot(hull(close, 16), "value")\n', "ta_hma"),
    "script_highest": ('//@version=4\nstudy("old names")\nplot(highest(20), title="value")\n', "ta_highest"),
    "script_stochastic": ('//@version=6\nindicator("stoch")\nlow14 = ta.lowest(14)\nhigh14 = ta.highest(14)\nspan = high14 - low14\nplot(span != 0 ? 100 * (close - low14) / span : na, "value")\n', "ta_stoch"),
    "script_cmo": ('//@version=6\nindicator("cmo")\nd = close - close[1]\nup = math.sum(math.max(d, 0), 14)\ndown = math.sum(math.max(-d, 0), 14)\nplot(100 * (up - down) / (up + down), "value")\n', "ta_cmo"),
    "script_mom": ('//@version=6\nindicator("history")\nx = close\nplot(x - x[10], "value")\n', "ta_mom"),
    "script_loop": ('//@version=6\nindicator("loop")\ntotal = 0.0\nready = bar_index >= 13\nif ready\n    for i = 0 to 13\n        total += close[i]\nplot(ready ? total / 14 : na, "value")\n', "ta_sma"),
    "script_array": ('//@version=6\nindicator("array")\nvar float[] held = array.new<float>()\nheld.push(close)\nif held.size() > 14\n    held.shift()\nfloat value = na\nif held.size() == 14\n    value := held.avg()\nplot(value, "value")\n', "ta_sma"),
}
SCRIPTS |= {
    f"script_{k}": (f'//@version=6\nindicator("{k}")\nplot(ta.{call}, "value")\n', f"ta_{k}")
    for k, call in {
        "cci": "cci(close, 14)", "dev": "dev(close, 14)", "cog": "cog(close, 10)", "correlation": "correlation(close, open, 14)", "covariance": "covariance(close, open, 14)", "dema": "dema(close, 9)", "tema": "tema(close, 9)", "tsi": "tsi(close, 5, 13)", "alma": "alma(close, 9, 0.85, 6)",
        "swma": "swma(close)", "mode": "mode(volume, 14)", "percentile_linear_interpolation": "percentile_linear_interpolation(close, 14, 30)", "percentrank": "percentrank(close, 14)", "rci": "rci(close, 14)", "bbw": "bbw(close, 14, 2)", "median": "median(close, 14)", "range": "range(close, 14)",
        "linreg": "linreg(close, 14, 2)", "atr": "atr(14)", "ema": "ema(close, 14)", "rma": "rma(close, 14)", "roc": "roc(close, 5)", "wma": "wma(close, 14)",
    }.items()
}
SCRIPTS |= {
    f"script_{k}": ('//@version=6\nindicator("x")\n' + body, f"ta_{k}")
    for k, body in {
        "supertrend": '[line, way] = ta.supertrend(3.0, 10)\nplot(line, "line")\nplot(way, "way")\n', "dmi": '[p, m, a] = ta.dmi(14, 10)\nplot(p, "plus")\nplot(m, "minus")\nplot(a, "adx")\n', "sar": 'plot(ta.sar(0.02, 0.02, 0.2), "value")\n', "vwap": 'plot(ta.vwap(close), "value")\n', "vwma": 'plot(ta.vwma(close, 14), "value")\n',
        "kc": '[b, u, l] = ta.kc(close, 20, 1.5)\nplot(b, "basis")\nplot(u, "upper")\nplot(l, "lower")\n', "kcw": 'plot(ta.kcw(close, 20, 1.5), "value")\n', "mfi": 'plot(ta.mfi(close, 14), "value")\n', "wpr": 'plot(ta.wpr(14), "value")\n', "ao": 'plot(ta.ao(), "value")\n', "bop": 'plot(ta.bop(), "value")\n',
        "accdist": 'plot(ta.accdist, "value")\n', "obv": 'plot(ta.obv, "value")\n', "pvt": 'plot(ta.pvt, "value")\n', "wad": 'plot(ta.wad, "value")\n', "iii": 'plot(ta.iii, "value")\n', "wvad": 'plot(ta.wvad, "value")\n', "nvi": 'plot(math.log(ta.nvi), "value")\n', "pvi": 'plot(math.log(ta.pvi), "value")\n',
        "percentile_nearest_rank": 'plot(ta.percentile_nearest_rank(close, 14, 30), "value")\n', "highestbars": 'plot(ta.highestbars(high, 20), "value")\n', "lowestbars": 'plot(ta.lowestbars(low, 20), "value")\n', "stoch": 'plot(ta.stoch(close, high, low, 14), "value")\n', "pivots": 'plot(ta.pivothigh(4, 3), "top")\nplot(ta.pivotlow(4, 3), "bottom")\n',
        "bb": '[b, u, l] = ta.bb(close, 14, 2)\nplot(b, "bb_basis")\nplot(u, "bb_upper")\nplot(l, "bb_lower")\n', "stdev": 'plot(ta.stdev(close, 14), "value")\nplot(ta.stdev(close, 14, false), "sample")\n', "variance": 'plot(ta.variance(close, 14), "value")\nplot(ta.variance(close, 14, false), "sample")\n',
        "barssince": 'plot(ta.barssince(close > open), "value")\n', "valuewhen": 'plot(ta.valuewhen(close > open, close, 0), "latest")\nplot(ta.valuewhen(close > open, close, 2), "third")\n', "lowest": 'plot(ta.lowest(20), "value")\n', "change": 'plot(ta.change(close, 3), "value")\n',
        "pivot_points_traditional": "x = ta.pivot_point_levels(\"Traditional\", bar_index % 24 == 0)\n" + "".join(f'plot(x.get({i}), "level{i}")\n' for i in range(11)), "pivot_points_dm": "x = ta.pivot_point_levels(\"DM\", bar_index % 24 == 0)\n" + "".join(f'plot(x.get({i}), "level{i}")\n' for i in range(3)),
    }.items()
}
for _name, (_source, _like) in SCRIPTS.items():
    def _query(spark, sf_dir, source=_source):
        b = run_script(event_bars(spark, sf_dir, HOUR), source)
        return indicators.tidy(b, *[c for c in b.columns if c not in ("sym", "bar_index", "time")])

    QUERIES[_name] = _query
    SQL[_name] = indicators.SQL[_like]

STATE = """//@version=6
indicator("state")
var int ups = 0
var float top = na
if close > open
    ups += 1
    top := na(top) ? close : math.max(top, close)
kind = switch
    close > open => 1
    close < open => -1
    => 0
plot(ups, "ups")
plot(top, "top")
plot(kind, "kind")
plot(nz(ups[1], -1), "before")
"""
QUERIES["script_state"] = lambda spark, sf_dir: indicators.tidy(run_script(event_bars(spark, sf_dir, HOUR), STATE), "ups", "top", "kind", "before")
SQL["script_state"] = f"""WITH {bars_sql()}, v AS (SELECT sym, bar_index, (count(*) FILTER (WHERE close > open) OVER {indicators.SO_FAR})::DOUBLE AS ups, max(CASE WHEN close > open THEN close END) OVER {indicators.SO_FAR} AS top, sign(close - open)::DOUBLE AS kind FROM bars),
w AS (SELECT *, coalesce(lag(ups) OVER {indicators.ORDER}, -1) AS before FROM v) {indicators.tidy_sql(['ups', 'top', 'kind', 'before'], 'w')}"""

REVERSING = """//@version=6
strategy("reversing", commission_type = "percent", commission_value = 0.1, pyramiding = 1)
fast = ta.sma(close, 5)
slow = ta.sma(close, 20)
up = ta.crossover(fast, slow)
down = ta.crossunder(fast, slow)
if up
    strategy.entry("long", strategy.long)
if down
    strategy.entry("short", strategy.short)
"""


def _trades(spark, sf_dir):
    t = run_strategy(event_bars(spark, sf_dir, HOUR), REVERSING)
    return t.select("sym", "number", "entry_id", "side", *[indicators.rounded(F.col(c)).alias(c) for c in ("size", "entry_price", "exit_price", "profit", "commission")], "entry_bar", "exit_bar")


QUERIES["script_strategy"] = _trades
SQL["script_strategy"] = strategies.SQL["strategy_reversing"]

SECURITY = """//@version=6
indicator("requests")
plot(request.security(syminfo.tickerid, "360", close), "value")
plot(request.security(syminfo.tickerid, "360", ta.sma(close, 3)), "mean")
plot(request.security(syminfo.tickerid, "360", close, gaps = barmerge.gaps_on), "gaps")
"""


def _requests(spark, sf_dir):
    big = event_bars(spark, sf_dir, 6 * HOUR).withColumns({"tf": F.lit("360"), "tf_millis": F.lit(6 * HOUR)})
    return indicators.tidy(run_script(event_bars(spark, sf_dir, HOUR), SECURITY, requested=big, millis=HOUR), "value", "mean", "gaps")


QUERIES["script_security"] = _requests
SQL["script_security"] = f"""WITH {bars_sql()}, {bars_sql(6 * HOUR, 'big')},
closed AS (SELECT *, coalesce(least(time + {6 * HOUR}, lead(time) OVER w), time + {6 * HOUR}) AS stamp, CASE WHEN count(*) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(close) OVER (w ROWS 2 PRECEDING) END AS m FROM big WINDOW w AS (PARTITION BY sym ORDER BY time)),
chart AS (SELECT *, coalesce(least(time + {HOUR}, lead(time) OVER w), time + {HOUR}) AS ends FROM bars WINDOW w AS (PARTITION BY sym ORDER BY time)),
v AS (SELECT c.sym, c.bar_index, b.close AS value, b.m AS mean, b.stamp, lag(c.ends) OVER (PARTITION BY c.sym ORDER BY c.time) AS was FROM chart c ASOF LEFT JOIN closed b ON c.sym = b.sym AND c.ends >= b.stamp),
x AS (SELECT *, CASE WHEN was IS NULL OR stamp > was THEN value END AS gaps FROM v) {indicators.tidy_sql(['value', 'mean', 'gaps'], 'x')}"""


def script(name: str, source: str, expressions: dict[str, str], steps: str = "", table: str = "bars", **given) -> None:
    """A script whose plots are these expressions over the bars."""
    def query(spark, sf_dir):
        return indicators.tidy(run_script(event_bars(spark, sf_dir, HOUR), "//@version=6\n" + source, **given), *expressions)

    QUERIES[name] = query
    SQL[name] = f"WITH {bars_sql()} {steps}, v AS (SELECT sym, bar_index, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in expressions.items())} FROM {table}) {indicators.tidy_sql(list(expressions))}"


def plots(names) -> str:
    return "".join(f'plot({n}, "{n}")\n' for n in names)


L1, L2 = f"lag(close) OVER {indicators.ORDER}", f"lag(close, 2) OVER {indicators.ORDER}"
script(
    "script_types",
    """indicator("types")
type Leg
    float price = 1.5
    int at
type Move
    Leg begin
    Leg end
enum Way
    up = "rising"
    down = "falling"
method span(Move m) =>
    m.end.price - m.begin.price
method moved(Leg leg, float by) =>
    leg.price += by
    leg
var Leg last = Leg.new(0.0, 0)
Move m = Move.new(last.copy(), Leg.new(close, bar_index))
Leg[] legs = array.from(m.begin, m.end)
legs.get(1).moved(1.0)
way = m.span() >= 1 ? Way.up : Way.down
span = m.span()
rising = way == Way.up ? 1 : 0
held = m.end.price
plain = Leg.new(at = 7).price
letters = str.length(str.tostring(way))
last := Leg.new(close, bar_index)
"""
    + plots(["span", "rising", "held", "plain", "letters"]),
    {"span": f"close + 1 - coalesce({L1}, 0)", "rising": f"CASE WHEN close - coalesce({L1}, 0) >= -1e-10 THEN 1 ELSE 0 END", "held": "close + 1", "plain": "1.5", "letters": f"CASE WHEN close - coalesce({L1}, 0) >= -1e-10 THEN 6 ELSE 7 END"},
)
LIBRARY = """//@version=6
library("tools")
STEP = 2
export type Band
    float low
    float high
half(float x) => x / STEP
export middle(float a, float b) =>
    half(a + b)
export method width(Band b) =>
    b.high - b.low
"""
script(
    "script_library",
    """indicator("library")
import someone/tools/3 as t
t.Band b = t.Band.new(low, high)
mid = t.middle(high, low)
wide = b.width()
step = t.STEP
"""
    + plots(["mid", "wide", "step"]),
    {"mid": "(high + low) / 2", "wide": "high - low", "step": "2"},
    libraries={"someone/tools/3": LIBRARY},
)
script(
    "script_matrix",
    """indicator("matrix")
m = matrix.new<float>(2, 2, 0.0)
m.set(0, 0, open)
m.set(0, 1, high)
m.set(1, 0, low)
m.set(1, 1, close)
n = matrix.new<float>(2, 2, 2.0)
det = m.det()
trace = matrix.trace(m)
p = m.mult(n)
cell = p.get(1, 0)
diff = matrix.diff(m, n).get(0, 1)
total = 0.0
for row in m
    total += row.sum()
m.add_row(1, array.from(1.0, 2.0))
rows = m.rows()
moved = m.get(2, 1)
t = m.transpose()
shape = t.rows() * 10 + t.columns()
m.remove_col(0)
rest = m.avg()
k = n.kron(n)
size = k.elements_count()
same = k.is_symmetric() ? 1 : 0
vector = array.sum(p.mult(array.from(1.0, -1.0)))
rank = matrix.new<float>(3, 2, 4.0).rank()
power = n.pow(3).get(0, 0)
"""
    + plots(["det", "trace", "cell", "diff", "total", "rows", "moved", "shape", "rest", "size", "same", "vector", "rank", "power"]),
    {"det": "open * close - high * low", "trace": "open + close", "cell": "2 * (low + close)", "diff": "high - 2", "total": "open + high + low + close", "rows": "3", "moved": "close", "shape": "23", "rest": "(high + 2 + close) / 3", "size": "16", "same": "1", "vector": "0", "rank": "1", "power": "32"},
)
script(
    "script_array_parts",
    """indicator("parts")
a = array.from(open, high, low, close)
v = a.slice(1, 3)
v.set(0, 5.0)
v.push(9.0)
fifth = a.get(3)
size = a.size()
first = v.first()
place = array.sort_indices(array.from(3.0, 1.0, 2.0)).get(0)
cov = array.covariance(array.from(1.0, 2.0, 3.0), array.from(open, high, close))
rank = array.percentrank(array.from(1.0, 2.0, 3.0, 4.0), 1)
near = array.percentile_nearest_rank(array.from(4.0, 1.0, 3.0, 2.0), 50)
low2 = array.binary_search_leftmost(array.from(1.0, 3.0, 5.0), 4.0)
high2 = array.binary_search_rightmost(array.from(1.0, 3.0, 5.0), 4.0)
z = array.standardize(array.from(1.0, 2.0, 3.0)).get(2)
"""
    + plots(["fifth", "size", "first", "place", "cov", "rank", "near", "low2", "high2", "z"]),
    {"fifth": "9", "size": "5", "first": "5", "place": "1", "cov": "(close - open) / 3", "rank": "50", "near": "2", "low2": "1", "high2": "2", "z": "sqrt(1.5)"},
)
script(
    "script_drawings",
    """indicator("drawings", max_lines_count = 3)
l = label.new(bar_index, close, "text")
l.set_xy(bar_index + 1, high)
c = l.copy()
c.set_text("longer text")
line w = line.new(bar_index, low, bar_index + 10, high)
f = linefill.new(w, w, color.red)
b = box.new(left = bar_index, top = high, right = bar_index + 2, bottom = low)
b.set_lefttop(bar_index - 1, close)
p = chart.point.from_index(bar_index + 3, open)
w2 = line.new(p, chart.point.now(close))
w2.set_second_point(chart.point.new(na, bar_index + 9, low))
t = table.new(position.top_right, 2, 2)
t.cell(0, 1, "a")
x = l.get_x()
y = l.get_y()
cx = c.get_x()
text1 = str.length(l.get_text())
text2 = str.length(c.get_text())
mid = w.get_price(bar_index + 5)
fill = f.get_line1().get_y2()
top = b.get_top()
side = b.get_left()
x1 = w2.get_x1()
y2 = w2.get_y2()
lines = array.size(line.all)
labels = array.size(label.all)
l.delete()
"""
    + plots(["x", "y", "cx", "text1", "text2", "mid", "fill", "top", "side", "x1", "y2", "lines", "labels"]),
    {"x": "bar_index + 1", "y": "high", "cx": "bar_index + 1", "text1": "4", "text2": "11", "mid": "(high + low) / 2", "fill": "high", "top": "close", "side": "bar_index - 1", "x1": "bar_index + 3", "y2": "low", "lines": "least(3, 2 * bar_index + 2)", "labels": "least(50, bar_index + 2)"},
)
script(
    "script_variables",
    """indicator("variables")
tf = timeframe.multiplier
intraday = timeframe.isintraday and timeframe.isminutes and not timeframe.isdwm ? 1 : 0
period = str.length(timeframe.period)
open_ = session.ismarket ? 1 : 0
first = session.isfirstbar ? 1 : 0
pre = session.ispremarket ? 1 : 0
tick = syminfo.mintick
name = syminfo.tickerid == "X:" + syminfo.ticker and syminfo.prefix == "X" ? 1 : 0
money = syminfo.currency == "EUR" and syminfo.type == "stock" ? 1 : 0
kind = chart.is_standard and not chart.is_renko ? 1 : 0
last = last_bar_index
last_time = last_bar_time
closes = time_close
day = time_tradingday
quote = na(ask) and na(bid) ? 1 : 0
begin = chart.left_visible_bar_time
four = time("240")
next = time_close("D")
new_day = timeframe.change("D") ? 1 : 0
hours = hour(time, "America/New_York")
stamp = timestamp("UTC", 2024, 13, 1, 0, 0)
seconds = timeframe.in_seconds("3M")
red = color.r(color.from_gradient(50.0, 0.0, 100.0, color.rgb(0, 0, 0), color.rgb(200, 100, 50)))
faint = color.t(color.new(color.red, 40))
cut = str.length(str.substring("abcdef", 2, 5)) + str.length(str.match("ab12", "[0-9]+"))
swapped = str.replace("aXbXc", "X", "--", 1) == "aXb--c" ? 1 : 0
date = str.format_time(0, "yyyy-MM-dd", "UTC") == "1970-01-01" ? 1 : 0
id = ticker.modify(ticker.new("NYSE", "A"), session.extended) == "{\\"session\\":\\"extended\\",\\"symbol\\":\\"NYSE:A\\"}" ? 1 : 0
plain = ticker.standard(ticker.heikinashi("NYSE:A")) == "NYSE:A" and syminfo.prefix("NYSE:A") == "NYSE" ? 1 : 0
again = ticker.inherit(ticker.renko("NYSE:A", "ATR", 10), "NYSE:B") == ticker.renko("NYSE:B", "ATR", 10) ? 1 : 0
rate = request.currency_rate("USD", "EUR")
isfirst = barstate.isfirst ? 1 : 0
islast = barstate.islast ? 1 : 0
calm = barstate.ishistory and barstate.isconfirmed and not barstate.isrealtime ? 1 : 0
"""
    + plots("tf intraday period open_ first pre tick name money kind last last_time closes day quote begin four next new_day hours stamp seconds red faint cut swapped date id plain again rate isfirst islast calm".split()),
    {
        "tf": "60", "intraday": "1", "period": "2", "open_": "CASE WHEN h >= 8 AND h < 20 THEN 1 ELSE 0 END", "first": f"CASE WHEN h >= 8 AND h < 20 AND (lag(h) OVER {indicators.ORDER} IS NULL OR NOT (lag(h) OVER {indicators.ORDER} >= 8 AND lag(h) OVER {indicators.ORDER} < 20) OR lag(d) OVER {indicators.ORDER} <> d) THEN 1 ELSE 0 END", "pre": "CASE WHEN h >= 4 AND h < 8 THEN 1 ELSE 0 END",
        "tick": "0.25", "name": "1", "money": "1", "kind": "1", "last": "max(bar_index) OVER (PARTITION BY sym)", "last_time": "max(time) OVER (PARTITION BY sym)", "closes": f"time + {HOUR}", "day": "d * 86400000", "quote": "1", "begin": "min(time) OVER (PARTITION BY sym)", "four": f"time - time % {4 * HOUR}", "next": "(d + 1) * 86400000",
        "new_day": f"CASE WHEN lag(d) OVER {indicators.ORDER} <> d THEN 1 ELSE 0 END", "hours": "(h + 19) % 24", "stamp": "epoch_ms(TIMESTAMP '2025-01-01')", "seconds": "7884009", "red": "100", "faint": "40", "cut": "5", "swapped": "1", "date": "1", "id": "1", "plain": "1", "again": "1", "rate": "CASE WHEN time >= 1704153600000 THEN 1 / 1.25 END",
        "isfirst": "CASE WHEN bar_index = 0 THEN 1 ELSE 0 END", "islast": "CASE WHEN bar_index = max(bar_index) OVER (PARTITION BY sym) THEN 1 ELSE 0 END", "calm": "1",
    },
    ", x AS (SELECT *, time // 86400000 AS d, (time % 86400000) // 3600000 AS h FROM bars)",
    "x",
    about={s: {"tickerid": f"X:{s}", "mintick": 0.25, "currency": "EUR", "session": "0800-2000:1234567", "premarket": "0400-0800:1234567"} for s in ("click", "view", "purchase", "signup", "logout", "login", "error", "scroll", "search")},
    rates={("EUR", "USD"): [(1704153600000, 1.25)]},
)
BALANCE = """//@version=6
strategy("balance", initial_capital = 5000, commission_type = strategy.commission.percent, commission_value = 0.1, margin_long = 0, margin_short = 0)
fast = ta.sma(close, 5)
slow = ta.sma(close, 20)
if ta.crossover(fast, slow)
    strategy.entry("long", strategy.long)
if ta.crossunder(fast, slow)
    strategy.entry("short", strategy.short)
done = strategy.closedtrades
net = strategy.netprofit_percent
gross = strategy.grossprofit_percent
lost = strategy.grossloss_percent
mean = strategy.avg_trade
held = strategy.max_contracts_held_all
start = strategy.initial_capital
share = strategy.closedtrades.profit_percent(strategy.closedtrades - 1)
hold = strategy.buy_and_hold_return_percent
money = strategy.account_currency == "USD" ? strategy.convert_to_account(3.0) : 0
"""
_BALANCE = ["done", "net", "gross", "lost", "mean", "held", "start", "share", "hold", "money"]
BALANCE += plots(_BALANCE)
QUERIES["script_balance"] = lambda spark, sf_dir: indicators.tidy(run_script(event_bars(spark, sf_dir, HOUR), BALANCE), *_BALANCE)
SQL["script_balance"] = f"""{strategies._SIGNALS}, a AS (SELECT b.sym, b.bar_index, b.close, first_value(b.close) OVER (PARTITION BY b.sym ORDER BY b.bar_index) AS c0, t.price, t.bar AS opened FROM bars b ASOF LEFT JOIN t ON b.sym = t.sym AND b.bar_index >= t.bar),
s2 AS (SELECT a.sym, a.bar_index, any_value(close) AS close, any_value(c0) AS c0, any_value(a.price) AS price, count(p.number) AS done, coalesce(sum(profit), 0) AS net, coalesce(sum(profit) FILTER (profit > 0), 0) AS gross, coalesce(-sum(profit) FILTER (profit < 0), 0) AS lost,
         arg_max(p.profit, p.number) AS last, arg_max(p.price, p.number) AS entry FROM a LEFT JOIN p ON p.sym = a.sym AND p.exit_bar <= a.bar_index GROUP BY a.sym, a.bar_index)
SELECT sym, bar_index, round(done + 1e-9, 6) AS done, round((net - coalesce(price, 0) * 0.001) / 50 + 1e-9, 6) AS net, round(gross / 50 + 1e-9, 6) AS gross, round(lost / 50 + 1e-9, 6) AS lost, round(CASE WHEN done > 0 THEN net / done END + 1e-9, 6) AS mean,
       round(CASE WHEN price IS NULL THEN 0 ELSE 1 END + 1e-9, 6) AS held, round(5000 + 1e-9, 6) AS start, round(100 * last / (entry * 1.001) + 1e-9, 6) AS share, round(100 * (close - c0) / c0 + 1e-9, 6) AS hold, round(3 + 1e-9, 6) AS money FROM s2""".replace("FILTER (profit", "FILTER (WHERE profit")
