"""Single operators on hand-made bars."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import arrays, maps, texts, times
from barloom.operators import recursive, strategy, ta
from barloom.operators.outputs import alert, delivered
from barloom.sources.bars import checked, from_rows, read_csv
from barloom.streaming.live import Rsi, corrected, live, replica

DAY = 86_400_000


def bars(spark, closes, volume=1.0, step=3_600_000):
    return from_rows(spark, [{"time": i * step, "open": c, "high": c, "low": c, "close": c, "volume": volume} for i, c in enumerate(closes)])


def column(df, name="v"):
    return [r[name] for r in df.orderBy("bar_index").collect()]


def test_means(spark):
    assert column(ta.sma(bars(spark, [1, 2, 3, 4]), "close", 3, "v")) == [None, None, 2, 3]
    assert column(ta.sma(bars(spark, [1, 2, 4, 8]), "close", 2, "v")) == [None, 1.5, 3, 6]
    assert column(ta.sma(bars(spark, [1, None, 3, 4, 5]), "close", 2, "v")) == [None, None, None, 3.5, 4.5]


def test_nulls_in_frames(spark):
    b = bars(spark, [3, None, 5, 4, None])
    assert column(ta.highest(b, 3, "v", "close")) == [None, None, 5, 5, 5]
    assert column(ta.highestbars(b, 3, "v", "close")) == [0, None, 0, -1, None]
    assert column(ta.cum(b, "close", "v")) == [3, None, 5, 9, None]
    assert column(ta.sum_(b, "close", 2, "v")) == [None, None, 8, 9, 9]
    assert column(ta.rising(bars(spark, [1, 2, 2, 3]), "close", 2, "v")) == [False, False, False, True]


def test_recurrences_keep_their_state_over_nulls(spark):
    b = recursive.recur(bars(spark, [1, 2, None, 3, 4]), [("v", "ema", "close", 2), ("w", "dema", "close", 2)])
    assert column(b)[:3] == [None, 1.5, None] and column(b)[3] == pytest.approx(2.5) and column(b)[4] == pytest.approx(3.5)
    assert column(b, "w")[0] == 1
    assert column(recursive.recur(bars(spark, [1, 2, 3, 4]), [("v", "rsi", "close", 2)])) == [None, None, 100, 100]


def test_random_stream_repeats(spark):
    b = bars(spark, [1] * 5)
    one, two = (column(recursive.recur(b, [("v", "random", 0, 10, 42)])) for _ in range(2))
    assert one == two and all(0 <= x < 10 for x in one) and len(set(one)) == 5


def test_csv_is_strict(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("time,open,high,low,close,volume\n1,1,1,1,1,1\n2,1,1,1,2,1\n")
    assert read_csv(spark, str(good)).count() == 2
    late = from_rows(spark, [{"time": t, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1} for t in (2, 1)])
    with pytest.raises(Exception, match="increase"):
        checked(late).collect()


def test_number_and_message_formats():
    cases = {("#.##", 1.005): "1.01", ("0.00", 1): "1.00", ("#,##0.0", 1234567.25): "1,234,567.3", ("#%", 0.256): "26%", ("000", 7): "007", ("#.########", 1 / 3): "0.33333333", ("0.0", -0.04): "0.0"}
    for (pattern, x), want in cases.items():
        assert texts.number_text(x, pattern) == want
    assert texts.number_text(None) == "NaN"
    assert texts.message_text("{0} '{'x'}' ''{1,number,integer}'' {9}", ("a", 1234.5)) == "a {x} '1,235' {9}"
    with pytest.raises(ValueError):
        texts.message_text("{", ())


def test_timeframes_and_sessions(spark):
    assert [times.from_seconds(s) for s in (1, 7, 50, 3600, 86_400, 7 * 86_400, times.MONTH, 10**8)] == ["1S", "10S", "1", "60", "1D", "1W", "1M", "12M"]
    assert times.in_seconds("W") == 604_800 and times.in_seconds("15") == 900
    night = spark.createDataFrame([(int((3 * 24 + h) * 3_600_000),) for h in (1, 10, 23)], "t long")  # a Sunday
    assert [r[0] for r in night.select(times.in_session("t", "2200-0200:1")).collect()] == [False, False, True]
    with pytest.raises(ValueError):
        times.parse_session("9-5")


def test_array_errors_and_maps(spark):
    df = spark.createDataFrame([([3.0, None, 1.0],)], "a array<double>")
    assert df.select(arrays.avg("a"), arrays.sum_(arrays.clear("a")), arrays.mode("a"), arrays.median("a")).first() == (2.0, None, None, 2.0)
    with pytest.raises(Exception, match="range"):
        df.select(arrays.get("a", 3)).collect()
    m = maps.put(maps.put(maps.new(), F.lit("x"), F.lit(1.0)), F.lit("y"), F.lit(2.0))
    assert df.select(maps.keys(maps.remove(m, F.lit("x"))[1])).first()[0] == ["y"]


def path(spark, rows):
    return from_rows(spark, [{"time": i * 3_600_000, "open": o, "high": h, "low": lo, "close": c, "volume": 1} for i, (o, h, lo, c) in enumerate(rows)])


def trades(spark, rows, script, settings=None):
    done = strategy.backtest(path(spark, rows), script, settings or strategy.Settings()).where("row = 'trade'").orderBy("number").collect()
    return [(t["entry_id"], t["exit_id"], t["side"], t["size"], t["entry_price"], t["exit_price"], t["entry_bar"], t["exit_bar"], round(t["profit"], 9)) for t in done]


def test_market_orders_fill_at_the_next_open(spark):
    def script(bar, broker):
        if bar["bar_index"] == 0:
            broker.entry("a", 1, 2)
        if bar["bar_index"] == 2:
            broker.close("a", qty_percent=50)
        if bar["bar_index"] == 3:
            broker.close_all()

    rows = [(10, 11, 9, 10), (12, 13, 11, 12), (13, 14, 12, 13), (15, 16, 14, 15), (14, 15, 13, 14)]
    got = trades(spark, rows, script, strategy.Settings(commission=1, commission_type="cash_per_contract"))
    assert [g[3:] for g in got] == [(1.0, 12.0, 15.0, 1, 3, 1.0), (1.0, 12.0, 14.0, 1, 4, 0.0)]


def test_path_meets_the_nearer_extreme_first(spark):
    def script(bar, broker):
        if bar["bar_index"] == 0:
            broker.entry("a", 1)
        broker.exit("x", "a", stop=9, limit=12)

    # open 10 is nearer to the high: the limit is met before the stop; in the other bar the low comes first
    assert trades(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (10, 12.5, 7, 10)], script)[0][5] == 12
    assert trades(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (10, 13, 8.5, 10)], script)[0][5] == 9
    assert trades(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (8, 13, 7, 10)], script)[0][5] == 8  # a gap fills at the open


def test_trailing_oca_reversal_and_risk(spark):
    def trailing(bar, broker):
        if bar["bar_index"] == 0:
            broker.entry("a", 1)
        broker.exit("x", "a", trail_price=11, trail_offset=100)

    assert trades(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (10, 13, 10, 13), (13, 13, 11, 11)], trailing)[0][5] == 12

    def straddle(bar, broker):
        if bar["bar_index"] == 0:
            broker.entry("up", 1, stop=11, oca="g", oca_type="cancel")
            broker.entry("down", -1, stop=9, oca="g", oca_type="cancel")
        if bar["bar_index"] == 2:
            broker.entry("turn", -1)

    got = trades(spark, [(10, 10, 10, 10), (10, 11.5, 8, 10), (10, 10, 10, 10), (9, 9, 9, 9), (9, 9, 9, 9)], straddle)
    assert got == [("up", "turn", 1, 1.0, 11.0, 9.0, 1, 3, -2.0)]

    def guarded(bar, broker):
        broker.risk.max_drawdown = (3, "cash")
        if not broker.position_size:
            broker.entry("a", 1)

    got = trades(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (6, 6, 6, 6), (6, 6, 6, 6), (6, 6, 6, 6)], guarded)
    assert len(got) == 1 and got[0][5] == 6


def test_pyramiding_and_margin(spark):
    def adding(bar, broker):
        broker.entry("a", 1)

    rows = [(10, 10, 10, 10)] * 5
    opened = strategy.backtest(path(spark, rows), adding, strategy.Settings(pyramiding=2)).where("row = 'open'").count()
    assert opened == 2

    def large(bar, broker):
        if bar["bar_index"] == 0:
            broker.entry("a", 1, 100)

    rows = [(10, 10, 10, 10), (10, 10, 10, 10), (7, 7, 7, 7)]
    called = strategy.backtest(path(spark, rows), large, strategy.Settings(initial_capital=600, margin_long=50)).where("row = 'trade'").collect()
    assert called and called[0]["exit_id"] == "Margin call"


def test_alerts(spark):
    events = spark.createDataFrame([("a", 0, 0, "x", "forming"), ("a", 0, 1, "y", "confirmed"), ("a", 1, 0, "z", "forming")], "sym string, bar_index long, seq long, message string, kind string")
    assert {r["message"] for r in alert(events).collect()} == {"x", "z"}
    assert {r["message"] for r in alert(events, "once_per_bar_close").collect()} == {"y"}
    tried = spark.createDataFrame([("a", 0, False), ("a", 0, True), ("a", 1, False)], "sym string, bar_index long, ok boolean")
    assert [r["bar_index"] for r in delivered(events, tried, ["sym", "bar_index"]).collect()] == [1]


def test_streaming_equals_batch(spark, tmp_path):
    r = random.Random(3)
    closes = [round(100 + r.gauss(0, 3), 2) for _ in range(40)]
    rows = []
    for i, c in enumerate(closes):
        rows += [("s", i, "forming", c + 1.0), ("s", i, "forming", c - 2.0), ("s", i, "confirmed", c)]
    rows.append(("s", 3, "confirmed", 1.0))  # late
    schema = "sym string, time long, kind string, close double"
    for k in range(3):
        part = rows[k * 40 : (k + 1) * 40 + (1 if k == 2 else 0)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live(stream, [("ema", "ema", 5), ("rsi", "rsi", 4)]).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    out = spark.sql("SELECT * FROM live_out")
    assert out.where("op = 'rejected'").count() >= 1
    batch = recursive.recur(bars(spark, closes, step=1), [("e", "ema", "close", 5), ("q", "rsi", "close", 4)]).collect()
    want = {b["time"]: (b["e"], b["q"]) for b in batch}
    state = {x["time"]: (x["ema"], x["rsi"]) for x in replica(out).where("op = 'commit'").collect()}
    for t, (e, q) in state.items():
        assert (e is None) == (want[t][0] is None) and (e is None or e == pytest.approx(want[t][0]))
        assert (q is None) == (want[t][1] is None) and (q is None or q == pytest.approx(want[t][1]))
    assert len(state) == 40
    with pytest.raises(Exception, match="missing"):
        replica(out.where("revision <> 5")).collect()


def test_step_rsi_equals_series():
    r = random.Random(1)
    x = [r.random() for _ in range(30)]
    step = Rsi(5)
    for a, b in zip([step(v) for v in x], recursive.rsi({"close": x}, "close", 5)[0], strict=True):
        assert math.isnan(a) == math.isnan(b) and (math.isnan(a) or a == pytest.approx(b))


def test_correction_replaces_a_suffix(spark):
    old = bars(spark, [1, 2, 3, 4])
    new = old.where("bar_index >= 2").withColumn("close", F.lit(9.0))
    assert sorted(r["close"] for r in corrected(old, new).collect()) == [1, 2, 9, 9]
