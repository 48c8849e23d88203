"""The script language on hand-made bars."""

import pytest

from barloom.lang.parse import ScriptError, parse
from barloom.lang.run import Run, run_events, run_script
from barloom.sources.bars import from_rows


def play(source, closes, inputs=None, volume=1.0):
    run = Run(source, inputs)
    for i, c in enumerate(closes):
        run.step({"sym": "s", "bar_index": i, "time": i * 3_600_000, "open": c, "high": c, "low": c, "close": c, "volume": volume, "_last": i == len(closes) - 1})
    return run


def shown(source, closes, **more):
    return play("//@version=6\n" + source, closes, **more).plots


def test_na_rules():
    plots = shown('x = bar_index == 1 ? na : close\nplot(x > 0 ? 1 : 0, "gt")\nplot(na(x) ? 1 : 0, "na")\nplot(nz(x, -1), "nz")\nplot(not (x > 0) ? 1 : 0, "not")\nplot(x / 0, "div")\nplot(7 % 3, "mod")\n', [1, 2, 3])
    assert plots["gt"] == [1, 0, 1] and plots["na"] == [0, 1, 0] and plots["nz"] == [1, -1, 3] and plots["not"] == [0, 1, 0] and plots["div"] == [None] * 3 and plots["mod"] == [1] * 3


def test_calls_in_branches_advance_only_when_run():
    plots = shown('float x = na\nif bar_index % 2 == 0\n    x := ta.sma(close, 2)\nplot(x, "x")\n', [1, 9, 3, 9, 5])
    assert plots["x"] == [None, None, 2, None, 4]


def test_functions_have_memory_per_call():
    plots = shown('count() =>\n    var int n = 0\n    n += 1\n    n\na = count()\nb = bar_index > 0 ? count() : 0\nplot(a, "a")\nplot(b, "b")\n', [1, 1, 1])
    assert plots["a"] == [1, 2, 3] and plots["b"] == [0, 1, 2]


def test_loops_and_switch():
    source = """
total = 0
for i = 5 to 1 by 2
    if i == 3
        continue
    total += i
n = 0
while true
    n += 1
    if n >= 4
        break
s = 0
for [k, v] in array.from(10, 20, 30)
    s += k * v
word = switch n
    3 => "three"
    4 => "four"
    => "other"
plot(total, "total")
plot(n, "n")
plot(s, "s")
plot(word == "four" ? 1 : 0, "word")
"""
    plots = shown(source, [1])
    assert [plots[k][0] for k in ("total", "n", "s", "word")] == [6, 4, 80, 1]


def test_arrays_are_shared_and_maps_keep_order():
    source = """
a = array.new<float>(2, 1.0)
b = a
b.push(close)
m = map.new<string, float>()
m.put("x", 1.0)
m.put("y", 2.0)
m.put("x", 3.0)
plot(array.size(a), "size")
plot(array.get(a, -1), "last")
plot(m.get("x") + m.size(), "map")
plot(str.length(str.format("{0,number,#.0}", close)), "text")
"""
    plots = shown(source, [5])
    assert [plots[k][0] for k in ("size", "last", "map", "text")] == [3, 5, 5, 3]


def test_inputs_constants_and_legacy_names():
    assert shown('n = input.int(2, "n")\nplot(n, "n")\n', [1], inputs={"n": 7})["n"] == [7]
    assert play('//@version=4\nstudy("x")\nplot(max(close, 2), "v")\nplot(sma(close, 2), "m")\n', [1, 3]).plots == {"v": [2, 3], "m": [None, 2]}


def test_lines_go_on_and_errors_name_their_line():
    assert shown('x = 1 +\n  2 +\n  3\nplot(math.max(x,\n    4), "x")\n', [1])["x"] == [6]
    with pytest.raises(ScriptError, match="line 2"):
        parse("x = 1\ny = ?\n")
    with pytest.raises(ScriptError, match="declared"):
        shown("plot(nothing)\n", [1])


def test_strategy_reads_its_ledger():
    run = play('//@version=6\nstrategy("s", initial_capital = 1000, pyramiding = 3)\nif strategy.position_size < 2\n    strategy.entry("a", strategy.long)\nif bar_index == 4\n    strategy.close_all()\nplot(strategy.position_size, "size")\nplot(strategy.closedtrades, "done")\n', [10, 11, 12, 13, 14, 15])
    assert run.plots["size"] == [0, 1, 2, 2, 2, 0] and run.plots["done"] == [0, 0, 0, 0, 0, 2]
    assert run.broker.netprofit == (15 - 11) + (15 - 12)


def test_events_and_tables(spark):
    b = from_rows(spark, [{"time": t, "open": 1, "high": 2, "low": 1, "close": c, "volume": 1} for t, c in enumerate((1, 2, 1))])
    source = '//@version=6\nindicator("x")\nif close > 1\n    id = label.new(bar_index, high, "up")\n    label.set_text(id, "more")\nalertcondition(close > 1, "t", "{{ticker}} at {{bar_index}}")\nplot(close)\n'
    assert [(r["kind"], r["text"]) for r in run_events(b, source).orderBy("seq").collect()] == [("label.new", "up"), ("label.set_text", "more"), ("alertcondition", "chart at 1")]
    assert run_script(b, source).count() == 3
