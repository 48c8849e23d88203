"""What a script shows: plots, marks, levels, alerts and drawings, as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Active drawings of a kind that a symbol keeps if not said otherwise (a fixed value of the language).
CAP = 50


def plots(b: DataFrame, series: dict[str, Column | str], show_last: int | None = None) -> DataFrame:
    """A column for each plot, one row a bar; with ``show_last`` only the last bars have values."""
    columns = {k: (F.col(c) if isinstance(c, str) else c) for k, c in series.items()}
    if show_last is not None:
        seen = F.max("bar_index").over(Window.partitionBy("sym")) - F.col("bar_index") < show_last
        columns = {k: F.when(seen, c) for k, c in columns.items()}
    return b.select("sym", "bar_index", "time", *[c.alias(k) for k, c in columns.items()])


def colored(b: DataFrame, color: Column, kind: str) -> DataFrame:
    """bgcolor and barcolor: a colour a bar, where there is one."""
    return b.select("sym", "bar_index", F.lit(kind).alias("kind"), color.cast("long").alias("color")).where("color IS NOT NULL")


def marks(b: DataFrame, condition: Column, kind: str, style: str, location: str = "abovebar", text: str = "", color: int | None = None) -> DataFrame:
    """plotshape and plotchar: a row for each bar where the condition holds."""
    row = b.where(F.coalesce(condition, F.lit(False)))
    return row.select("sym", "bar_index", "time", F.lit(kind).alias("kind"), F.lit(style).alias("style"), F.lit(location).alias("location"), F.lit(text).alias("text"), F.lit(color).cast("long").alias("color"))


def arrows(b: DataFrame, series: str, least: float = 5, most: float = 100) -> DataFrame:
    """plotarrow: up for positive values, down for negative ones, with heights in proportion."""
    top = F.max(F.abs(F.col(series))).over(Window.partitionBy("sym"))
    height = F.when(top > 0, least + (most - least) * F.abs(F.col(series)) / top)
    return b.withColumn("height", height).where(F.col(series) != 0).select("sym", "bar_index", F.signum(series).cast("int").alias("direction"), "height")


def candles(b: DataFrame, o: str, h: str, low: str, c: str, up: int, down: int) -> DataFrame:
    """plotbar and plotcandle: bars of which no price is missing."""
    whole = b.where(" AND ".join(f"{x} IS NOT NULL" for x in (o, h, low, c)))
    return whole.select("sym", "bar_index", F.col(o).alias("open"), F.greatest(o, h, low, c).alias("high"), F.least(o, h, low, c).alias("low"), F.col(c).alias("close"), F.when(F.col(c) >= F.col(o), up).otherwise(down).cast("long").alias("color"))


def hline(b: DataFrame, price: float, title: str = "") -> DataFrame:
    return b.select("sym").distinct().select("sym", F.lit(title).alias("title"), F.lit(float(price)).alias("price"))


def fill(b: DataFrame, one: str, other: str, color: int, fillgaps: bool = False) -> DataFrame:
    """The span between two plots on each bar."""
    x, y = F.col(one), F.col(other)
    if fillgaps:
        before = Window.partitionBy("sym").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
        x, y = F.last(one, ignorenulls=True).over(before), F.last(other, ignorenulls=True).over(before)
    return b.select("sym", "bar_index", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"), F.lit(color).cast("long").alias("color"), (x.isNotNull() & y.isNotNull()).alias("_both")).where("_both").drop("_both")


_PLACE = re.compile(r"\{\{(\w+)\}\}")


def rendered(template: str, names: dict[str, str] | None = None) -> Column:
    """A message with {{close}} and other columns, {{ticker}} and {{interval}} in it; unknown placeholders stay."""
    known = {"ticker": "sym"} | {c: c for c in ("open", "high", "low", "close", "volume", "time")} | (names or {})
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(F.col(known[m[1]]).cast("string"), F.lit("NaN")) if m[1] in known else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def alertcondition(b: DataFrame, condition: Column, title: str, message: str) -> DataFrame:
    return b.where(F.coalesce(condition, F.lit(False))).select("sym", "bar_index", "time", F.lit(title).alias("title"), rendered(message).alias("message"))


def alert(events: DataFrame, frequency: str = "once_per_bar") -> DataFrame:
    """Alert events (sym, bar_index, seq, message, kind): all, the first of a bar, or those of its close."""
    if frequency == "all":
        return events
    if frequency == "once_per_bar_close":
        return events.where("kind <> 'forming'")
    first = F.row_number().over(Window.partitionBy("sym", "bar_index").orderBy("seq"))
    return events.withColumn("_n", first).where("_n = 1").drop("_n")


def delivered(alerts: DataFrame, attempts: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """Alerts still to be sent: each once, without those that an attempt delivered or that were tried ``most`` times."""
    tried = attempts.groupBy(*key).agg(F.count(F.lit(1)).alias("_tries"), F.max(F.col("ok").cast("int")).alias("_ok"))
    left = alerts.dropDuplicates(key).join(tried, key, "left")
    return left.where(f"coalesce(_ok, 0) = 0 AND coalesce(_tries, 0) < {most}").drop("_tries", "_ok")


def drawings(events: DataFrame, fields: list[str], cap: int = CAP) -> DataFrame:
    """The objects that stand at the end of an event log (sym, id, seq, op, fields...).

    op is new, set or delete; a set changes its fields that aren't null. Of the objects that weren't deleted, a symbol
    keeps the ``cap`` that were created last.
    """
    order = F.col("seq")
    state = events.groupBy("sym", "id").agg(
        F.min(F.when(F.col("op") == "new", order)).alias("created"), F.max(F.when(F.col("op") == "delete", 1).otherwise(0)).alias("gone"), *[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    )
    live = state.where("gone = 0 AND created IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.col("created").desc(), F.col("id").desc()))
    return live.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r", "gone")


def performance(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of closed trades."""
    p = F.col("profit")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("closedtrades"), F.count_if(p > 0).alias("wintrades"), F.count_if(p < 0).alias("losstrades"), F.count_if(p == 0).alias("eventrades"),
        F.sum(p).alias("netprofit"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("grossprofit"), F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0)).alias("grossloss"),
        F.avg(p).alias("avg_trade"), F.avg(F.when(p > 0, p)).alias("avg_winning_trade"), F.avg(F.when(p < 0, p)).alias("avg_losing_trade"),
    )


ORDER_FIELDS = {"strategy.order.action": "action", "strategy.order.contracts": "size", "strategy.order.price": "entry_price", "strategy.order.id": "entry_id", "strategy.position_size": "position", "ticker": "sym", "time": "time", "close": "close"}


def fill_alerts(fills: DataFrame, template: str) -> DataFrame:
    """A message for each fill, with {{strategy.order.action}} and the like; fields that are no columns stay as they are."""
    rows = fills.withColumn("action", F.when(F.col("side") > 0, "buy").otherwise("sell"))
    parts, at = [], 0
    for m in re.finditer(r"\{\{([\w.]+)\}\}", template):
        column = ORDER_FIELDS.get(m[1])
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(column).cast("string"), F.lit("NaN")) if column in rows.columns else F.lit(m[0])]
        at = m.end()
    return rows.withColumn("message", F.concat(*parts, F.lit(template[at:])))


def running_alerts(alerts: DataFrame, config: DataFrame) -> DataFrame:
    """Alerts (sym, title, bar_index, ...) of those that run: ``config`` (sym, title, since, until) was frozen when each was
    set up; an alert counts from ``since`` up to ``until``, if there is one."""
    held = config.select("sym", "title", "since", "until")
    joined = alerts.join(held, ["sym", "title"])
    return joined.where("bar_index >= since AND (until IS NULL OR bar_index < until)").drop("since", "until")


def to_json(result: DataFrame, keys: list[str], schema_version: int = 1) -> DataFrame:
    """One JSON document a row of keys: {"schema": ..., "rows": [...]} with the rows in order of bar_index."""
    fields = [c for c in result.columns if c not in keys]
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return result.groupBy(*keys).agg(F.to_json(F.struct(F.lit(schema_version).alias("schema"), rows.alias("rows")), {"ignoreNullFields": "false"}).alias("json"))


def from_json(documents: DataFrame, keys: list[str], fields: str, schema_version: int = 1) -> DataFrame:
    """The rows of such documents; reading one of another schema fails."""
    parsed = documents.withColumn("_d", F.from_json("json", f"schema int, rows array<struct<{fields}>>", {"mode": "FAILFAST"}))
    checked = F.when(F.col("_d.schema") == schema_version, F.col("_d.rows")).otherwise(F.raise_error(F.lit("a result of another schema")).cast(parsed.select("_d.rows").schema["rows"].dataType))
    return parsed.select(*keys, F.inline(checked))


def changes(old: DataFrame, new: DataFrame, keys: list[str], revision: int) -> DataFrame:
    """What leads from one result to the next: rows of op insert, update or delete, with the new values and a revision."""
    fields = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*fields).alias("_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select(*keys, "op", F.lit(revision).cast("long").alias("revision"), "_new.*")


def retained(result: DataFrame, bars: int) -> DataFrame:
    """Each symbol's rows of its last ``bars`` bars: the display window of a result that goes on."""
    last = F.max("bar_index").over(Window.partitionBy("sym"))
    return result.withColumn("_last", last).where(F.col("bar_index") > F.col("_last") - bars).drop("_last")
