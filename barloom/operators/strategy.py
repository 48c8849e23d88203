"""A simulated broker, one pass per symbol over its bars.

A strategy is a Python function of the bar's context, called once a bar after the bar's fills; it reads the ledger and
places orders, so signals and broker share one pass. What can be computed without the ledger should be columns of the
bars beforehand: the function reads them by name. Symbols run in parallel; one symbol's bars are one task.

Order of a bar: market orders at the open; the inferred path (open, the nearer extreme, the other, close) with limits,
stops and exits in the order that it meets them; the function; orders on close if asked; risk rules; the equity row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

LONG, SHORT = 1, -1


@dataclass(frozen=True)
class Settings:
    initial_capital: float = 1_000_000.0
    qty_type: str = "fixed"  # fixed, cash, percent_of_equity
    qty: float = 1.0
    pyramiding: int = 1
    commission_type: str = "percent"  # percent, cash_per_contract, cash_per_order
    commission: float = 0.0
    slippage: int = 0
    mintick: float = 0.01
    point_value: float = 1.0
    process_on_close: bool = False
    any_close: bool = False  # else first in, first out
    margin_long: float = 0.0
    margin_short: float = 0.0


@dataclass
class Order:
    id: str
    side: int
    qty: float
    limit: float | None = None
    stop: float | None = None
    oca: str | None = None
    oca_type: str = "none"
    kind: str = "entry"  # entry, order, close, exit
    entry: str | None = None  # the entry that an exit belongs to
    trail: tuple[float, float] | None = None  # (activation price, offset)
    comment: str | None = None
    seq: int = 0
    best: float | None = None  # the best price since a trail was activated
    active: bool = False


@dataclass
class Trade:
    id: str
    side: int
    size: float
    price: float
    bar: int
    time: int
    fee: float
    comment: str | None = None
    runup: float = 0.0
    drawdown: float = 0.0


@dataclass
class Closed:
    entry_id: str
    exit_id: str
    side: int
    size: float
    entry_price: float
    exit_price: float
    entry_bar: int
    exit_bar: int
    entry_time: int
    exit_time: int
    profit: float
    commission: float
    runup: float
    drawdown: float
    entry_comment: str | None = None
    exit_comment: str | None = None
    entry_fee: float = 0.0


@dataclass
class Risk:
    max_drawdown: tuple[float, str] | None = None
    max_intraday_loss: tuple[float, str] | None = None
    max_intraday_filled_orders: int | None = None
    max_cons_loss_days: int | None = None
    max_position_size: float | None = None
    allow: int = 0  # 0 both, else one side
    halted: bool = False
    halted_day: int | None = None
    day: int | None = None
    day_equity: float = 0.0
    day_fills: int = 0
    loss_days: int = 0


@dataclass
class Broker:
    """The ledger and what a strategy may ask it."""

    s: Settings
    orders: list[Order] = field(default_factory=list)
    open: list[Trade] = field(default_factory=list)
    closed: list[Closed] = field(default_factory=list)
    fills: list[tuple] = field(default_factory=list)
    risk: Risk = field(default_factory=Risk)
    bar: dict = field(default_factory=dict)
    mark: float = math.nan
    seq: int = 0
    peak: float = 0.0
    trough: float = 0.0
    max_drawdown: float = 0.0
    max_runup: float = 0.0
    max_drawdown_percent: float = 0.0
    max_runup_percent: float = 0.0
    max_contracts_held_long: float = 0.0
    max_contracts_held_short: float = 0.0

    # what is held

    @property
    def position_size(self) -> float:
        return sum(t.side * t.size for t in self.open)

    @property
    def position_avg_price(self) -> float:
        size = sum(t.size for t in self.open)
        return sum(t.size * t.price for t in self.open) / size if size else math.nan

    @property
    def position_entry_name(self) -> str:
        return self.open[0].id if self.open else ""

    @property
    def openprofit(self) -> float:
        return sum(t.side * t.size * (self.mark - t.price) * self.s.point_value for t in self.open)

    @property
    def netprofit(self) -> float:
        """Of closed trades, less the fees that open ones have paid."""
        return sum(c.profit for c in self.closed) - sum(t.fee for t in self.open)

    @property
    def initial_capital(self) -> float:
        return self.s.initial_capital

    def _percent(self, amount: float) -> float:
        return 100 * amount / self.s.initial_capital if self.s.initial_capital > 0 else 0.0

    @property
    def openprofit_percent(self) -> float:
        held = self.s.initial_capital + self.netprofit
        return 100 * self.openprofit / held if held > 0 else math.nan

    @property
    def netprofit_percent(self) -> float:
        return self._percent(self.netprofit)

    @property
    def grossprofit_percent(self) -> float:
        return self._percent(self.grossprofit)

    @property
    def grossloss_percent(self) -> float:
        return self._percent(self.grossloss)

    def capital_of(self, trade) -> float:
        """What a trade's entry took: its price and fee."""
        price, fee = (trade.entry_price, getattr(trade, "entry_fee", 0.0)) if hasattr(trade, "entry_price") else (trade.price, trade.fee)
        return price * trade.size * self.s.point_value + fee

    def trade_amount(self, trade, what: str) -> float:
        if what == "profit":
            return trade.profit if hasattr(trade, "profit") else trade.side * trade.size * (self.mark - trade.price) * self.s.point_value
        return trade.runup if what == "max_runup" else trade.drawdown

    @staticmethod
    def _mean(values: list) -> float:
        return sum(values) / len(values) if values else math.nan

    @property
    def avg_trade(self) -> float:
        return self._mean([c.profit for c in self.closed])

    @property
    def avg_winning_trade(self) -> float:
        return self._mean([c.profit for c in self.closed if c.profit > 0])

    @property
    def avg_losing_trade(self) -> float:
        return self._mean([-c.profit for c in self.closed if c.profit < 0])

    def _shares(self) -> list[float]:
        return [100 * c.profit / self.capital_of(c) for c in self.closed]

    @property
    def avg_trade_percent(self) -> float:
        return self._mean(self._shares())

    @property
    def avg_winning_trade_percent(self) -> float:
        return self._mean([p for p in self._shares() if p > 0])

    @property
    def avg_losing_trade_percent(self) -> float:
        return self._mean([-p for p in self._shares() if p < 0])

    @property
    def max_contracts_held_all(self) -> float:
        return max(self.max_contracts_held_long, self.max_contracts_held_short)

    @property
    def closedtrades_first_index(self) -> int:
        return 0

    @property
    def opentrades_capital_held(self) -> float:
        if not (self.s.margin_long or self.s.margin_short):
            return math.nan
        size = self.position_size
        return abs(size) * self.mark * self.s.point_value * (self.s.margin_long if size > 0 else self.s.margin_short) / 100

    @property
    def grossprofit(self) -> float:
        return sum(c.profit for c in self.closed if c.profit > 0)

    @property
    def grossloss(self) -> float:
        return -sum(c.profit for c in self.closed if c.profit < 0)

    @property
    def equity(self) -> float:
        return self.s.initial_capital + self.netprofit + self.openprofit

    @property
    def closedtrades(self) -> int:
        return len(self.closed)

    @property
    def opentrades(self) -> int:
        return len(self.open)

    @property
    def wintrades(self) -> int:
        return sum(c.profit > 0 for c in self.closed)

    @property
    def losstrades(self) -> int:
        return sum(c.profit < 0 for c in self.closed)

    @property
    def eventrades(self) -> int:
        return sum(c.profit == 0 for c in self.closed)

    def margin_liquidation_price(self) -> float:
        size = self.position_size
        rate = (self.s.margin_long if size > 0 else self.s.margin_short) / 100
        if not size or not rate:
            return math.nan
        # equity at p equals the margin at p
        side, n, cash = math.copysign(1, size), abs(size) * self.s.point_value, self.s.initial_capital + self.netprofit
        below = n * (rate - side)
        return (cash - side * n * self.position_avg_price) / below if below else math.nan

    # orders

    def default_qty(self, price: float) -> float:
        if self.s.qty_type == "fixed":
            return self.s.qty
        money = self.s.qty if self.s.qty_type == "cash" else self.equity * self.s.qty / 100
        return money / (price * self.s.point_value) if price > 0 else 0.0

    def _place(self, order: Order) -> None:
        if self.risk.halted or self.risk.halted_day == self._day() and order.kind in ("entry", "order"):
            return
        self.seq += 1
        order.seq = self.seq
        self.orders = [o for o in self.orders if not (o.id == order.id and o.kind == order.kind and o.entry == order.entry)]
        self.orders.append(order)

    def entry(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, oca: str | None = None, oca_type: str = "none", comment: str | None = None) -> None:
        if self.risk.allow and side != self.risk.allow:
            self.close_all()
            return
        self._place(Order(id, side, math.nan if qty is None else qty, limit, stop, oca, oca_type, "entry", comment=comment))

    def order(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, oca: str | None = None, oca_type: str = "none", comment: str | None = None) -> None:
        self._place(Order(id, side, math.nan if qty is None else qty, limit, stop, oca, oca_type, "order", comment=comment))

    def close(self, id: str, qty: float | None = None, qty_percent: float | None = None, comment: str | None = None, immediately: bool = False) -> None:
        mine = [t for t in self.open if t.id == id]
        total = sum(t.size for t in mine)
        if total:
            size = qty if qty is not None else total * (100 if qty_percent is None else qty_percent) / 100
            order = Order(f"Close entry(s) order {id}", -mine[0].side, min(size, total), kind="close", entry=id, comment=comment)
            self._fill(order, self.bar["close"]) if immediately else self._place(order)

    def close_all(self, comment: str | None = None, immediately: bool = False) -> None:
        size = self.position_size
        if size:
            order = Order("Close position order", -1 if size > 0 else 1, abs(size), kind="close", comment=comment)
            self._fill(order, self.bar["close"]) if immediately else self._place(order)

    def cancel(self, id: str) -> None:
        self.orders = [o for o in self.orders if o.id != id]

    def cancel_all(self) -> None:
        self.orders = []

    def exit(self, id: str, from_entry: str | None = None, stop: float | None = None, limit: float | None = None, profit: float | None = None, loss: float | None = None, trail_price: float | None = None, trail_points: float | None = None, trail_offset: float | None = None, qty: float | None = None, qty_percent: float | None = None, comment: str | None = None) -> None:
        """Orders that leave a position; the distances are in ticks from the entry. Without any leg nothing is placed."""
        names = [from_entry] if from_entry is not None else list(dict.fromkeys(t.id for t in self.open))
        for name in names:
            mine = [t for t in self.open if t.id == name]
            total = sum(t.size for t in mine)
            if not total:
                continue
            side, price, tick = mine[0].side, sum(t.size * t.price for t in mine) / total, self.s.mintick
            down = stop if stop is not None else None if loss is None else price - side * loss * tick
            up = limit if limit is not None else None if profit is None else price + side * profit * tick
            start = trail_price if trail_price is not None else None if trail_points is None else price + side * trail_points * tick
            trail = (start, (trail_offset or 0) * tick) if start is not None else None
            if down is None and up is None and trail is None:
                continue
            size = qty if qty is not None else total * (100 if qty_percent is None else qty_percent) / 100
            old = next((o for o in self.orders if o.id == id and o.kind == "exit" and o.entry == name), None)
            order = Order(id, -side, min(size, total), up, down, kind="exit", entry=name, trail=trail, comment=comment)
            if old is not None and old.trail == trail:
                order.best, order.active = old.best, old.active
            self._place(order)

    # fills

    def _day(self) -> int:
        return self.bar["time"] // 86_400_000

    def _fee(self, size: float, price: float) -> float:
        if self.s.commission_type == "percent":
            return size * price * self.s.point_value * self.s.commission / 100
        return self.s.commission * (size if self.s.commission_type == "cash_per_contract" else 1)

    def _fill(self, order: Order, price: float, slips: bool = True) -> bool:
        """Fill a whole order at a price; false if it does nothing."""
        if price <= 0 or not math.isfinite(price):
            return False
        if slips:
            price += order.side * self.s.slippage * self.s.mintick
        self.mark = price
        qty = self.default_qty(price) if math.isnan(order.qty) else order.qty
        position = self.position_size
        if order.kind in ("close", "exit"):
            qty = min(qty, sum(t.size for t in self.open if order.entry in (None, t.id) and t.side == -order.side))
        elif order.kind == "entry":
            if position * order.side > 0:
                if len(self.open) >= self.s.pyramiding:
                    return False
            else:
                qty += abs(position)  # an opposite entry first closes
        if self.risk.max_position_size is not None and order.kind in ("entry", "order"):
            qty = min(qty, max(0.0, self.risk.max_position_size - position * order.side))
        if order.kind in ("entry", "order") and position * order.side >= 0:
            margin = (self.s.margin_long if order.side > 0 else self.s.margin_short) / 100
            if margin and (abs(position) + qty) * price * self.s.point_value * margin > self.equity:
                return False
        if not qty > 0 or not math.isfinite(qty):
            return False
        fee = self._fee(qty, price)
        left = qty
        pool = [t for t in self.open if t.side == -order.side and (order.entry is None or t.id == order.entry)] if order.kind in ("close", "exit") and self.s.any_close else [t for t in self.open if t.side == -order.side]
        for t in list(pool):
            if left <= 1e-12:
                break
            n = min(left, t.size)
            share, exit_fee = n / t.size, fee * n / qty
            profit = t.side * n * (price - t.price) * self.s.point_value - t.fee * share - exit_fee
            self.closed.append(Closed(t.id, order.id, t.side, n, t.price, price, t.bar, self.bar["bar_index"], t.time, self.bar["time"], profit, t.fee * share + exit_fee, t.runup * share, t.drawdown * share, t.comment, order.comment, t.fee * share))
            t.fee, t.runup, t.drawdown, t.size = t.fee * (1 - share), t.runup * (1 - share), t.drawdown * (1 - share), t.size - n
            left -= n
            if t.size <= 1e-12:
                self.open.remove(t)
        if left > 1e-12 and order.kind in ("entry", "order"):
            self.open.append(Trade(order.id, order.side, left, price, self.bar["bar_index"], self.bar["time"], fee * left / qty, order.comment))
        self.fills.append((order.id, order.side, qty, price, self.bar["bar_index"], self.bar["time"], order.kind))
        self.risk.day_fills += 1
        self.max_contracts_held_long, self.max_contracts_held_short = max(self.max_contracts_held_long, self.position_size), max(self.max_contracts_held_short, -self.position_size)
        if order.oca is not None and order.oca_type != "none":
            for o in list(self.orders):
                if o is not order and o.oca == order.oca and o.oca_type == order.oca_type:
                    if order.oca_type == "cancel" or o.qty - qty <= 1e-12:
                        self.orders.remove(o)
                    else:
                        o.qty -= qty
        names = {t.id for t in self.open}
        self.orders = [o for o in self.orders if o.kind != "exit" or o.entry in names]
        return True

    def _touch(self, price: float) -> None:
        self.mark = price
        for t in self.open:
            gain = t.side * t.size * (price - t.price) * self.s.point_value
            t.runup, t.drawdown = max(t.runup, gain), max(t.drawdown, -gain)

    @staticmethod
    def _meets(order: Order, a: float, b: float) -> float | None:
        """The price between a and b at which an order fills, if any; a is met first."""
        low, high, found = min(a, b), max(a, b), []
        limit, stop = order.limit, order.stop
        if order.trail is not None and order.active and order.best is not None:
            trailing = order.best + order.side * order.trail[1]
            stop = trailing if stop is None else max(stop, trailing) if order.side < 0 else min(stop, trailing)
        if order.kind in ("entry", "order") and limit is not None and stop is not None and not order.active:
            return None  # a stop-limit order waits for its stop
        if limit is not None:
            good = (lambda p: p <= limit) if order.side > 0 else (lambda p: p >= limit)
            found += [a] if good(a) else [limit] if low <= limit <= high else []
        if stop is not None and not (order.kind in ("entry", "order") and limit is not None):
            hit = (lambda p: p >= stop) if order.side > 0 else (lambda p: p <= stop)
            found += [a] if hit(a) else [stop] if low <= stop <= high else []
        return min(found, key=lambda p: abs(p - a)) if found else None

    def _wake(self, a: float, b: float) -> None:
        """Activate stop-limit orders and trails that the path from a to b reaches, and move the trails along."""
        for o in self.orders:
            if o.kind in ("entry", "order") and o.limit is not None and o.stop is not None and not o.active:
                o.active = max(a, b) >= o.stop if o.side > 0 else min(a, b) <= o.stop
            if o.trail is not None:
                far = max(a, b) if o.side < 0 else min(a, b)
                if not o.active and (far >= o.trail[0] if o.side < 0 else far <= o.trail[0]):
                    o.active = True
                if o.active:
                    o.best = far if o.best is None else max(o.best, far) if o.side < 0 else min(o.best, far)

    def _walk(self, a: float, b: float) -> None:
        for _ in range(10_000):
            met = [(abs(p - a), o.seq, o, p) for o in self.orders if (o.limit is not None or o.stop is not None or o.trail is not None) and (p := self._meets(o, a, b)) is not None]
            if not met:
                break
            _, _, order, price = min(met, key=lambda x: x[:2])
            self._touch(price)
            self.orders.remove(order)
            self._fill(order, price, slips=order.limit is None or price != order.limit)
            a = price
        self._wake(a, b)
        self._touch(b)

    def _market(self, price: float) -> None:
        for order in sorted((o for o in self.orders if o.limit is None and o.stop is None and o.trail is None), key=lambda o: (o.kind not in ("close",), o.seq)):
            if order in self.orders:
                self.orders.remove(order)
                self._fill(order, price)

    def _check_risk(self) -> None:
        r = self.risk
        self.peak, self.trough = max(self.peak, self.equity), min(self.trough, self.equity)
        self.max_drawdown, self.max_runup = max(self.max_drawdown, self.peak - self.equity), max(self.max_runup, self.equity - self.trough)
        if self.peak > 0:
            self.max_drawdown_percent = max(self.max_drawdown_percent, 100 * (self.peak - self.equity) / self.peak)
        if self.trough > 0:
            self.max_runup_percent = max(self.max_runup_percent, 100 * (self.equity - self.trough) / self.trough)
        limit = lambda rule, base: rule[0] if rule[1] == "cash" else base * rule[0] / 100
        stop = r.max_drawdown is not None and self.max_drawdown >= limit(r.max_drawdown, self.peak)
        stop = stop or r.max_cons_loss_days is not None and r.loss_days >= r.max_cons_loss_days
        today = r.max_intraday_loss is not None and r.day_equity - self.equity >= limit(r.max_intraday_loss, r.day_equity)
        today = today or r.max_intraday_filled_orders is not None and r.day_fills >= r.max_intraday_filled_orders
        if stop or today:
            self.orders = []
            self.close_all("risk", immediately=True)
            r.halted, r.halted_day = r.halted or stop, self._day()

    def _margin_call(self) -> None:
        size = self.position_size
        rate = (self.s.margin_long if size > 0 else self.s.margin_short) / 100
        need = abs(size) * self.mark * self.s.point_value * rate
        if size and rate and need > self.equity:
            # four times what would cover the gap, as brokers do
            n = min(abs(size), 4 * (need - self.equity) / (self.mark * self.s.point_value * rate))
            self._fill(Order("Margin call", -1 if size > 0 else 1, n, kind="close", comment="margin"), self.mark, slips=False)

    def step(self, bar: dict, script: Callable) -> None:
        self.bar = bar
        if self.risk.day != self._day():
            if self.risk.day is not None:
                self.risk.loss_days = self.risk.loss_days + 1 if self.equity < self.risk.day_equity else 0
            self.risk.day, self.risk.day_fills = self._day(), 0
            self.mark = bar["open"]
            self.risk.day_equity = self.equity
        o, h, lo, c = (bar[k] for k in ("open", "high", "low", "close"))
        if not self.peak:
            self.peak = self.trough = self.s.initial_capital
        self._touch(o)
        self._market(o)
        path = (o, h, lo, c) if abs(h - o) < abs(o - lo) else (o, lo, h, c)
        for a, b in zip(path[:-1], path[1:], strict=True):
            self._walk(a, b)
            self._margin_call()
        script(bar, self)
        if self.s.process_on_close:
            self._market(c)
        self._touch(c)
        self._check_risk()


_SCHEMA = pa.schema([
    ("sym", pa.string()), ("row", pa.string()), ("number", pa.int64()), ("bar_index", pa.int64()), ("time", pa.int64()), ("entry_id", pa.string()), ("exit_id", pa.string()), ("side", pa.int64()), ("size", pa.float64()),
    ("entry_price", pa.float64()), ("exit_price", pa.float64()), ("entry_bar", pa.int64()), ("exit_bar", pa.int64()), ("profit", pa.float64()), ("commission", pa.float64()), ("runup", pa.float64()), ("drawdown", pa.float64()), ("position", pa.float64()), ("equity", pa.float64()), ("openprofit", pa.float64()),
    ("entry_comment", pa.string()), ("exit_comment", pa.string()),
])
SCHEMA = "sym string, row string, number long, bar_index long, time long, entry_id string, exit_id string, side long, size double, entry_price double, exit_price double, entry_bar long, exit_bar long, profit double, commission double, runup double, drawdown double, position double, equity double, openprofit double, entry_comment string, exit_comment string"


def backtest(bars: DataFrame, script: Callable[[dict, Broker], None], settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Rows of ``script`` run over every symbol: closed trades, open trades, fills and a bar's equity, told apart by ``row``."""

    def one(table: pa.Table) -> pa.Table:
        broker, out = Broker(settings), []
        rows = table.sort_by("bar_index").to_pylist()
        for bar in rows:
            broker.step(bar, script)
            out.append({"row": "equity", "number": bar["bar_index"], "bar_index": bar["bar_index"], "time": bar["time"], "position": broker.position_size, "equity": broker.equity, "openprofit": broker.openprofit, "profit": broker.netprofit})
        for k, c in enumerate(broker.closed):
            out.append({"row": "trade", "number": k, "bar_index": c.exit_bar, "time": c.exit_time, **{n: getattr(c, n) for n in ("entry_id", "exit_id", "side", "size", "entry_price", "exit_price", "entry_bar", "exit_bar", "profit", "commission", "runup", "drawdown", "entry_comment", "exit_comment")}})
        for k, t in enumerate(broker.open):
            out.append({"row": "open", "number": k, "bar_index": t.bar, "time": t.time, "entry_id": t.id, "side": t.side, "size": t.size, "entry_price": t.price, "entry_bar": t.bar, "profit": t.side * t.size * (broker.mark - t.price) * settings.point_value, "commission": t.fee, "runup": t.runup, "drawdown": t.drawdown, "entry_comment": t.comment})
        for k, (i, side, qty, price, bar, time, _) in enumerate(broker.fills):
            out.append({"row": "fill", "number": k, "bar_index": bar, "time": time, "entry_id": i, "side": side, "size": qty, "entry_price": price})
        return pa.Table.from_pylist([{"sym": rows[0]["sym"], **x} for x in out], schema=_SCHEMA)

    return bars.groupBy("sym").applyInArrow(one, SCHEMA)
