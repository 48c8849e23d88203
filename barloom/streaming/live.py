"""Live indicators on Structured Streaming.

A symbol's state is what its recurrences were after the last confirmed bar. A forming update runs copies of them on the
bar so far and leaves the state alone, so it can be replaced any number of times; a confirmed one commits. Updates at or
before the last confirmed time are late and rejected: a correction is a batch over the symbol's history from then on.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.recursive import NAN, Ema, Rma

HISTORICAL, FORMING, CONFIRMED = "historical", "forming", "confirmed"


class Rsi:
    def __init__(self, n: int):
        self.up, self.down, self.before = Rma(n), Rma(n), NAN

    def __call__(self, x: float) -> float:
        d, self.before = x - self.before, x
        up, down = (self.up(max(d, 0.0)), self.down(max(-d, 0.0))) if d == d else (NAN, NAN)
        if up != up or down != down:
            return NAN
        return 100.0 if down == 0 else 0.0 if up == 0 else 100 - 100 / (1 + up / down)


class Macd:
    """The line; its signal and histogram follow from it."""

    def __init__(self, fast: int, slow: int):
        self.fast, self.slow = Ema(fast), Ema(slow)

    def __call__(self, x: float) -> float:
        return self.fast(x) - self.slow(x)


class Counter:
    """Bars, and, not rolled back with the bar, updates: the two lives that a script's variable can have."""

    def __init__(self):
        self.bars, self.updates = 0, 0

    def __call__(self, x: float) -> float:
        self.bars += 1
        return float(self.bars)


KINDS: dict[str, Callable] = {"ema": Ema, "rma": Rma, "rsi": Rsi, "macd": Macd, "count": Counter}


def live(updates: DataFrame, calls: list[tuple], source: str = "close") -> DataFrame:
    """One row for each update (sym, time, kind, prices): the results of ``calls`` (name, kind, arguments...), ``op`` that
    says whether the bar is put as a preview, committed or rejected, and ``revision``, the number of the symbol's output."""
    names = [c[0] for c in calls]
    schema = "sym string, time long, kind string, op string, revision long, updates long, " + ", ".join(f"{n} double" for n in names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            confirmed, last, revision, varip = pickle.loads(state.get[0])
        else:
            confirmed, last, revision, varip = [KINDS[k](*a) for _, k, *a in calls], None, 0, 0
        rows = []
        # a batch's updates of a bar come in any order: its time decides, then forming before confirmed
        given = pd.concat(list(frames))
        given["_rank"] = (given["kind"] != FORMING).astype(int)
        for r in given.sort_values(["time", "_rank"], kind="stable").itertuples():
            revision += 1
            if last is not None and r.time <= last:
                rows.append((key[0], r.time, r.kind, "rejected", revision, varip, *[None] * len(names)))
                continue
            varip += 1
            working = copy.deepcopy(confirmed) if r.kind == FORMING else confirmed
            found = [f(getattr(r, source)) for f in working]
            if r.kind != FORMING:
                last = r.time
            rows.append((key[0], r.time, r.kind, "preview" if r.kind == FORMING else "commit", revision, varip, *[None if v != v else v for v in found]))
        state.update((pickle.dumps((confirmed, last, revision, varip)),))
        yield pd.DataFrame(rows, columns=["sym", "time", "kind", "op", "revision", "updates", *names]).astype({n: "float64" for n in names})

    return updates.groupBy("sym").applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def replica(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The state that a log of changes leaves: for each (sym, time) its highest revision, without rejected rows.

    A change that is sent again is the same row and changes nothing; a gap in a symbol's revisions is an error.
    """
    keys = keys or ["sym", "time"]
    once = changes.dropDuplicates(["sym", "revision"])
    whole = once.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("top"))
    gaps = whole.select(F.col("sym").alias("_sym"), F.when(F.col("n") != F.col("top"), F.raise_error(F.concat(F.lit("revisions are missing of "), "sym"))).alias("_gap"))
    columns = [c for c in changes.columns if c not in keys]
    kept = once.join(gaps, F.col("sym") == F.col("_sym")).where("_gap IS NULL AND op <> 'rejected'")
    latest = kept.groupBy(*keys).agg(F.max_by(F.struct(*columns), "revision").alias("_row"))
    return latest.select(*keys, "_row.*")


def corrected(history: DataFrame, suffix: DataFrame) -> DataFrame:
    """Each symbol's ``history`` before its first time in ``suffix``, followed by that; symbols without any stay whole."""
    start = suffix.groupBy(F.col("sym").alias("_sym")).agg(F.min("time").alias("_from"))
    old = history.join(start, F.col("sym") == F.col("_sym"), "left").where("_from IS NULL OR time < _from").drop("_sym", "_from")
    return old.unionByName(suffix)
