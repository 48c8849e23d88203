"""array.*: values, not references; a function that changes an array returns the changed one. Indexes may be negative."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import TOLERANCE, col

#: Most elements (a fixed value of the language).
MOST = 100_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def new(size: int, initial=None, kind: str = "double") -> Column:
    return F.array_repeat(F.lit(initial).cast(kind), size)


def from_(*values) -> Column:
    return F.array(*[col(v) for v in values])


def size(a) -> Column:
    return F.size(col(a))


def _at(a: Column, index) -> Column:
    """The 1-based place of a 0-based or negative index; an error outside."""
    i = col(index)
    place = F.when(i < 0, F.size(a) + i).otherwise(i)
    return F.when((place < 0) | (place >= F.size(a)), F.raise_error(F.lit("array index out of range")).cast("int")).otherwise(place + 1).cast("int")


def get(a, index) -> Column:
    return F.element_at(col(a), _at(col(a), index))


def set_(a, index, value) -> Column:
    at = _at(col(a), index)
    return F.transform(col(a), lambda v, i: F.when(i + 1 == at, col(value)).otherwise(v))


def push(a, value) -> Column:
    return F.array_append(col(a), col(value))


def unshift(a, value) -> Column:
    return F.array_prepend(col(a), col(value))


def insert(a, index: int, value) -> Column:
    """In front of the element at the index; the size is one more place."""
    at = F.lit(index) if index >= 0 else F.size(col(a)) + index
    return F.concat(F.slice(col(a), F.lit(1), at), F.array(col(value)), F.slice(col(a), at + 1, F.greatest(F.size(col(a)), F.lit(1))))


def remove(a, index) -> tuple[Column, Column]:
    """(the element, the rest)."""
    at = _at(col(a), index)
    return F.element_at(col(a), at), F.filter(col(a), lambda v, i: i + 1 != at)


def pop(a) -> tuple[Column, Column]:
    return remove(a, -1)


def shift(a) -> tuple[Column, Column]:
    return remove(a, 0)


def fill(a, value, start: int = 0, end: int | None = None) -> Column:
    stop = F.size(col(a)) if end is None else F.lit(end)
    return F.transform(col(a), lambda v, i: F.when((i >= start) & (i < stop), col(value)).otherwise(v))


def first(a) -> Column:
    return get(a, 0)


def last(a) -> Column:
    return get(a, -1)


def copy(a) -> Column:
    return col(a)


def slice_(a, start: int, end: int) -> Column:
    return F.slice(col(a), start + 1, max(0, end - start))


def concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def _equal(v: Column, x: Column, number: bool) -> Column:
    same = F.abs(v - x) <= TOLERANCE if number else v == x
    return F.coalesce(same, v.isNull() & x.isNull())


def includes(a, value, number: bool = True) -> Column:
    return F.exists(col(a), lambda v: _equal(v, col(value), number))


def every(a) -> Column:
    return F.forall(col(a), lambda v: F.coalesce(v.cast("boolean"), F.lit(False)))


def some(a) -> Column:
    return F.exists(col(a), lambda v: F.coalesce(v.cast("boolean"), F.lit(False)))


def _places(a, value, number: bool) -> Column:
    return F.filter(F.transform(col(a), lambda v, i: F.when(_equal(v, col(value), number), i)), lambda i: i.isNotNull())


def indexof(a, value, number: bool = True) -> Column:
    return F.coalesce(F.array_min(_places(a, value, number)), F.lit(-1))


def lastindexof(a, value, number: bool = True) -> Column:
    return F.coalesce(F.array_max(_places(a, value, number)), F.lit(-1))


def binary_search(a, value) -> Column:
    """In a sorted array; -1 if absent."""
    return indexof(a, value)


def binary_search_leftmost(a, value) -> Column:
    """The first match, else the place of the last smaller one."""
    smaller = F.size(F.filter(col(a), lambda v: v < col(value)))
    return F.when(includes(a, value), smaller).otherwise(smaller - 1)


def binary_search_rightmost(a, value) -> Column:
    """The last match, else the place of the first greater one."""
    up_to = F.size(F.filter(col(a), lambda v: v <= col(value)))
    return F.when(includes(a, value), up_to - 1).otherwise(up_to)


def there(a) -> Column:
    return F.filter(col(a), lambda v: v.isNotNull())


def abs_(a) -> Column:
    return F.transform(col(a), F.abs)


def min_(a, nth: int = 0) -> Column:
    return F.get(F.sort_array(there(a)), F.lit(nth))


def max_(a, nth: int = 0) -> Column:
    return F.get(F.sort_array(there(a), asc=False), F.lit(nth))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def sum_(a) -> Column:
    return let(there(a), lambda x: F.when(F.size(x) > 0, _total(x)))


def avg(a) -> Column:
    return let(there(a), lambda x: F.when(F.size(x) > 0, _total(x) / F.size(x)))


def range_(a) -> Column:
    return F.array_max(there(a)) - F.array_min(there(a))


def percentile_linear_interpolation(a, p: float) -> Column:
    def one(x: Column) -> Column:
        rank = (F.size(x) - 1) * (p / 100)
        low = F.floor(rank).cast("int")
        below, above = F.get(x, low), F.get(x, F.least(low + 1, F.size(x) - 1))
        return F.when(F.size(x) > 0, below + (above - below) * (rank - low))

    return let(F.sort_array(there(a)), one)


def median(a) -> Column:
    return percentile_linear_interpolation(a, 50)


def percentile_nearest_rank(a, p: float) -> Column:
    return let(F.sort_array(there(a)), lambda x: F.get(x, F.greatest(F.ceil(F.size(x) * (p / 100)), F.lit(1)).cast("int") - 1))


def percentrank(a, index) -> Column:
    """Per cent of the values that aren't above the one at the index."""
    return let(F.array(get(a, index)), lambda x: 100.0 * F.size(F.filter(col(a), lambda v: v <= x[0])) / F.size(col(a)))


def mode(a) -> Column:
    """The most frequent value, of equally frequent ones the smallest; na if none repeats."""

    def one(x: Column) -> Column:
        counted = F.transform(F.array_distinct(x), lambda v: F.struct(F.size(F.filter(x, lambda o: o == v)).alias("n"), (-v).alias("v")))
        return let(F.array_max(counted), lambda m: F.when(m["n"] > 1, -m["v"]))

    return let(there(a), one)


def variance(a, biased: bool = True) -> Column:
    def one(x: Column) -> Column:
        n = F.size(x)
        squares = let(_total(x) / n, lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
        return F.when(n > (0 if biased else 1), squares / (n if biased else n - 1))

    return let(there(a), one)


def stdev(a, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def covariance(a, b, biased: bool = True) -> Column:
    def one(p: Column) -> Column:
        n = F.size(p)
        mean = lambda k: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[k]) / n
        total = let(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda m: F.aggregate(p, F.lit(0.0), lambda s, v: s + (v["x"] - m["x"]) * (v["y"] - m["y"])))
        return F.when(n > (0 if biased else 1), total / (n if biased else n - 1))

    pairs = F.filter(F.zip_with(col(a), col(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return let(pairs, one)


def standardize(a) -> Column:
    mean, spread = avg(a), stdev(a)
    return let(F.struct(mean.alias("m"), spread.alias("s")), lambda k: F.transform(col(a), lambda v: F.when(k["s"] != 0, (v - k["m"]) / k["s"]).otherwise(F.when(v.isNotNull(), 1.0))))


def sort(a, ascending: bool = True) -> Column:
    return F.sort_array(col(a), ascending)


def sort_indices(a, ascending: bool = True) -> Column:
    """Stable in either direction."""
    placed = F.transform(col(a), lambda v, i: F.struct((v if ascending else -v).alias("v"), i.alias("i")))
    return F.transform(F.sort_array(placed), lambda s: s["i"])


def reverse(a) -> Column:
    return F.reverse(col(a))


def join(a, separator: str = ",") -> Column:
    return F.array_join(F.transform(col(a), lambda v: v.cast("string")), separator, "NaN")


def clear(a) -> Column:
    return F.slice(col(a), 1, 0)


def checked(a) -> Column:
    return F.when(F.size(col(a)) > MOST, F.raise_error(F.lit(f"arrays have at most {MOST} elements"))).otherwise(col(a))


def rank_place(p: float, n: int) -> int:
    return max(1, math.ceil(p / 100 * n))
