"""map.*, as arrays of (k, v) entries, which keep the order of insertion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

#: Most entries (a fixed value of the language).
MOST = 50_000


def new(key: str = "string", value: str = "double") -> Column:
    return F.array().cast(f"array<struct<k:{key},v:{value}>>")


def from_map(m) -> Column:
    return F.transform(F.map_entries(col(m)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def put(m, key, value) -> Column:
    """A key that is there keeps its place."""
    entry = F.struct(col(key).alias("k"), col(value).alias("v"))
    changed = F.transform(col(m), lambda e: F.when(e["k"] == col(key), entry).otherwise(e))
    return F.when(contains(m, key), changed).otherwise(F.when(F.size(col(m)) >= MOST, F.raise_error(F.lit(f"maps have at most {MOST} entries"))).otherwise(F.array_append(col(m), entry)))


def get(m, key) -> Column:
    return F.get(F.filter(col(m), lambda e: e["k"] == col(key)), F.lit(0))["v"]


def contains(m, key) -> Column:
    return F.exists(col(m), lambda e: e["k"] == col(key))


def remove(m, key) -> tuple[Column, Column]:
    """(the value or na, the rest)."""
    return get(m, key), F.filter(col(m), lambda e: e["k"] != col(key))


def clear(m) -> Column:
    return F.slice(col(m), 1, 0)


def copy(m) -> Column:
    return col(m)


def put_all(m, other) -> Column:
    """Keys of both take the other's values, new ones follow in the other's order."""
    theirs = lambda k: F.filter(col(other), lambda o: o["k"] == k)
    kept = F.transform(col(m), lambda e: F.coalesce(F.get(theirs(e["k"]), F.lit(0)), e))
    return F.concat(kept, F.filter(col(other), lambda o: ~F.exists(col(m), lambda e: e["k"] == o["k"])))


def size(m) -> Column:
    return F.size(col(m))


def keys(m) -> Column:
    return F.transform(col(m), lambda e: e["k"])


def values(m) -> Column:
    return F.transform(col(m), lambda e: e["v"])
