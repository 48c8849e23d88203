"""math.*"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, finite

E = 2.718281828459045
PI = 3.141592653589793
PHI = 1.618033988749895
RPHI = 0.618033988749895


def _all_there(values: list[Column], out: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), out)


def abs_(x):
    return F.abs(col(x))


def max_(*xs):
    """Na if any is."""
    values = [col(x) for x in xs]
    return _all_there(values, F.greatest(*values))


def min_(*xs):
    values = [col(x) for x in xs]
    return _all_there(values, F.least(*values))


def avg(*xs):
    values = [col(x) for x in xs]
    return reduce(lambda a, b: a + b, values) / len(values)


def floor(x):
    return F.floor(finite(x))


def ceil(x):
    return F.ceil(finite(x))


def trunc(x):
    v = finite(x)
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def sign(x):
    return F.signum(col(x))


def round_(x, precision: int | None = None):
    """Halves go up; without a precision a whole number."""
    v = finite(x)
    if precision is None:
        return F.floor(v + 0.5)
    return F.floor(v * 10.0**precision + 0.5) / 10.0**precision


def round_to_mintick(x, tick: float):
    return F.floor(finite(x) / tick + 0.5) * tick


def pow_(a, b):
    return finite(F.pow(col(a), col(b)))


def hypot(a, b):
    return finite(F.hypot(col(a), col(b)))


def _unary(f):
    return lambda x: finite(f(col(x)))


sqrt, cbrt, exp = _unary(F.sqrt), _unary(F.cbrt), _unary(F.exp)
log, log10 = _unary(F.ln), _unary(F.log10)
acos, asin, atan = _unary(F.acos), _unary(F.asin), _unary(F.atan)
sin, cos, tan = _unary(F.sin), _unary(F.cos), _unary(F.tan)
todegrees, toradians = _unary(F.degrees), _unary(F.radians)
