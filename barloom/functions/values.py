"""Missing values, comparisons, logic, arithmetic and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers no further apart than this compare as equal (a fixed value of the language).
TOLERANCE = 1e-10


def col(x: Column | str | float | bool | None) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x: Column | str) -> Column:
    """Null where a number is not finite."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def na(x: Column | str) -> Column:
    return col(x).isNull() | F.coalesce(F.isnan(col(x).cast("double")), F.lit(False))


def nz(x: Column | str, replacement: Column | float = 0.0) -> Column:
    return F.when(na(x), col(replacement)).otherwise(col(x))


def _compared(test: Column, version: int) -> Column:
    """From version 6 on a comparison with na is false, before it is na."""
    return F.coalesce(test, F.lit(False)) if version >= 6 else test


def eq(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return _compared(F.abs(col(a) - col(b)) <= TOLERANCE, version)


def ne(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return _compared(F.abs(col(a) - col(b)) > TOLERANCE, version)


def gt(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return _compared(col(a) - col(b) > TOLERANCE, version)


def ge(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return _compared(col(a) - col(b) >= -TOLERANCE, version)


def lt(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return gt(b, a, version)


def le(a: Column | str, b: Column | str, version: int = 6) -> Column:
    return ge(b, a, version)


def same_text(a: Column | str, b: Column | str) -> Column:
    """Texts are equal with na as the empty one."""
    return F.coalesce(col(a), F.lit("")) == F.coalesce(col(b), F.lit(""))


def _true(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(False))


def and_(a: Column | str, b: Column | str) -> Column:
    return _true(a) & _true(b)


def or_(a: Column | str, b: Column | str) -> Column:
    return _true(a) | _true(b)


def not_(a: Column | str) -> Column:
    return ~_true(a)


def iff(test: Column | str, a: Column, b: Column) -> Column:
    """An na test takes the second branch."""
    return F.when(_true(test), a).otherwise(b)


def switch(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(None) if default is None else default
    for test, value in reversed(cases):
        out = iff(test, value, out)
    return out


def add(a: Column | str, b: Column | str) -> Column:
    """Whole numbers that overflow become floats."""
    return F.coalesce(F.try_add(col(a), col(b)).cast("double"), col(a).cast("double") + col(b).cast("double"))


def div(a: Column | str, b: Column | str) -> Column:
    """Always a float; by zero na."""
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def mod(a: Column | str, b: Column | str) -> Column:
    """The sign follows the dividend; by zero na."""
    return F.when(col(b) != 0, col(a) % col(b))


def int_(x: Column | str) -> Column:
    return F.when(col(x) < 0, F.ceil(col(x))).otherwise(F.floor(col(x))).cast("long")


def float_(x: Column | str) -> Column:
    return col(x).cast("double")


def bool_(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("double") != 0, F.lit(False))


def string_(x: Column | str) -> Column:
    return col(x).cast("string")


def handle(x: Column | None = None) -> Column:
    """A typed na of a drawing's handle, or the handle itself."""
    return F.lit(None).cast("long") if x is None else x.cast("long")


def error(message: Column | str) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))
