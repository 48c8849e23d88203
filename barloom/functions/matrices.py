"""matrix.*: a struct of rows, cols and the cells, row by row. What linear algebra needs runs in Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays
from .values import col

KIND = "struct<rows:int,cols:int,data:array<double>>"


def make(rows, cols, data: Column) -> Column:
    return F.struct(col(rows).cast("int").alias("rows"), col(cols).cast("int").alias("cols"), data.alias("data"))


def new(rows: int, cols: int, value=None, kind: str = "double") -> Column:
    return make(F.lit(rows), F.lit(cols), F.array_repeat(F.lit(value).cast(kind), rows * cols))


def rows(m) -> Column:
    return col(m)["rows"]


def columns(m) -> Column:
    return col(m)["cols"]


def elements_count(m) -> Column:
    return rows(m) * columns(m)


def _cells(r, c, cell) -> Column:
    """A matrix of r by c whose cells are ``cell(row, column)``."""
    n = (col(r) * col(c)).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return make(r, c, F.transform(places, lambda k: cell(F.floor(k / col(c)).cast("int"), (k % col(c)).cast("int"))))


def at(m, r, c) -> Column:
    return F.get(col(m)["data"], (r * columns(m) + c).cast("int"))


def get(m, r, c) -> Column:
    outside = (col(r) < 0) | (col(c) < 0) | (col(r) >= rows(m)) | (col(c) >= columns(m))
    return F.when(outside, F.raise_error(F.lit("matrix index out of range")).cast("double")).otherwise(at(m, col(r), col(c)))


def set_(m, r, c, value) -> Column:
    return make(rows(m), columns(m), F.transform(col(m)["data"], lambda v, i: F.when(i == col(r) * columns(m) + col(c), col(value)).otherwise(v)))


def fill(m, value, from_row: int = 0, to_row: int | None = None, from_col: int = 0, to_col: int | None = None) -> Column:
    last_r = rows(m) if to_row is None else F.lit(to_row)
    last_c = columns(m) if to_col is None else F.lit(to_col)
    return _cells(rows(m), columns(m), lambda i, j: F.when((i >= from_row) & (i < last_r) & (j >= from_col) & (j < last_c), col(value)).otherwise(at(m, i, j)))


def copy(m) -> Column:
    return col(m)


def concat(a, b) -> Column:
    return make(rows(a) + rows(b), columns(a), F.concat(col(a)["data"], col(b)["data"]))


def transpose(m) -> Column:
    return _cells(columns(m), rows(m), lambda i, j: at(m, j, i))


def reverse(m) -> Column:
    return make(rows(m), columns(m), F.reverse(col(m)["data"]))


def reshape(m, r: int, c: int) -> Column:
    return make(F.when(elements_count(m) == r * c, F.lit(r)).otherwise(F.raise_error(F.lit("a reshape keeps the number of cells")).cast("int")), F.lit(c), col(m)["data"])


def row(m, r) -> Column:
    return F.slice(col(m)["data"], (col(r) * columns(m) + 1).cast("int"), columns(m))


def col_(m, c) -> Column:
    return F.filter(col(m)["data"], lambda v, i: i % columns(m) == col(c))


def add_row(m, r: int, array) -> Column:
    cut = (F.lit(r) * columns(m)).cast("int")
    data = col(m)["data"]
    return make(rows(m) + 1, columns(m), F.concat(F.slice(data, F.lit(1), cut), col(array), F.slice(data, cut + 1, F.greatest(F.size(data), F.lit(1)))))


def add_col(m, c: int, array) -> Column:
    return _cells(rows(m), columns(m) + 1, lambda i, j: F.when(j == c, F.get(col(array), i)).otherwise(at(m, i, F.when(j > c, j - 1).otherwise(j))))


def remove_row(m, r: int) -> tuple[Column, Column]:
    """(the row, the rest)."""
    return row(m, F.lit(r)), make(rows(m) - 1, columns(m), F.filter(col(m)["data"], lambda v, i: F.floor(i / columns(m)) != r))


def remove_col(m, c: int) -> tuple[Column, Column]:
    return col_(m, F.lit(c)), make(rows(m), columns(m) - 1, F.filter(col(m)["data"], lambda v, i: i % columns(m) != c))


def _swapped(k: Column, a: int, b: int) -> Column:
    return F.when(k == a, b).when(k == b, a).otherwise(k)


def swap_rows(m, a: int, b: int) -> Column:
    return _cells(rows(m), columns(m), lambda i, j: at(m, _swapped(i, a, b), j))


def swap_columns(m, a: int, b: int) -> Column:
    return _cells(rows(m), columns(m), lambda i, j: at(m, i, _swapped(j, a, b)))


def sort(m, column: int = 0, ascending: bool = True) -> Column:
    """Rows by a column; rows with equal cells there keep their order."""
    key = col_(m, F.lit(column))
    order = arrays.sort_indices(key, ascending)
    return arrays.let(order, lambda o: make(rows(m), columns(m), F.flatten(F.transform(o, lambda i: row(m, i)))))


def submatrix(m, from_row: int = 0, to_row: int | None = None, from_col: int = 0, to_col: int | None = None) -> Column:
    r = (rows(m) if to_row is None else F.lit(to_row)) - from_row
    c = (columns(m) if to_col is None else F.lit(to_col)) - from_col
    return _cells(r, c, lambda i, j: at(m, i + from_row, j + from_col))


def sum_(a, b) -> Column:
    """Of two matrices, or of a matrix and a number."""
    return _elementwise(a, b, lambda x, y: x + y)


def diff(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def _elementwise(a, b, f) -> Column:
    if isinstance(b, int | float):
        return make(rows(a), columns(a), F.transform(col(a)["data"], lambda v: f(v, F.lit(float(b)))))
    if isinstance(a, int | float):
        return make(rows(b), columns(b), F.transform(col(b)["data"], lambda v: f(F.lit(float(a)), v)))
    return make(rows(a), columns(a), F.zip_with(col(a)["data"], col(b)["data"], f))


def _inner(k: Column) -> Column:
    return F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))


def mult(a, b) -> Column:
    """A matrix with a matrix or a number."""
    if isinstance(b, int | float):
        return _elementwise(a, b, lambda x, y: x * y)
    return _cells(rows(a), columns(b), lambda i, j: F.aggregate(_inner(columns(a)), F.lit(0.0), lambda s, k: s + at(a, i, k) * at(b, k, j)))


def mult_array(a, v) -> Column:
    """A matrix with an array, as an array."""
    return F.transform(_inner(rows(a)), lambda i: F.aggregate(_inner(columns(a)), F.lit(0.0), lambda s, k: s + at(a, i, k) * F.get(col(v), k)))


def kron(a, b) -> Column:
    part = lambda x, n: F.floor(x / n).cast("int")
    return _cells(rows(a) * rows(b), columns(a) * columns(b), lambda i, j: at(a, part(i, rows(b)), part(j, columns(b))) * at(b, i % rows(b), j % columns(b)))


def trace(m) -> Column:
    return F.aggregate(_inner(rows(m)), F.lit(0.0), lambda s, i: s + at(m, i, i))


def avg(m) -> Column:
    return arrays.avg(col(m)["data"])


def min_(m) -> Column:
    return arrays.min_(col(m)["data"])


def max_(m) -> Column:
    return arrays.max_(col(m)["data"])


def median(m) -> Column:
    return arrays.median(col(m)["data"])


def mode(m) -> Column:
    return arrays.mode(col(m)["data"])


def is_square(m) -> Column:
    return rows(m) == columns(m)


def _all(m, test) -> Column:
    """Every cell passes ``test(value, row, column)``."""
    checked = F.transform(col(m)["data"], lambda v, i: test(v, F.floor(i / columns(m)).cast("int"), (i % columns(m)).cast("int")))
    return F.coalesce(F.forall(checked, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def is_binary(m) -> Column:
    return _all(m, lambda v, i, j: (v == 0) | (v == 1))


def is_zero(m) -> Column:
    return _all(m, lambda v, i, j: v == 0)


def is_diagonal(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: (i == j) | (v == 0))


def is_antidiagonal(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: (i + j == columns(m) - 1) | (v == 0))


def is_triangular(m) -> Column:
    return is_square(m) & (_all(m, lambda v, i, j: (i <= j) | (v == 0)) | _all(m, lambda v, i, j: (i >= j) | (v == 0)))


def is_identity(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: v == F.when(i == j, 1.0).otherwise(0.0))


def is_symmetric(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: v == at(m, j, i))


def is_antisymmetric(m) -> Column:
    return is_square(m) & _all(m, lambda v, i, j: v == -at(m, j, i))


def is_stochastic(m) -> Column:
    """No negative cell, and all rows or all columns sum to one; an empty matrix is not."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    by_row = F.forall(_inner(rows(m)), lambda i: total(row(m, i)) == 1)
    by_col = F.forall(_inner(columns(m)), lambda j: total(col_(m, j)) == 1)
    return (elements_count(m) > 0) & _all(m, lambda v, i, j: v >= 0) & (by_row | by_col)


def _numpy(name: str, f, out: str):
    @F.pandas_udf(out)
    def run(frame: pd.DataFrame) -> pd.Series:
        found = []
        for r, c, data in zip(frame["rows"], frame["cols"], frame["data"], strict=True):
            x = np.array([np.nan if v is None else v for v in data], float).reshape(int(r), int(c))
            found.append(None if np.isnan(x).any() else f(x))
        return pd.Series(found, dtype=object) if out == "array<double>" else pd.Series(found, dtype=float)

    run.__name__ = name
    return run


def _square(x: np.ndarray) -> np.ndarray:
    if x.shape[0] != x.shape[1]:
        raise ValueError("the matrix is not square")
    return x


def det(m) -> Column:
    return _numpy("det", lambda x: float(np.linalg.det(_square(x))) if x.size else 1.0, "double")(col(m))


def rank(m) -> Column:
    return _numpy("rank", lambda x: float(np.linalg.matrix_rank(x)), "double")(col(m)).cast("long")


def inv(m) -> Column:
    """Na for a singular matrix."""

    def one(x: np.ndarray):
        try:
            return np.linalg.inv(_square(x)).ravel().tolist()
        except np.linalg.LinAlgError:
            return None

    return _as_matrix(m, _numpy("inv", one, "array<double>")(col(m)), rows(m), columns(m))


def pinv(m) -> Column:
    return _as_matrix(m, _numpy("pinv", lambda x: np.linalg.pinv(x).ravel().tolist(), "array<double>")(col(m)), columns(m), rows(m))


def pow_(m, n: int) -> Column:
    return _as_matrix(m, _numpy("pow", lambda x: np.linalg.matrix_power(_square(x), n).ravel().tolist(), "array<double>")(col(m)), rows(m), columns(m))


def _as_matrix(m, data: Column, r: Column, c: Column) -> Column:
    return F.when(data.isNotNull(), make(r, c, data))


def eigenvalues(m) -> Column:
    """Descending; na if any is not real."""

    def one(x: np.ndarray):
        w = np.linalg.eigvals(_square(x))
        return None if np.abs(w.imag).max(initial=0) > 1e-9 else sorted(w.real.tolist(), reverse=True)

    return _numpy("eigenvalues", one, "array<double>")(col(m))


def eigenvectors(m) -> Column:
    """Unit columns in the order of the eigenvalues; the first cell that isn't 0 is positive."""

    def one(x: np.ndarray):
        w, v = np.linalg.eig(_square(x))
        if np.abs(w.imag).max(initial=0) > 1e-9:
            return None
        v = v.real[:, np.argsort(-w.real, kind="stable")]
        for k in range(v.shape[1]):
            big = np.flatnonzero(np.abs(v[:, k]) > 1e-12)
            if len(big) and v[big[0], k] < 0:
                v[:, k] *= -1
        return v.ravel().tolist()

    return _as_matrix(m, _numpy("eigenvectors", one, "array<double>")(col(m)), rows(m), columns(m))
