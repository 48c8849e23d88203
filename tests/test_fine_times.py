"""Ticks that stand less than a millisecond apart, or from the end of an hour, as 1 GB of events has them."""

import datetime as dt

import duckdb
import pytest

from barloom.plans import catalog

from .test_queries import rows_of

NEW_YEAR = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def fine(spark, tmp_path_factory):
    """Thirty hours of ticks; each has several in its first and in its last millisecond, ids against the times."""
    rows = []
    for h in range(30):
        for us in (100, 400, 700, 1_000_000, 899_999_499, 899_999_500, 899_999_999, 1_800_000_000, 3_599_998_700, 3_599_998_900, 3_599_999_400, 3_599_999_499, 3_599_999_500, 3_599_999_900):
            k = len(rows)
            rows.append((100_000 - k, NEW_YEAR + dt.timedelta(hours=h, microseconds=us), k % 7, "click", float(k * 37 % 101) + 0.25, "{}"))
    path = tmp_path_factory.mktemp("fine")
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


CLOSES = "alma array array_parts balance bb bbw bop cci change cmo cog correlation covariance dema".split()


@pytest.mark.parametrize("name", [*[f"script_{k}" for k in CLOSES], "ta_change", "time_functions"])
def test_fine_times(spark, fine, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{fine}/events.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, fine)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalog.SQL[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())
