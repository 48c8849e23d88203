"""All queries over the bar engine, and the equivalent SQL."""

from barloom.plans import indicators, scalars, scripts, strategies

FLAGSHIP = "ta_sma"
QUERIES = {**indicators.QUERIES, **scalars.QUERIES, **strategies.QUERIES, **scripts.QUERIES}
SQL = {**indicators.SQL, **scalars.SQL, **strategies.SQL, **scripts.SQL}
