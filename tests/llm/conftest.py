import random

import pytest

_WORDS = "the of and to in zebra quartz lumen Über éclair niño tension river stone cloud amber violet meadow copper lantern".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows():
    """(doc_id, text, source): nulls, empties, blanks, one very long text, copies, near copies, repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    return [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "b"), (5, "", None), (6, " \t\n\x0b ", "a"), (7, "one", "c"), (8, "One", "a"),
        (9, prose(2, 30_000), "a"), (10, prose(3, 60), "a"), (10, prose(3, 60), "a"), (None, prose(4, 80), "b"), (None, None, None), (13, "The THE the " * 40, "a"),
        (14, "a b c", "b"), (15, "x\nx\nx\ny", "a"), (16, prose(5, 55) + " ### $$$ " * 20, "a"), (17, "naïve café Ünïcode 漢字 🙂 " * 20, "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def clashing(edge):
    """The same rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_words", "_row", "_text", "words", "n_words", "n_symbols", "slot", "place", "node", "label", "_id", "_at", "part", "batch", "blob", "held", "n", "ids", "prefix", "_h", "_size", "value", "count", "_later", "n_chars", "failed_rule"]
    return edge.select("*", *[F.lit("other").alias(c) for c in names])
