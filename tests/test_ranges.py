"""Points in ranges, against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from playseq.operators import ranges
from tests.conftest import collected


def test_blocks_cover_a_range_once(spark):
    rng = random.Random(3)
    spans = [(0, 0), (5, 4), (-9, 7), (-8, -1), (0, 2**35)] + [(a, a + rng.choice((0, 3, 40, 999))) for a in (rng.randrange(-500, 500) for _ in range(60))]
    df = spark.createDataFrame([(*s,) for s in spans], "a long, b long")
    for r in df.select("a", "b", ranges.dyadic_blocks(F.col("a"), F.col("b")).alias("blocks")).collect():
        assert sum(2**x.level for x in r.blocks) == max(0, r.b - r.a + 1)
        assert len(r.blocks) <= 2 * max(1, (r.b - r.a + 1).bit_length())
        if r.b - r.a < 2000:
            held = [v for x in r.blocks for v in range(x.block << x.level, (x.block + 1) << x.level)]
            assert sorted(held) == list(range(r.a, r.b + 1))


@pytest.mark.parametrize("most", (10_000, 0))
def test_against_all_pairs(spark, monkeypatch, most):
    """Sent to every task, or dealt by block."""
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    spans = [(i, a, a + rng.choice((-2, 0, 1, 6, 30, 400))) for i, a in enumerate(rng.randrange(-300, 300) for _ in range(200))] + [(900, None, 5), (901, 5, None)]
    points = [(i, rng.randrange(-350, 800)) for i in range(300)] + [(400, None)]
    want = sorted((p, r) for p, x in points if x is not None for r, a, b in spans if a is not None and b is not None and a <= x <= b)
    day = dt.date(2020, 1, 1)
    date = lambda n: None if n is None else day + dt.timedelta(n)
    for make, kind in ((lambda n: n, "int"), (date, "date")):
        left = spark.createDataFrame([(i, make(x)) for i, x in points], f"p int, at {kind}")
        right = spark.createDataFrame([(i, make(a), make(b)) for i, a, b in spans], f"r int, a {kind}, b {kind}")
        found = ranges.in_ranges(left, right, "at", "a", "b")
        assert collected(found, "p", "r") == sorted(want, key=repr)
        assert found.columns == ["p", "at", "r", "a", "b"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.in_ranges(left, right.limit(0), "at", "a", "b").count() == 0
