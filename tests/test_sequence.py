"""The sliced verbs give what the plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from playseq.operators.sequence import SLICE, Ordered
from tests.conftest import collected

SEQ = Ordered(("game_id",), ("ord",))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    rows = [(g, o, rng.choice([None, *range(-5, 6)])) for g, n in ((1, 57), (2, 1), (3, 23), (None, 9)) for o in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "game_id int, ord int, v int")


def verbs(df, seq):
    df = seq.shift(df, back=(F.col("v"), 1), back3=(F.col("v"), 3, -99), ahead=(F.col("v"), -1), ahead2=(F.col("v"), -2, 99))
    df = seq.running(df, total=("sum", F.col("v")), before=("max", F.col("v"), False), low=("min", F.col("v")))
    df = seq.running(df, backwards=True, rest=("sum", F.col("v"), False), last=("max", F.struct("ord", "v")))
    return seq.number(seq.total(df, top=("max", F.col("v")), all=("sum", F.lit(1))), "n")


@pytest.mark.parametrize("rows", [1, 2, 5, 30])
def test_slices_give_the_same(numbers, rows):
    plain = verbs(numbers, SEQ)
    cut, seq = SEQ.slice(numbers, rows)
    assert cut.select(SLICE).distinct().count() > 1
    assert collected(verbs(cut, seq).drop(SLICE)) == collected(plain)


def test_slices_keep_the_order(numbers):
    cut, _ = SEQ.slice(numbers, 10)
    spans = cut.groupBy("game_id", SLICE).agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count("*").alias("n"))
    rows = sorted(spans.collect(), key=lambda r: (r.game_id or 0, r[SLICE]))
    for one, two in zip(rows, rows[1:]):
        if one.game_id == two.game_id:
            assert one.b < two.a
    assert max(r.n for r in rows) <= 30


def test_over_splits_only_hot_keys(spark, numbers):
    spark.conf.set("spark.playseq.hotRows", "20")
    try:
        modes = []

        def operator(df, seq):
            modes.append(seq.sliced)
            return verbs(df, seq)

        assert collected(SEQ.over(numbers, operator)) == collected(verbs(numbers, SEQ))
        assert modes == [False, True]
    finally:
        spark.conf.unset("spark.playseq.hotRows")


def test_chain_needs_one_exchange(numbers):
    plan = verbs(numbers, SEQ)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
