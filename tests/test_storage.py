"""Joins with tables too large to broadcast."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from playseq.operators import alerts, scoring, storage
from playseq.operators.sequence import GAME
from playseq.plans import pipeline
from playseq.plans.catalog import on_feed
from tests.conftest import SF, collected


@pytest.mark.parametrize("limit", [0, 1000])
def test_filter_and_lookup(spark, monkeypatch, limit):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", limit)
    df = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 10).alias("k"), "id")
    df = df.withColumn("k", F.when(F.col("id") % 50 != 0, F.col("k")))
    small = spark.createDataFrame([(7, "x"), (3, "y"), (11, "z")], "k bigint, name string")
    kept = storage.filter_by_keys(df, small, ["k"])
    left = storage.filter_by_keys(df, small, ["k"], keep=False)
    assert kept.columns == left.columns == df.columns
    assert kept.count() == df.where("k in (3, 7)").count()
    assert kept.count() + left.count() == 300
    named = storage.lookup(df, small, ["k"])
    assert collected(named, "id", "name") == collected(df.join(small, "k", "left"), "id", "name")


def test_shared_folder_is_the_configured_one(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_games_are_not_copied_through_the_driver(spark):
    """Tables with a row per game are merged even when they look small enough to be copied."""
    games = spark.range(50).selectExpr("cast(id as string) as game_id", "'x' as name")
    issues = games.where("game_id < 30").select("game_id")
    counts = games.select("game_id", F.lit(2).alias("play_count"))
    clean = alerts.clean_game_alerts(games, issues, counts)
    scores = games.selectExpr("game_id", "1 as ord", "3 as home_score", "7 as away_score")
    final = scoring.final_score(games, scores)
    assert clean.count() == 20 and final.where("actual_home = 3 and actual_away = 7").count() == 50
    for df in (clean, final):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keys_of_many_games_are_not_copied_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", 10)
    games = spark.range(50).selectExpr("cast(id as string) as game_id")
    left = storage.filter_by_keys(games, games.where("game_id < 30"), ["game_id"], keep=False)
    assert left.count() == 20
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_other_columns_pass_windows_as_one(spark):
    """Packed twice and back, values and nulls stay; and the optimizer does not take the columns apart below a window."""
    df = spark.sql("select id g, id % 3 k, if(id % 2 = 0, 'x', null) a, struct(id b) c, array(id) d from range(9)")
    slim = storage.packed(storage.packed(df, ["g", "k"]), ["g"])
    assert slim.columns == ["g", storage.REST] and storage.packed(df, df.columns).columns == df.columns
    back = storage.unpacked(slim.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("g"))))
    assert collected(back, *df.columns) == collected(df, *df.columns)
    plan = back.select("a", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert f"AS {storage.REST}#" in plan.split("Window")[1]


def test_clock_repair_sorts_few_columns(spark):
    """The rows of a game pass the clock repair with what it needs and one column more."""
    plays = on_feed(spark, SF, lambda df, seq: df.withColumn("extra", F.lit("x")))
    entries = pipeline.entries_from_plays(plays, GAME, "extra")
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert f"{storage.REST}#" in plan and entries.where("extra = 'x'").count() == entries.count() > 0
