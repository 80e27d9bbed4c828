"""Rows before a cut are gone through once and their shuffles deleted; only what later steps read is kept."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelbook.operators import draft, form
from duelbook.plans import fixtures as fx
from duelbook.plans import models
from duelbook.session import cut, discard, shared_dir, stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables of the contest fixtures."""
    at = str(tmp_path_factory.mktemp("tables"))
    n = F.col("id")
    spark.range(25).select(n.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), n).alias("n_name"), (n % 5).cast("int").alias("n_regionkey")).write.parquet(f"{at}/nation.parquet")
    spark.range(20).select(n.alias("s_suppkey"), (n % 5).cast("int").alias("s_nationkey")).write.parquet(f"{at}/supplier.parquet")
    spark.range(40).select(n.alias("c_custkey"), (n % 7).cast("int").alias("c_nationkey")).write.parquet(f"{at}/customer.parquet")
    spark.range(600).select(n.alias("o_orderkey"), (n % 40).alias("o_custkey"), F.date_add(F.lit("1996-01-01").cast("date"), (n % 90).cast("int")).alias("o_orderdate")).write.parquet(f"{at}/orders.parquet")
    spark.range(3000).select((n % 600).alias("l_orderkey"), (1 + n % 7).cast("int").alias("l_linenumber"), (n * 7 % 50).alias("l_partkey"), (n * 11 % 20).alias("l_suppkey"),
                             (1 + n * 13 % 50).cast("double").alias("l_quantity")).write.parquet(f"{at}/lineitem.parquet")
    return at


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*", recursive=True)}


@pytest.mark.parametrize("write", [cut, lambda df: stored(df, "test")])
def test_written_results_leave_no_shuffles(spark, write):
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before = shuffle_files(spark)
    kept = write(rows)
    assert not shuffle_files(spark) - before
    assert sorted(kept.collect()) == sorted(rows.collect())  # the query itself can be read again


def test_form_reads_games_once(spark, folder):
    """The state comes from the cut rows, not from the games again."""
    games = fx.games(spark, folder)
    for state in (form.arena_form(games), form.arena_form(games, form.asks_of(games, "arena").localCheckpoint())):
        assert not any(folder in f for f in state.inputFiles())


def test_repeated_contests_are_read_once(spark, folder):
    found = entry.queries()["form_repeated"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    games = fx.games(spark, folder)
    assert found.count() == games.count() + games.where("arena % 3 = 0").count()


def test_wide_sums_are_all_asked_for(spark):
    asked = " ".join(str(c) for c in form.wide_figures().values())
    assert all(name in asked for name in form.WIDE_SUMS)


def test_draft_features_read_games_once(spark, folder):
    found = entry.queries()["feature_tables_draft"](spark, folder)
    assert not any("lineitem" in f for f in found.inputFiles())


def test_rates_and_form_are_those_of_each(spark, folder):
    games, asks = fx.games(spark, folder), form.asks_of(fx.games(spark, folder), "arena")
    asks = asks.union(asks.withColumn("date", F.date_add("date", 1))).distinct().localCheckpoint()
    for n in (2, 20, 0):
        win, state = form.rates_and_form(games, asks, n)
        order = ["side", "arena", "date"]
        assert win.orderBy(order).select(*order, "games", "wins", "win_rate").collect() == form.arena_win_rate(games, asks, n).orderBy(order).select(*order, "games", "wins", "win_rate").collect()
        assert state.orderBy(order).collect() == form.arena_form(games, asks, n).orderBy(order).collect()


def test_discarded_tables_are_gone(spark):
    table, plain = stored(spark.range(3).toDF("x"), "test"), spark.range(3)
    path = table.inputFiles()[0].removeprefix("file://")
    discard(table, plain)
    assert not glob.glob(path) and plain.count() == 3


@pytest.mark.parametrize("name, label", [("gbt_series_winner", "choices"), ("gbt_planted", "planted"), ("train_backtest", "game-rows"), ("upcoming_card", "choices")])
def test_learned_tables_are_not_kept(spark, folder, monkeypatch, name, label):
    """What models were learned from goes before the result is read."""
    trees = models.classifier
    monkeypatch.setattr(models, "classifier", lambda names, label="label", **params: trees(names, label, **(params | {"maxIter": 1})))
    at = f"{shared_dir(spark).removeprefix('file://')}/duelbook"
    before = set(glob.glob(f"{at}/{label}-*"))
    entry.queries()[name](spark, folder).collect()
    assert not set(glob.glob(f"{at}/{label}-*")) - before


def test_stored_rates_are_not_broadcast(spark, folder):
    """The rows of both sides are one for each ask, many times what their compressed files say."""
    games, series = fx.games(spark, folder), fx.series(spark, folder)
    asks = stored(draft.draft_asks(series, fx.ARENAS), "asks")
    win, _ = form.rates_and_form(games, asks)
    plan = draft.with_mean_rates(draft.touched_arenas(series, fx.ARENAS, ["match_id", "a", "b", "date"]), win, draft.draft_rates(series, asks, fx.ARENAS, fx.CALENDAR))
    joins = [line for line in plan._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "arena" in line and "side" in line]
    assert joins and not any("Broadcast" in line for line in joins)
