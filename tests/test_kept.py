"""State that is moved on by new days against a full pass over the history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duelbook.operators.history import sums_before
from duelbook.plans import features
from duelbook.sources.commits import CommitLog
from duelbook.sources.kept import LastRows

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
SUMS = {"n": "1", "w": "cast(won as int)", "p": "points"}


def history(spark, days, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), rng.randrange(3), DAY(rng.randrange(days)), rng.random() < 0.5, rng.randrange(30)) for i in range(days * 12)]
    rows += [(10_000 + i, 1, 1, DAY(3), True, i) for i in range(40)]  # more on one day than are kept
    return spark.createDataFrame(rows, "game int, side int, arena int, date date, won boolean, points int")


def found(df):
    return sorted(tuple(r) for r in df.select("side", "arena", "date", *SUMS).collect())


def test_updates_by_day_equal_a_full_pass(spark, tmp_path):
    rows, key, n = history(spark, 12), ["side", "arena"], 5
    kept = LastRows(spark, str(tmp_path), key, SUMS, ["game"], n, buckets=4)
    asks = lambda after: spark.createDataFrame([(s, a, DAY(after + d)) for s in range(8) for a in range(4) for d in (1, 30)], "side int, arena int, date date")
    assert all(sum(r[3:]) == 0 for r in found(kept.sums(asks(0))))
    for through in (2, 3, 4, 8, 11):
        day = str(DAY(through))
        assert kept.update(rows, day) and not kept.update(rows, day) and not kept.update(rows, str(DAY(1)))
        past = rows.where(F.col("date") <= F.lit(day).cast("date"))
        assert found(kept.sums(asks(through))) == found(sums_before(past, asks(through), key, SUMS, n, ["game"]))
    assert kept.rows().agg(F.max(F.size("rows"))).first()[0] == n


def test_an_update_reads_new_days_and_touched_buckets_only(spark, tmp_path):
    rows = history(spark, 12)
    kept = LastRows(spark, str(tmp_path), ["side"], SUMS, ["game"], 5, buckets=8)
    kept.update(rows, str(DAY(10)))
    before = kept.state()["folders"]
    late = spark.createDataFrame([(1, 3, 0, DAY(11), True, 1)], rows.schema)
    kept.update(late, str(DAY(11)))  # the history is not handed in again
    after = kept.state()["folders"]
    assert sum(after[b] != before.get(b) for b in after) == 1
    ask = spark.createDataFrame([(3, DAY(12))], "side int, date date")
    whole = rows.where(F.col("date") <= F.lit(str(DAY(10))).cast("date")).unionByName(late)
    assert kept.sums(ask).first() == sums_before(whole, ask, ["side"], SUMS, 5, ["game"]).first()


def test_a_crash_leaves_the_state_as_it_was(spark, tmp_path, monkeypatch):
    rows = history(spark, 12)
    kept = LastRows(spark, str(tmp_path), ["side", "arena"], SUMS, ["game"], 5)
    kept.update(rows, str(DAY(5)))
    ask = spark.createDataFrame([(s, 1, DAY(20)) for s in range(6)], "side int, arena int, date date")
    before = found(kept.sums(ask))
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "commit", lambda *_: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            kept.update(rows, str(DAY(9)))
    assert found(kept.sums(ask)) == before and kept.state()["through"] == str(DAY(5))
    assert kept.update(rows, str(DAY(9)))


def test_parts_that_are_through_different_days_are_an_error(spark, tmp_path):
    card = features.KeptCard(spark, str(tmp_path), [0, 1], [("2030-01-01", [])])
    card._parts()[0].update(history(spark, 3).limit(0).withColumns({x: F.lit(0) for x in ("own_rds", "opp_rds", "own_fks", "opp_fks", "own_acs5", "own_kills", "own_assists", "own_deaths")})
                            .withColumn("game_id", F.lit("g")), "2024-01-01")
    with pytest.raises(RuntimeError):
        card.through()


def test_the_new_days_are_gone_through_once_for_both_parts_of_games(spark, tmp_path, monkeypatch):
    figures = ("rds", "fks", "acs5", "kills", "assists", "deaths")
    rng = random.Random(3)
    rows = [(f"g{i}", rng.randrange(4), 4 + rng.randrange(3), rng.randrange(2), DAY(rng.randrange(9)), rng.random() < 0.5, *[rng.randrange(1, 20) for _ in range(12)]) for i in range(600)]
    games = spark.createDataFrame(rows, "game_id string, a int, b int, arena int, date date, won_a boolean, " + ", ".join(f"{s}_{x} int" for x in figures for s in "ab"))
    series = spark.createDataFrame([], "match_id int, a int, b int, date date, a_ban1 int, a_ban2 int, b_ban1 int, b_ban2 int, a_pick int, b_pick int, remaining int")
    seen, stored = [], features.stored
    monkeypatch.setattr(features, "stored", lambda df, label: (seen.append(stored(df, label)), seen[-1])[1])
    card = features.KeptCard(spark, str(tmp_path), [0, 1], [("2030-01-01", [])], n=5)
    for day in (4, 8):
        card.update(series, games, str(DAY(day)))
    assert len(seen) == 2 and all(s.count() <= 7 * 2 * 5 for s in seen)  # at most n rows of a side and arena
    upcoming = spark.createDataFrame([(1, a, b, DAY(20)) for a in range(4) for b in range(4, 7)], "match_id int, a int, b int, date date")
    kept, whole = card.features(upcoming), features.upcoming_features(upcoming, series, games, [0, 1], [("2030-01-01", [])], 5)
    assert sorted(map(str, kept.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
