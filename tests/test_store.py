"""Committed appends: crashes, replays, conflicts, and how little is read."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.sources.commits import CommitConflict
from duelbook.sources.store import KeyedStore

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("day", T.DateType())])
ORDER = ["v"]


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, None) for k, v in pairs], SCHEMA).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")))


def held(store):
    return sorted(((r.k, r.v) for r in store.read().collect()), key=str)


def test_append_keeps_the_first_of_each_key_and_replays(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), ["k"], SCHEMA, buckets=4, dated="day")
    assert held(store) == [] and store.newest() is None and store.set_aside(SCHEMA).isEmpty()
    assert store.append("one", rows(spark, (1, "b"), (1, "a"), (2, "x")), ORDER)
    assert not store.append("one", rows(spark, (9, "again")), ORDER)
    assert store.append("two", rows(spark, (2, "y"), (3, "z"), (None, "none")), ORDER, aside=rows(spark, (7, "bad")))
    assert held(store) == sorted([(1, "a"), (2, "x"), (3, "z"), (None, "none")], key=str)
    assert store.newest() == "2024-01-04" and [r.k for r in store.set_aside(SCHEMA).collect()] == [7]
    assert store.append("three", rows(spark), ORDER) and len(store.commits()) == 3 and len(held(store)) == 4


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path), ["k"], SCHEMA, buckets=4)
    store.append("one", rows(spark, (1, "a")), ORDER)

    def lost(self, entry):
        raise OSError("the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(KeyedStore, "_commit", lost)
        with pytest.raises(OSError):
            store.append("two", rows(spark, (2, "staged")), ORDER, aside=rows(spark, (3, "bad")))
    assert held(store) == [(1, "a")] and store.set_aside(SCHEMA).isEmpty() and len(store.commits()) == 1
    assert store.suspected(rows(spark, (2, "q"))).isEmpty()
    assert store.append("two", rows(spark, (2, "second try")), ORDER) and held(store) == [(1, "a"), (2, "second try")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store, other = (KeyedStore(spark, str(tmp_path), ["k"], SCHEMA, buckets=4) for _ in range(2))
    store.append("one", rows(spark, (1, "a")), ORDER)
    stage = KeyedStore._stage

    def slow(self, *args):
        if self is other:
            store.append("mine", rows(spark, (2, "mine")), ORDER)
        return stage(self, *args)

    monkeypatch.setattr(KeyedStore, "_stage", slow)
    with pytest.raises(CommitConflict):
        other.append("theirs", rows(spark, (2, "theirs")), ORDER)
    assert held(store) == [(1, "a"), (2, "mine")]


def test_only_buckets_that_may_hold_a_key_are_read(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path), ["k"], SCHEMA, buckets=32, pages=1)
    store.append("one", spark.range(3000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(None).cast("date").alias("day")), ORDER)
    seen = []
    read = KeyedStore.read
    monkeypatch.setattr(KeyedStore, "read", lambda self, buckets=None: (seen.append(buckets), read(self, buckets))[1])
    fresh = store.absent(rows(spark, *[(k, "new") for k in (17, 90, 5000, 5001, 5002)]))
    assert sorted(r.k for r in fresh.collect()) == [5000, 5001, 5002]
    own = {r.bucket for r in store.suspected(rows(spark, (17, ""), (90, ""))).collect()}
    assert len(seen) == 1 and own <= set(seen[0]) and len(seen[0]) <= 3  # of 32 buckets
    assert {r.k for r in store.suspected(rows(spark, *[(k, "") for k in range(0, 3000, 7)])).collect()} == set(range(0, 3000, 7))
    wrong = store.suspected(spark.range(10_000, 14_000).select(F.col("id").alias("k"))).count()
    assert wrong < 200
    assert store.absent(rows(spark, (9000, "n"))).count() == 1 and len(seen) <= 2
