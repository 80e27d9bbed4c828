"""What is exploded behind a shuffle is many times what Spark takes it for: it is not to be broadcast."""

from pyspark.sql import functions as F

from duelbook.llm import simhash


def _plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_exploded_cells_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(simhash, "cut", lambda df: (plans.append(_plan(df)), df)[1])
    distinct = spark.range(300).select(F.xxhash64("id").alias("bits")).union(spark.range(8).select((F.lit(1) * F.pow(2, "id")).cast("long").alias("bits")))
    linked = simhash.links(distinct, crowd=0)  # every cell is crowded
    assert {(r.src, r.dst) for r in linked.collect()} >= {(1, 2), (1, 4)}
    plans.append(_plan(linked))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
