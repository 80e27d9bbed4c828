import datetime as dt
import random

from pyspark.sql import functions as F

from duelbook.functions import prices, text
from duelbook.operators import ledger, ratings

DAY = dt.date(2024, 1, 1)
PRED = "match_id long, a long, b long, date date, won_a boolean, pred double, odds double, best_odds double, worst_odds double"


def bets_of(spark, rows):
    return spark.createDataFrame([(i, 1, 2, DAY + dt.timedelta(days=d), *rest) for i, (d, *rest) in enumerate(rows)], PRED)


def test_decisions_at_the_edges(spark):
    df = bets_of(spark, [
        (0, True, 0.6, 0.6, 0.6, 0.6),    # equal: none
        (0, True, 0.9, 0.1, 0.1, 0.1),    # at 0.1: not on a
        (0, True, 0.2, 0.9, 0.9, 0.9),    # at 0.9: not on b
        (0, True, 0.6, 0.5, 0.5, 0.5),    # on a, wins 50
        (0, False, 0.3, None, None, None),
        (0, True, 0.3, 0.4, 0.4, 0.4),    # on b, loses
    ])
    got = ledger.average_bets(df).orderBy("match_id").collect()
    assert [(r.match_id, r.backed, r.correct, float(r.profit), r.underdog) for r in got] == [(3, "a", True, 50.0, False), (5, "b", False, -50.0, False)]


def test_no_bets_give_a_null_summary(spark):
    row = ledger.summary(ledger.average_bets(bets_of(spark, [(0, True, 0.5, 0.5, 0.5, 0.5)]))).first()
    assert row.bets == 0 and row.accuracy is None and row.ev is None and row.underdog is None and row.end_bankroll is None


def test_running_sum_with_blocks_inside_a_day(spark):
    rnd = random.Random(5)
    # Two thirds of all rows fall on one day, which several blocks share.
    rows = [(i * 7 % 1009, DAY + dt.timedelta(days=0 if rnd.random() < 0.66 else rnd.randrange(1, 6)), rnd.randrange(-50, 90)) for i in range(600)]
    df = spark.createDataFrame(rows, "match_id long, date date, v int").withColumn("v", F.col("v").cast("decimal(38,10)"))
    total, want = 0, {}
    for i, d, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        want[i] = total
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.match_id: int(r.run) for r in ledger.running_sum(df, "v", "run").collect()} == want
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hit_rate_counts_a_half_as_wrong(spark):
    df = bets_of(spark, [(0, True, 0.5, None, None, None), (0, False, 0.4, None, None, None), (0, True, 0.7, None, None, None), (0, False, 0.5, None, None, None)])
    assert ledger.hit_rate(df).first().hit_rate == 0.5


def test_prices(spark):
    rows = [(True, [150.0, 200.0, 0.0], 2 / 3, 0.5), (False, [150.0, 200.0, 0.0], 0.5, 1 - 1 / 1.5), (True, [], 0.0, 1.0), (True, [100.0], 0.0, 1.0)]
    df = spark.createDataFrame([(w, p) for w, p, *_ in rows], "w boolean, p array<double>")
    probs = prices.side_one_probabilities(F.col("p"), F.col("w"))
    got = df.select(prices.best_probability(probs).alias("b"), prices.worst_probability(probs).alias("l")).collect()
    for r, (_, _, best, worst) in zip(got, rows):
        assert abs(r.b - best) < 1e-12 and abs(r.l - worst) < 1e-12
    line = spark.createDataFrame([(0.6, 0.4), (0.6, 1.0), (0.0, 0.4), (0.0, 1.0), (1.2, -0.1)], "b double, l double")
    assert [r[0] for r in line.select(prices.line_probability(F.col("b"), F.col("l"))).collect()] == [0.5, 0.6, 0.4, None, None]
    assert spark.range(1).select(prices.best_decimal(F.array(F.lit(0.5)))).first()[0] == 1.0


def test_texts(spark):
    one = spark.range(1)

    def value(col):
        return one.select(col).first()[0]

    assert value(text.alternating_net(F.array(*[F.lit(x) for x in ("3", "1", "x", "9")]))) == 2
    assert value(text.alternating_net(F.array(*[F.lit(str(x)) for x in range(12)]))) == -5
    assert value(text.alternating_net(F.lit(None).cast("array<string>"))) is None
    assert value(text.leading_int(F.lit(" 12 (3)"))) == 12 and value(text.leading_int(F.lit("-"))) == 0
    assert value(text.slash_date(F.lit("2021/03/30"))) == dt.date(2021, 3, 30)
    assert value(text.stamp_date(F.lit("2024-06-22 17:00:00"))) == dt.date(2024, 6, 22)
    assert value(text.team_slug(F.lit("/team/17/side-x"))) == "side-x" and value(text.team_id(F.lit("/team/17/gen-g"))) == 17
    assert value(text.number_or_zero(F.lit("n/a"))) == 0.0


def test_period_elo_is_zero_sum(spark):
    rows = [(m, m % 4, (m + 1 + m % 3) % 4, m % 3 == 0, m // 10) for m in range(40) if m % 4 != (m + 1 + m % 3) % 4]
    df = spark.createDataFrame(rows, "match_id long, a int, b int, won_a boolean, period int")
    last = ratings.ratings_by_period(df).groupBy("side").agg(F.max_by("after", "period").alias("r"))
    sides = last.count()
    assert abs(last.agg(F.sum("r")).first()[0] - 1500 * sides) < 1e-6
