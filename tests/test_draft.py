import datetime as dt

from pyspark.sql import functions as F

from duelbook.functions.draft_text import FIELDS, with_draft
from duelbook.operators import draft, pool

D = dt.date
CAL = [("2024-01-10", [6, 8]), ("2024-02-10", [1, 2])]
SERIES = ("match_id long, a int, b int, date date, won_a boolean, a_ban1 int, a_ban2 int, b_ban1 int, b_ban2 int, a_pick int, b_pick int, "
          "remaining int, net_h2h double")


def test_pool_edges(spark):
    days = spark.createDataFrame([(D(2024, 1, 9),), (D(2024, 1, 10),), (D(2024, 2, 9),), (D(2024, 2, 10),)], "date date")
    got = [r.in_pool_6 for r in pool.with_pool_flags(days, CAL, [6]).orderBy("date").collect()]
    assert got == [0, 1, 1, None]
    late = days.filter("date = '2024-02-10'")
    assert [r.arena for r in pool.for_each_arena(late, CAL, [1, 2, 3]).collect()] == [None] and pool.uncovered(days, CAL).count() >= 1


def test_steps_touched_and_rates(spark):
    series = spark.createDataFrame([
        (1, 1, 2, D(2024, 1, 5), True, 0, 1, 2, 3, 4, 5, 7, None),
        (2, 2, 1, D(2024, 1, 20), True, 0, 6, 8, 3, 4, 5, 7, 1.0),
    ], SERIES)
    steps = draft.draft_steps(series.filter("match_id = 1"), list(range(11)), CAL).orderBy("step").collect()
    assert [(s.side_no, s.action, s.arena) for s in steps] == [
        (1, "ban", 0), (2, "ban", 2), (1, "pick", 4), (2, "pick", 5), (1, "ban", 1), (2, "ban", 3), (0, "remaining", 7)]
    assert steps[0].open_arenas == [0, 1, 2, 3, 4, 5, 7, 9, 10]
    assert steps[-1].open_arenas == [7, 9, 10]
    touched = draft.touched_arenas(series.filter("match_id = 1"), list(range(11)), ["match_id"])
    assert {(r.arena, r.played) for r in touched.collect()} == {(0, False), (1, False), (2, False), (3, False), (4, True), (5, True), (7, True)}
    asks = spark.createDataFrame([(1, i, D(2024, 3, 1)) for i in (4, 5, 6, 7)], "side int, arena int, date date")
    got = {r.arena: (r.total, r.pick_rate, r.ban_rate, r.play_rate) for r in draft.draft_rates(series, asks, list(range(11)), CAL).collect()}
    # Side 1 picked 4 in the first series and, listed second, 5 in the other; arena 6 was out in the first.
    assert got == {4: (2, 0.5, 0, 1), 5: (2, 0.5, 0, 1), 6: (1, 0, 0, 0), 7: (2, 0, 0, 1)}


def test_head_to_head_is_order_free_and_strict(spark):
    series = spark.createDataFrame([(1, 1, 2, D(2024, 1, 5), True, 0, 1, 2, 3, 4, 5, 7, None)], SERIES)
    asks = spark.createDataFrame([(2, 1, D(2024, 1, 6), 4), (2, 1, D(2024, 1, 5), 4), (2, 1, D(2024, 1, 6), 0), (3, 1, D(2024, 1, 6), 4)],
                                 "a int, b int, date date, arena int")
    got = sorted((r.a, str(r.date), r.arena, r.h2h_played) for r in draft.head_to_head(asks, series).collect())
    assert got == [(2, "2024-01-05", 4, 0), (2, "2024-01-06", 0, 0), (2, "2024-01-06", 4, 1), (3, "2024-01-06", 4, 0)]


def test_draft_text(spark):
    names = ["Alpha", "Bravo", "Coda", "Dune", "Echo", "Forge", "Grove"]
    good = "ÖRÜ ban Alpha; U1 ban Bravo; ÖRÜ pick Coda; U1 pick Dune; ÖRÜ ban Echo; U1 ban Forge; Grove remains"
    texts = [(1, good, "ÖRÜ"), (2, good, "U1"), (3, good.replace("U1 ban Forge; ", ""), "ÖRÜ"), (4, good.replace("Grove remains", ""), "ÖRÜ"),
             (5, good.replace("U1 ban Forge", "X ban Forge"), "ÖRÜ"), (6, good.replace("Alpha", "Nowhere"), "ÖRÜ"), (7, "", "ÖRÜ"), (8, None, None)]
    df = spark.createDataFrame(texts, "id int, t string, tag string")
    plain = {r.id: tuple(r[f] for f in FIELDS) if r.complete else None for r in with_draft(df, "t", names).collect()}
    assert plain == {1: (0, 4, 1, 5, 2, 3, 6), 2: (0, 4, 1, 5, 2, 3, 6), **{i: None for i in range(3, 9)}}
    tagged = {r.id: tuple(r[f] for f in FIELDS) if r.complete else None for r in with_draft(df, "t", names, "tag").collect()}
    assert tagged[1] == (0, 4, 1, 5, 2, 3, 6) and tagged[2] == (1, 5, 0, 4, 3, 2, 6)


def test_zero_history_rows_go(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.1, 0.0, 0.0)], "avg_win double, avg_pick double, avg_ban double, avg_play double")
    assert draft.has_history(rows).count() == 1
    assert rows.filter(F.col("avg_pick") > 0).count() == 1


def test_a_calendar_table_of_any_length(spark):
    table = spark.createDataFrame([(D.fromisoformat(u), o) for u, o in CAL] + [(None, [1]), (D(2024, 2, 10), [1, 2])], "until_date date, out_arenas array<int>")
    days = spark.createDataFrame([(k, D(2024, 1, 1) + dt.timedelta(days=k % 50)) for k in range(120)] + [(-1, None), (-2, D(1971, 1, 1)), (-3, D(2030, 1, 1))], "k int, date date")
    for name in ("with_pool_flags", "for_each_arena"):
        call = getattr(pool, name)
        assert sorted(map(tuple, call(days, table, [1, 2, 6]).collect()), key=str) == sorted(map(tuple, call(days, CAL, [1, 2, 6]).collect()), key=str)
    assert sorted(r.k for r in pool.uncovered(days, table).collect()) == sorted(r.k for r in pool.uncovered(days, CAL).collect())
    assert pool.with_pool_flags(days.limit(0), table, [1]).isEmpty()
    # a hundred thousand entries: one a day, whose arena is the day's number
    long = spark.range(100_000).select(F.date_add(F.lit("1900-01-02").cast("date"), F.col("id").cast("int")).alias("until_date"), F.array(F.col("id").cast("int")).alias("out_arenas"))
    asked = spark.createDataFrame([(D(1900, 1, 1),), (D(1950, 6, 1),), (D(2024, 2, 29),), (D(2173, 10, 14),), (D(2173, 10, 15),), (D(1899, 1, 1),)], "date date")
    got = {r.date: r._out for r in pool.with_out(asked, long).collect()}
    number = lambda d: (d - D(1900, 1, 1)).days
    assert got == {d: [max(0, number(d))] if number(d) < 100_000 else None for d in got}
    assert len(pool.with_out(asked, long)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_games_of_an_arena_are_dealt_out_when_rates_are_of_all_time(spark):
    from duelbook.operators.players import comp_strength

    games = spark.createDataFrame([(f"g{i}", 1, 2, 0, dt.date(2024, 1, 1), i % 2 == 0, [1, 2], [2, 3]) for i in range(40)],
                                  "game_id string, a int, b int, arena int, date date, won_a boolean, a_agents array<int>, b_agents array<int>")
    found = comp_strength(games, months=None)
    assert {(r.side_no, r.comp_wr) for r in found.collect()} == {(1, 0.5), (2, 0.5)} and found.count() == 80
    assert "_part" in found._jdf.queryExecution().optimizedPlan().toString()
