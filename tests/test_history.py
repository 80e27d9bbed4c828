"""Edge cases of "last n strictly before the day", against a plain Python restatement."""

import datetime as dt
import random

from pyspark.sql import functions as F

from duelbook.operators import form, history
from duelbook.operators.sides import side_rows

GAME = "game_id string, a int, b int, arena int, date date, won_a boolean, " + ", ".join(
    f"{s}_{x} long" for x in ("rds", "fks", "acs5", "kills", "assists", "deaths") for s in "ab"
)


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def game(i, a, b, arena, when, won=True, rds=(13, 7), fks=(6, 5), deaths=(10, 12)):
    return (f"g{i:04d}", a, b, arena, day(when), won, *rds, *fks, 1000 + i, 900 + i, 20 + i, 15, 5, 4, *deaths)


def table(spark, rows):
    return spark.createDataFrame(rows, GAME)


def random_games(spark, count=160, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        a, b = rnd.sample(range(1, 5), 2)
        rows.append(game(i, a, b, rnd.randrange(3), rnd.randrange(25), rnd.random() < 0.5, (rnd.randrange(14), 7)))
    return table(spark, rows), rows


def plain_wins(rows, side, arena, when, n):
    past = sorted((r[4], r[0], r[5] if r[1] == side else not r[5]) for r in rows if side in r[1:3] and r[3] == arena and r[4] < when)
    kept = past[-n:] if n else past
    return len(kept), sum(w for _, _, w in kept)


def test_win_rate_matches_plain_python(spark):
    games, rows = random_games(spark)
    for n in (0, 1, 3, 20):
        own = {(r.side, r.arena, r.date): (r.games, r.wins) for r in form.arena_win_rate(games, n=n).collect()}
        assert own == {k: plain_wins(rows, *k, n) for k in own}
        asks = form.with_arenas(spark.createDataFrame([(s, day(d)) for s in range(1, 7) for d in (0, 5, 13, 40)], "side int, date date"), [0, 1, 2, 3])
        asked = {(r.side, r.arena, r.date): (r.games, r.wins) for r in form.arena_win_rate(games, asks, n=n).collect()}
        assert len(asked) == 6 * 4 * 4
        assert asked == {k: plain_wins(rows, *k, n) for k in asked}


def test_many_games_on_one_day_keep_the_last_n(spark):
    rows = [game(i, 1, 2, 0, 0, won=i >= 25) for i in range(30)] + [game(99, 1, 2, 0, 1)]
    state = form.arena_win_rate(table(spark, rows), n=20).filter((F.col("side") == 1) & (F.col("date") == day(1))).first()
    assert (state.games, state.wins) == (20, 5)


def test_exactly_n_and_one_more(spark):
    for count in (19, 20, 21):
        rows = [game(i, 1, 2, 0, i, won=i == 0) for i in range(count)] + [game(50, 1, 2, 0, 60)]
        last = form.arena_win_rate(table(spark, rows), n=20).filter((F.col("side") == 1) & (F.col("date") == day(60))).first()
        assert last.games == min(count, 20)
        assert last.wins == (1 if count <= 20 else 0)


def test_listed_perspective_counts_the_first_side(spark):
    rows = [game(0, 1, 2, 0, 0, True), game(1, 2, 1, 0, 1, True), game(2, 1, 2, 0, 5)]
    pick = (F.col("side") == 1) & (F.col("date") == day(5))
    assert form.arena_win_rate(table(spark, rows)).filter(pick).first().win_rate == 0.5
    assert form.arena_win_rate(table(spark, rows), perspective="listed").filter(pick).first().win_rate == 1.0


def test_arena_fallback_and_zero_guards(spark):
    rows = [
        game(0, 1, 2, 0, 0), game(1, 1, 2, 1, 3),            # arena 1 is new: form comes from arena 0
        game(2, 3, 4, 0, 0, fks=(0, 0)), game(3, 3, 4, 0, 3),  # no first kills: all 0
        game(4, 5, 6, 0, 0, deaths=(0, 9)), game(5, 5, 6, 0, 3),  # no deaths: ratio 0, the rest kept
    ]
    got = {(r.side, r.arena, r.date): r for r in form.arena_form(table(spark, rows)).collect()}
    assert got[(1, 1, day(3))].round_wr == 13 / 20
    assert got[(1, 0, day(0))].round_wr == 0
    assert got[(3, 0, day(3))].acs == 0 and got[(3, 0, day(3))].kills == 0
    five = got[(5, 0, day(3))]
    assert five.kdr == 0 and five.kills == 24 / 20 and five.acs == 1004 / 5


def test_trailing_months_are_open_at_both_ends(spark):
    rows = [game(0, 1, 2, 0, 0), game(1, 1, 2, 0, 1), game(2, 1, 2, 0, 91)]  # 2024-01-01, 01-02, 04-01
    asks = spark.createDataFrame([(1, 0, dt.date(2024, 4, 1)), (1, 0, dt.date(2024, 4, 2)), (1, 5, dt.date(2024, 4, 1))], "side int, arena int, date date")
    got = {(r.arena, r.date.isoformat()): r.games for r in form.trailing_win_rate(table(spark, rows), asks).collect()}
    assert got == {(0, "2024-04-01"): 1, (0, "2024-04-02"): 1, (5, "2024-04-01"): 0}


def test_raw_rows_are_cut_before_the_shuffle(spark):
    games, _ = random_games(spark)
    sides = side_rows(games, keep=["arena", "date", "game_id"])
    plan = history.last_of_day(sides, ["side", "arena"], 20, ["game_id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("Final") < physical.index("Exchange hashpartitioning") < physical.index("Partial")


def test_repeated_contests_keep_their_own_figures(spark):
    games, _ = random_games(spark)
    state = form.arena_form(games)
    listed = games.unionByName(games.filter("arena = 1")).unionByName(games.filter("arena = 1")).withColumn("notes", F.create_map(F.lit("k"), F.col("game_id")))
    carried = ["game_id", "a", "b", "date", "arena", "notes"]
    once = {r.game_id: r for r in form.form_difference(games, state, ["game_id", "a", "b", "date", "arena"]).collect()}
    found = form.form_difference(listed, state, carried).collect()
    assert sorted(r.game_id for r in found) == sorted(r.game_id for r in listed.collect())
    assert all(r.notes == {"k": r.game_id} and all(r[f"{v}_diff"] == once[r.game_id][f"{v}_diff"] for v in form.FORM) for r in found)


def plain_form(rows, side, arena, when, n):
    past = sorted((r for r in rows if side in r[1:3] and r[4] < when), key=lambda r: (r[4], r[0]))
    kept = ([r for r in past if r[3] == arena] or past)[-n:]
    own = [(r[6], r[6] + r[7]) if r[1] == side else (r[7], r[6] + r[7]) for r in kept]
    return sum(x for x, _ in own) / sum(x for _, x in own) if kept and sum(x for _, x in own) else 0.0


def test_first_day_on_an_arena_falls_back_to_any_arena(spark):
    games, rows = random_games(spark, 120, 9)
    # an arena first played late, twice on one day, by sides with history elsewhere and by one without
    rows += [game(900, 1, 2, 7, 30), game(901, 1, 3, 7, 30), game(902, 1, 2, 7, 31), game(903, 8, 9, 7, 31)]
    for n in (1, 4, 20):
        found = {(r.side, r.arena, r.date): r.round_wr for r in form.arena_form(table(spark, rows), n=n).collect()}
        assert found.keys() == {(s, r[3], r[4]) for r in rows for s in r[1:3]}
        assert all(abs(v - plain_form(rows, *k, n)) < 1e-12 for k, v in found.items())


def test_both_sides_are_looked_up_by_one_join(spark):
    from pyspark.sql import functions as F

    from duelbook.operators.history import side_totals
    contests = spark.createDataFrame([(1, 1, 2, 5), (1, 1, 2, 5), (2, None, 2, 5), (3, 1, 9, 5), (4, 2, 1, None)], "id int, a int, b int, date int")
    state = spark.createDataFrame([(1, 5, 0.5), (2, 5, 2.0), (None, 5, 7.0), (1, None, 7.0)], "side int, date int, x double")
    got = side_totals(contests, state, {"x": "x_diff"}, ["id", "a", "b", "date"], weights=(1.0, -1.0))
    assert sorted((r.id, r.x_diff) for r in got.collect()) == [(1, -1.5), (1, -1.5), (2, -2.0), (3, 0.5), (4, 0.0)]
    # a second state of the same keys finds the contests where they lie
    twice = side_totals(got, state.withColumn("y", F.col("x")), {"y": "y_sum"}, got.columns, weights=(1.0, 1.0))
    assert twice._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
