"""Pick/ban drafts: unpivot, ordered steps, pick/ban/play rates, head-to-head flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.numbers import ratio
from duelbook.operators.form import arena_win_rate
from duelbook.operators.history import Measures, asks_of, last_of_day, side_totals, sums_before
from duelbook.operators.pool import Calendar, with_pool
from duelbook.operators.sides import pair_key, side_rows

PLAYED = ["a_pick", "b_pick", "remaining"]
BANNED = ["a_ban1", "a_ban2", "b_ban1", "b_ban2"]
# Fixed value: order of the draft, as (column, acting side, action); side 0 acts for the leftover arena.
STEPS = [
    ("a_ban1", 1, "ban"), ("b_ban1", 2, "ban"), ("a_pick", 1, "pick"), ("b_pick", 2, "pick"),
    ("a_ban2", 1, "ban"), ("b_ban2", 2, "ban"), ("remaining", 0, "remaining"),
]
TIE = ["match_id"]
RATES = ["pick_rate", "ban_rate", "play_rate"]
DRAFT_SUMS: Measures = {
    "total": "1",
    "picked": "cast(own_pick = arena as int)",
    "banned": "cast(arena in (own_ban1, own_ban2) as int)",
    "played": "cast(arena in (own_pick, opp_pick, remaining) as int)",
}


def touched_arenas(series: DataFrame, arenas: list[int], carried: list[str]) -> DataFrame:
    """One row per series and arena its draft touched; ``played`` tells picks from bans."""
    def status(i: int) -> Column:
        def among(cols):
            return F.array_contains(F.array(*cols), F.lit(i))
        return F.when(among(PLAYED), F.lit(True)).when(among(BANNED), F.lit(False))

    marks = F.array(*[F.struct(F.lit(i).alias("arena"), status(i).alias("played")) for i in arenas])
    return series.select(*carried, F.inline(F.filter(marks, lambda m: m["played"].isNotNull())))


def draft_asks(series: DataFrame, arenas: list[int]) -> DataFrame:
    """Distinct (side, arena, date) of the touched arenas."""
    return asks_of(touched_arenas(series, arenas, ["a", "b", "date"]), "arena")


def draft_steps(series: DataFrame, arenas: list[int], calendar: Calendar) -> DataFrame:
    """The seven draft steps in order, with the pool still open before each."""
    moves = F.array(*[
        F.struct(F.lit(who).alias("side_no"), F.lit(what).alias("action"), F.col(col).alias("arena"))
        for col, who, what in STEPS
    ])
    rows = with_pool(series, calendar, arenas).select("match_id", "a", "b", "date", "_pool", F.array(*[s[0] for s in STEPS]).alias("_drafted"),
                         F.posexplode(moves).alias("step", "_move"))
    return rows.select(
        "match_id", "a", "b", "date", "step", F.col("_move.side_no"), F.col("_move.action"), F.col("_move.arena"),
        F.array_sort(F.array_except("_pool", F.slice("_drafted", F.lit(1), F.col("step")))).alias("open_arenas"),
    )


def draft_rates(
    series: DataFrame, asks: DataFrame, arenas: list[int], calendar: Calendar, n: int = 20
) -> DataFrame:
    """Pick, ban and play rate per (side, arena, date) ask.

    Counts the side's last n earlier series dated when the arena was in the pool; series past the last calendar entry
    count for no arena (``pool.uncovered`` lists them). Whether an arena is
    in the pool depends on the date alone, so cutting each (side, day) to n series before spreading
    them over arenas loses nothing.
    """
    sides = _drafting(series)
    if n > 0:
        sides = last_of_day(sides, ["side"], n, TIE)
    spread = with_pool(sides, calendar, arenas).withColumn("arena", F.explode("_pool")).drop("_pool")
    return rates_of_sums(sums_before(spread, asks, ["side", "arena"], DRAFT_SUMS, n, TIE, is_cut=True))


def _drafting(series: DataFrame) -> DataFrame:
    return side_rows(series, keep=["match_id", "date", "remaining"]).select(
        "side", "date", *TIE, "own_ban1", "own_ban2", "own_pick", "opp_pick", "remaining"
    )


def drafting_sides(series: DataFrame, arenas: list[int], calendar: Calendar) -> DataFrame:
    """Side rows of the drafts, one for each arena in the pool on their date."""
    return with_pool(_drafting(series), calendar, arenas).withColumn("arena", F.explode("_pool")).drop("_pool")


def rates_of_sums(state: DataFrame) -> DataFrame:
    """Adds the rates to the sums of ``DRAFT_SUMS``."""
    total = F.col("total")
    return state.withColumns({
        "pick_rate": ratio(F.col("picked"), total),
        "ban_rate": ratio(F.col("banned"), total),
        "play_rate": ratio(F.col("played"), total),
    })


def with_mean_rates(contests: DataFrame, win: DataFrame, draft: DataFrame) -> DataFrame:
    """Adds avg_win, avg_pick, avg_ban, avg_play: the mean of the two sides' rates on the arena."""
    key = ["side", "arena", "date"]
    # both have a row for each ask; a stored one would be taken for as small as its compressed file, and broadcast
    state = win.select(*key, "win_rate").join(draft.select(*key, *RATES).hint("merge"), key)
    names = {"win_rate": "avg_win", "pick_rate": "avg_pick", "ban_rate": "avg_ban", "play_rate": "avg_play"}
    return side_totals(contests, state, names, contests.columns, "arena", weights=(0.5, 0.5))


AVERAGES = ["avg_win", "avg_pick", "avg_ban", "avg_play"]


def has_history(df: DataFrame) -> DataFrame:
    """Drops rows whose four mean rates are all zero."""
    return df.filter(~((F.col("avg_win") == 0) & (F.col("avg_pick") == 0) & (F.col("avg_ban") == 0) & (F.col("avg_play") == 0)))


def draft_choices(
    series: DataFrame, games: DataFrame, arenas: list[int], calendar: Calendar, carried: list[str], n: int = 20,
    asks: DataFrame | None = None, win: DataFrame | None = None,
) -> DataFrame:
    """Arenas touched by each draft with both sides' mean rates before the series.

    ``asks`` can be handed in from ``draft_asks`` of a cheaper form of the same series, ``win`` as the games' win rates for them.
    """
    rows = touched_arenas(series, arenas, carried)
    asks = draft_asks(series, arenas) if asks is None else asks
    win = arena_win_rate(games, asks, n) if win is None else win
    return has_history(with_mean_rates(rows, win, draft_rates(series, asks, arenas, calendar, n)))


def head_to_head(contests: DataFrame, series: DataFrame) -> DataFrame:
    """Adds ``h2h_played``: 1 if this pair, in either order, played the arena on an earlier date.

    "Any earlier meeting" is "the first meeting is earlier", so history shrinks to one row per
    (pair, arena) before the join.
    """
    meetings = series.select(*pair_key(), "date", F.explode(F.array_distinct(F.array(*PLAYED))).alias("arena"))
    first = meetings.groupBy("low", "high", "arena").agg(F.min("date").alias("_first"))
    keyed = contests.select("*", *pair_key())
    joined = keyed.join(first, ["low", "high", "arena"], "left")
    flag = F.coalesce(F.col("_first") < F.col("date"), F.lit(False)).cast("int")
    return joined.select(*contests.columns, flag.alias("h2h_played"))
