"""Player rows -> side totals, performance buckets, agent win rates, composition strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.functions.numbers import ratio
from duelbook.functions.text import leading_int
from duelbook.operators.history import sums_of_trailing_months
from duelbook.operators.sides import side_rows

TEAM = 5
#: Parts of the games of an arena where rates are those of all time.
PARTS = 64


def player_totals(players: DataFrame, agents: list[int]) -> DataFrame:
    """Totals per (game_id, side_no), with the sorted agent ids.

    acs and rating are fifths of the sum, a zero rating sum is null. Agents are counted per dictionary
    id and spelled out after the aggregation, so it keeps partial sums only and no lists. ``unknown_agents`` counts
    players whose agent is not in the dictionary (or null): a row with any is not complete.
    """
    counts = [F.count_if(F.col("agent") == i).alias(f"_n{i}") for i in agents]
    unknown = F.count_if(~F.coalesce(F.col("agent").isin(agents), F.lit(False))).alias("unknown_agents")
    totals = players.groupBy("game_id", "side_no").agg(
        *[F.sum(x).alias(x) for x in ("fks", "kills", "deaths", "assists")],
        F.sum("acs").alias("_acs"), F.sum("rating").alias("_rating"), unknown, *counts,
    )
    ids = F.flatten(F.array(*[F.array_repeat(F.lit(i), F.col(f"_n{i}").cast("int")) for i in agents]))
    return totals.select(
        "game_id", "side_no", "fks", "kills", "deaths", "assists",
        (F.col("_acs") / F.lit(float(TEAM))).alias("acs"),
        F.when(F.col("_rating") != 0, F.col("_rating") / F.lit(float(TEAM))).alias("rating"),
        ids.alias("agents"), "unknown_agents",
    )


def performance_buckets(cells: DataFrame) -> DataFrame:
    """Performance-table cells (game_id, side_no, col, text) -> bucket sums by column place."""
    stat = leading_int(F.col("text"))

    def bucket(low: int, high: int):
        return F.sum(F.when(F.col("col").between(low, high), stat).otherwise(0))

    return cells.groupBy("game_id", "side_no").agg(
        bucket(2, 5).alias("mks"), bucket(6, 10).alias("clutches"),
        (bucket(11, 11) / F.lit(float(TEAM))).alias("econ"),
        bucket(12, 12).alias("plants"), bucket(13, 13).alias("defuses"),
    )


def agent_rows(games: DataFrame) -> DataFrame:
    """One row per game, side and agent: agent, arena, date, won, and whether it is a mirror."""
    sides = side_rows(games, keep=["game_id", "arena", "date"])
    each = sides.select(
        "game_id", "side_no", "arena", "date", "won", "opp_agents",
        F.explode(F.array_distinct("own_agents")).alias("agent"),
    )
    return each.withColumn("mirror", F.array_contains("opp_agents", F.col("agent"))).drop("opp_agents")


def agent_win_rate(games: DataFrame, by_arena: bool = True) -> DataFrame:
    """Win rate per (agent, arena); or per agent over all arenas, leaving out mirror games."""
    rows = agent_rows(games)
    key = ["agent", "arena"] if by_arena else ["agent"]
    if not by_arena:
        rows = rows.filter(~F.col("mirror"))
    sums = rows.groupBy(*key).agg(F.count("*").alias("games"), F.sum(F.col("won").cast("int")).alias("wins"))
    return sums.withColumn("win_rate", ratio(F.col("wins"), F.col("games")))


def comp_strength(games: DataFrame, months: int | None = 3) -> DataFrame:
    """Mean win rate of a side's agents on the arena, per game and side.

    With ``months`` the rates are those of the trailing months before the game; with None the rates
    over all games.
    """
    lineup = side_rows(games, keep=["game_id", "arena", "date"]).select("game_id", "side_no", "arena", "date", "own_agents")
    if months is None:
        # a few arenas have all the games: each arena's rates are handed to every part of its games
        lineup = lineup.withColumn("_part", F.pmod(F.xxhash64("game_id", "side_no", "date"), F.lit(PARTS)).cast("int"))
        rates, place = agent_win_rate(games).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["arena", "_part"]
    else:
        place = ["arena", "date"]
        asks = lineup.select(*place, F.explode("own_agents").alias("agent")).distinct()
        state = sums_of_trailing_months(agent_rows(games), asks, ["agent", "arena"], {"games": "1", "wins": "cast(won as int)"}, months)
        rates = state.withColumn("win_rate", ratio(F.col("wins"), F.col("games")))
    # One map for each place, with at most one entry for each agent of the dictionary; a game is joined once and averaged in place.
    maps = rates.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("agent", "win_rate"))).alias("rates"))
    joined = lineup.join(maps, place, "left")
    total = F.aggregate("own_agents", F.lit(0.0), lambda a, agent: a + F.coalesce(F.try_element_at(F.col("rates"), agent), F.lit(0.0)))
    return joined.select("game_id", "side_no", F.try_divide(total, F.size("own_agents")).alias("comp_wr"))
