"""Side form: win rates, seven- and nineteen-figure profiles, with arena fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.numbers import ratio
from duelbook.operators.history import (
    Measures,
    asks_of,
    last_of_day,
    side_differences,
    sums_before,
    sums_before_own_days,
    sums_of_trailing_months,
)
from duelbook.operators.sides import side_rows
from duelbook.session import stored

FORM = ["round_wr", "fk_percent", "acs", "kills", "assists", "deaths", "kdr"]
TIE = ["game_id"]


# acs5 is the five-player total of the combat score, an integer, so that sums are exact.
FORM_SUMS: Measures = {
    "n": "1",
    "rds": "own_rds",
    "all_rds": "own_rds + opp_rds",
    "fks": "own_fks",
    "all_fks": "own_fks + opp_fks",
    "acs5": "own_acs5",
    "k": "own_kills",
    "s": "own_assists",
    "d": "own_deaths",
}


def form_figures() -> dict[str, Column]:
    """Ratios of sums; all 0 when there are no games or no first kills."""
    c = F.col
    figures = {
        "round_wr": ratio(c("rds"), c("all_rds")),
        "fk_percent": ratio(c("fks"), c("all_fks")),
        "acs": ratio(c("acs5"), c("n") * 5),
        "kills": ratio(c("k"), c("all_rds")),
        "assists": ratio(c("s"), c("all_rds")),
        "deaths": ratio(c("d"), c("all_rds")),
        "kdr": ratio(c("k"), c("d")),
    }
    usable = (c("n") > 0) & (c("all_fks") > 0)
    return {name: F.when(usable, value).otherwise(F.lit(0.0)) for name, value in figures.items()}


_WIDE_PAIRS = ["rds", "pistols", "ecos_won", "ecos_lost", "clutches"]
_WIDE_OWN = ["retakes_won", "retakes_lost", "postplants_won", "postplants_lost", "fullbuys_won", "fullbuys_lost",
             "acs", "kills", "assists", "deaths", "kast", "mks", "econ"]
#: The sums that the figures ask for, and no others: the rows before the cut carry each of them.
WIDE_SUMS: Measures = {
    "n": "1",
    **{f"own_{x}": f"own_{x}" for x in _WIDE_PAIRS + _WIDE_OWN},
    **{f"opp_{x}": f"opp_{x}" for x in _WIDE_PAIRS},
    "own_fks": "own_atk_fks + own_def_fks",
    "opp_fks": "opp_atk_fks + opp_def_fks",
    "own_rating": "own_atk_rating + own_def_rating",
}


def wide_figures() -> dict[str, Column]:
    """Nineteen-figure profile: name -> ratio of sums, 0 where a denominator is 0."""
    def own(x): return F.col(f"own_{x}")
    def opp(x): return F.col(f"opp_{x}")
    n = F.col("n")
    rounds = own("rds") + opp("rds")
    table = {
        "round_wr": (own("rds"), rounds),
        "retake_wr": (own("retakes_won"), own("retakes_won") + own("retakes_lost")),
        "postplant_wr": (own("postplants_won"), own("postplants_won") + own("postplants_lost")),
        "fk_percent": (own("fks"), own("fks") + opp("fks")),
        "pistol_wr": (own("pistols"), own("pistols") + opp("pistols")),
        "eco_wr": (own("ecos_won"), own("ecos_won") + own("ecos_lost")),
        "antieco_wr": (opp("ecos_lost"), opp("ecos_won") + opp("ecos_lost")),
        "fullbuy_wr": (own("fullbuys_won"), own("fullbuys_won") + own("fullbuys_lost")),
        "acs": (own("acs"), n),
        "kills": (own("kills"), rounds),
        "assists": (own("assists"), rounds),
        "deaths": (own("deaths"), rounds),
        "kdr": (own("kills"), own("deaths")),
        "kadr": (own("kills") + own("assists"), own("deaths")),
        "kast": (own("kast"), n),
        "rating": (own("rating"), n * 2),
        "mks": (own("mks"), n),
        "clutch": (own("clutches"), own("clutches") + opp("clutches")),
        "econ": (own("econ"), n),
    }
    return {name: ratio(num, den) for name, (num, den) in table.items()}


WIDE = [
    "round_wr", "retake_wr", "postplant_wr", "fk_percent", "pistol_wr", "eco_wr", "antieco_wr", "fullbuy_wr",
    "acs", "kills", "assists", "deaths", "kdr", "kadr", "kast", "rating", "mks", "clutch", "econ",
]


def _profile(sums: DataFrame, key: list[str], figures: dict[str, Column]) -> DataFrame:
    return sums.select(*key, "date", *[c.alias(name) for name, c in figures.items()])


def arena_form(
    games: DataFrame,
    asks: DataFrame | None = None,
    n: int = 20,
    measures: Measures = FORM_SUMS,
    figures: dict[str, Column] | None = None,
) -> DataFrame:
    """Form per (side, arena, date): last n earlier games on the arena, or on any arena if none.

    ``asks`` holds distinct (side, arena, date); without it the games' own keys are used.
    """
    figures = figures or form_figures()
    names = list(measures)
    key, wide_key = ["side", "arena"], ["side"]
    sides = side_rows(games, keep=["arena", "date", *TIE]).select(
        "side", "arena", "date", *TIE, *[F.expr(c).alias(m) for m, c in measures.items()]
    )
    own = {m: m for m in names}
    if n > 0:
        # The last n of a day over all arenas are among the last n of each arena, so both states
        # are read from the one cut table. It is stored, as the rows before the cut are many times as many.
        sides = stored(last_of_day(sides, key, n, TIE), "last-of-day")
    if asks is None:
        here = sums_before_own_days(sides, key, own, n, TIE, is_cut=n > 0).filter(F.col("n") > 0)
        # without a game on the arena so far: a side's first day there, which takes the rows before its last such day only
        firsts = sides.groupBy(*key).agg(F.min("date").alias("date"))
        firsts = stored(firsts, "first-days") if n > 0 else firsts  # its size is then known, and few rows are not joined by a shuffle of the many
        early = sides.join(firsts.groupBy("side").agg(F.max("date").alias("_until")), "side").filter(F.col("date") < F.col("_until"))
        anywhere = sums_before(early.drop("_until"), firsts.select("side", "date").distinct(), wide_key, own, n, TIE)
        return _profile(here.unionByName(firsts.join(anywhere, ["side", "date"])), key, figures)
    here = sums_before(sides, asks, key, own, n, TIE, is_cut=True)
    anywhere = sums_before(sides, asks.select("side", "date").distinct(), wide_key, own, n, TIE)
    return _profile(or_anywhere(here, anywhere, names), key, figures)


def rates_and_form(games: DataFrame, asks: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """``arena_win_rate`` and ``arena_form`` of the same asks; both are read from one cut of the games, which are gone through once."""
    if n <= 0:
        return arena_win_rate(games, asks, n), arena_form(games, asks, n)
    key, measures = ["side", "arena"], FORM_SUMS | {"wins": "cast(won as int)"}
    sides = side_rows(games, keep=["arena", "date", *TIE]).select("side", "arena", "date", *TIE, *[F.expr(c).alias(m) for m, c in measures.items()])
    sides = stored(last_of_day(sides, key, n, TIE), "last-of-day")
    sums = stored(sums_before(sides, asks, key, {m: m for m in measures}, n, TIE, is_cut=True), "sums")
    anywhere = sums_before(sides, asks.select("side", "date").distinct(), ["side"], {m: m for m in FORM_SUMS}, n, TIE)
    win = sums.select("side", "arena", "date", F.col("n").alias("games"), "wins", ratio(F.col("wins"), F.col("n")).alias("win_rate"))
    return win, form_of_sums(or_anywhere(sums, anywhere, list(FORM_SUMS)))


def or_anywhere(here: DataFrame, anywhere: DataFrame, names: list[str]) -> DataFrame:
    """The sums on the arena, or those on any arena where a side has no game there; ``n`` counts the games."""
    spare = anywhere.select("side", "date", *[F.col(m).alias(f"_any_{m}") for m in names])
    return here.join(spare, ["side", "date"], "left").select(
        "side", "arena", "date",
        *[F.when(F.col("n") > 0, F.col(m)).otherwise(F.col(f"_any_{m}")).alias(m) for m in names],
    )


def form_of_sums(sums: DataFrame) -> DataFrame:
    """The seven figures of sums by (side, arena, date)."""
    return _profile(sums, ["side", "arena"], form_figures())


def side_form(games: DataFrame, asks: DataFrame, n: int = 20) -> DataFrame:
    """Form per (side, date) over all arenas."""
    sides = side_rows(games, keep=["date", *TIE])
    return _profile(sums_before(sides, asks, ["side"], FORM_SUMS, n, TIE), ["side"], form_figures())


def form_difference(contests: DataFrame, form: DataFrame, carried: list[str], values: list[str] | None = None) -> DataFrame:
    """Side a's figures minus side b's, by (side, arena, date) or (side, date)."""
    values = values or FORM
    more = ["arena"] if "arena" in form.columns else []
    return side_differences(contests, form, values, carried, *more)


def _win_sums(perspective: str) -> Measures:
    label = {"side": "won", "listed": "listed_won"}[perspective]
    return {"games": "1", "wins": f"cast({label} as int)"}


def arena_win_rate(
    games: DataFrame, asks: DataFrame | None = None, n: int = 20, perspective: str = "side"
) -> DataFrame:
    """Share of the side's last n earlier games on the arena that it won; no games -> 0; n=0 -> all.

    ``perspective='listed'`` counts games won by the side listed first instead.
    """
    sides = side_rows(games, keep=["arena", "date", *TIE])
    key, sums = ["side", "arena"], _win_sums(perspective)
    if asks is None:
        state = sums_before_own_days(sides, key, sums, n, TIE)
    else:
        state = sums_before(sides, asks, key, sums, n, TIE)
    return state.withColumn("win_rate", ratio(F.col("wins"), F.col("games")))


def trailing_win_rate(games: DataFrame, asks: DataFrame, months: int = 3) -> DataFrame:
    """Win rate on the arena over the trailing calendar months."""
    sides = side_rows(games, keep=["arena", "date"])
    state = sums_of_trailing_months(sides, asks, ["side", "arena"], _win_sums("side"), months)
    return state.withColumn("win_rate", ratio(F.col("wins"), F.col("games")))


def with_arenas(asks: DataFrame, arenas: list[int]) -> DataFrame:
    """Every ask for every arena of the dictionary."""
    return asks.withColumn("arena", F.explode(F.array(*[F.lit(i) for i in arenas])))


def arena_win_rate_wide(games: DataFrame, asks: DataFrame, arenas: list[int], n: int = 20) -> DataFrame:
    """One row per (side, date) with a win-rate column per arena."""
    long = arena_win_rate(games, with_arenas(asks, arenas), n)
    return wide_by_arena(long, arenas, {"win_rate": "wr"})


def wide_by_arena(long: DataFrame, arenas: list[int], values: dict[str, str]) -> DataFrame:
    """(side, arena, date) rows -> one row per (side, date), column ``<name>_<arena>`` per value."""
    cells = [
        F.max(F.when(F.col("arena") == i, F.col(v))).alias(f"{name}_{i}")
        for i in arenas for v, name in values.items()
    ]
    return long.groupBy("side", "date").agg(*cells)


def win_rate_difference(series: DataFrame, games: DataFrame, arenas: list[int], carried: list[str]) -> DataFrame:
    """All-history win-rate difference per arena, wide on the series.

    Arenas become columns of the daily totals first, so one window by side serves all of them.
    """
    sums: Measures = {}
    for i in arenas:
        sums[f"g{i}"] = f"cast(arena = {i} as int)"
        sums[f"w{i}"] = f"cast(arena = {i} and won as int)"
    sides = side_rows(games, keep=["arena", "date"])
    state = sums_before(sides, asks_of(series), ["side"], sums, 0, [])
    rates = state.select("side", "date", *[ratio(F.col(f"w{i}"), F.col(f"g{i}")).alias(f"wr_{i}") for i in arenas])
    names = [f"wr_{i}" for i in arenas]
    return side_differences(series, rates, names, carried)
