"""Feature tables: games, draft choices and series with their point-in-time figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions.numbers import ratio
from duelbook.operators.draft import DRAFT_SUMS, draft_asks, draft_choices, draft_rates, drafting_sides, rates_of_sums, with_mean_rates
from duelbook.operators.draft import TIE as DRAFT_TIE
from duelbook.operators.form import (
    FORM,
    FORM_SUMS,
    WIDE,
    WIDE_SUMS,
    arena_form,
    form_difference,
    form_of_sums,
    or_anywhere,
    rates_and_form,
    side_form,
    wide_figures,
)
from duelbook.operators.form import TIE as FORM_TIE
from duelbook.operators.history import asks_of
from duelbook.operators.pool import Calendar, for_each_arena
from duelbook.operators.ratings import month_number, with_period_elo
from duelbook.operators.sides import drop_nulls, fill_zero, side_rows, with_difference
from duelbook.session import stored
from duelbook.sources.kept import LastRows

DIFFS = [f"{v}_diff" for v in FORM]
WIDE_DIFFS = [f"{v}_diff" for v in WIDE]
GAME_KEYS = ["game_id", "a", "b", "won_a", "date", "arena"]
_GAME_INPUT = ["rds", "fks", "acs5", "kills", "assists", "deaths"]
SERIES_CARRIED = ["match_id", "a", "b", "date", "elo_diff", "won_a", "net_h2h", "past_diff", "odds", "best_odds", "worst_odds"]


def game_features(games: DataFrame, n: int = 20) -> DataFrame:
    """Seven form differences per game; games with a missing figure are left out first."""
    needed = [*GAME_KEYS, *(f"{s}_{x}" for x in _GAME_INPUT for s in "ab")]
    whole = drop_nulls(games.select(*needed))
    return form_difference(whole, arena_form(whole, n=n), GAME_KEYS)


def wide_game_features(games: DataFrame, n: int = 20) -> DataFrame:
    """Nineteen form differences per game; missing inputs count as 0."""
    figures = arena_form(fill_zero(games), n=n, measures=WIDE_SUMS, figures=wide_figures())
    return form_difference(games, figures, GAME_KEYS, WIDE)


def with_form(rows: DataFrame, games: DataFrame, n: int = 20, asks: DataFrame | None = None) -> DataFrame:
    """Adds the seven form differences to rows with sides, arena and date.

    Hand in ``asks`` (any superset of the rows' own keys) when the rows are costly to compute.
    """
    form = arena_form(games, asks_of(rows, "arena") if asks is None else asks, n)
    return form_difference(rows, form, rows.columns)


def rated_series(series: DataFrame, period: Column | None = None) -> DataFrame:
    """Series with elo_diff (monthly periods by default), past_diff, and net_h2h filled with 0."""
    timed = series.withColumn("period", month_number(F.col("date")) if period is None else period)
    return fill_zero(with_difference(with_period_elo(timed), "past"), ["net_h2h"]).drop("period")


def choice_features(
    series: DataFrame, games: DataFrame, arenas: list[int], calendar: Calendar, n: int = 20, plain: DataFrame | None = None
) -> DataFrame:
    """Draft choices of rated series with mean rates and form differences.

    ``plain`` is the same series before rating; the asked keys come from it, so ratings are joined once.
    """
    return choices_with_form(series, games, arenas, calendar, SERIES_CARRIED, n, plain)


def choices_with_form(
    series: DataFrame, games: DataFrame, arenas: list[int], calendar: Calendar, carried: list[str], n: int = 20, plain: DataFrame | None = None
) -> DataFrame:
    """Draft choices with mean rates and form differences; the games are gone through once for both."""
    asks = stored(draft_asks(series if plain is None else plain, arenas), "asks")  # one for each side, arena and day at most
    win, form = rates_and_form(games, asks, n)
    choices = draft_choices(series, games, arenas, calendar, carried, n, asks, win)
    return form_difference(choices, form, choices.columns)


def upcoming_features(
    upcoming: DataFrame, series: DataFrame, games: DataFrame, arenas: list[int], calendar: Calendar, n: int = 20
) -> DataFrame:
    """Contest x in-pool arena rows of the card with mean rates and form differences."""
    rows = for_each_arena(upcoming, calendar, arenas)
    asks = asks_of(rows, "arena")
    win, form = rates_and_form(games, asks, n)
    averaged = with_mean_rates(rows, win, draft_rates(series, asks, arenas, calendar, n))
    return form_difference(averaged, form, averaged.columns)


@dataclass
class KeptCard:
    """What the card needs of the past, kept between runs: each side's last games on an arena and on any, and last drafts."""

    spark: SparkSession
    path: str
    arenas: list[int]
    calendar: Calendar
    n: int = 20

    def _parts(self) -> tuple[LastRows, LastRows, LastRows]:
        games = FORM_SUMS | {"wins": "cast(won as int)"}
        return (LastRows(self.spark, f"{self.path}/here", ["side", "arena"], games, FORM_TIE, self.n),
                LastRows(self.spark, f"{self.path}/anywhere", ["side"], FORM_SUMS, FORM_TIE, self.n),
                LastRows(self.spark, f"{self.path}/drafts", ["side", "arena"], DRAFT_SUMS, DRAFT_TIE, self.n))

    def update(self, series: DataFrame, games: DataFrame, through: str) -> None:
        """Moves the state on to a day. A run that ended between its parts is made whole by the next run for that day."""
        here, anywhere, drafts = self._parts()
        sides = side_rows(games, keep=["arena", "date", *FORM_TIE])
        if (here.state() or {}).get("through") == (anywhere.state() or {}).get("through"):
            # the last games of a side on any arena are among its last ones on each: the new days are gone through once for both
            sides = stored(here.last(here.fresh(sides, through)), "new-days")
        here.update(sides, through)
        anywhere.update(sides, through)
        drafts.update(drafting_sides(series, self.arenas, self.calendar), through)

    def through(self) -> str | None:
        """The day the state is through; an error if its parts differ."""
        days = {(part.state() or {}).get("through") for part in self._parts()}
        if len(days) > 1:
            raise RuntimeError(f"the kept state is through different days, {sorted(map(str, days))}: run the update again")
        return days.pop()

    def features(self, upcoming: DataFrame) -> DataFrame:
        """As ``upcoming_features``, for contests behind the state's day, without a look at the history."""
        self.through()
        here, anywhere, drafts = self._parts()
        rows = for_each_arena(upcoming, self.calendar, self.arenas)
        asks = asks_of(rows, "arena")
        sums = here.sums(asks)
        win = sums.select("side", "arena", "date", ratio(F.col("wins"), F.col("n")).alias("win_rate"))
        form = form_of_sums(or_anywhere(sums, anywhere.sums(asks.select("side", "date").distinct()), list(FORM_SUMS)))
        averaged = with_mean_rates(rows, win, rates_of_sums(drafts.sums(asks)))
        return form_difference(averaged, form, averaged.columns)


def second_tier_features(series: DataFrame, games: DataFrame, n: int = 20) -> DataFrame:
    """Series-level form differences over all arenas, with past_diff and the line."""
    carried = ["match_id", "a", "b", "date", "won_a", "past_diff", "odds"]
    contests = with_difference(series, "past")
    return form_difference(contests, side_form(games, asks_of(series), n), carried)
