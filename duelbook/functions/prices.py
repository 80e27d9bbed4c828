"""Bookmaker prices: payouts, implied probabilities, flat-stake profit, expected value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied_probability(payout: Column) -> Column:
    """Payout of a stake of 100 -> implied probability; 0 when there is no payout."""
    return F.when(payout > 0, F.lit(1.0) / (payout / F.lit(100.0))).otherwise(F.lit(0.0))


def side_one_probabilities(payouts: Column, won_a: Column) -> Column:
    """The page prices the winner, so probabilities flip when side 1 lost."""
    return F.transform(
        payouts,
        lambda v: F.when(won_a, implied_probability(v)).otherwise(F.lit(1.0) - implied_probability(v)),
    )


def best_probability(probs: Column) -> Column:
    top = F.array_max(F.filter(probs, lambda p: (p > 0) & (p != 1)))
    return F.coalesce(top, F.lit(0.0))


def worst_probability(probs: Column) -> Column:
    low = F.array_min(F.filter(probs, lambda p: (p < 1) & (p != 0)))
    return F.coalesce(low, F.lit(1.0))


def line_probability(best: Column, worst: Column) -> Column:
    """Mean of the usable ends, the usable one, or null; usable is strictly inside (0, 1)."""
    best_ok = (best > 0) & (best < 1)
    worst_ok = (worst > 0) & (worst < 1)
    return (
        F.when(best_ok & worst_ok, (best + worst) / F.lit(2.0))
        .when(best_ok, best)
        .when(worst_ok, worst)
    )


def best_decimal(prices: Column) -> Column:
    """Highest decimal price, never below 1."""
    return F.greatest(F.lit(1.0), F.array_max(prices))


def flat_profit(prob: Column, stake: float) -> Column:
    return F.try_divide(F.lit(float(stake)), prob) - F.lit(float(stake))


def expected_value(chance: Column, price: Column) -> Column:
    """chance * price - (1 - chance), the form bets are picked on."""
    return chance * price - (F.lit(1.0) - chance)


def expected_value_decimal(chance: Column, price: Column) -> Column:
    """Textbook expected profit per unit at a decimal price; worth a bet above 0."""
    return chance * price - F.lit(1.0)


def pick_bet(ev_a: Column, ev_b: Column, above: float = 1.0, names: tuple[str, str] = ("a", "b")) -> Column:
    return F.when(ev_a > above, F.lit(names[0])).when(ev_b > above, F.lit(names[1]))
