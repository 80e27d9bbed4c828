"""Contest rows <-> side rows, set and region filters, name lookups.

A contest row has sides ``a`` and ``b``; per-side columns start with ``a_`` and ``b_``;
``won_a`` is true when side a won.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_columns(df: DataFrame) -> list[str]:
    """Names x such that both ``a_x`` and ``b_x`` exist."""
    names = set(df.columns)
    return [c[2:] for c in df.columns if c.startswith("a_") and f"b_{c[2:]}" in names]


def side_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per contest, each seen from one side, in one scan.

    ``side``/``opp`` are the ids, ``own_x``/``opp_x`` the column pairs, ``won`` is from the side's
    view and ``listed_won`` is the contest's own label. Other columns are carried unchanged.
    """
    pairs = paired_columns(df)
    paired = {"a", "b", *(f"{s}_{x}" for s in "ab" for x in pairs)}
    shared = [c for c in df.columns if c not in paired]
    if keep is not None:
        shared = [c for c in shared if c in keep]
    has_label = "won_a" in df.columns

    def view(own: str, other: str, number: int) -> Column:
        fields = [F.col(own).alias("side"), F.col(other).alias("opp"), F.lit(number).alias("side_no")]
        if has_label:
            won = F.col("won_a") if own == "a" else ~F.col("won_a")
            fields += [won.alias("won"), F.col("won_a").alias("listed_won")]
        for x in pairs:
            fields += [F.col(f"{own}_{x}").alias(f"own_{x}"), F.col(f"{other}_{x}").alias(f"opp_{x}")]
        return F.struct(*fields)

    carried = [c for c in shared if c != "won_a"]
    return df.select(*carried, F.inline(F.array(view("a", "b", 1), view("b", "a", 2))))


def between_dates(df: DataFrame, first, last, half_open: bool = False) -> DataFrame:
    upper = F.col("date") < F.lit(last) if half_open else F.col("date") <= F.lit(last)
    return df.filter((F.col("date") >= F.lit(first)) & upper)


def _ids(teams: DataFrame, name: str, column: str) -> DataFrame:
    return teams.select(F.col(column).alias(name)).distinct()


def both_in(df: DataFrame, teams: DataFrame, column: str = "team_id") -> DataFrame:
    """Contests whose two sides are both in the set."""
    return df.join(_ids(teams, "a", column), "a", "left_semi").join(_ids(teams, "b", column), "b", "left_semi").select(df.columns)


def neither_in(df: DataFrame, teams: DataFrame, column: str = "team_id") -> DataFrame:
    """Contests with no side in the set."""
    return df.join(_ids(teams, "a", column), "a", "left_anti").join(_ids(teams, "b", column), "b", "left_anti").select(df.columns)


def with_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds ``a_region`` and ``b_region``; unlisted teams are 'unknown'."""
    one = regions.groupBy("team_id").agg(F.min("region").alias("region"))
    for s in "ab":
        lookup = one.select(F.col("team_id").alias(s), F.col("region").alias(f"{s}_region"))
        df = df.join(lookup, s, "left").withColumn(f"{s}_region", F.coalesce(f"{s}_region", F.lit("unknown")))
    return df


def _same_region() -> Column:
    return (F.col("a_region") == F.col("b_region")) & (F.col("a_region") != "unknown")


def regional(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Contests inside one known region."""
    return with_regions(df, regions).filter(_same_region()).select(df.columns)


def cross_region(df: DataFrame, regions: DataFrame) -> DataFrame:
    """All other contests; two unknown sides never count as one region."""
    return with_regions(df, regions).filter(~_same_region()).select(df.columns)


def with_names(df: DataFrame, teams: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``a_name`` and ``b_name``; with ``strict`` an unknown id fails the job."""
    for s in "ab":
        lookup = teams.select(F.col("team_id").alias(s), F.col("name").alias(f"{s}_name"))
        df = df.join(lookup, s, "left")
        if strict:
            missing = F.raise_error(F.concat(F.lit("no team with id "), F.col(s).cast("string")))
            df = df.withColumn(f"{s}_name", F.when(F.col(f"{s}_name").isNull(), missing.cast("string")).otherwise(F.col(f"{s}_name")))
    return df


def decided(df: DataFrame, name_a: str = "a_text", name_b: str = "b_text") -> DataFrame:
    """Drops contests with a side still 'TBD'."""
    return df.filter((F.trim(F.col(name_a)) != "TBD") & (F.trim(F.col(name_b)) != "TBD"))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows with no null or NaN in the columns.

    One plain test per column: it reaches the scan, which a counted test over all columns does not.
    """
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    tests = [F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull() for c in subset or df.columns]
    return df.filter(reduce(lambda x, y: x & y, tests))


def fill_zero(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=subset)


def with_winner(df: DataFrame, a_score: str = "a_gamewins", b_score: str = "b_gamewins") -> DataFrame:
    """``won_a`` from the two scores; a draw counts as lost."""
    return df.withColumn("won_a", F.col(a_score) > F.col(b_score))


def with_difference(df: DataFrame, name: str) -> DataFrame:
    """``<name>_diff`` = side a minus side b."""
    return df.withColumn(f"{name}_diff", F.col(f"a_{name}") - F.col(f"b_{name}"))


def pair_key() -> list[Column]:
    """The two ids in fixed order, so that (x, y) and (y, x) are one pair."""
    return [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]


def first_of_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in the given order.

    The rank filter is pushed below the shuffle, so each task sends one row per key however many
    copies a key has.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
