"""Arena pool calendar: which arenas were playable on a date.

A calendar entry (until_date, arenas) says the arenas are out of the pool on every date before
until_date, down to the previous entry. A calendar is a list of a few entries read as configuration, which becomes a literal in
the plan and makes the interval lookup an expression, or a table of any length (until_date, out_arenas). Entries of a table are dealt into
bins of ``BIN`` days that they cover; the distinct days asked for meet the entry of their bin that holds them, and rows
are joined to their day. Entries are distinct dates, so a table has at most one row for each day of history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Calendar = list[tuple[str, list[int]]] | DataFrame
#: Days of a bin.
BIN = 32


def calendar_entries(table: DataFrame) -> list[tuple[str, list[int]]]:
    """Entries of a calendar table (until_date, out_arenas) in date order."""
    rows = table.select(F.col("until_date").cast("string").alias("u"), "out_arenas").dropDuplicates(["u"]).collect()
    return sorted((r["u"], list(r["out_arenas"])) for r in rows)


def out_of_pool(calendar: Calendar, day: Column) -> Column:
    """Arenas out of the pool on the day: those of the first entry after it; null past the last."""
    entries = F.array(*[
        F.struct(
            F.lit(until).cast("date").alias("until"),
            F.array(*[F.lit(i) for i in out]).cast("array<int>").alias("out"),
        )
        for until, out in sorted(calendar)
    ])
    return F.get(F.filter(entries, lambda e: e["until"] > day), F.lit(0))["out"]


def in_pool(calendar: Calendar, day: Column, arena: Column) -> Column:
    """True/false, or null when the calendar says nothing about the day."""
    return ~F.array_contains(out_of_pool(calendar, day), arena)


def pool_on(calendar: Calendar, day: Column, arenas: list[int]) -> Column:
    """Arenas in the pool on the day; null past the last entry."""
    return F.array_except(F.array(*[F.lit(i) for i in arenas]), out_of_pool(calendar, day))


def out_by_day(entries: DataFrame, days: DataFrame) -> DataFrame:
    """(date, out) of distinct days by a calendar table; days past the last entry are not in it."""
    dated = entries.select(F.col("until_date").cast("date").alias("until"), F.col("out_arenas").cast("array<int>").alias("out")).where("until is not null").dropDuplicates(["until"])
    first = days.agg(F.min("date")).first()[0]
    if first is None:
        return days.select("date", F.lit(None).cast("array<int>").alias("out"))
    # a row for each day of the calendar at most: the one before gives the interval's start
    start = F.coalesce(F.lag("until").over(Window.orderBy("until")), F.lit(first))
    spans = dated.withColumn("start", start).where(F.col("until") > F.lit(first)).withColumn("start", F.greatest("start", F.lit(first)))

    def bin_of(day: Column) -> Column:
        return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BIN)

    bins = spans.select("start", "until", "out", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.date_sub("until", 1)))).alias("bin"))
    asked = days.select("date", bin_of(F.col("date")).alias("bin"))
    return asked.join(bins, "bin").where((F.col("start") <= F.col("date")) & (F.col("date") < F.col("until"))).select("date", "out")


def with_out(df: DataFrame, calendar: Calendar) -> DataFrame:
    """Adds ``_out``, the arenas out of the pool on the row's date; null past the last entry."""
    if not isinstance(calendar, DataFrame):
        return df.withColumn("_out", out_of_pool(calendar, F.col("date")))
    days = out_by_day(calendar, df.select("date").where("date is not null").distinct())
    return df.join(days.withColumnRenamed("out", "_out"), "date", "left").select(*df.columns, "_out")


def with_pool(df: DataFrame, calendar: Calendar, arenas: list[int]) -> DataFrame:
    """Adds ``_pool``, the arenas in the pool on the row's date; null past the last entry."""
    return with_out(df, calendar).withColumn("_pool", F.array_except(F.array(*[F.lit(i) for i in arenas]), F.col("_out"))).drop("_out")


def with_pool_flags(df: DataFrame, calendar: Calendar, arenas: list[int]) -> DataFrame:
    """One 0/1/null column ``in_pool_<arena>`` per arena."""
    flags = {f"in_pool_{i}": (~F.array_contains("_out", F.lit(i))).cast("int") for i in arenas}
    return with_out(df, calendar).withColumns(flags).drop("_out")


def for_each_arena(df: DataFrame, calendar: Calendar, arenas: list[int]) -> DataFrame:
    """One row per contest and arena in the pool on its date.

    A contest past the last calendar entry, or without any arena, keeps one row with a null arena: ``uncovered`` picks them.
    """
    return with_pool(df, calendar, arenas).withColumn("arena", F.explode_outer("_pool")).drop("_pool")


def uncovered(df: DataFrame, calendar: Calendar) -> DataFrame:
    """The contests on whose date the calendar says nothing."""
    return with_out(df, calendar).filter(F.col("_out").isNull()).drop("_out")
