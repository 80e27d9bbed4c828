"""Small configuration files: ordered name lists and the arena pool calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) from an ordered list with one name per line; the id is the line number from 0."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("id", "name"))
    return lines.filter(F.trim("name") != "")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'date;1,2,3' -> (from_date, until_date, out_arenas): out of the pool on [from, until).

    The first entry has no from_date.
    """
    raw = spark.read.schema("until_date date, ids string").option("sep", ";").csv(path)
    parts = F.transform(F.split("ids", ","), lambda x: F.trim(x).cast("int"))
    table = raw.select("until_date", parts.alias("out_arenas"))
    # One row per pool change, a handful per year.
    previous = F.lag("until_date").over(Window.orderBy("until_date"))
    return table.select(previous.alias("from_date"), "until_date", "out_arenas")
