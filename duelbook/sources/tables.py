"""Readers and writers for contest tables: headered CSV in, parquet (or CSV) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.sources import schemas

BAD = "_bad_record"


def typed(raw: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """Text columns -> the schema's columns, found by name; other columns, such as a leading index, are left out.

    Every value is read as text and cast on its own, so a row is good or bad whatever columns are selected later: one with
    a text that does not fit its type, or without its id (the first column), keeps the line's texts in ``_bad_record``.
    Columns that the file does not have are null, the id must be there.
    """
    found = {c.strip().lower(): c for c in raw.columns}
    key = schema.fields[0].name
    if key not in found:
        raise ValueError(f"no column {key} among {raw.columns}")
    values, wrong = [], F.lit(False)
    for field in schema.fields:
        if field.name not in found:
            values.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{found[field.name]}`")
        value = text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)
        values.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            wrong |= (F.coalesce(F.trim(text), F.lit("")) != "") & value.isNull()
    wrong |= values[0].isNull()
    line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns if c not in more])
    return raw.select(*values, *more, F.when(wrong, line).alias(BAD))


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with all columns as text. Files of one read must have the same header."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV under an explicit schema, matched by column name, with ``_bad_record``."""
    return typed(read_text_csv(spark, path), schema)


def good_rows(df: DataFrame) -> DataFrame:
    """Rows that fit the schema and have their id, the first column."""
    return df.filter(F.col(BAD).isNull()).drop(BAD)


def bad_rows(df: DataFrame) -> DataFrame:
    """The texts of the rows that do not fit, to be set aside."""
    return df.filter(F.col(BAD).isNotNull()).select(BAD)


def to_library(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(schemas.library_name(c)) for c in df.columns])


def to_file(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(schemas.file_name(c)) for c in df.columns])


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return to_library(good_rows(read_csv(spark, path, schemas.SERIES_FILE)))


def read_rated_series(spark: SparkSession, path: str) -> DataFrame:
    """Series with both ratings and their difference."""
    return to_library(good_rows(read_csv(spark, path, schemas.RATED_SERIES_FILE)))


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Games with ``acs5``, the integer five-player total, and one agent array per side."""
    raw = to_library(good_rows(read_csv(spark, path, schemas.GAMES_FILE)))
    for s in "ab":
        names = [f"{s}_agent{i}" for i in range(1, 6)]
        raw = raw.withColumn(f"{s}_agents", F.array(*names)).drop(*names)
        raw = raw.withColumn(f"{s}_acs5", F.round(F.col(f"{s}_acs") * 5).cast("long"))
    return raw


def read_upcoming(spark: SparkSession, path: str) -> DataFrame:
    return to_library(good_rows(read_csv(spark, path, schemas.UPCOMING_FILE)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return to_library(good_rows(read_csv(spark, path, schemas.LEDGER_FILE)))


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    """Team dimension; lines with fewer fields than the header are kept, the missing ones null."""
    raw = good_rows(read_csv(spark, path, schemas.TEAMS_FILE))
    return raw.select(F.col("id").alias("team_id"), "linkname", F.col("fullname").alias("name"), "abbrev", "secondary_id")


def read_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Teams of every ``<region>.csv`` (a file, or a folder of files) in the folder, as one table with the region from that name."""
    files = read_text_csv(spark, f"{folder.rstrip('/')}/*.csv").select("*", F.col("_metadata.file_path").alias("file_name"))
    # a region is one file, or one folder of files as Spark writes them
    region = F.regexp_extract("file_name", r"([^/]+)\.csv(?:/[^/]*)?$", 1)
    return good_rows(typed(files, schemas.TEAMS_FILE, "file_name")).select(
        F.col("id").alias("team_id"), "linkname", F.col("fullname").alias("name"), "abbrev", "secondary_id", region.alias("region")
    )


def write_table(df: DataFrame, path: str, season_of: str | None = None) -> None:
    """Overwrites a parquet table, optionally partitioned by the year of a date column."""
    if season_of is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.withColumn("season", F.year(season_of)).write.mode("overwrite").partitionBy("season").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV folder in the file column names."""
    to_file(df).write.mode("overwrite").option("header", True).csv(path)


def write_regions(teams: DataFrame, path: str) -> None:
    teams.write.mode("overwrite").partitionBy("region").parquet(path)


def append_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """One table from several sources, matched by column name."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
