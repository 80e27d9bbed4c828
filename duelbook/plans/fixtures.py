"""Contest tables derived from the star-schema test tables.

The texts below hold only expressions that Spark SQL and DuckDB read the same way, so the checks can
rebuild the same inputs. ``{orders}`` and the like stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAMES = """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) game_id, l_orderkey match_id,
  s_nationkey a, c_nationkey b, l_linenumber - 1 arena, cast(o_orderdate as date) date,
  cast(l_quantity as bigint) a_rds, 51 - cast(l_quantity as bigint) b_rds, cast(l_quantity as bigint) > 25 won_a,
  (l_partkey*7 + l_linenumber) % 13 a_fks, (l_partkey*5 + l_suppkey) % 13 b_fks,
  700 + (l_partkey*31 + l_suppkey) % 600 a_acs5, 700 + (l_partkey*17 + l_orderkey) % 600 b_acs5,
  40 + l_partkey % 41 a_kills, 40 + l_orderkey % 41 b_kills, l_suppkey % 23 a_assists, l_partkey % 23 b_assists,
  (l_partkey + l_orderkey) % 41 a_deaths, (l_partkey + l_suppkey) % 41 b_deaths
from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey
  join {supplier} on s_suppkey = l_suppkey where s_nationkey <> c_nationkey
"""

SERIES = """
select o_orderkey match_id, s_nationkey a, c_nationkey b, cast(o_orderdate as date) date, o_orderkey % 3 <> 0 won_a,
  (o_orderkey*4) % 11 a_ban1, (o_orderkey*4 + 3) % 11 a_ban2, (o_orderkey*4 + 6) % 11 b_ban1, (o_orderkey*4 + 9) % 11 b_ban2,
  (o_orderkey*4 + 12) % 11 a_pick, (o_orderkey*4 + 15) % 11 b_pick, (o_orderkey*4 + 18) % 11 remaining,
  case when o_orderkey % 10 = 0 then null else o_orderkey % 5 - 2 end net_h2h, o_orderkey % 9 - 4 a_past, o_custkey % 9 - 4 b_past,
  cast(5 + (o_orderkey*37) % 81 as double) / 100 worst_odds, cast(8 + (o_orderkey*37) % 81 as double) / 100 best_odds,
  case when o_orderkey % 17 = 0 then null else cast(13 + 2*((o_orderkey*37) % 81) as double) / 200 end odds,
  cast(1 + (o_orderkey*53 + o_custkey) % 99 as double) / 100 pred
from {orders} join {customer} on c_custkey = o_custkey
  join (select * from (select l_orderkey, l_suppkey, row_number() over
        (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) rn from {lineitem}) z where rn = 1) f
    on l_orderkey = o_orderkey
  join {supplier} on s_suppkey = l_suppkey where s_nationkey <> c_nationkey
"""

# Per-side columns of the nineteen-figure profile and their ranges.
WIDE_RANGES = {
    "retakes_won": 5, "retakes_lost": 4, "postplants_won": 6, "postplants_lost": 5, "atk_fks": 7, "def_fks": 6, "pistols": 3,
    "ecos_won": 4, "ecos_lost": 3, "fullbuys_won": 9, "fullbuys_lost": 8, "clutches": 3, "acs": 300, "kills": 60,
    "assists": 30, "deaths": 50, "kast": 100, "atk_rating": 200, "def_rating": 200, "mks": 12, "econ": 80,
}


def _wide_columns() -> str:
    cols = []
    for i, (name, top) in enumerate(WIDE_RANGES.items()):
        cols.append(f"(l_partkey*{2 * i + 3} + l_suppkey*{i + 1} + l_linenumber) % {top} a_{name}")
        cols.append(f"(l_orderkey*{2 * i + 3} + l_suppkey*{i + 2} + l_linenumber) % {top} b_{name}")
    return ", ".join(cols)


WIDE_GAMES = f"""
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) game_id,
  s_nationkey a, c_nationkey b, l_linenumber - 1 arena, cast(o_orderdate as date) date, cast(l_quantity as bigint) > 25 won_a,
  cast(l_quantity as bigint) a_rds, 51 - cast(l_quantity as bigint) b_rds, {_wide_columns()}
from {{lineitem}} join {{orders}} on o_orderkey = l_orderkey join {{customer}} on c_custkey = o_custkey
  join {{supplier}} on s_suppkey = l_suppkey where s_nationkey <> c_nationkey
"""

PLAYERS = """
select l_orderkey game_id, 1 + l_linenumber % 2 side_no, cast(l_partkey % 24 as int) agent, l_suppkey % 5 fks, l_partkey % 31 kills,
  l_orderkey % 19 deaths, l_suppkey % 17 assists, 100 + l_partkey % 200 acs, cast(l_suppkey % 3 as double) / 4 rating
from {lineitem}
"""

CELLS = """
select l_orderkey game_id, 1 + l_linenumber % 2 side_no, cast(2 + l_partkey % 12 as int) col,
  case when l_suppkey % 4 = 0 then '' when l_suppkey % 4 = 1 then concat(cast(l_suppkey % 7 as varchar(9)), ' (x)')
       when l_suppkey % 4 = 2 then concat(' ', cast(l_suppkey % 9 as varchar(9))) else '-' end text
from {lineitem}
"""

# Pool calendar: until date -> arenas out of the pool before it. Orders run past the last entry.
CALENDAR = [
    ("1996-03-01", [0, 4, 7, 9]), ("1997-08-01", [1, 3, 8, 10]), ("1998-07-15", [2, 6, 7, 9]),
    ("1999-04-01", [0, 5, 8, 10]), ("2000-08-01", [1, 4, 6, 9]), ("2001-05-01", [2, 3, 7, 8]),
]
ARENAS = list(range(11))
# Arena names by id.
ARENA_NAMES = ["Ascent", "Bind", "Breeze", "Fracture", "Haven", "Icebox", "Lotus", "Pearl", "Split", "Sunset", "Abyss"]
AGENTS = list(range(24))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def from_text(spark: SparkSession, folder: str, text: str) -> DataFrame:
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def games(spark: SparkSession, folder: str) -> DataFrame:
    return from_text(spark, folder, GAMES)


def series(spark: SparkSession, folder: str) -> DataFrame:
    return from_text(spark, folder, SERIES)


def wide_games(spark: SparkSession, folder: str) -> DataFrame:
    return from_text(spark, folder, WIDE_GAMES)


def agent_games(spark: SparkSession, folder: str) -> DataFrame:
    """Games with five agent ids per side, taken from the combat score."""
    def five(col: str):
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col(col) + 5 * i) % 24).cast("int"))

    return games(spark, folder).select(
        "game_id", "a", "b", "arena", "date", "won_a", five("a_acs5").alias("a_agents"), five("b_acs5").alias("b_agents")
    )


def teams(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Region of each listed team; keys 23 and 24 are left unlisted."""
    listed = table(spark, folder, "nation").filter("n_nationkey < 23")
    return listed.select(F.col("n_nationkey").alias("team_id"), F.concat(F.lit("region_"), "n_regionkey").alias("region"))


def first_tier(spark: SparkSession, folder: str) -> DataFrame:
    return teams(spark, folder).filter("team_id < 20")


def excluded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").filter("n_regionkey = 3").select(F.col("n_nationkey").alias("team_id"))


def series_columns() -> list[str]:
    return ["match_id", "a", "b", "date", "won_a"]


# Text fields as a page would show them, built from the series columns.
STAGED = """
select match_id, a, b, date, won_a, a_past, b_past,
  concat('/', cast(match_id as varchar(20)), '/side-', cast(a as varchar(9)), '-vs-side-', cast(b as varchar(9))) link,
  concat(cast(date as varchar(10)), ' 18:00:00') stamp,
  concat('/team/', cast(a as varchar(9)), '/side-', cast(a as varchar(9))) a_href,
  concat('/team/', cast(b as varchar(9)), '/side-', cast(b as varchar(9))) b_href,
  case when won_a then ' 2 : 1 ' when match_id % 2 = 0 then '0 : 2' else '–' end score,
  case when match_id % 13 = 0 then 'bans unknown' else concat(
    'T', cast(a as varchar(9)), ' ban ', {ban1}, '; U', cast(b as varchar(9)), ' ban ', {ban2}, '; T', cast(a as varchar(9)), ' pick ', {pick1},
    '; U', cast(b as varchar(9)), ' pick ', {pick2}, '; T', cast(a as varchar(9)), ' ban ', {ban3}, '; ',
    case when match_id % 7 = 0 then '' when match_id % 7 = 1 then concat('Third ban ', {ban4}, '; ')
         else concat('U', cast(b as varchar(9)), ' ban ', {ban4}, '; ') end,
    case when match_id % 7 = 2 then '' else concat({rest}, ' remains') end) end draft,
  match_id % 7 k7, match_id % 13 k13, match_id % 5 k5, match_id % 11 k11,
  a_ban1, a_ban2, b_ban1, b_ban2, a_pick, b_pick, remaining
from {series}
"""


def arena_name(col: str) -> str:
    return f"split_part('{','.join(ARENA_NAMES)}', ',', cast({col} + 1 as int))"


def staged_text(series_table: str) -> str:
    return STAGED.format(
        series=series_table, ban1=arena_name("a_ban1"), ban2=arena_name("b_ban1"), pick1=arena_name("a_pick"),
        pick2=arena_name("b_pick"), ban3=arena_name("a_ban2"), ban4=arena_name("b_ban2"), rest=arena_name("remaining"),
    )


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """Landed page fields of every series: texts and text arrays."""
    # the tables of one file give one task; landed pages come in many
    contests = series(spark, folder).repartition(spark.sparkContext.defaultParallelism, "match_id")
    rows = spark.sql(staged_text("{series}"), series=contests)
    m = F.col("match_id")

    def texts(*values):
        return F.array(*[v.cast("string") for v in values])

    h2h = texts(m % 4, m % 3, m % 5, m % 2, F.when(F.col("k11") == 0, F.lit("-")).otherwise((m % 6).cast("string")), m % 7,
                m % 8, m % 9, m % 10, m % 11, m % 12, m % 13)
    money = [F.concat(F.lit("$"), v.cast("string")) for v in ((m * 37) % 400 + 100, (m * 53) % 500 + 100)]
    third = F.when(F.col("k7") == 3, F.lit("$0")).otherwise(F.concat(F.lit("$"), ((m * 71) % 90 + 60).cast("string")))
    payouts = F.when(F.col("k5") == 0, F.array().cast("array<string>")).otherwise(F.array(*money, third))
    return rows.withColumns({
        "h2h": F.when(F.col("k13") == 1, F.lit(None)).otherwise(h2h),
        "a_wins": texts(m % 3, m % 4), "a_losses": texts(m % 2, m % 5),
        "b_wins": texts(m % 5), "b_losses": texts(m % 4),
        "payouts": payouts,
        "a_text": F.when(F.col("k11") == 5, F.lit(" TBD ")).otherwise(F.concat(F.lit("Side "), F.col("a").cast("string"))),
        "b_text": F.concat(F.lit("Side "), F.col("b").cast("string")),
        "a_prices": texts((m * 37 % 300 + 80).cast("double") / 100, (m * 41 % 300 + 80).cast("double") / 100),
        "b_prices": F.when(F.col("k5") == 0, F.array().cast("array<string>")).otherwise(texts((m * 43 % 300 + 80).cast("double") / 100)),
    })
