"""Landed pages and extracted page fields -> links and records, with load windows and keep-first appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.functions import prices, text
from duelbook.functions.draft_text import FIELDS, with_draft
from duelbook.operators.players import player_totals
from duelbook.operators.sides import decided, first_of_key
from duelbook.session import cut
from duelbook.session import stored as written
from duelbook.sources.store import KeyedStore


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct links of all pages with their kind and ids."""
    href = pages.select(F.explode(text.links(F.col("html"))).alias("href")).distinct()
    h = F.col("href")
    return href.select(
        "href", text.link_kind(h).alias("kind"), text.team_id(h).alias("team_id"), text.match_id(h).alias("match_id"),
        F.when(h.startswith("/team/"), h.substr(F.lit(6), F.length(h))).alias("team_path"),
    )


def links_since(links: DataFrame, start: Column, dated: str = "date") -> DataFrame:
    """Links dated on or after the start of the load window."""
    return links.filter(F.col(dated) >= start)


def high_water_mark(loaded: DataFrame, dated: str = "date", full_from: str | None = None) -> DataFrame:
    """One row: the day before the newest loaded row, or ``full_from`` when nothing is loaded."""
    day = F.date_sub(F.max(dated), 1)
    return loaded.agg(F.coalesce(day, F.lit(full_from).cast("date")).alias("start_date"))


def new_rows(existing: DataFrame, arrived: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first copy of each arrived key that the existing rows do not hold: what an append has to write."""
    fresh = arrived.join(existing.select(*key).distinct(), key, "left_anti").select(arrived.columns)
    return first_of_key(fresh, key, order)


def append_new(existing: DataFrame, arrived: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Existing rows, then the new ones."""
    return existing.unionByName(new_rows(existing, arrived, key, order))


def dated_links(pages: DataFrame) -> DataFrame:
    """(href, match_id, date) of match links: the newest date (yyyy/mm/dd or yyyy-mm-dd) that stands before one of them on its page.

    A link with no date before it on any page has none: ``undated_links`` has it.
    """
    stretch = pages.select(F.explode(text.dated_hrefs(F.col("html"))).alias("s")).select("s.date", F.explode("s.hrefs").alias("href"))
    h = F.col("href")
    return stretch.where(text.link_kind(h) == "match").groupBy("href").agg(F.max("date").alias("date")).withColumn("match_id", text.match_id(h))


def undated_links(links: DataFrame) -> DataFrame:
    """Links that no load window can hold, as they have no date."""
    return links.filter(F.col("date").isNull())


def update(stored: DataFrame, links: DataFrame, staged: DataFrame, arenas: list[str], full_from: str) -> tuple[DataFrame, DataFrame]:
    """One update of the series table: the rows to append, and the records set aside with their problem.

    Links dated in the load window (from the day before the newest stored row, or ``full_from``) and not yet stored pick
    the staged pages; those become records, and of the good ones the first of each match is new. A staged page is known by
    its ``link``; pages of one link are taken in the order of their stamp. What is stored is compared once: wanted links are of
    matches it does not hold. Links without a date are in no window: ``undated_links`` has them.
    """
    start = high_water_mark(stored, full_from=full_from).scalar()
    wanted = links_since(links, start).join(stored.select("match_id").distinct(), "match_id", "left_anti")
    pages = staged.join(wanted.select(F.col("href").alias("link")).distinct(), "link", "left_semi")
    good, bad = good_and_quarantined(cut(series_records(pages, arenas)))
    return first_of_key(good, ["match_id"], [F.col("date"), F.col("a"), F.col("b")]), bad


PROBLEMS = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("date", T.DateType()), T.StructField("problem", T.StringType())])


def run_update(store: KeyedStore, batch: str, links: DataFrame, staged: DataFrame, arenas: list[str], full_from: str) -> bool:
    """One update as a job: new rows, and records and undated links with their problem, become visible with one commit.

    The load window begins the day before the newest date that the commits note, and stored matches are found by the store's
    filters, so what is stored is not read but for buckets that may hold a wanted match. False if the batch was committed before:
    then nothing is read. Pages are gone through once.
    """
    if store.holds(batch):
        return False
    start = F.date_sub(F.lit(store.newest()).cast("date"), 1) if store.newest() else F.lit(full_from).cast("date")
    recent = written(links.where(F.col("date").isNull() | (F.col("date") >= start)), "recent-links")
    wanted = cut(store.absent(recent))
    pages = staged.join(links_since(wanted, start).select(F.col("href").alias("link")).distinct(), "link", "left_semi")
    good, bad = good_and_quarantined(cut(series_records(pages, arenas)))
    undated = undated_links(wanted).select("match_id", "date", F.lit("undated link").alias("problem"))
    return store.append(batch, good, [F.col("date"), F.col("a"), F.col("b")], bad.select("match_id", "date", "problem").unionByName(undated), checked=True)


def series_records(staged: DataFrame, arenas: list[str]) -> DataFrame:
    """Extracted page fields -> series rows; ``problem`` names why a row cannot be used (null = good).

    Write them before filtering by ``problem``: a filter moves down to the fields and takes every step below it along, many times over.

    Staged columns: link, stamp, a_href, b_href, score, h2h, a_wins, a_losses, b_wins, b_losses, payouts,
    draft, and optionally a_tag.
    """
    score_a, score_b = text.score_pair(F.col("score"))
    tag = "a_tag" if "a_tag" in staged.columns else None
    first = with_draft(staged.select(
        text.match_id(F.col("link")).alias("match_id"),
        text.team_id(F.col("a_href")).alias("a"), text.team_id(F.col("b_href")).alias("b"),
        text.stamp_date(F.col("stamp")).alias("date"),
        score_a.alias("a_gamewins"), score_b.alias("b_gamewins"),
        text.alternating_net(F.col("h2h")).alias("net_h2h"),
        text.history_net(F.col("a_wins"), F.col("a_losses")).alias("a_past"),
        text.history_net(F.col("b_wins"), F.col("b_losses")).alias("b_past"),
        (text.bad_history(F.col("a_wins"), F.col("a_losses")) | text.bad_history(F.col("b_wins"), F.col("b_losses"))).alias("_history_bad"),
        F.coalesce(text.prices(F.col("payouts")), F.array().cast("array<double>")).alias("_paid"),
        "draft", *([tag] if tag else []),
    ), "draft", arenas, tag).withColumn("won_a", F.col("a_gamewins") > F.col("b_gamewins"))
    probs = prices.side_one_probabilities(F.col("_paid"), F.col("won_a"))
    priced = first.withColumn("_probs", probs).withColumns({
        "best_odds": prices.best_probability(F.col("_probs")),
        "worst_odds": prices.worst_probability(F.col("_probs")),
    }).withColumn("odds", prices.line_probability(F.col("best_odds"), F.col("worst_odds")))
    problem = (
        F.when(F.col("match_id").isNull() | F.col("a").isNull() | F.col("b").isNull(), "no id")
        .when(F.col("date").isNull(), "no date")
        .when(F.col("won_a").isNull(), "no score")
        .when(F.exists("_paid", lambda p: p.isNull()), "bad price")
        .when(F.col("_history_bad"), "bad history")
        .when(~F.col("complete"), "no draft")
    )
    return priced.select(
        "match_id", "a", "b", "won_a", *FIELDS,
        "a_gamewins", "b_gamewins", "net_h2h", "a_past", "b_past", "odds", "best_odds", "worst_odds", "date",
        problem.alias("problem"),
    )


def good_and_quarantined(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return records.filter(F.col("problem").isNull()).drop("problem"), records.filter(F.col("problem").isNotNull())


def game_records(players: DataFrame, headers: DataFrame, agents: list[int]) -> DataFrame:
    """Player rows and game headers -> one row per game with both sides' totals; ``problem`` is null for a good row."""
    totals = player_totals(players, agents)
    names = ["agents", "fks", "rating", "acs", "kills", "assists", "deaths", "unknown_agents"]
    sides = totals.groupBy("game_id").agg(*[
        F.any_value(F.when(F.col("side_no") == no, F.col(x)), ignoreNulls=True).alias(f"{s}_{x}")
        for no, s in ((1, "a"), (2, "b")) for x in names
    ])
    unknown = F.coalesce("a_unknown_agents", F.lit(0)) + F.coalesce("b_unknown_agents", F.lit(0))
    joined = headers.join(sides, "game_id")
    return joined.withColumn("problem", F.when(unknown > 0, "unknown agent")).drop("a_unknown_agents", "b_unknown_agents")


def upcoming_records(staged: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Fields of scheduled contests -> upcoming rows of the next ``days`` days with both sides known.

    A row without an id or date is kept with its ``problem``; good rows have none.

    Staged columns: link, stamp, a_text, b_text, a_href, b_href, h2h, a_wins, a_losses, b_wins, b_losses,
    a_prices, b_prices.
    """
    def best(col: str) -> Column:
        return prices.best_decimal(F.transform(F.col(col), lambda t: F.trim(t).try_cast("double")))

    known = decided(staged)
    rows = known.select(
        text.path_part(F.col("link"), 1).try_cast("bigint").alias("match_id"),
        text.path_part(F.col("a_href"), 2).try_cast("bigint").alias("a"),
        text.path_part(F.col("b_href"), 2).try_cast("bigint").alias("b"),
        text.stamp_date(F.col("stamp")).alias("date"),
        text.alternating_net(F.col("h2h")).alias("net_h2h"),
        F.coalesce(text.history_net(F.col("a_wins"), F.col("a_losses")), F.lit(0)).alias("a_past"),
        F.coalesce(text.history_net(F.col("b_wins"), F.col("b_losses")), F.lit(0)).alias("b_past"),
        best("a_prices").alias("a_odds"), best("b_prices").alias("b_odds"),
    )
    problem = F.when(F.col("match_id").isNull() | F.col("a").isNull() | F.col("b").isNull(), "no id").when(F.col("date").isNull(), "no date")
    return rows.withColumn("problem", problem).filter(F.col("date").isNull() | (F.col("date") >= today) & (F.col("date") < F.date_add(today, days)))


def team_rows(variants: DataFrame) -> DataFrame:
    """Name variants (href, place, name) -> one dimension row per team id.

    The first name is the full one, then the abbreviation, then a second id. Links without an id belong to no team:
    ``bad_team_links`` has them.
    """
    rows = variants.select(
        text.path_part(F.col("href"), 1).try_cast("bigint").alias("team_id"),
        text.path_part(F.col("href"), 2).alias("linkname"), "place", "name",
    )

    def at(place: int) -> Column:
        return F.min(F.when(F.col("place") == place, F.col("name")))

    return rows.where("team_id is not null").groupBy("team_id").agg(
        F.min("linkname").alias("linkname"), at(0).alias("name"), at(1).alias("abbrev"), at(2).alias("secondary_id")
    )


def bad_team_links(variants: DataFrame) -> DataFrame:
    """The name variants whose link holds no team id."""
    return variants.where(text.path_part(F.col("href"), 1).try_cast("bigint").isNull())
