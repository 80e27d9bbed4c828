"""Registered queries: name -> (spark, folder) -> DataFrame over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions import prices, text
from duelbook.functions.draft_text import with_draft
from duelbook.operators import draft, form, history, ingest, ledger, players, pool, ratings, scale, sides
from duelbook.plans import backtest, features, models
from duelbook.plans import fixtures as fx
from duelbook.session import cut, discard, scratch_path, stored
from duelbook.sources import dictionaries
from duelbook.sources import models as stored_models
from duelbook.sources import store, tables
from duelbook.streaming import ingest as streaming
from duelbook.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Windows of the train-and-bet runs over the test tables.
TRAIN_FROM, TEST_FROM, TEST_TO = "1998-01-01", "2000-06-01", "2001-08-01"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# Form and history ----------------------------------------------------------------------------


@query
def form_diff(spark, folder):
    return features.game_features(fx.games(spark, folder))


@query
def form_repeated(spark, folder):
    """Form differences of contests of which a third is listed twice: each row keeps its own figures."""
    games = fx.games(spark, folder)
    copies = F.when(F.col("arena") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    listed = games.withColumn("_copy", F.explode(copies)).drop("_copy")
    return form.form_difference(listed, form.arena_form(games), features.GAME_KEYS)


@query
def form_all_arenas(spark, folder):
    return features.second_tier_features(fx.series(spark, folder), fx.games(spark, folder))


@query
def form_extended(spark, folder):
    return features.wide_game_features(fx.wide_games(spark, folder))


@query
def arena_win_rate(spark, folder):
    return form.arena_win_rate(fx.games(spark, folder))


@query
def arena_win_rate_listed(spark, folder):
    return form.arena_win_rate(fx.games(spark, folder), n=0, perspective="listed")


@query
def arena_win_rate_wide(spark, folder):
    return form.arena_win_rate_wide(fx.games(spark, folder), history.asks_of(fx.series(spark, folder)), fx.ARENAS)


@query
def win_rate_diff(spark, folder):
    return form.win_rate_difference(fx.series(spark, folder), fx.games(spark, folder), fx.ARENAS, fx.series_columns())


@query
def trailing_3_months(spark, folder):
    games = fx.games(spark, folder)
    return form.trailing_win_rate(games, history.asks_of(games, "arena"))


# Drafts and pool -----------------------------------------------------------------------------


def _touched(series: DataFrame) -> DataFrame:
    return draft.touched_arenas(series, fx.ARENAS, ["match_id", "a", "b", "date"])


@query
def draft_rates(spark, folder):
    series = fx.series(spark, folder)
    return draft.draft_rates(series, history.asks_of(_touched(series), "arena"), fx.ARENAS, fx.CALENDAR)


@query
def draft_rates_wide(spark, folder):
    """Pick, ban, play and win rate of every side for every arena, wide per (side, date)."""
    series, games = fx.series(spark, folder), fx.games(spark, folder)
    asks = form.with_arenas(history.asks_of(series), fx.ARENAS)
    rates = draft.draft_rates(series, asks, fx.ARENAS, fx.CALENDAR)
    long = rates.join(form.arena_win_rate(games, asks).drop("games", "wins"), ["side", "arena", "date"])
    return form.wide_by_arena(long, fx.ARENAS, {"pick_rate": "pick", "ban_rate": "ban", "play_rate": "play", "win_rate": "wr"})


@query
def draft_choices(spark, folder):
    series = sides.fill_zero(sides.with_difference(fx.series(spark, folder), "past"), ["net_h2h"])
    carried = ["match_id", "a", "b", "date", "won_a", "net_h2h", "past_diff", "odds", "best_odds", "worst_odds"]
    return draft.draft_choices(series, fx.games(spark, folder), fx.ARENAS, fx.CALENDAR, carried)


@query
def draft_steps(spark, folder):
    steps = draft.draft_steps(fx.series(spark, folder), fx.ARENAS, fx.CALENDAR)
    return steps.withColumn("open_arenas", F.array_join("open_arenas", ","))


@query
def pool_flags(spark, folder):
    return pool.with_pool_flags(fx.series(spark, folder).select("match_id", "date"), fx.CALENDAR, fx.ARENAS)


@query
def pool_arenas(spark, folder):
    rows = fx.series(spark, folder).select("match_id", "a", "b", "date")
    return pool.for_each_arena(rows, fx.CALENDAR, fx.ARENAS)


@query
def pool_uncovered(spark, folder):
    return pool.uncovered(fx.series(spark, folder).select("match_id", "a", "b", "date"), fx.CALENDAR)


@query
def touched_arenas(spark, folder):
    return _touched(fx.series(spark, folder))


@query
def head_to_head(spark, folder):
    series = fx.series(spark, folder)
    return draft.head_to_head(_touched(series).drop("played"), series)


# Projections, filters, lookups ------------------------------------------------------------------


@query
def side_rows(spark, folder):
    return sides.side_rows(fx.series(spark, folder), keep=["match_id", "date", "remaining"])


@query
def date_window(spark, folder):
    return sides.between_dates(fx.series(spark, folder).select(fx.series_columns()), "1997-03-01", "1999-06-30")


@query
def both_in_set(spark, folder):
    return sides.both_in(fx.series(spark, folder).select(fx.series_columns()), fx.first_tier(spark, folder))


@query
def exclude_set(spark, folder):
    return sides.neither_in(fx.series(spark, folder).select(fx.series_columns()), fx.excluded(spark, folder))


@query
def region_label(spark, folder):
    return sides.with_regions(fx.series(spark, folder).select("match_id", "a", "b"), fx.regions(spark, folder)).select(
        "match_id", "a", "b", "a_region", "b_region"
    )


@query
def regional(spark, folder):
    return sides.regional(fx.series(spark, folder).select(fx.series_columns()), fx.regions(spark, folder))


@query
def cross_region(spark, folder):
    return sides.cross_region(fx.series(spark, folder).select(fx.series_columns()), fx.regions(spark, folder))


@query
def named_sides(spark, folder):
    return sides.with_names(fx.series(spark, folder).select("match_id", "a", "b"), fx.teams(spark, folder)).select(
        "match_id", "a", "b", "a_name", "b_name"
    )


@query
def null_drop(spark, folder):
    rows = fx.series(spark, folder).select("match_id", "date", "net_h2h", "odds", "pred")
    return sides.drop_nulls(rows)


@query
def null_drop_subset(spark, folder):
    rows = fx.series(spark, folder).select("match_id", "date", "net_h2h", "odds", "pred")
    return sides.drop_nulls(rows, ["odds"])


@query
def null_fill(spark, folder):
    return sides.fill_zero(fx.series(spark, folder).select("match_id", "net_h2h", "odds"))


@query
def score_winner(spark, folder):
    rows = fx.series(spark, folder).select("match_id", "a_past", "b_past")
    return sides.with_winner(rows, "a_past", "b_past")


@query
def past_diff(spark, folder):
    return sides.with_difference(fx.series(spark, folder).select("match_id", "a_past", "b_past"), "past")


@query
def undecided(spark, folder):
    return sides.decided(fx.staged(spark, folder).select("match_id", "a_text", "b_text"))


# Scaling and winshare ---------------------------------------------------------------------------


@query
def max_abs(spark, folder):
    rows = sides.with_difference(fx.series(spark, folder), "past").select("match_id", "net_h2h", "past_diff", "pred")
    return scale.scaled(rows, ["net_h2h", "past_diff", "pred"])


def _chances(spark, folder) -> DataFrame:
    """Arena rows with made-to-check chances in exact binary fractions."""
    m, arena = F.col("match_id"), F.col("arena")
    a_chance = (1 + (m * 13 + arena * 7) % 127).cast("double") / 128
    return _touched(fx.series(spark, folder)).drop("played").withColumns({
        "play_prob": ((m * 31 + arena * 17) % 101).cast("double") / 128,
        "a_chance": a_chance, "b_chance": 1.0 - a_chance,
    })


@query
def drop_least_likely(spark, folder):
    return scale.drop_least_likely(_chances(spark, folder)).select("match_id", "arena", "play_prob")


@query
def winshare(spark, folder):
    return scale.winshare(scale.drop_least_likely(_chances(spark, folder)), ["match_id", "a", "b", "date"])


@query
def winshare_weighted(spark, folder):
    kept = scale.drop_least_likely(_chances(spark, folder))
    return scale.winshare(kept, ["match_id", "a", "b", "date"], weight="play_prob")


# Ratings ----------------------------------------------------------------------------------------


def _six(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query
def elo_period(spark, folder):
    series = fx.series(spark, folder).select("match_id", "a", "b", "won_a", ratings.month_number(F.col("date")).alias("period"))
    return _six(ratings.with_period_elo(series).drop("won_a"), "a_elo", "b_elo", "elo_diff").select(
        "match_id", "a", "b", "period", "a_elo", "b_elo", "elo_diff"
    )


# Back-test --------------------------------------------------------------------------------------


def _two(df: DataFrame) -> DataFrame:
    return df.withColumn("bankroll", F.round("bankroll", 2))


@query
def ledger_average(spark, folder):
    return _two(ledger.one_price_ledger(ledger.average_bets(fx.series(spark, folder))))


@query
def ledger_best_worst(spark, folder):
    return _two(ledger.ledger(ledger.best_worst_bets(fx.series(spark, folder))))


@query
def ledger_second_tier(spark, folder):
    rows = fx.series(spark, folder).withColumn("win_chance", 1.0 - F.col("pred"))
    return _two(ledger.one_price_ledger(ledger.average_bets(rows, "win_chance")))


@query
def ledger_summary(spark, folder):
    series = fx.series(spark, folder)
    lines = {"average": ledger.average_bets(series), "best_worst": ledger.best_worst_bets(series)}
    each = [ledger.summary(bets).withColumn("line", F.lit(name)) for name, bets in lines.items()]
    return tables.append_all(*each)


@query
def hit_rate(spark, folder):
    return ledger.hit_rate(fx.series(spark, folder))


@query
def earnings_by_side(spark, folder):
    bets = ledger.best_worst_bets(fx.series(spark, folder)).withColumn("bet_size", F.lit(50.0))
    return ledger.earnings_by_side(bets, fx.teams(spark, folder)).withColumn("net_earnings", F.round("net_earnings", 2))


@query
def region_report(spark, folder):
    bets = ledger.best_worst_bets(fx.series(spark, folder))
    return ledger.region_report(bets, fx.regions(spark, folder)).withColumn("net", F.round("net", 2))


# Prices and texts -------------------------------------------------------------------------------


@query
def implied_odds(spark, folder):
    staged = fx.staged(spark, folder)
    probs = prices.side_one_probabilities(text.prices(F.col("payouts")), F.col("won_a"))
    best, worst = prices.best_probability(F.col("_p")), prices.worst_probability(F.col("_p"))
    return staged.select("match_id", "won_a", probs.alias("_p")).select(
        "match_id", best.alias("best_odds"), worst.alias("worst_odds"), prices.line_probability(best, worst).alias("odds")
    )


@query
def best_decimal_odds(spark, folder):
    def best(col):
        return prices.best_decimal(F.transform(F.col(col), lambda t: t.try_cast("double")))

    return fx.staged(spark, folder).select("match_id", best("a_prices").alias("a_odds"), best("b_prices").alias("b_odds"))


@query
def expected_value(spark, folder):
    m, p = F.col("match_id"), F.col("pred")
    rows = fx.series(spark, folder).select(
        "match_id", "pred", ((m * 37) % 400 + 101).cast("double").alias("_a"), ((m * 59) % 400 + 101).cast("double").alias("_b")
    )
    a_price, b_price = F.col("_a") / 100, F.col("_b") / 100
    ev_a, ev_b = prices.expected_value(p, a_price), prices.expected_value(1.0 - p, b_price)
    return rows.select(
        "match_id", ev_a.alias("ev_a"), ev_b.alias("ev_b"), prices.pick_bet(ev_a, ev_b).alias("bet"),
        prices.expected_value_decimal(p, a_price).alias("ev_a_decimal"),
    )


@query
def url_ids(spark, folder):
    url = F.col("url")
    pages = fx.table(spark, folder, "pages").select(
        url.alias("link"), text.path_part(url, 2).alias("slug"), text.match_id(url).alias("match_id"), text.team_id(url).alias("team_id")
    )
    h = F.col("href")
    hrefs = fx.table(spark, folder, "customer").select(
        F.concat(F.lit("/team/"), F.col("c_custkey").cast("string"), F.lit("/"), F.lower("c_mktsegment")).alias("href")
    ).select(h.alias("link"), text.team_slug(h).alias("slug"), text.match_id(h).alias("match_id"), text.team_id(h).alias("team_id"))
    return pages.unionByName(hrefs)


@query
def text_numbers(spark, folder):
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    raw = fx.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(part % 3 == 0, F.lit("n/a")).otherwise(part.cast("string")).alias("maybe"),
        F.when(part % 4 == 0, F.lit("-")).otherwise(F.concat(supp.cast("string"), F.lit("x "))).alias("lead"),
        F.concat(line.cast("string"), F.lit(" ("), supp.cast("string"), F.lit(")\n")).alias("pair"),
        F.concat(line.cast("string"), F.lit(" : "), F.when(part % 5 == 0, F.lit("-")).otherwise((part % 3).cast("string"))).alias("score"),
        F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit(" 17:30:00")).alias("stamp"),
        F.date_format("l_shipdate", "yyyy/MM/dd").alias("slashed"),
    )
    won, lost = text.won_lost(F.col("pair"))
    left, right = text.score_pair(F.col("score"))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        text.number_or_zero(F.col("maybe")).alias("number"), text.leading_int(F.col("lead")).alias("lead_int"),
        won.alias("won"), lost.alias("lost"), left.alias("left_score"), right.alias("right_score"),
        text.stamp_date(F.col("stamp")).alias("stamp_day"), text.slash_date(F.col("slashed")).alias("slash_day"),
    )


@query
def h2h_net(spark, folder):
    return fx.staged(spark, folder).select(
        "match_id", text.alternating_net(F.col("h2h")).alias("net_h2h"),
        text.history_net(F.col("a_wins"), F.col("a_losses")).alias("a_net"),
        text.history_net(F.col("b_wins"), F.col("b_losses")).alias("b_net"),
    )


@query
def draft_text(spark, folder):
    return with_draft(fx.staged(spark, folder).select("match_id", "draft"), "draft", fx.ARENA_NAMES).drop("draft")


# Records, links, appends ------------------------------------------------------------------------


@query
def series_records(spark, folder):
    return ingest.series_records(fx.staged(spark, folder), fx.ARENA_NAMES)


@query
def game_records(spark, folder):
    people = fx.from_text(spark, folder, fx.PLAYERS)
    headers = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("date"))
    rows = ingest.game_records(people, headers, fx.AGENTS)
    return rows.withColumns({f"{s}_agents": F.array_join(f"{s}_agents", ",") for s in "ab"})


@query
def upcoming_records(spark, folder):
    return ingest.upcoming_records(fx.staged(spark, folder), F.lit("1998-05-01").cast("date"), days=700)


@query
def team_rows(spark, folder):
    name, key = F.col("c_name"), F.col("c_custkey")
    names = F.array(name, F.concat(F.lit("C"), key.cast("string")), F.when(key % 4 != 0, F.col("c_mktsegment")))
    variants = fx.table(spark, folder, "customer").select(
        F.concat(F.lit("/"), key.cast("string"), F.lit("/"), F.lower(F.col("c_mktsegment"))).alias("href"),
        F.posexplode(names).alias("place", "name"),
    )
    return ingest.team_rows(variants.filter(F.col("name").isNotNull()))


@query
def distinct_links(spark, folder):
    return ingest.page_links(fx.table(spark, folder, "pages"))


def _spread(pages: DataFrame) -> DataFrame:
    """Landed pages come in many files; by their bytes alone few tasks would read them all."""
    return pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism)


def _month_pages(series: DataFrame) -> DataFrame:
    """Result pages of a month: each day's mark and its links, which are written in four ways, behind a link without a date.

    Dates and links in comments, scripts and attributes are none.
    """
    m = F.col("match_id")
    address = F.concat(F.lit("/"), m.cast("string"), F.lit("/x"))
    link = F.when(m % 4 == 0, F.concat(F.lit('<a class="r 1999/09/09" href="'), address, F.lit('">x</a>'))) \
        .when(m % 4 == 1, F.concat(F.lit("<A HREF = '"), address, F.lit("'>x</A>"))) \
        .when(m % 4 == 2, F.concat(F.lit("<a data-href=/0/no href="), address, F.lit(">x</a>"))) \
        .otherwise(F.concat(F.lit('<a title=" href=/0/no " href="&#47;'), m.cast("string"), F.lit('/x?a=1&amp;b=&#x32;">x</a>')))
    days = series.groupBy("date").agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("links"))
    mark = F.concat(F.lit('<h2 data-day="1999/01/01">'), F.date_format("date", "yyyy/MM/dd"), F.lit("</h2>"))
    parts = F.array_sort(F.collect_list(F.struct("date", F.concat(mark, "links").alias("part"))))
    months = days.groupBy(F.date_format("date", "yyyyMM").alias("month")).agg(F.array_join(F.transform(parts, lambda d: d["part"]), "\n").alias("body"))
    head = F.lit("<html><!-- 2003/03/03 <a href='/0/no'> --><script>d = '2004/04/04'; s = \"<a href='/0/no'>\"</script><p>9999/99/99<a href=/")
    foot = F.lit("/undated>x</a>"), F.lit("<a name=2005/05/05></a><style>a[href='/0/no'] {}</style><a href=#top>top</a>")
    return _spread(months.select(F.concat(head, "month", foot[0], "body", foot[1]).alias("html")))


@query
def dated_links(spark, folder):
    """Match links of pages with many dates, each with the date that stands before it."""
    return ingest.dated_links(_month_pages(fx.series(spark, folder)))


@query
def high_water_mark(spark, folder):
    return ingest.high_water_mark(fx.series(spark, folder).select("date"), full_from="2021-03-30")


@query
def load_window(spark, folder):
    series = fx.series(spark, folder).select("match_id", "date")
    start = ingest.high_water_mark(series.filter(F.col("date") < "2000-01-01")).scalar()
    return ingest.links_since(series, start)


_LINE_KEY = ["l_orderkey", "l_linenumber"]


def _lines(spark, folder) -> tuple[DataFrame, list]:
    rows = fx.table(spark, folder, "lineitem").select(*_LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return rows, [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]


@query
def keep_first(spark, folder):
    rows, order = _lines(spark, folder)
    return sides.first_of_key(rows, _LINE_KEY, order).drop("l_shipdate")


@query
def incremental_append(spark, folder):
    rows, order = _lines(spark, folder)
    held = sides.first_of_key(rows.filter(F.col("l_shipdate") < "1998-01-01"), _LINE_KEY, order)
    return ingest.append_new(held, rows, _LINE_KEY, order).drop("l_shipdate")


@query
def stream_ingest(spark, folder):
    """All events and a second copy of them, deduplicated as a stream."""
    schema = fx.table(spark, folder, "events").schema
    path = f"{folder.rstrip('/')}/events*.parquet"
    twice = streaming.landed(spark, path, schema).union(streaming.landed(spark, path, schema))
    return streaming.ingest(spark, twice, ["event_id"], [F.col("ts")]).select("event_id", "user_id", "event_type", "value")


@query
def stream_state(spark, folder):
    """Events that land in two runs, some again and some late, kept first by state and committed to a store."""
    events = fx.table(spark, folder, "events")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    scratch = scratch_path(spark, "stream-state")
    kept = store.KeyedStore(spark, f"{scratch}/store", ["event_id"], events.schema, buckets=16)
    for landed in (events.filter("event_id % 4 <> 3"), events.filter("event_id % 4 = 3 or event_id % 5 = 0")):
        landed.write.mode("append").parquet(f"{scratch}/landed")
        state.run_to_store(streaming.landed(spark, f"{scratch}/landed", events.schema), kept, f"{scratch}/checkpoint", "ts", ["event_type"])
    return kept.read().select("event_id", "user_id", "event_type", "value")


def _pages(series: DataFrame) -> DataFrame:
    """Result pages of a day, with links to its matches."""
    links = F.array_join(F.transform(F.array_sort(F.collect_set("link")), lambda h: F.concat(F.lit('<a href="'), h, F.lit('">x</a>'))), "")
    return _spread(series.groupBy("date").agg(F.concat(F.lit("<p>"), F.date_format("date", "yyyy/MM/dd"), F.lit("</p>"), links).alias("html")))


def _update(spark, folder):
    staged = stored(fx.staged(spark, folder), "landed-pages")
    loaded = ingest.series_records(staged, fx.ARENA_NAMES).filter((F.col("date") < UPDATE_FROM) & (F.col("match_id") % 3 != 0))
    held, _ = ingest.good_and_quarantined(stored(loaded, "records"))
    return ingest.update(held, ingest.dated_links(_pages(staged.select("date", "link"))), staged, fx.ARENA_NAMES, "1990-01-01")


UPDATE_FROM = "2000-01-01"


@query
def update_series(spark, folder):
    """What one update appends to a table that ends on a day and misses some of its matches."""
    return _update(spark, folder)[0].select("match_id", "a", "b", "date", "won_a", "remaining")


@query
def update_quarantine(spark, folder):
    return _update(spark, folder)[1].select("match_id", "date", "problem")


def _committed(spark, folder):
    """A store filled by one append, then updated by a job that runs twice; pages carry a link without a date too."""
    staged = stored(fx.staged(spark, folder), "landed-pages")
    records = stored(ingest.series_records(staged, fx.ARENA_NAMES), "records")
    good, _ = ingest.good_and_quarantined(records)
    kept = store.KeyedStore(spark, scratch_path(spark, "series-store"), ["match_id"], good.schema, dated="date")
    order = [F.col("date"), F.col("a"), F.col("b")]
    kept.append("load", good.filter((F.col("date") < UPDATE_FROM) & (F.col("match_id") % 3 != 0)), order)
    links = ingest.dated_links(_month_pages(staged.select("match_id", "date")))
    pages = staged.withColumn("link", F.when(F.col("match_id") % 4 == 3, F.concat(F.lit("/"), F.col("match_id").cast("string"), F.lit("/x?a=1&b=2"))).otherwise(
        F.concat(F.lit("/"), F.col("match_id").cast("string"), F.lit("/x"))))
    for _ in range(2):  # the second run finds its batch committed
        ingest.run_update(kept, "update", links, pages, fx.ARENA_NAMES, "1990-01-01")
    return kept


@query
def committed_update(spark, folder):
    """The series table after a committed load and a committed update."""
    return _committed(spark, folder).read().select("match_id", "a", "b", "date", "won_a", "remaining")


@query
def committed_quarantine(spark, folder):
    """What the update has set aside in the same commit: bad records, and links without a date."""
    return _committed(spark, folder).set_aside(ingest.PROBLEMS)


@query
def csv_bad_rows(spark, folder):
    """Series written as CSV with a leading index, columns in reverse order and some broken texts, read back by name."""
    path = scratch_path(spark, "bad-csv")
    rows = fx.series(spark, folder).withColumns({"a_gamewins": F.lit(2), "b_gamewins": F.lit(0)}).drop("pred")
    wanted = [tables.schemas.library_name(f.name) for f in tables.schemas.SERIES_FILE.fields]
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in wanted]).withColumns({
        "date": F.when(F.col("match_id").cast("long") % 19 == 4, F.lit("soon")).otherwise(F.col("date")),
        "a_past": F.when(F.col("match_id").cast("long") % 23 == 5, F.lit("many")).otherwise(F.col("a_past"))})
    tables.to_file(text.select(F.lit("0").alias("index"), *reversed(wanted))).write.option("header", True).csv(path)
    raw = tables.read_csv(spark, path, tables.schemas.SERIES_FILE)
    good = tables.good_rows(raw).select("match_id", F.lit(False).alias("bad"))
    return good.unionByName(tables.bad_rows(raw).select(
        F.element_at(F.split(tables.BAD, ","), -1).cast("long").alias("match_id"), F.lit(True).alias("bad")))


@query
def names_file(spark, folder):
    """The nations' names written as an ordered list, read back as a dictionary and looked up."""
    path = scratch_path(spark, "names")
    names = fx.teams(spark, folder).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("team_id", "name"))), lambda s: s["name"]), "\n").alias("value"))
    names.coalesce(1).write.text(path)
    read = dictionaries.read_names(spark, path).select(F.col("id").cast("long").alias("team_id"), "name")
    return sides.with_names(fx.series(spark, folder).select("match_id", "a", "b"), read).select("match_id", "a", "b", "a_name", "b_name")


@query
def calendar_file(spark, folder):
    """The pool calendar written as lines, read back and used."""
    path = scratch_path(spark, "calendar")
    lines = [(f"{until};{','.join(map(str, out))}",) for until, out in fx.CALENDAR]
    spark.createDataFrame(lines, "value string").write.text(path)
    calendar = pool.calendar_entries(dictionaries.read_calendar(spark, path))
    return pool.with_pool_flags(fx.series(spark, folder).select("match_id", "date"), calendar, fx.ARENAS)


def _calendar_table(spark, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    spark.createDataFrame([(f"{until};{','.join(map(str, out))}",) for until, out in fx.CALENDAR], "value string").write.text(path)
    return dictionaries.read_calendar(spark, path)


@query
def calendar_index(spark, folder):
    """Contests by arena in the pool, with the calendar joined as a table."""
    rows = fx.series(spark, folder).select("match_id", "a", "b", "date")
    return pool.for_each_arena(rows, _calendar_table(spark, "calendar-index"), fx.ARENAS)


@query
def calendar_draft_rates(spark, folder):
    """Draft rates with the calendar joined as a table."""
    series = fx.series(spark, folder)
    return draft.draft_rates(series, history.asks_of(_touched(series), "arena"), fx.ARENAS, _calendar_table(spark, "calendar-rates"))


@query
def region_files(spark, folder):
    """One file for each region, read back with the region from the file name, used to find regional series."""
    path = scratch_path(spark, "regions")
    teams = fx.regions(spark, folder).join(fx.teams(spark, folder), "team_id").select(
        F.col("team_id").alias("id"), F.lower("name").alias("linkname"), F.col("name").alias("fullname"), F.upper(F.substring("name", 1, 3)).alias("abbrev"), "region")
    for k in range(5):  # one writer for each of the five regions of the configuration
        teams.filter(F.col("region") == f"region_{k}").drop("region").coalesce(1).write.option("header", True).csv(f"{path}/region_{k}.csv")
    read = tables.read_regions(spark, path)
    return sides.regional(fx.series(spark, folder).select(fx.series_columns()), read)


@query
def csv_round_trip(spark, folder):
    """Series written as headered CSV and read back under the explicit schema."""
    path = scratch_path(spark, "series-csv")
    rows = fx.series(spark, folder).withColumns({"a_gamewins": F.lit(2), "b_gamewins": F.lit(0)}).drop("pred")
    wanted = [f.name for f in tables.schemas.SERIES_FILE.fields]
    tables.write_csv(rows.select(*[tables.schemas.library_name(n) for n in wanted]), path)
    return tables.read_series(spark, path)


@query
def season_table(spark, folder):
    """Series stored by season, one season read back through partition pruning."""
    path = scratch_path(spark, "seasons")
    tables.write_table(fx.series(spark, folder).select(fx.series_columns()), path, season_of="date")
    return spark.read.parquet(path).filter(F.col("season") == 1999).drop("season")


# Players ----------------------------------------------------------------------------------------


@query
def player_totals(spark, folder):
    totals = players.player_totals(fx.from_text(spark, folder, fx.PLAYERS), fx.AGENTS)
    return totals.withColumn("agents", F.array_join("agents", ","))


@query
def performance_buckets(spark, folder):
    return players.performance_buckets(fx.from_text(spark, folder, fx.CELLS))


@query
def agent_win_rate(spark, folder):
    return players.agent_win_rate(fx.agent_games(spark, folder))


@query
def agent_win_rate_no_mirror(spark, folder):
    return players.agent_win_rate(fx.agent_games(spark, folder), by_arena=False)


@query
def comp_strength(spark, folder):
    return players.comp_strength(fx.agent_games(spark, folder)).withColumn("comp_wr", F.round("comp_wr", 9))


@query
def comp_strength_all_time(spark, folder):
    return players.comp_strength(fx.agent_games(spark, folder), months=None).withColumn("comp_wr", F.round("comp_wr", 9))


# Learning ---------------------------------------------------------------------------------------


@query
def seeded_split(spark, folder):
    train, test = models.split(fx.series(spark, folder).select("match_id"), ["match_id"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def feature_tables(spark, folder):
    """Scaled game features."""
    return scale.scaled(_game_rows(spark, folder), features.DIFFS)


@query
def feature_tables_draft(spark, folder):
    """Draft choices with mean rates and form differences."""
    series, games = stored(fx.series(spark, folder), "series"), fx.games(spark, folder)
    return features.choices_with_form(series, games, fx.ARENAS, fx.CALENDAR, ["match_id", "a", "b", "date", "won_a"])


def _quarter():
    """Rating period of the model runs."""
    return F.year("date") * 4 + F.quarter("date")


def _game_rows(spark, folder) -> DataFrame:
    return stored(features.game_features(fx.games(spark, folder)), "game-rows")


def _learned_rows(games: DataFrame, *more: str) -> DataFrame:
    """Of the game features what the game-winner model learns from: a key or a name is not stored with each game."""
    return stored(features.game_features(games).select(*more, "won_a", *features.DIFFS), "game-rows")


def _series_rows(spark, folder) -> DataFrame:
    """Series with the winshare that the arena-pick and game-winner models, learned from all series and games, give."""
    series, games = stored(fx.series(spark, folder), "series"), fx.games(spark, folder)
    carried = ["match_id", "elo_diff", "past_diff", "won_a"]
    wanted = features.choice_features(features.rated_series(series, _quarter()), games, fx.ARENAS, fx.CALENDAR, plain=series)
    choices = stored(wanted.select(*carried, "arena", "played", *models.AVERAGES, *features.DIFFS), "choices")
    rows = _learned_rows(games)
    pick, game = models.train_arena_pick(choices), models.train_game_winner(rows)
    discard(rows)
    scores = stored(models.series_scores(choices, pick, game, carried).filter(F.col("winshare").isNotNull()), "series-rows")
    discard(choices, series)
    return scores


def _in_range(name: str):
    return F.coalesce(F.col(name).between(0, 1), F.lit(False)).alias(f"{name}_in_range")


def _fit_and_score(rows: DataFrame, key: list[str], names: list[str], label: str) -> DataFrame:
    """Fit on the split's training part, save, load, and score the held-out part."""
    train, test = models.split(rows, key)
    path = scratch_path(rows.sparkSession, "model")
    stored_models.save_model(models.train(train, names, label), path)
    return models.predicted(stored_models.load_model(path), test, names, label, *key)


def _checked(scored: DataFrame, *key: str) -> DataFrame:
    """Held-out keys and labels, and whether chance and prediction fit each other: what a statement without the model can say."""
    return scored.select(*key, F.col("label").cast("int").alias("label"), _in_range("chance"),
                         ((F.col("chance") > 0.5) == (F.col("prediction") == 1)).alias("consistent"))


@query
def gbt_arena_pick(spark, folder):
    series, games = fx.series(spark, folder), fx.games(spark, folder)
    rows = stored(draft.draft_choices(series, games, fx.ARENAS, fx.CALENDAR, ["match_id", "a", "b", "date"]), "choices")
    key = ["match_id", "arena"]
    return _checked(_fit_and_score(rows, key, models.AVERAGES, "played"), *key)


@query
def gbt_game_winner(spark, folder):
    return _checked(_fit_and_score(_game_rows(spark, folder), ["game_id"], features.DIFFS, "won_a"), "game_id")


def _planted(rows: DataFrame, key: list[str], names: list[str], top: str, model: str) -> DataFrame:
    """What a model says of a label planted on one feature: a constant or shuffled one fails every flag."""
    rows = stored(rows.select(*key, *names, F.coalesce(F.nanvl(F.col(top), F.lit(0.0)) > 0, F.lit(False)).alias("planted")), "planted")
    train, test = models.split(rows, key)
    first, second = (models.train(train, names, "planted", maxIter=10) for _ in range(2))
    told = models.predicted(first, test, names, "planted", *key).join(
        models.predicted(second, test, names, "planted", *key).select(*key, F.col("chance").alias("again")), key)
    # every third row loses a feature that is not the planted one; it is scored all the same
    broken = test.withColumn(names[0], F.when(F.crc32(F.col(key[0]).cast("string").cast("binary")) % 3 == 0, F.lit(float("nan"))).otherwise(F.col(names[0])))
    scored = models.score(first, broken, names, "chance").agg(F.count("chance").alias("scored"))
    best = models.importances(first, names, rows).limit(1).select(F.col("feature").alias("top_feature"))
    hits, n, positives = F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    figures = told.agg(n.alias("held_out"), positives.alias("positives"), (hits > 0.95).alias("accurate"),
                       (hits - F.greatest(positives, n - positives) / n > 0.02).alias("beats_majority"), F.bool_and(F.col("chance") == F.col("again")).alias("repeats"))
    found = cut(figures.crossJoin(scored).crossJoin(best).withColumn("model", F.lit(model)))  # one row each
    discard(rows)
    return found


@query
def gbt_planted(spark, folder):
    """Game, series and second-tier models on labels planted on one of their features."""
    series, games = stored(fx.series(spark, folder), "series"), fx.games(spark, folder)
    timed = sides.with_difference(series, "past").withColumns({"elo_diff": F.col("a_past") * 3.0 - F.col("match_id") % 7, "winshare": F.col("pred")})
    return tables.append_all(
        _planted(features.game_features(games), ["game_id"], features.DIFFS, "kdr_diff", "game"),
        _planted(timed.select("match_id", *models.SERIES_FEATURES), ["match_id"], models.SERIES_FEATURES, "past_diff", "series"),
        _planted(features.second_tier_features(series, games), ["match_id"], features.DIFFS, "round_wr_diff", "second_tier"))


@query
def gbt_one_arena(spark, folder):
    """The game-winner model of arena 3, and none for an arena that was never played."""
    rows = _game_rows(spark, folder)
    train, test = models.split(rows, ["game_id"])
    found = [(arena, models.train_game_winner(train, arena)) for arena in (3, 9)]
    scored = [
        models.score(model, test.filter(F.col("arena") == 3), features.DIFFS, "chance").select(
            "game_id", F.lit(arena).alias("arena"), F.col("chance").isNull().alias("no_model"), _in_range("chance"))
        for arena, model in found
    ]
    return tables.append_all(*scored)


@query
def gbt_series_winner(spark, folder):
    return _checked(_fit_and_score(_series_rows(spark, folder), ["match_id"], models.SERIES_FEATURES, "won_a"), "match_id")


@query
def gbt_second_tier(spark, folder):
    """Scores of the bet window, and whether the ledger's row is the bet that the score asks for."""
    scored, placed = backtest.second_tier(fx.series(spark, folder), fx.games(spark, folder), TRAIN_FROM, TEST_FROM, TEST_TO)
    return _with_ledger(scored, placed, "win_chance", "odds", "odds")


def _with_ledger(scored: DataFrame, placed: DataFrame, chance: str, price_a: str, price_b: str) -> DataFrame:
    """Bets stated again from the stored chances: same rows, and the same outcome on each."""
    c, pa, pb = F.col(chance), F.col(price_a), F.col(price_b)
    side = F.when((c > pa) & (pa > 0.1), F.lit(True)).when((c < pb) & (pb < 0.9), F.lit(False))
    rows = placed.select("match_id", F.col("correct").alias("_correct"), F.lit(True).alias("_placed"))
    return scored.join(rows, "match_id", "left").select(
        "match_id", "date", F.col("won_a"), F.coalesce(c.between(0, 1), F.lit(False)).alias("in_range"),
        (side.isNotNull() == F.col("_placed").isNotNull()).alias("bet_as_stated"),
        F.coalesce(F.col("_correct") == (side == F.col("won_a")), F.lit(True)).alias("outcome_as_stated"),
    )


#: The registered search: every number of trees for one seeded choice of the other settings. The whole space is ``points=None``.
SEARCHED = {k: models.GRID["maxIter"] if k == "maxIter" else [v] for k, v in models.grid_points(models.GRID, 1)[0].items()}
FOLDS = 2


@query
def gbt_search(spark, folder):
    """Cross-validated accuracy over a part of the search space for the second-tier model, on a label planted on one feature.

    Points that differ in the number of trees are one fit for each fold. ``accurate`` asks for more than a constant reaches.
    """
    rows = features.second_tier_features(stored(fx.series(spark, folder), "series"), fx.games(spark, folder))
    train, _ = models.split(stored(rows.select("match_id", *features.DIFFS, (F.col("round_wr_diff") > 0).alias("planted")), "planted"), ["match_id"])
    _, results = models.search(train, features.DIFFS, "planted", ["match_id"], SEARCHED, points=None, folds=FOLDS, refit=False)
    found = spark.createDataFrame([(point["maxIter"], float(value)) for point, value in results], "trees int, accuracy double")
    known = train.agg(F.count(F.lit(1)).alias("rows"), F.count_if("planted").alias("positives"))
    return found.crossJoin(known).select("trees", "rows", "positives", (F.col("accuracy") > 0.95).alias("accurate"))  # three rows beside one


@query
def classification_report(spark, folder):
    scored = _fit_and_score(_game_rows(spark, folder), ["game_id"], features.DIFFS, "won_a")
    return models.report(scored).select("label", "support", *[_in_range(c) for c in ("precision", "recall", "f1")])


@query
def label_report(spark, folder):
    """The report on a plain threshold at 0.5, which a query can restate."""
    rows = fx.series(spark, folder).select(
        F.col("won_a").cast("double").alias("label"), (F.col("pred") > 0.5).cast("double").alias("prediction")
    )
    return models.report(rows)


@query
def importances(spark, folder):
    rows = _game_rows(spark, folder)
    found = models.importances(models.train_game_winner(rows), features.DIFFS, rows)
    total = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    return found.crossJoin(total).select("feature", _in_range("importance"), "total")  # seven rows beside one


@query
def train_backtest(spark, folder):
    run = backtest.train_and_test(
        stored(fx.series(spark, folder), "series"), fx.games(spark, folder), fx.regions(spark, folder), fx.excluded(spark, folder),
        fx.ARENAS, fx.CALENDAR, TRAIN_FROM, TEST_FROM, TEST_TO, period=_quarter())
    return _with_ledger(run.predictions, run.best_worst, "pred", "worst_odds", "best_odds")


CARD_FROM = "2000-10-01"


def _kept(spark, past: DataFrame, games: DataFrame) -> features.KeptCard:
    """State of the past, brought to the card's eve by three updates."""
    state_of = features.KeptCard(spark, scratch_path(spark, "kept"), fx.ARENAS, fx.CALENDAR)
    for through in ("1997-12-31", "2000-09-29", "2000-09-30"):
        state_of.update(past, games, through)
    return state_of


@query
def kept_features(spark, folder):
    """Mean rates and form differences of the card's contests from kept state."""
    series, games = fx.series(spark, folder), fx.games(spark, folder)
    later = series.filter(F.col("date") >= CARD_FROM).select("match_id", "a", "b", "date")
    return _kept(spark, series, games).features(later)


@query
def upcoming_card(spark, folder):
    """Models trained before the card's first day score every later series as if it were upcoming."""
    series, games = stored(fx.series(spark, folder), "series"), fx.games(spark, folder)
    past, later = series.filter(F.col("date") < CARD_FROM), series.filter(F.col("date") >= CARD_FROM)
    earlier_games = games.filter(F.col("date") < CARD_FROM)
    choices = stored(features.choice_features(features.rated_series(past, _quarter()), earlier_games, fx.ARENAS, fx.CALENDAR, plain=past), "choices")
    rows = _learned_rows(earlier_games, "date")
    trained, scores = backtest.train_models(choices, rows, TRAIN_FROM, CARD_FROM)
    discard(choices, rows, scores)
    card = later.withColumns({"a_odds": 1.0 / F.col("best_odds"), "b_odds": 1.0 / (1.0 - F.col("worst_odds"))})
    rows = backtest.upcoming_card(
        card, past, earlier_games, trained, fx.teams(spark, folder), fx.ARENAS, fx.CALENDAR,
        known=fx.first_tier(spark, folder), excluded=fx.excluded(spark, folder), period=_quarter(), kept=_kept(spark, past, earlier_games),
    )
    p = F.col("pred")
    bet = prices.pick_bet(prices.expected_value(p, F.col("a_odds")), prices.expected_value(1.0 - p, F.col("b_odds")))
    return rows.select(
        "match_id", "date", "a", "b", "a_name", "b_name", p.isNull().alias("no_chance"), F.coalesce(p.between(0, 1), F.lit(True)).alias("in_range"),
        bet.eqNullSafe(F.col("bet")).alias("bet_as_stated"),
    )
