import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.functions import text
from duelbook.operators import ingest
from duelbook.operators.sides import first_of_key
from duelbook.plans import queries
from duelbook.sources.store import KeyedStore
from duelbook.streaming import ingest as streaming
from duelbook.streaming import state

NAMES = ["Alpha", "Bravo", "Coda", "Dune", "Echo", "Forge", "Grove"]
DRAFT = "A ban Alpha; B ban Bravo; A pick Coda; B pick Dune; A ban Echo; B ban Forge; Grove remains"
STAGED = ("link string, stamp string, a_href string, b_href string, score string, h2h array<string>, a_wins array<string>, "
          "a_losses array<string>, b_wins array<string>, b_losses array<string>, payouts array<string>, draft string")


def page(**over):
    base = dict(link="/123/x-vs-y", stamp="2024-05-01 12:00:00", a_href="/team/1/x", b_href="/team/2/y", score="2 : 1", h2h=["2", "1"],
                a_wins=["2"], a_losses=["1"], b_wins=None, b_losses=None, payouts=["$200", "$160"], draft=DRAFT)
    return tuple((base | over).values())


def test_series_records_and_quarantine(spark):
    rows = [page(), page(link="/nothing"), page(stamp="soon"), page(score="– : –"), page(payouts=["$abc"]), page(draft="none"), page(score="0 : 2", payouts=[]),
            page(b_wins=["1", "x"], b_losses=["0", "1"])]
    good, bad = ingest.good_and_quarantined(ingest.series_records(spark.createDataFrame(rows, STAGED), NAMES))
    assert sorted(r.problem for r in bad.collect()) == ["bad history", "bad price", "no date", "no draft", "no id", "no score"]
    won, lost = sorted(good.collect(), key=lambda r: -r.a_gamewins)
    assert (won.match_id, won.a, won.b, won.won_a, won.date, won.net_h2h, won.a_past, won.b_past) == (123, 1, 2, True, dt.date(2024, 5, 1), 1, 1, None)
    assert (won.a_ban1, won.a_ban2, won.b_ban1, won.b_ban2, won.a_pick, won.b_pick, won.remaining) == (0, 4, 1, 5, 2, 3, 6)
    assert (won.best_odds, won.worst_odds, won.odds) == (0.625, 0.5, 0.5625)
    assert (lost.won_a, lost.best_odds, lost.worst_odds, lost.odds) == (False, 0.0, 1.0, None)


def test_upcoming_records(spark):
    schema = STAGED.replace("payouts array<string>, draft string", "a_prices array<string>, b_prices array<string>, a_text string, b_text string")
    def row(**over):
        base = dict(link="/9/x", stamp="2024-05-03 10:00:00", a_href="/team/1/x", b_href="/team/2/y", score="", h2h=None, a_wins=None, a_losses=None,
                    b_wins=["1"], b_losses=["3"], a_prices=["1.5", "1.7"], b_prices=[], a_text="X", b_text="Y")
        return tuple((base | over).values())
    df = spark.createDataFrame([row(), row(a_text=" TBD "), row(stamp="2024-05-08 10:00:00"), row(stamp="2024-05-07 23:00:00", link="/10/x"), row(link="/x"), row(stamp="?")], schema)
    good, bad = ingest.good_and_quarantined(ingest.upcoming_records(df, F.lit("2024-05-01").cast("date"), 7))
    got = good.orderBy("match_id").collect()
    assert [tuple(r) for r in got] == [(9, 1, 2, dt.date(2024, 5, 3), None, 0, -2, 1.7, 1.0), (10, 1, 2, dt.date(2024, 5, 7), None, 0, -2, 1.7, 1.0)]
    assert sorted(r.problem for r in bad.collect()) == ["no date", "no id"]


def test_links_and_append(spark):
    html = '<a href="/team/17/side">x</a><a href="/55/a-vs-b">y</a><a href="/team/17/side">z</a><a href=\'/event/3\'>e</a>'
    links = {r.href: (r.kind, r.team_id, r.match_id, r.team_path) for r in ingest.page_links(spark.createDataFrame([("u", html)], "url string, html string")).collect()}
    assert links == {"/team/17/side": ("team", 17, 17, "/17/side"), "/55/a-vs-b": ("match", None, 55, None), "/event/3": ("event", None, None, None)}
    held = spark.createDataFrame([(1, "old")], "k int, v string")
    arrived = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, "c")], "k int, v string")
    got = sorted(tuple(r) for r in ingest.append_new(held, arrived, ["k"], [F.col("v")]).collect())
    assert got == [(1, "old"), (2, "a"), (3, "c")]
    empty = spark.createDataFrame([], "date date")
    assert ingest.high_water_mark(empty, full_from="2021-03-30").first().start_date == dt.date(2021, 3, 30)


def test_links_are_read_from_tags(spark):
    def found(html):
        return [(str(r.date) if r.date else None, r.hrefs) for r in spark.createDataFrame([(html,)], "html string").select(
            F.explode(text.dated_hrefs(F.col("html"))).alias("s")).select("s.*").collect()]

    assert found("<!-- <a href='/1/no'> 2001-01-01 --><a href=/13/q>x</a>") == [(None, ["/13/q"])]
    assert found('<p>2024/03/05</p><a href="/1/a">x</a>2023-01-02 <A\nHREF = \'/2/b\' >2023/13/45<a href=/3/c/>x') == [
        (None, []), ("2024-03-05", ["/1/a"]), ("2023-01-02", ["/2/b", "/3/c/"])]
    assert found('<a title="2024/01/01 href=/0/no" data-href="/0/no" href="/5/x?a=1&amp;b=&#x20AC;&lt;&amp;#47;&#0;&bogus;">') == [(None, ["/5/x?a=1&b=€<&#47;&#0;&bogus;"])]
    assert found("<script>'<a href=/0/no>' 2024/01/01</script><style>a</style><area href=/6/x><link href=/0/no><a name=x>12024/01/01 2024/01/012") == [(None, ["/6/x"])]
    assert found("<a href='/7/x'><!-- 2024/01/01 <a href='/0/no'>") == [(None, ["/7/x"])] and found("") == [(None, [])]
    for junk in ("<a " * 60_000, '<a "' * 60_000, "<a x=" + "y z=" * 60_000, "<!--" * 60_000, "<" * 200_000, '<a ' + 'x="1" ' * 30_000 + 'href="/8/x">'):
        assert found(junk + "<a href=/9/x>")[0][1][-1:] in ([], ["/9/x"])  # in linear time, and without a deep stack


def test_undated_links_are_not_lost(spark):
    pages = spark.createDataFrame([("<a href=/1/x>2024/03/05<a href=/2/x>2023/01/02<a href=/3/x><a href=/2/x>",), ("<a href=/3/x>",), (None,)], "html string")
    links = ingest.dated_links(pages)
    assert {(r.match_id, r.date) for r in links.collect()} == {(1, None), (2, dt.date(2024, 3, 5)), (3, dt.date(2023, 1, 2))}
    assert [r.match_id for r in ingest.undated_links(links).collect()] == [1]
    assert [r.match_id for r in ingest.links_since(links, F.lit("2023-06-01").cast("date")).collect()] == [2]


def test_team_rows(spark):
    df = spark.createDataFrame([("/1/one", 0, "One"), ("/1/one", 1, "O"), ("/2/two", 0, "Two"), ("/2/two", 1, "T"), ("/2/two", 2, "77")], "href string, place int, name string")
    df = df.union(spark.createDataFrame([("/x/y", 0, "Bad"), (None, 0, "None")], df.schema))
    assert sorted(r.name for r in ingest.bad_team_links(df).collect()) == ["Bad", "None"]
    assert sorted(tuple(r) for r in ingest.team_rows(df).collect()) == [(1, "one", "One", "O", None), (2, "two", "Two", "T", "77")]


def test_stream_goes_on_after_a_restart_and_loses_no_late_row(spark, tmp_path):
    src, out, check, table = (str(tmp_path / x) for x in ("src", "out", "check", "table"))
    rows = [(1, dt.datetime(2024, 1, 9, 1)), (2, dt.datetime(2024, 1, 9, 2)), (1, dt.datetime(2024, 1, 9, 1))]
    first = spark.createDataFrame(rows, "id long, ts timestamp")
    first.coalesce(1).write.mode("append").parquet(src)
    read = lambda: streaming.landed(spark, src, first.schema, files_per_trigger=1)
    streaming.run_to_parquet(streaming.keep_first_stream(read(), ["id"], "ts"), out, check)
    streaming.run_append_new(read(), table, check + "-t", ["id"], [F.col("ts")])
    more = [(2, dt.datetime(2024, 1, 9, 2)), (3, dt.datetime(2024, 1, 9, 3)), (4, dt.datetime(2024, 1, 2, 3))]  # the last is a week late
    spark.createDataFrame(more, first.schema).coalesce(1).write.mode("append").parquet(src)
    streaming.run_to_parquet(streaming.keep_first_stream(read(), ["id"], "ts"), out, check)
    streaming.run_append_new(read(), table, check + "-t", ["id"], [F.col("ts")])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    whole = first_of_key(spark.read.parquet(src), ["id"], [F.col("ts")])
    assert sorted((r.id, r.ts) for r in spark.read.parquet(table).collect()) == sorted((r.id, r.ts) for r in whole.collect())


def test_update_twice(spark):
    html = lambda day, *ids: f"<p>{day}</p>" + "".join(f'<a href="/{i}/x-vs-y">m</a>' for i in ids)
    pages = spark.createDataFrame([("u", html("2024/05/02", 121, 123)), ("v", html("2024/04/01", 90)), ("w", html("none", 95))], "url string, html string")
    links = ingest.dated_links(pages)
    assert {(r.match_id, r.date) for r in links.collect()} == {(121, dt.date(2024, 5, 2)), (123, dt.date(2024, 5, 2)), (90, dt.date(2024, 4, 1)), (95, None)}
    staged = spark.createDataFrame([page(link="/123/x-vs-y"), page(link="/121/x-vs-y", draft="none"), page(link="/90/x-vs-y"), page(link="/123/x-vs-y")], STAGED)
    records = ingest.series_records(staged, NAMES).drop("problem")
    stored = records.where("match_id = 0")
    fresh, bad = ingest.update(stored, links, staged, NAMES, "2024-04-20")
    assert [r.match_id for r in fresh.collect()] == [123] and [(r.match_id, r.problem) for r in bad.collect()] == [(121, "no draft")]
    again, _ = ingest.update(stored.unionByName(fresh), links, staged, NAMES, "2024-04-20")
    assert again.isEmpty()


def test_unknown_agents_are_a_problem(spark):
    people = spark.createDataFrame([(1, s, a, 1, 1, 1, 1, 1, 1.0) for s in (1, 2) for a in (0, 1, 2, 3, 99 if s == 2 else 4)],
                                   "game_id long, side_no int, agent int, fks int, kills int, deaths int, assists int, acs int, rating double")
    row = ingest.game_records(people, spark.createDataFrame([(1,)], "game_id long"), list(range(5))).first()
    assert row.a_agents == [0, 1, 2, 3, 4] and row.b_agents == [0, 1, 2, 3] and row.problem == "unknown agent"


def test_stateful_stream_counts_and_late_rows(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("ts", T.TimestampType())])
    store = KeyedStore(spark, f"{tmp_path}/store", ["id"], schema, buckets=4)
    landed = [
        [(1, "b", at(9, 1)), (1, "a", at(9, 1)), (2, "x", at(9, 2)), (1, "c", at(9, 1)), (3, "x", at(9, 3))],
        [(2, "y", at(9, 2)), (4, "late", at(2, 1)), (5, "far", at(20, 1)), (3, "z", at(9, 4)), (4, "late too", at(2, 2))],
        [(1, "old", at(9, 1)), (6, "late", at(9, 1)), (2, "new again", at(21, 1)), (5, "f", at(20, 1)), (7, "new", at(20, 2))],
    ]
    every = []
    for rows in landed:
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        stream = streaming.landed(spark, f"{tmp_path}/src", schema, files_per_trigger=1)
        state.run_to_store(stream, store, f"{tmp_path}/check", "ts", ["v"])
        state.run_to_store(stream, store, f"{tmp_path}/check", "ts", ["v"])  # nothing new
    assert sorted((r.id, r.v) for r in store.read().collect()) == [(1, "a"), (2, "x"), (3, "x"), (4, "late"), (5, "far"), (6, "late"), (7, "new")]
    counts = {r.kind: r.rows for r in state.told(store).collect()}
    # late: 4 twice, and in the third batch 1 (its state is gone) and 6; repeats: 1 twice, 2, 3 and 5
    assert counts == {"late": 4, "repeat": 5}
    # 2 comes again with a new time when its state is gone: the filters find it
    assert len(every) - len({r[0] for r in every}) == counts["repeat"] + 2 + 1


class _Handle:
    """State and timers of one shard, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):  # noqa: N802 (Spark calls it by this name)
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class _Time:
    def __init__(self, watermark, fired=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: watermark, lambda: fired


def test_state_is_asked_for_once_a_shard(spark):
    row, handle = Row("id", "v", "_at", "_key"), _Handle()
    keep = state.KeepFirst(["id", "v"], ["v"], 100)
    keep.init(handle)
    opened = keep.handleInputRows((0,), iter([row(i, "x", 1000 + i, f"[{i}]") for i in range(500)]), _Time(0))
    assert [tuple(r) for r in opened] == [(i, "x", "first", 1) for i in range(500)]
    assert handle.calls <= 3 and handle.timers == {1100}
    keep.handleExpiredTimer((0,), _Time(1590, 1100), _Time(1590, 1100))  # keys 0 to 489 end before the watermark
    handle.timers.discard(1100)
    assert handle.timers == {1590} and handle.calls <= 6
    got = keep.handleInputRows((0,), iter([row(3, "x", 1003, "[3]"), row(495, "y", 1495, "[495]"), row(495, "z", 9, "[495]"), row(600, "b", 1600, "[600]"), row(600, "a", 1600, "[600]")]), _Time(1590))
    assert [tuple(r) for r in got] == [(3, "x", "late", 1), (600, "a", "first", 1), (None, None, "repeat", 2), (None, None, "repeat", 1)]
    keep.handleExpiredTimer((0,), _Time(9000, 1590), _Time(9000, 1590))
    assert handle.value is None


def test_stateful_stream_keys_of_any_kind(spark, tmp_path):
    at, stamp = dt.datetime(2024, 1, 9, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.TimestampType()),
                           T.StructField("v", T.LongType()), T.StructField("ts", T.TimestampType())])
    keys = [("x", 0.0, stamp), ("x", float("nan"), stamp), ("x", 1.0, None), ('x","', 1.0, stamp), ("x", 1.0, stamp + dt.timedelta(microseconds=1)), ("", 1.0, stamp)]
    again = [("x", -0.0, stamp), *keys[1:]]
    spark.createDataFrame([(*k, 2**53 + 1, at) for k in keys] + [(*k, 2**53 + 3, at) for k in again], schema).write.parquet(f"{tmp_path}/src")
    store = KeyedStore(spark, f"{tmp_path}/store", ["a", "d", "t"], schema, buckets=2)
    state.run_to_store(streaming.landed(spark, f"{tmp_path}/src", schema), store, f"{tmp_path}/check", "ts", ["v"])
    assert [r.v for r in store.read().collect()] == [2**53 + 1] * len(keys)
    assert {r.kind: r.rows for r in state.told(store).collect()} == {"repeat": len(keys)}


def test_a_committed_update_is_not_worked_on_again(spark, tmp_path):
    pages = spark.createDataFrame([("<a href=/5/x>2024/05/02<a href=/121/x-vs-y><a href=/123/x-vs-y>",)], "html string")
    staged = spark.createDataFrame([page(), page(link="/121/x-vs-y", draft="none")], STAGED)
    schema = ingest.series_records(staged, NAMES).drop("problem").schema
    store = KeyedStore(spark, f"{tmp_path}/store", ["match_id"], schema, buckets=2, dated="date")
    links = ingest.dated_links(pages)
    assert ingest.run_update(store, "one", links, staged, NAMES, "2024-04-20") and store.holds("one") and not store.holds("two")
    never = links.withColumn("date", F.raise_error(F.lit("read again")).cast("date"))
    assert not ingest.run_update(store, "one", never, staged, NAMES, "2024-04-20")
    assert [r.match_id for r in store.read().collect()] == [123]
    assert sorted(tuple(r)[::2] for r in store.set_aside(ingest.PROBLEMS).collect()) == [(5, "undated link"), (121, "no draft")]


def test_update_reads_each_draft_once(spark, monkeypatch):
    rows = [page(link=f"/{i}/x-vs-y", stamp=f"{1990 + i}-05-01 12:00:00") for i in range(1, 13)]
    staged = spark.createDataFrame(rows, STAGED).withColumns({
        "match_id": text.match_id(F.col("link")), "date": text.stamp_date(F.col("stamp"))})
    monkeypatch.setattr(queries.fx, "staged", lambda *_: staged)
    monkeypatch.setattr(queries.fx, "ARENA_NAMES", NAMES)
    plans = []
    for name in ("cut", "stored"):
        def noted(df, *more, real=getattr(queries, name)):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return real(df, *more)
        monkeypatch.setattr(queries, name, noted)
    fresh, bad = queries._update(spark, "")
    assert plans and not [p for plan in plans for p in plan.splitlines() if "Filter" in p and "regexp_extract_all" in p]
    assert sorted(r.match_id for r in fresh.collect()) == [9, 10, 11, 12] and bad.isEmpty()


def test_pages_of_few_bytes_are_read_by_many_tasks(spark):
    series = spark.range(3000).select(F.col("id").alias("match_id"), F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("date"))
    for pages in (queries._month_pages(series), queries._pages(series.select("date", F.concat(F.lit("/"), F.col("match_id"), F.lit("/x")).alias("link")))):
        assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert ingest.dated_links(pages).where("date is not null").count() == 3000
