import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelbook.operators import ledger, pool, sides
from duelbook.sources import dictionaries, tables

# Own rows: 40 at 0.25 on side 1, 0.8 on side 2, and 0.5 on side 1.
LEDGER = """match_id,t1,t2,correct,date,bankroll,betsize,earnings,bet_size,best_odds,worst_odds
41,7,3,True,2031-05-02,1150.0,50,150.0,50,0.3,0.25
42,3,9,False,2031-05-02,1100.0,50,200.0,50,0.8,0.75
40,9,7,True,2031-05-03,1150.0,50,50.0,50,0.6,0.5
"""


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ledger_file_and_side_earnings(spark, tmp_path):
    rows = tables.read_ledger(spark, put(tmp_path / "l.csv", LEDGER))
    assert rows.columns[:3] == ["match_id", "a", "b"] and rows.count() == 3
    # The bet side follows from the price: 50/worst - 50 on a, 50/(1 - best) - 50 on b.
    on_a = F.abs(F.col("earnings") - (50 / F.col("worst_odds") - 50)) < 1e-6
    on_b = F.abs(F.col("earnings") - (50 / (1 - F.col("best_odds")) - 50)) < 1e-6
    assert [(r.a, r.b) for r in rows.orderBy("date", "match_id").select(on_a.alias("a"), on_b.alias("b")).collect()] == [(True, False), (False, True), (True, False)]
    money = rows.withColumn("profit", F.when(F.col("correct"), F.col("earnings")).otherwise(-F.col("bet_size")).cast(ledger.MONEY))
    run = {r.match_id: (float(r.run) + 1000, r.bankroll) for r in ledger.running_sum(money, "profit", "run").collect()}
    assert all(a == b for a, b in run.values()) and run[40][0] == 1150.0
    teams = spark.createDataFrame([(7, "x"), (9, "y")], "team_id long, name string")
    net = {r.team_id: round(r.net_earnings, 4) for r in ledger.earnings_by_side(rows, teams).collect()}
    assert net == {7: 150.0 - 50.0, 3: -50.0 - 50.0, 9: 200.0 + 50.0}


def test_short_team_rows_regions_and_names(spark, tmp_path):
    folder = tmp_path / "teams"
    folder.mkdir()
    put(folder / "east.csv", "id,linkname,fullname,abbrev,secondary_id\n1,one,One,O\n2,two,Twö,T,9\n")
    put(folder / "west.csv", "id,linkname,fullname,abbrev,secondary_id\n3,three,Three,H,\n")
    regions = tables.read_regions(spark, str(folder))
    assert sorted((r.team_id, r.region, r.name) for r in regions.collect()) == [(1, "east", "One"), (2, "east", "Twö"), (3, "west", "Three")]
    tables.write_regions(regions, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("region = 'east'").count() == 2
    contests = spark.createDataFrame([(1, 2), (1, 3), (8, 9), (1, 8)], "a long, b long")
    assert [(r.a, r.b) for r in sides.regional(contests, regions).collect()] == [(1, 2)]
    assert sorted((r.a, r.b) for r in sides.cross_region(contests, regions).collect()) == [(1, 3), (1, 8), (8, 9)]
    assert sides.with_names(contests.filter("a = 1 and b = 2"), regions, strict=True).first().b_name == "Twö"
    try:
        sides.with_names(contests, regions, strict=True).collect()
    except Exception as error:
        assert "no team with id 8" in str(error) or "no team with id 9" in str(error)
    else:
        raise AssertionError("an unknown id must fail")


def test_dictionaries(spark, tmp_path):
    names = dictionaries.read_names(spark, put(tmp_path / "n.txt", "Alpha\nBravo\nCoda"))
    assert [(r.id, r.name) for r in names.orderBy("id").collect()] == [(0, "Alpha"), (1, "Bravo"), (2, "Coda")]
    table = dictionaries.read_calendar(spark, put(tmp_path / "c.txt", "2031-02-03;4,7\n2031-08-09;0,2\n"))
    assert [(r.from_date, r.until_date, r.out_arenas) for r in table.orderBy("until_date").collect()] == [
        (None, dt.date(2031, 2, 3), [4, 7]), (dt.date(2031, 2, 3), dt.date(2031, 8, 9), [0, 2])]
    assert pool.calendar_entries(table) == [("2031-02-03", [4, 7]), ("2031-08-09", [0, 2])]


UPCOMING = "match_id,t1,t2,date,net_h2h,t1_past,t2_past,t1_odds,t2_odds"


def test_bad_csv_rows_are_set_aside_whatever_is_selected(spark, tmp_path):
    path = put(tmp_path / "u.csv", f"{UPCOMING}\n5,8,6,2031-05-04,-2.0,3,1,1.25,4.0\nx,8,6,2031-05-04,,,,,\n7,8,6,oops,,,,,\n9,8,6\n")
    raw = tables.read_csv(spark, path, tables.schemas.UPCOMING_FILE)
    assert sorted(r[0] for r in tables.bad_rows(raw).collect()) == ["7,8,6,oops,,,,,", "x,8,6,2031-05-04,,,,,"]
    good = tables.read_upcoming(spark, path)
    assert good.columns == ["match_id", "a", "b", "date", "net_h2h", "a_past", "b_past", "a_odds", "b_odds"]
    assert good.count() == good.select("match_id").count() == len(good.select("a", "date").collect()) == len(good.collect()) == 2
    assert good.where("match_id = 5").first().a_odds == 1.25


def test_columns_are_found_by_name(spark, tmp_path):
    path = put(tmp_path / "r.csv", ",T2,date,match_id,t1,t1_odds,note\n0,6,2031-05-04,5,8,1.25,hello\n")
    row = tables.read_upcoming(spark, path).first()
    assert (row.match_id, row.a, row.b, row.a_odds, row.b_odds, row.date) == (5, 8, 6, 1.25, None, dt.date(2031, 5, 4))
    assert tables.read_upcoming(spark, path).select("b").first().b == 6
    with pytest.raises(ValueError, match="no column match_id"):
        tables.read_upcoming(spark, put(tmp_path / "n.csv", "t1,t2\n1,2\n"))


def test_rated_series_with_an_index(spark, tmp_path):
    cols = [f.name for f in tables.schemas.RATED_SERIES_FILE.fields]
    fixed = {"date": "2031-01-05", "winner": "True", "t1_elo": "1516.0", "t2_elo": "1484.0", "elo_diff": "32.0"}
    text = "," + ",".join(cols) + "\n0," + ",".join(fixed.get(c, "3") for c in cols) + "\n"
    row = tables.read_rated_series(spark, put(tmp_path / "s.csv", text)).first()
    assert (row.match_id, row.a_elo, row.b_elo, row.elo_diff, row.won_a, row.a_ban1) == (3, 1516.0, 1484.0, 32.0, True, 3)


def test_games_file_has_exact_scores(spark, tmp_path):
    cols = [f.name for f in tables.schemas.GAMES_FILE.fields]
    fixed = {"map_id": "7", "t1": "1", "t2": "2", "date": "2024-01-01", "winner": "True", "map": "3"}
    line = ",".join(fixed.get(c, "201.4" if c.endswith("acs") else "1.5" if c.endswith("rating") else "4") for c in cols)
    row = tables.read_games(spark, put(tmp_path / "g.csv", ",".join(cols) + "\n" + line + "\n")).first()
    assert (row.game_id, row.arena, row.a_acs5, row.b_agents, row.won_a) == (7, 3, 1007, [4] * 5, True)


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (None, 3.0), (4, float("nan"))], "i int, d double")
    assert sides.drop_nulls(df).count() == 1 and sides.drop_nulls(df, ["i"]).count() == 3
    assert sorted((r.i, r.d) for r in sides.fill_zero(df).collect()) == [(0, 3.0), (1, 1.0), (2, 0.0), (4, 0.0)]
