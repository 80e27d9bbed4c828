"""DuckDB statements that restate the registered queries on the same tables."""

from __future__ import annotations

from duelbook.plans import fixtures as fx

FORM = ["round_wr", "fk_percent", "acs", "kills", "assists", "deaths", "kdr"]
_SAME = {t: t for t in fx.TABLES}
GAMES = f"games as materialized ({fx.GAMES.format(**_SAME)})"
SERIES = f"series as materialized ({fx.SERIES.format(**_SAME)})"
WIDE_GAMES = f"games as materialized ({fx.WIDE_GAMES.format(**_SAME)})"
STAGED = f"staged as ({fx.staged_text('series')})"
PLAYERS = f"players as ({fx.PLAYERS.format(**_SAME)})"
CELLS = f"cells as ({fx.CELLS.format(**_SAME)})"
KEYS = "match_id, a, b, date, won_a"


def _swap(columns: list[str], own: str, other: str) -> str:
    return ", ".join(f"{own}_{c} own_{c}, {other}_{c} opp_{c}" for c in columns)


def _side_view(table: str, shared: str, columns: list[str]) -> str:
    one = f"select {shared}, a side, b opp, 1 side_no, won_a won, won_a listed, {_swap(columns, 'a', 'b')} from {table}"
    two = f"select {shared}, b side, a opp, 2 side_no, not won_a won, won_a listed, {_swap(columns, 'b', 'a')} from {table}"
    return f"{one} union all {two}"


GAME_SIDES = f"gs as materialized ({_side_view('games', 'game_id, arena, date', ['rds', 'fks', 'acs5', 'kills', 'assists', 'deaths'])})"
WIDE_SIDES = f"gs as materialized ({_side_view('games', 'game_id, arena, date', ['rds', *fx.WIDE_RANGES])})"
SERIES_SIDES = f"ss as materialized ({_side_view('series', 'match_id, date, remaining', ['ban1', 'ban2', 'pick', 'past'])})"


def _asks(table: str, *more: str) -> str:
    cols = "".join(f"{m}, " for m in more)
    return f"select a side, {cols}date from {table} union select b, {cols}date from {table}"


def _last(name: str, hist: str, keys: str, key: list[str], tie: str, measures: dict[str, str], n: int) -> str:
    """CTEs: sums over the last n rows of the key before each asked date.

    Running sums give the state at the end of each day of the key; a frame over these and the asked dates gives each ask
    the last earlier one. An ask sorts before the state of its own day.
    """
    k = ", ".join(key)
    order = f"partition by {k} order by date, {tie}"
    frame = f"{order} rows between {f'{n - 1} preceding' if n else 'unbounded preceding'} and current row"
    runs = ", ".join(f"sum({e}) over ({frame}) {m}" for m, e in measures.items())
    found = ", ".join(f"last_value({m} ignore nulls) over earlier {m}" for m in measures)
    sums = ", ".join(f"cast(coalesce({m}, 0) as bigint) {m}" for m in measures)
    return f"""
    {name}_run as materialized (select {k}, date, row_number() over (partition by {k}, date order by {tie} desc) back, {runs} from {hist}),
    {name}_both as materialized (select {k}, date, 1 kind, {", ".join(measures)} from {name}_run where back = 1
       union all select distinct {k}, date, 0, {", ".join("null" for _ in measures)} from {keys}),
    {name} as materialized (select {k}, date, {sums} from (select {k}, date, kind, {found} from {name}_both
       window earlier as (partition by {k} order by date, kind rows between unbounded preceding and 1 preceding)) z where kind = 0)"""


def ratio(num: str, den: str) -> str:
    return f"case when {den} <> 0 then cast({num} as double) / cast({den} as double) else 0.0 end"


FORM_SUMS = {"n": "1", "rds": "own_rds", "all_rds": "own_rds + opp_rds", "fks": "own_fks", "all_fks": "own_fks + opp_fks",
             "acs5": "own_acs5", "k": "own_kills", "s": "own_assists", "d": "own_deaths"}
_FORM = {"round_wr": ("rds", "all_rds"), "fk_percent": ("fks", "all_fks"), "acs": ("acs5", "(n * 5)"), "kills": ("k", "all_rds"),
         "assists": ("s", "all_rds"), "deaths": ("d", "all_rds"), "kdr": ("k", "d")}
FORM_FIGURES = ", ".join(
    f"case when n > 0 and all_fks > 0 then {ratio(*nd)} else 0.0 end {name}" for name, nd in _FORM.items()
)

WIDE_SUMS = {"n": "1", "own_rds": "own_rds", "opp_rds": "opp_rds",
             **{f"{s}_{c}": f"{s}_{c}" for c in fx.WIDE_RANGES for s in ("own", "opp")}}
_ROUNDS = "(own_rds + opp_rds)"
_WIDE = {
    "round_wr": ("own_rds", _ROUNDS),
    "retake_wr": ("own_retakes_won", "(own_retakes_won + own_retakes_lost)"),
    "postplant_wr": ("own_postplants_won", "(own_postplants_won + own_postplants_lost)"),
    "fk_percent": ("(own_atk_fks + own_def_fks)", "(own_atk_fks + own_def_fks + opp_atk_fks + opp_def_fks)"),
    "pistol_wr": ("own_pistols", "(own_pistols + opp_pistols)"),
    "eco_wr": ("own_ecos_won", "(own_ecos_won + own_ecos_lost)"),
    "antieco_wr": ("opp_ecos_lost", "(opp_ecos_won + opp_ecos_lost)"),
    "fullbuy_wr": ("own_fullbuys_won", "(own_fullbuys_won + own_fullbuys_lost)"),
    "acs": ("own_acs", "n"), "kills": ("own_kills", _ROUNDS), "assists": ("own_assists", _ROUNDS),
    "deaths": ("own_deaths", _ROUNDS), "kdr": ("own_kills", "own_deaths"),
    "kadr": ("(own_kills + own_assists)", "own_deaths"), "kast": ("own_kast", "n"),
    "rating": ("(own_atk_rating + own_def_rating)", "(n * 2)"), "mks": ("own_mks", "n"),
    "clutch": ("own_clutches", "(own_clutches + opp_clutches)"), "econ": ("own_econ", "n"),
}
WIDE_FIGURES = ", ".join(f"{ratio(*nd)} {name}" for name, nd in _WIDE.items())


def _with_fallback(keys: str, sums: dict[str, str], figures: str, name: str = "f", hist: str = "gs") -> str:
    cols = ", ".join(f"case when h.n > 0 then h.{m} else w.{m} end {m}" for m in sums)
    return f"""
    {_last(name + '_here', hist, keys, ['side', 'arena'], 'game_id', sums, 20)},
    {_last(name + '_any', hist, keys, ['side'], 'game_id', sums, 20)},
    {name} as materialized (select side, arena, date, {figures} from (select h.side, h.arena, h.date, {cols}
       from {name}_here h join {name}_any w on w.side = h.side and w.date = h.date) z)"""


def _diff(contests: str, state: str, carried: str, names: list[str], arena: bool = True) -> str:
    on = " and x.arena = c.arena" if arena else ""
    on2 = " and y.arena = c.arena" if arena else ""
    cols = ", ".join(f"coalesce(x.{v}, 0.0) - coalesce(y.{v}, 0.0) {v}_diff" for v in names)
    picked = ", ".join(f"c.{p.strip()}" for p in carried.split(","))
    return f"""select {picked}, {cols} from {contests} c
      left join {state} x on x.side = c.a and x.date = c.date{on}
      left join {state} y on y.side = c.b and y.date = c.date{on2}"""


OUT = "case " + " ".join(f"when date < date '{d}' then {ids}" for d, ids in fx.CALENDAR) + " end"
POOL = f"case when {OUT} is null then null else list_filter(range(0, 11), lambda x: not list_contains({OUT}, x)) end"
PICKED = "[a_pick, b_pick, remaining]"
BANNED = "[a_ban1, a_ban2, b_ban1, b_ban2]"
ARENAS = "(select unnest(range(0, 11)) arena) ar"
TOUCHED = f"""touched as materialized (select series.*, cast(ar.arena as int) arena, list_contains({PICKED}, ar.arena) played from series, {ARENAS}
   where list_contains({PICKED}, ar.arena) or list_contains({BANNED}, ar.arena))"""
IN_POOL = f"pooled as materialized (select z.*, cast(unnest({POOL}) as int) arena from ss z)"
DRAFT_SUMS = {
    "total": "1", "picked": "cast(own_pick = arena as int)", "banned": "cast(own_ban1 = arena or own_ban2 = arena as int)",
    "played": "cast(own_pick = arena or opp_pick = arena or remaining = arena as int)",
}
DRAFT_RATES = f"{ratio('picked', 'total')} pick_rate, {ratio('banned', 'total')} ban_rate, {ratio('played', 'total')} play_rate"
WIN_SUMS = {"games": "1", "wins": "cast(won as int)"}
WIN_RATE = f"{ratio('wins', 'games')} win_rate"


def _draft_state(keys: str) -> str:
    return f"{SERIES_SIDES}, {IN_POOL}, {_last('dr', 'pooled', keys, ['side', 'arena'], 'match_id', DRAFT_SUMS, 20)}"


def _averages(carried: str) -> str:
    cols = ", ".join(f"(coalesce(x.{v}, 0.0) + coalesce(y.{v}, 0.0)) / 2.0 {o}" for o, v in
                     (("avg_win", "win_rate"), ("avg_pick", "pick_rate"), ("avg_ban", "ban_rate"), ("avg_play", "play_rate")))
    return f"""asked as materialized ({_asks('touched', 'arena')}), {GAMES}, {GAME_SIDES}, {_draft_state('asked')},
    {_last('wr', 'gs', 'asked', ['side', 'arena'], 'game_id', WIN_SUMS, 20)},
    st as materialized (select dr.side, dr.arena, dr.date, {WIN_RATE}, {DRAFT_RATES} from dr join wr using (side, arena, date)),
    av as (select {carried}, c.arena, c.played, {cols} from touched c
      left join st x on x.side = c.a and x.arena = c.arena and x.date = c.date
      left join st y on y.side = c.b and y.arena = c.arena and y.date = c.date),
    choices as materialized (select * from av where not (avg_win = 0 and avg_pick = 0 and avg_ban = 0 and avg_play = 0))"""


REGIONS = "regions as (select n_nationkey team_id, 'region_' || cast(n_regionkey as varchar) region from nation where n_nationkey < 23)"
LABELLED = f"""labelled as (select s.*, coalesce(x.region, 'unknown') a_region, coalesce(y.region, 'unknown') b_region
   from series s left join regions x on x.team_id = s.a left join regions y on y.team_id = s.b)"""


def _bets(name: str, pred: str, pa: str, pb: str, source: str = "series") -> str:
    back = f"case when {pred} > {pa} and {pa} > 0.1 then 'a' when {pred} < {pb} and {pb} < 0.9 then 'b' end"
    return f"""{name}_0 as (select *, {back} backed from {source}),
    {name} as (select *, won_a = (backed = 'a') correct, profit_if earnings, cast(case when won_a = (backed = 'a') then profit_if else -50 end as decimal(38, 10)) profit,
        case when backed = 'a' then {pa} < 0.5 else {pb} > 0.5 end underdog
      from (select *, case when backed = 'a' then cast(50 as double) / {pa} - 50 else cast(50 as double) / (cast(1 as double) - {pb}) - 50 end profit_if
            from {name}_0 where backed is not null) z)"""


def _ledger(name: str, best: str, worst: str) -> str:
    return f"""select match_id, a, b, correct, date,
      round(cast(1000 + sum(profit) over (order by date, match_id rows unbounded preceding) as double), 2) bankroll,
      cast(50 as double) betsize, earnings, cast(50 as double) bet_size, {best} best_odds, {worst} worst_odds from {name}"""


def _summary(name: str, line: str) -> str:
    n = "nullif(count(*), 0)"
    return f"""select count(*) bets, round_even(1000 + cast(sum(profit) as double), 2) end_bankroll,
      round_even(cast(count(*) filter (correct) as double) * 100 / {n}, 2) accuracy,
      round_even(cast(sum(profit) as double) / ({n} * cast(50 as double)), 2) ev,
      round_even(cast(count(*) filter (underdog) as double) * 100 / {n}, 2) underdog, '{line}' line from {name}"""


PAYOUTS = """case when match_id % 5 = 0 then cast([] as double[]) else
   [cast((match_id * 37) % 400 + 100 as double), cast((match_id * 53) % 500 + 100 as double),
    case when match_id % 7 = 3 then cast(0 as double) else cast((match_id * 71) % 90 + 60 as double) end] end"""


def _prices(source: str, won: str) -> str:
    """CTE ``priced``: best, worst and middle implied probability of side a."""
    one = "case when v > 0 then cast(1 as double) / (v / cast(100 as double)) else cast(0 as double) end"
    return f"""pr0 as (select * exclude (best_odds, worst_odds, odds), list_transform({PAYOUTS}, lambda v: case when {won} then {one} else cast(1 as double) - ({one}) end) p from {source}),
    pr1 as (select *, coalesce(list_max(list_filter(p, lambda x: x > 0 and x <> 1)), cast(0 as double)) best_odds,
       coalesce(list_min(list_filter(p, lambda x: x < 1 and x <> 0)), cast(1 as double)) worst_odds from pr0),
    priced as (select *, case when best_odds > 0 and best_odds < 1 and worst_odds > 0 and worst_odds < 1 then (best_odds + worst_odds) / cast(2 as double)
       when best_odds > 0 and best_odds < 1 then best_odds when worst_odds > 0 and worst_odds < 1 then worst_odds end odds from pr1)"""


NET_H2H = """cast(case when match_id % 13 = 1 then null
   when match_id % 11 = 0 then match_id % 4 - match_id % 3 + match_id % 5 - match_id % 2
   else match_id % 4 - match_id % 3 + match_id % 5 - match_id % 2 + match_id % 6 - match_id % 7 + match_id % 8 - match_id % 9
      + match_id % 10 - match_id % 11 end as int)"""
A_NET = "cast(match_id % 3 + match_id % 4 - match_id % 2 - match_id % 5 as int)"
B_NET = "cast(match_id % 5 - match_id % 4 as int)"
COMPLETE = "(match_id % 13 <> 0 and match_id % 7 not in (0, 1, 2))"
DRAFT_FIELDS = ["a_ban1", "a_ban2", "b_ban1", "b_ban2", "a_pick", "b_pick", "remaining"]
PARSED = ", ".join(f"cast(case when {COMPLETE} then {f} end as int) {f}" for f in DRAFT_FIELDS)
SCORED = "case when won_a then true when match_id % 2 = 0 then false end"

CHANCES = f"""chances as (select match_id, a, b, date, arena, cast((match_id * 31 + arena * 17) % 101 as double) / 128 play_prob,
     cast(1 + (match_id * 13 + arena * 7) % 127 as double) / 128 a_chance from touched),
   kept as (select *, 1.0 - a_chance b_chance from (select *, row_number() over (partition by match_id order by play_prob, arena) rn from chances) z where rn > 2)"""

FIVE = "list_transform(range(0, 5), lambda i: cast(({col} + 5 * i) % 24 as int))"
AGENT_GAMES = f"""ag as (select game_id, 1 side_no, arena, date, won_a won, {FIVE.format(col='a_acs5')} own, {FIVE.format(col='b_acs5')} opp from games
   union all select game_id, 2, arena, date, not won_a, {FIVE.format(col='b_acs5')}, {FIVE.format(col='a_acs5')} from games),
   each_agent as (select *, unnest(own) agent from ag)"""

ELO_A = "1 / (1 + pow(cast(10 as double), ({rb} - {ra}) / 400))"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    game_asks = f"asked as materialized ({_asks('games', 'arena')})"
    series_asks = f"asked as materialized ({_asks('series')})"

    q["form_diff"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks}, {_with_fallback('asked', FORM_SUMS, FORM_FIGURES)}
      {_diff('games', 'f', 'game_id, a, b, won_a, date, arena', FORM)}"""
    q["form_repeated"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks}, {_with_fallback('asked', FORM_SUMS, FORM_FIGURES)},
      listed as (select * from games union all select * from games where arena % 3 = 0)
      {_diff('listed', 'f', 'game_id, a, b, won_a, date, arena', FORM)}"""
    q["form_all_arenas"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {series_asks},
      {_last('s', 'gs', 'asked', ['side'], 'game_id', FORM_SUMS, 20)}, f as materialized (select side, date, {FORM_FIGURES} from s),
      c as materialized (select *, a_past - b_past past_diff from series)
      {_diff('c', 'f', 'match_id, a, b, date, won_a, past_diff, odds', FORM, arena=False)}"""
    q["form_extended"] = f"""with {WIDE_GAMES}, {WIDE_SIDES}, {game_asks}, {_with_fallback('asked', WIDE_SUMS, WIDE_FIGURES)}
      {_diff('games', 'f', 'game_id, a, b, won_a, date, arena', list(_WIDE))}"""
    q["arena_win_rate"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks},
      {_last('w', 'gs', 'asked', ['side', 'arena'], 'game_id', WIN_SUMS, 20)} select *, {WIN_RATE} from w"""
    q["arena_win_rate_listed"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks},
      {_last('w', 'gs', 'asked', ['side', 'arena'], 'game_id', {'games': '1', 'wins': 'cast(listed as int)'}, 0)} select *, {WIN_RATE} from w"""
    spread = f"asked as (select z.*, cast(ar.arena as int) arena from ({_asks('series')}) z, {ARENAS})"
    wide_wr = ", ".join(f"max(case when arena = {i} then win_rate end) wr_{i}" for i in fx.ARENAS)
    q["arena_win_rate_wide"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {spread},
      {_last('w', 'gs', 'asked', ['side', 'arena'], 'game_id', WIN_SUMS, 20)}
      select side, date, {wide_wr} from (select *, {WIN_RATE} from w) z group by side, date"""
    per = ", ".join(f"{ratio(f'sum(case when h.arena = {i} and h.won then 1 else 0 end)', f'sum(case when h.arena = {i} then 1 else 0 end)')} wr_{i}" for i in fx.ARENAS)
    q["win_rate_diff"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {series_asks},
      daily as (select side, date, arena, won, count(*) n from gs group by all),
      f as (select k.side, k.date, {per.replace('then 1 else', 'then h.n else')} from asked k left join daily h on h.side = k.side and h.date < k.date group by all)
      {_diff('series', 'f', KEYS, [f'wr_{i}' for i in fx.ARENAS], arena=False)}"""
    q["trailing_3_months"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks},
      w as (select k.side, k.arena, k.date, count(h.side) games, cast(coalesce(sum(cast(h.won as int)), 0) as bigint) wins from asked k
        left join gs h on h.side = k.side and h.arena = k.arena and h.date < k.date and h.date > k.date - interval 3 month group by all)
      select *, {WIN_RATE} from w"""

    q["draft_rates"] = f"""with {SERIES}, {TOUCHED}, asked as ({_asks('touched', 'arena')}), {_draft_state('asked')}
      select *, {DRAFT_RATES} from dr"""
    wide_all = ", ".join(
        f"max(case when arena = {i} then {v} end) {n}_{i}" for i in fx.ARENAS
        for v, n in (("pick_rate", "pick"), ("ban_rate", "ban"), ("play_rate", "play"), ("win_rate", "wr")))
    q["draft_rates_wide"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {spread}, {_draft_state('asked')},
      {_last('w', 'gs', 'asked', ['side', 'arena'], 'game_id', WIN_SUMS, 20)},
      j as (select dr.side, dr.arena, dr.date, {DRAFT_RATES}, {WIN_RATE} from dr join w using (side, arena, date))
      select side, date, {wide_all} from j group by side, date"""
    carried = "c.match_id, c.a, c.b, c.date, c.won_a, coalesce(c.net_h2h, 0) net_h2h, c.a_past - c.b_past past_diff, c.odds, c.best_odds, c.worst_odds"
    q["draft_choices"] = f"with {SERIES}, {TOUCHED}, {_averages(carried)} select * from choices"
    order = "[a_ban1, b_ban1, a_pick, b_pick, a_ban2, b_ban2, remaining]"
    q["draft_steps"] = f"""with {SERIES}, st as (select *, {order} d, {POOL} pool, unnest(range(0, 7)) step from series)
      select match_id, a, b, date, cast(step as int) step, [1, 2, 1, 2, 1, 2, 0][step + 1] side_no,
        ['ban', 'ban', 'pick', 'pick', 'ban', 'ban', 'remaining'][step + 1] action, cast(d[step + 1] as bigint) arena,
        case when pool is null then null else array_to_string(list_transform(list_filter(pool, lambda x: not list_contains(d[1:step], x)), lambda x: cast(x as varchar)), ',') end open_arenas
      from st"""
    flags = ", ".join(f"cast(not list_contains({OUT}, {i}) as int) in_pool_{i}" for i in fx.ARENAS)
    q["pool_flags"] = f"with {SERIES} select match_id, date, {flags} from series"
    q["pool_arenas"] = f"""with {SERIES} select match_id, a, b, date, cast(unnest({POOL}) as int) arena from series
      union all select match_id, a, b, date, null from series where {OUT} is null"""
    q["pool_uncovered"] = f"with {SERIES} select match_id, a, b, date from series where date >= date '{fx.CALENDAR[-1][0]}'"
    q["touched_arenas"] = f"with {SERIES}, {TOUCHED} select match_id, a, b, date, arena, played from touched"
    q["head_to_head"] = f"""with {SERIES}, {TOUCHED},
      met as (select least(a, b) lo, greatest(a, b) hi, date, unnest({PICKED}) arena from series)
      select match_id, a, b, date, arena, cast(exists (select 1 from met where met.lo = least(t.a, t.b) and met.hi = greatest(t.a, t.b)
        and met.arena = t.arena and met.date < t.date) as int) h2h_played from touched t"""

    pairs = ["ban1", "ban2", "pick", "past"]
    q["side_rows"] = f"""with {SERIES}, {SERIES_SIDES} select match_id, date, remaining, side, opp, side_no, won, listed listed_won,
      {', '.join(f'own_{p}, opp_{p}' for p in pairs)} from ss"""
    q["date_window"] = f"with {SERIES} select {KEYS} from series where date between date '1997-03-01' and date '1999-06-30'"
    q["both_in_set"] = f"with {SERIES} select {KEYS} from series where a < 20 and b < 20"
    q["exclude_set"] = f"""with {SERIES}, ex as (select n_nationkey k from nation where n_regionkey = 3)
      select {KEYS} from series where a not in (select k from ex) and b not in (select k from ex)"""
    q["region_label"] = f"with {SERIES}, {REGIONS}, {LABELLED} select match_id, a, b, a_region, b_region from labelled"
    q["regional"] = f"with {SERIES}, {REGIONS}, {LABELLED} select {KEYS} from labelled where a_region = b_region and a_region <> 'unknown'"
    q["cross_region"] = f"with {SERIES}, {REGIONS}, {LABELLED} select {KEYS} from labelled where a_region <> b_region or a_region = 'unknown'"
    q["named_sides"] = f"""with {SERIES} select match_id, a, b, x.n_name a_name, y.n_name b_name from series
      left join nation x on x.n_nationkey = a left join nation y on y.n_nationkey = b"""
    q["null_drop"] = f"with {SERIES} select match_id, date, net_h2h, odds, pred from series where net_h2h is not null and odds is not null"
    q["null_drop_subset"] = f"with {SERIES} select match_id, date, net_h2h, odds, pred from series where odds is not null"
    q["null_fill"] = f"with {SERIES} select match_id, coalesce(net_h2h, 0) net_h2h, coalesce(odds, 0.0) odds from series"
    q["score_winner"] = f"with {SERIES} select match_id, a_past, b_past, a_past > b_past won_a from series"
    q["past_diff"] = f"with {SERIES} select match_id, a_past, b_past, a_past - b_past past_diff from series"
    q["undecided"] = f"""with {SERIES} select match_id, 'Side ' || cast(a as varchar) a_text, 'Side ' || cast(b as varchar) b_text
      from series where match_id % 11 <> 5"""

    q["max_abs"] = f"""with {SERIES}, r as (select match_id, net_h2h, a_past - b_past past_diff, pred from series)
      select match_id, {', '.join(f'cast({c} as double) / (select max(abs({c})) from r) {c}' for c in ('net_h2h', 'past_diff', 'pred'))} from r"""
    q["drop_least_likely"] = f"with {SERIES}, {TOUCHED}, {CHANCES} select match_id, arena, play_prob from kept"
    q["winshare"] = f"""with {SERIES}, {TOUCHED}, {CHANCES} select match_id, a, b, date, sum(a_chance) / (sum(a_chance) + sum(b_chance)) winshare
      from kept group by match_id, a, b, date"""
    q["winshare_weighted"] = f"""with {SERIES}, {TOUCHED}, {CHANCES} select match_id, a, b, date,
      sum(a_chance * play_prob) / nullif(sum(a_chance * play_prob) + sum(b_chance * play_prob), 0) winshare from kept group by match_id, a, b, date"""

    ea, eb = ELO_A.format(ra="x.elo", rb="y.elo"), ELO_A.format(ra="y.elo", rb="x.elo")
    q["elo_period"] = f"""with recursive {SERIES},
      timed as (select *, (year(date) - 1995) * 12 + month(date) - 1 period from series),
      c as (select period, a, b, sum(cast(won_a as int)) w, count(*) n from timed group by all),
      who as (select a side from series union select b from series),
      r as (select cast(0 as bigint) p, side, cast(1500 as double) elo from who
        union all select r.p + 1, r.side, r.elo + coalesce(g.gain, 0) from r left join (select side, sum(gain) gain from (
            select c.a side, 32 * (w - n * ({ea})) gain from c join r x on x.p = c.period and x.side = c.a join r y on y.p = c.period and y.side = c.b
            union all
            select c.b side, 32 * (n - w - n * ({eb})) gain from c join r x on x.p = c.period and x.side = c.a join r y on y.p = c.period and y.side = c.b) z
            group by side) g on g.side = r.side where r.p < (select max(period) from timed))
      select match_id, a, b, cast(period as int) period, round(x.elo, 6) a_elo, round(y.elo, 6) b_elo, round(x.elo - y.elo, 6) elo_diff
      from timed join r x on x.p = period and x.side = a join r y on y.p = period and y.side = b"""
    avg, bw = _bets("avg_bets", "pred", "odds", "odds"), _bets("bw_bets", "pred", "worst_odds", "best_odds")
    q["ledger_average"] = f"with {SERIES}, {avg} {_ledger('avg_bets', 'odds', 'odds')}"
    q["ledger_best_worst"] = f"with {SERIES}, {bw} {_ledger('bw_bets', 'best_odds', 'worst_odds')}"
    q["ledger_second_tier"] = f"""with {SERIES}, other as (select *, cast(1 as double) - pred win_chance from series),
      {_bets('t2', 'win_chance', 'odds', 'odds', 'other')} {_ledger('t2', 'odds', 'odds')}"""
    q["ledger_summary"] = f"with {SERIES}, {avg}, {bw} {_summary('avg_bets', 'average')} union all {_summary('bw_bets', 'best_worst')}"
    q["hit_rate"] = f"""with {SERIES} select avg(case when (pred > 0.5 and won_a) or (pred < 0.5 and not won_a) then cast(1 as double) else 0 end) hit_rate from series"""
    q["earnings_by_side"] = f"""with {SERIES}, {bw},
      nets as (select a team_id, case when correct then cast(earnings as decimal(38, 10)) else cast(-50 as decimal(38, 10)) end net from bw_bets
        union all select b, case when correct then cast(-50 as decimal(38, 10)) else cast(earnings as decimal(38, 10)) end from bw_bets)
      select team_id, n_name as name, round(cast(sum(net) as double), 2) net_earnings from nets left join nation on n_nationkey = team_id group by team_id, n_name"""
    q["region_report"] = f"""with {SERIES}, {REGIONS}, {bw}
      select region, count(*) bets, cast(count(*) filter (correct) as double) * 100 / count(*) hit_pct,
        round(cast(coalesce(sum(case when correct then cast(earnings as decimal(38, 10)) end), 0) - count(*) filter (not correct) * 50 as double), 2) net
      from bw_bets join regions on team_id = a group by region"""

    q["implied_odds"] = f"with {SERIES}, {_prices('series', 'won_a')} select match_id, best_odds, worst_odds, odds from priced"
    best_a = "greatest(cast(1 as double), cast(match_id * 37 % 300 + 80 as double) / 100, cast(match_id * 41 % 300 + 80 as double) / 100)"
    best_b = "case when match_id % 5 = 0 then cast(1 as double) else greatest(cast(1 as double), cast(match_id * 43 % 300 + 80 as double) / 100) end"
    q["best_decimal_odds"] = f"with {SERIES} select match_id, {best_a} a_odds, {best_b} b_odds from series"
    q["expected_value"] = f"""with {SERIES}, v as (select match_id, pred, cast((match_id * 37) % 400 + 101 as double) / 100 pa,
        cast((match_id * 59) % 400 + 101 as double) / 100 pb, cast(1 as double) - pred other from series),
      e as (select match_id, pred * pa - other ev_a, other * pb - (cast(1 as double) - other) ev_b, pred * pa - 1 ev_a_decimal from v)
      select *, case when ev_a > 1 then 'a' when ev_b > 1 then 'b' end bet from e"""
    q["url_ids"] = r"""select url link, string_split(url, '/')[3] slug, try_cast(nullif(regexp_extract(url, '/(\d+)/', 1), '') as bigint) match_id,
        try_cast(nullif(regexp_extract(url, '/team/(\d+)', 1), '') as bigint) team_id from pages
      union all select '/team/' || cast(c_custkey as varchar) || '/' || lower(c_mktsegment), lower(c_mktsegment), c_custkey, c_custkey from customer"""
    q["text_numbers"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        case when l_partkey % 3 = 0 then cast(0 as double) else cast(l_partkey as double) end number,
        cast(case when l_partkey % 4 = 0 then 0 else l_suppkey end as int) lead_int, l_linenumber won, cast(l_suppkey as int) lost,
        l_linenumber left_score, cast(case when l_partkey % 5 = 0 then null else l_partkey % 3 end as int) right_score,
        cast(l_shipdate as date) stamp_day, cast(l_shipdate as date) slash_day from lineitem"""
    q["h2h_net"] = f"with {SERIES} select match_id, {NET_H2H} net_h2h, {A_NET} a_net, {B_NET} b_net from series"
    q["draft_text"] = f"with {SERIES} select match_id, {COMPLETE} complete, {PARSED} from series"

    q["series_records"] = f"""with {SERIES}, sc as (select *, {SCORED} scored from series), {_prices('sc', 'scored')}
      select match_id, cast(a as bigint) a, cast(b as bigint) b, scored won_a, {PARSED},
        cast(case when scored then 2 when scored is not null then 0 end as int) a_gamewins,
        cast(case when scored then 1 when scored is not null then 2 end as int) b_gamewins,
        {NET_H2H} net_h2h, {A_NET} a_past, {B_NET} b_past, odds, best_odds, worst_odds, date,
        case when scored is null then 'no score' when not {COMPLETE} then 'no draft' end problem from priced"""
    totals = """totals as (select game_id, side_no, cast(sum(fks) as bigint) fks, cast(sum(kills) as bigint) kills, cast(sum(deaths) as bigint) deaths,
        cast(sum(assists) as bigint) assists, cast(sum(acs) as double) / 5 acs, case when sum(rating) <> 0 then sum(rating) / 5 end rating,
        array_to_string(list_transform(list_sort(list(agent)), lambda x: cast(x as varchar)), ',') agents, count(*) filter (agent not between 0 and 23) unknown_agents
        from players group by game_id, side_no)"""
    sides = ", ".join(f"{s}.{x} {s}_{x}" for s in "ab" for x in ("agents", "fks", "rating", "acs", "kills", "assists", "deaths"))
    q["game_records"] = f"""with {PLAYERS}, {totals}, ids as (select distinct game_id from players)
      select ids.game_id, cast(o_orderdate as date) date, {sides}, cast(null as varchar) problem from ids join orders on o_orderkey = ids.game_id
        left join totals a on a.game_id = ids.game_id and a.side_no = 1 left join totals b on b.game_id = ids.game_id and b.side_no = 2"""
    q["upcoming_records"] = f"""with {SERIES} select match_id, cast(a as bigint) a, cast(b as bigint) b, date, {NET_H2H} net_h2h, {A_NET} a_past, {B_NET} b_past,
        {best_a} a_odds, {best_b} b_odds, cast(null as varchar) problem from series where match_id % 11 <> 5 and date >= date '1998-05-01' and date < date '1998-05-01' + interval 700 day"""
    q["team_rows"] = """select c_custkey team_id, lower(c_mktsegment) linkname, c_name as name, 'C' || cast(c_custkey as varchar) abbrev,
        case when c_custkey % 4 <> 0 then c_mktsegment end secondary_id from customer"""
    q["distinct_links"] = r"""with l as (select distinct unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages)
      select href, case when regexp_matches(href, '^/team/\d+') then 'team' when regexp_matches(href, '^/\d+/') then 'match'
          when regexp_matches(href, '^/event/') then 'event' else 'other' end kind,
        try_cast(nullif(regexp_extract(href, '/team/(\d+)', 1), '') as bigint) team_id,
        try_cast(nullif(regexp_extract(href, '/(\d+)/', 1), '') as bigint) match_id,
        case when starts_with(href, '/team/') then substr(href, 6) end team_path from l"""
    q["dated_links"] = f"""with {SERIES} select case when match_id % 4 = 3 then concat('/', match_id, '/x?a=1&b=2') else concat('/', match_id, '/x') end href,
        match_id, max(date) date from series group by match_id
      union all select distinct concat('/', strftime(date, '%Y%m'), '/undated'), cast(strftime(date, '%Y%m') as bigint), null from series"""
    q["high_water_mark"] = f"with {SERIES} select cast(max(date) - interval 1 day as date) start_date from series"
    q["load_window"] = f"""with {SERIES} select match_id, date from series
      where date >= (select max(date) - interval 1 day from series where date < date '2000-01-01')"""
    line = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    first = "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) rn"
    q["keep_first"] = f"select {line} from (select *, {first} from lineitem) z where rn = 1"
    q["incremental_append"] = f"""with held as (select * from (select *, {first} from lineitem where l_shipdate < timestamp '1998-01-01') z where rn = 1)
      select {line} from held union all select {line} from (select *, {first} from lineitem l
        where not exists (select 1 from held h where h.l_orderkey = l.l_orderkey and h.l_linenumber = l.l_linenumber)) z where rn = 1"""
    q["stream_ingest"] = "select event_id, user_id, event_type, value from events"
    q["stream_state"] = q["stream_ingest"]
    wins = "2 a_gamewins, 0 b_gamewins"
    ints = ", ".join(f"cast({f} as int) {f}" for f in DRAFT_FIELDS)
    q["csv_round_trip"] = f"""with {SERIES} select match_id, cast(a as bigint) a, cast(b as bigint) b, won_a, {ints}, {wins}, cast(net_h2h as double) net_h2h,
      cast(a_past as double) a_past, cast(b_past as double) b_past, odds, best_odds, worst_odds, date from series"""
    fits = "match_id % 19 <> 4 and match_id % 23 <> 5"
    q["csv_bad_rows"] = f"with {SERIES} select match_id, not ({fits}) bad from series"
    q["names_file"], q["calendar_file"], q["region_files"] = q["named_sides"], q["pool_flags"], q["regional"]
    q["calendar_index"], q["calendar_draft_rates"] = q["pool_arenas"], q["draft_rates"]
    good = f"(won_a or match_id % 2 = 0) and {COMPLETE}"
    window = f"""stored as (select match_id, date from series where date < date '2000-01-01' and match_id % 3 <> 0 and {good}),
      wanted as (select * from series where date >= (select cast(max(date) - interval 1 day as date) from stored) and match_id not in (select match_id from stored))"""
    q["update_series"] = f"""with {SERIES}, {window} select match_id, cast(a as bigint) a, cast(b as bigint) b, date, won_a, cast(remaining as int) remaining
      from wanted where {good}"""
    q["update_quarantine"] = f"""with {SERIES}, {window} select match_id, date,
      case when not (won_a or match_id % 2 = 0) then 'no score' else 'no draft' end problem from wanted where not ({good})"""
    rows = "match_id, cast(a as bigint) a, cast(b as bigint) b, date, won_a, cast(remaining as int) remaining"
    q["committed_update"] = f"""with {SERIES}, {window} select {rows} from series where match_id in (select match_id from stored)
      union all select {rows} from wanted where {good}"""
    q["committed_quarantine"] = q["update_quarantine"] + """
      union all select distinct cast(strftime(date, '%Y%m') as bigint), null, 'undated link' from series"""
    q["season_table"] = f"with {SERIES} select {KEYS} from series where year(date) = 1999"

    q["player_totals"] = f"with {PLAYERS}, {totals} select * from totals"
    stat = r"coalesce(try_cast(nullif(regexp_extract(trim(text), '^(\d+)', 1), '') as int), 0)"

    def bucket(low: int, high: int) -> str:
        return f"sum(case when col between {low} and {high} then {stat} else 0 end)"

    q["performance_buckets"] = f"""with {CELLS} select game_id, side_no, cast({bucket(2, 5)} as bigint) mks, cast({bucket(6, 10)} as bigint) clutches,
      cast({bucket(11, 11)} as double) / 5 econ, cast({bucket(12, 12)} as bigint) plants, cast({bucket(13, 13)} as bigint) defuses
      from cells group by game_id, side_no"""
    count_wins = "count(*) games, cast(sum(cast(won as int)) as bigint) wins"
    q["agent_win_rate"] = f"""with {GAMES}, {AGENT_GAMES}, s as (select agent, arena, {count_wins} from each_agent group by agent, arena)
      select *, {WIN_RATE} from s"""
    q["agent_win_rate_no_mirror"] = f"""with {GAMES}, {AGENT_GAMES},
      s as (select agent, {count_wins} from each_agent where not list_contains(opp, agent) group by agent) select *, {WIN_RATE} from s"""
    q["comp_strength_all_time"] = f"""with {GAMES}, {AGENT_GAMES}, s as (select agent, arena, {count_wins} from each_agent group by agent, arena)
      select game_id, side_no, round(avg({ratio('wins', 'games')}), 9) comp_wr from each_agent join s using (agent, arena) group by game_id, side_no"""
    q["comp_strength"] = f"""with {GAMES}, {AGENT_GAMES},
      daily as (select agent, arena, date, {count_wins} from each_agent group by all),
      s as (select k.agent, k.arena, k.date, coalesce(sum(h.games), 0) games, coalesce(sum(h.wins), 0) wins from (select distinct agent, arena, date from each_agent) k
        left join daily h on h.agent = k.agent and h.arena = k.arena and h.date < k.date and h.date > k.date - interval 3 month group by all)
      select game_id, side_no, round(avg({ratio('wins', 's.games')}), 9) comp_wr from each_agent join s using (agent, arena, date) group by game_id, side_no"""

    q["seeded_split"] = f"""with {SERIES} select match_id, case when cast('0x' || substr(md5(cast(match_id as varchar) || '|42'), 1, 8) as bigint) % 1000 < 200
      then 'test' else 'train' end part from series"""
    q["feature_tables"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks}, {_with_fallback('asked', FORM_SUMS, FORM_FIGURES)},
      t as ({_diff('games', 'f', 'game_id, a, b, won_a, date, arena', FORM)})
      select game_id, a, b, won_a, date, arena, {', '.join(f'{v}_diff / (select max(abs({v}_diff)) from t) {v}_diff' for v in FORM)} from t"""
    q["feature_tables_draft"] = f"""with {SERIES}, {TOUCHED}, {_averages('c.match_id, c.a, c.b, c.date, c.won_a')},
      asked2 as ({_asks('choices', 'arena')}), {_with_fallback('asked2', FORM_SUMS, FORM_FIGURES)}
      {_diff('choices', 'f', 'match_id, a, b, date, won_a, arena, played, avg_win, avg_pick, avg_ban, avg_play', FORM)}"""
    def held_out(key: str) -> str:
        return f"cast('0x' || substr(md5({key} || '|42'), 1, 8) as bigint) % 1000 < 200"

    choices = f"{SERIES}, {TOUCHED}, {_averages('c.match_id, c.a, c.b, c.date, c.won_a')}"
    shared = f"{choices}, shared as (select match_id, a, b, date, won_a from choices group by all having count(*) > 2)"
    checked = "true chance_in_range, true consistent"
    id_text, game_text = "cast(match_id as varchar)", "game_id"
    q["gbt_arena_pick"] = f"""with {choices} select match_id, arena, cast(played as int) label, {checked} from choices
      where {held_out(f"{id_text} || '|' || cast(arena as varchar)")}"""
    q["gbt_game_winner"] = f"with {GAMES} select game_id, cast(won_a as int) label, {checked} from games where {held_out(game_text)}"
    flags = "true accurate, true beats_majority, true repeats, count(*) scored"
    q["gbt_planted"] = f"""with {GAMES}, {GAME_SIDES}, {game_asks}, {_with_fallback('asked', FORM_SUMS, FORM_FIGURES)},
      t as ({_diff('games', 'f', 'game_id, a, b, won_a, date, arena', FORM)}), {SERIES}, series_asked as ({_asks('series')}),
      {_last('s', 'gs', 'series_asked', ['side'], 'game_id', FORM_SUMS, 20)}, sf as materialized (select side, date, {FORM_FIGURES} from s),
      u as ({_diff('series', 'sf', 'match_id, a, b, date', FORM, arena=False)})
      select 'game' model, count(*) held_out, count(*) filter (kdr_diff > 0) positives, {flags}, 'kdr_diff' top_feature from t where {held_out(game_text)}
      union all select 'series', count(*), count(*) filter (a_past > b_past), {flags}, 'past_diff' from series where {held_out(id_text)}
      union all select 'second_tier', count(*), count(*) filter (round_wr_diff > 0), {flags}, 'round_wr_diff' from u where {held_out(id_text)}"""
    q["gbt_one_arena"] = f"""with {GAMES}, t as (select game_id from games where arena = 3 and {held_out(game_text)})
      select game_id, 3 arena, false no_model, true chance_in_range from t union all select game_id, 9, true, false from t"""
    q["gbt_series_winner"] = f"with {shared} select match_id, cast(won_a as int) label, {checked} from shared where {held_out(id_text)}"
    stated = "true in_range, true bet_as_stated, true outcome_as_stated"
    bet_window = "date between date '2000-06-01' and date '2001-08-01'"
    q["gbt_second_tier"] = f"with {SERIES} select match_id, date, won_a, {stated} from series where {bet_window}"
    q["gbt_search"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {series_asks}, {_last('s', 'gs', 'asked', ['side'], 'game_id', FORM_SUMS, 20)},
      f as materialized (select side, date, {FORM_FIGURES} from s), u as ({_diff('series', 'f', 'match_id', FORM, arena=False)})
      select trees, count(*) as rows, count(*) filter (round_wr_diff > 0) positives, true accurate from u, (select unnest([100, 200, 300]) trees) z
      where not {held_out(id_text)} group by trees"""
    q["classification_report"] = f"""with {GAMES} select cast(won_a as int) label, count(*) support, true precision_in_range, true recall_in_range, true f1_in_range
      from games where {held_out(game_text)} group by won_a"""
    q["importances"] = f"select feature, true importance_in_range, cast(1 as double) total from (values {', '.join(f"('{v}_diff')" for v in FORM)}) z(feature)"
    q["train_backtest"] = f"""with {shared}, {REGIONS}, ex as (select n_nationkey k from nation where n_regionkey = 3)
      select match_id, date, won_a, {stated} from shared join regions x on x.team_id = a join regions y on y.team_id = b
      where {bet_window} and x.region = y.region and a not in (select k from ex) and b not in (select k from ex)"""
    draft_means = ", ".join(f"(coalesce(x.{v}, 0.0) + coalesce(y.{v}, 0.0)) / 2.0 {o}" for o, v in
                            (("avg_win", "win_rate"), ("avg_pick", "pick_rate"), ("avg_ban", "ban_rate"), ("avg_play", "play_rate")))
    q["kept_features"] = f"""with {GAMES}, {GAME_SIDES}, {SERIES}, {SERIES_SIDES}, {IN_POOL},
      past as materialized (select * from gs where date < date '2000-10-01'), drafted as materialized (select * from pooled where date < date '2000-10-01'),
      later as materialized (select match_id, a, b, date, cast(unnest({POOL}) as int) arena from series where date >= date '2000-10-01'
        union all select match_id, a, b, date, null from series where date >= date '2000-10-01' and {OUT} is null),
      asked as materialized ({_asks('later', 'arena')}),
      {_last('dr', 'drafted', 'asked', ['side', 'arena'], 'match_id', DRAFT_SUMS, 20)}, {_last('wr', 'past', 'asked', ['side', 'arena'], 'game_id', WIN_SUMS, 20)},
      st as materialized (select dr.side, dr.arena, dr.date, {WIN_RATE}, {DRAFT_RATES} from dr join wr using (side, arena, date)),
      av as materialized (select c.*, {draft_means} from later c left join st x on x.side = c.a and x.arena = c.arena and x.date = c.date
        left join st y on y.side = c.b and y.arena = c.arena and y.date = c.date),
      {_with_fallback('asked', FORM_SUMS, FORM_FIGURES, hist='past')}
      {_diff('av', 'f', 'match_id, a, b, date, arena, avg_win, avg_pick, avg_ban, avg_play', FORM)}"""
    q["upcoming_card"] = f"""with {SERIES}, ex as (select n_nationkey k from nation where n_regionkey = 3)
      select match_id, date, a, b, x.n_name a_name, y.n_name b_name, {OUT} is null no_chance, true in_range, true bet_as_stated
      from series join nation x on x.n_nationkey = a join nation y on y.n_nationkey = b
      where date >= date '2000-10-01' and a < 20 and b < 20 and a not in (select k from ex) and b not in (select k from ex)"""
    q["label_report"] = f"""with {SERIES}, p as (select won_a, pred > 0.5 said from series),
      k as (select c, count(*) filter (won_a = c) support, count(*) filter (said = c) said, count(*) filter (won_a = c and said = c) hit
            from p, (select unnest([false, true]) c) z group by c),
      r as (select c, support, {ratio('hit', 'said')} pr, {ratio('hit', 'support')} rc from k)
      select cast(c as int) label, pr as precision, rc recall, case when pr + rc > 0 then 2.0 * pr * rc / (pr + rc) else 0.0 end f1, support from r"""
    return q
