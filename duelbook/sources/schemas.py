"""Explicit schemas of the table files, and the map between file and library column names."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _D, _B, _S, _DT = (T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.DateType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# The column lists of the table files.
SERIES_FILE = _schema(
    ("match_id", _L), ("t1", _L), ("t2", _L), ("winner", _B),
    ("t1_ban1", _I), ("t1_ban2", _I), ("t2_ban1", _I), ("t2_ban2", _I), ("t1_pick", _I), ("t2_pick", _I), ("remaining", _I),
    ("t1_mapwins", _I), ("t2_mapwins", _I), ("net_h2h", _D), ("t1_past", _D), ("t2_past", _D),
    ("odds", _D), ("best_odds", _D), ("worst_odds", _D), ("date", _DT),
)

RATED_SERIES_FILE = _schema(*[(f.name, f.dataType) for f in SERIES_FILE.fields], ("t1_elo", _D), ("t2_elo", _D), ("elo_diff", _D))

_PLAYER = [(f"agent{i}", _I) for i in range(1, 6)] + [
    ("fks", _I), ("rating", _D), ("acs", _D), ("kills", _I), ("assists", _I), ("deaths", _I)
]
GAMES_FILE = _schema(
    ("map_id", _L), ("t1", _L), ("t2", _L), ("date", _DT), ("winner", _B), ("map", _I), ("t1_rds", _I), ("t2_rds", _I),
    *[(f"t1_{n}", k) for n, k in _PLAYER], *[(f"t2_{n}", k) for n, k in _PLAYER],
)

UPCOMING_FILE = _schema(
    ("match_id", _L), ("t1", _L), ("t2", _L), ("date", _DT), ("net_h2h", _D), ("t1_past", _D), ("t2_past", _D),
    ("t1_odds", _D), ("t2_odds", _D),
)

LEDGER_FILE = _schema(
    ("match_id", _L), ("t1", _L), ("t2", _L), ("correct", _B), ("date", _DT), ("bankroll", _D), ("betsize", _D),
    ("earnings", _D), ("bet_size", _D), ("best_odds", _D), ("worst_odds", _D),
)

TEAMS_FILE = _schema(("id", _L), ("linkname", _S), ("fullname", _S), ("abbrev", _S), ("secondary_id", _S))

FILE_TO_LIBRARY = {"t1": "a", "t2": "b", "winner": "won_a", "map": "arena", "map_id": "game_id",
                   "t1_mapwins": "a_gamewins", "t2_mapwins": "b_gamewins"}


def library_name(name: str) -> str:
    if name in FILE_TO_LIBRARY:
        return FILE_TO_LIBRARY[name]
    for number, side in (("t1_", "a_"), ("t2_", "b_")):
        if name.startswith(number):
            return side + name[len(number):]
    return name


def file_name(name: str) -> str:
    back = {v: k for k, v in FILE_TO_LIBRARY.items()}
    if name in back:
        return back[name]
    for side, number in (("a_", "t1_"), ("b_", "t2_")):
        if name.startswith(side):
            return number + name[len(side):]
    return name
