"""Draft sentences ('X ban Arena; ... Arena remains') -> arena ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One word: letters, digits and underscore of any script, tried only at its first character.
WORD = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]++"
ACTOR = rf"({WORD}) (?:ban|pick)"
MOVE = rf"{WORD} (?:ban|pick) {WORD};"
REMAINS = rf"({WORD}) remains"

FIELDS = ("a_ban1", "a_ban2", "b_ban1", "b_ban2", "a_pick", "b_pick", "remaining")


def with_draft(df: DataFrame, text: str, arenas: list[str], tag_a: str | None = None) -> DataFrame:
    """Adds ``complete`` and the seven arena ids, which are null unless the draft is complete.

    Complete means two actors with two bans and one pick each and one remaining arena, all of
    them known. The first actor to appear is side 1 unless column ``tag_a`` names the other. The steps
    are separate projections, so each pattern runs once per text.
    """
    col = F.col(text)
    found = df.withColumns({
        "_actors": F.array_distinct(F.regexp_extract_all(col, F.lit(ACTOR), 1)),
        "_moves": F.transform(F.regexp_extract_all(col, F.lit(MOVE), 0), lambda m: F.split(F.rtrim(m, F.lit(";")), " ")),
        "_rest": F.regexp_extract(col, REMAINS, 1),
    })
    first, second = F.get("_actors", F.lit(0)), F.get("_actors", F.lit(1))
    if tag_a is not None:
        swap = F.coalesce(second == F.col(tag_a), F.lit(False))
        first, second = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    named = found.withColumns({"_a": first, "_b": second})

    def moves(actor: str, verb: str) -> Column:
        """Arena names of the actor's moves of one kind, from (actor, verb, arena) words."""
        own = F.filter(F.col("_moves"), lambda m: (m[0] == F.col(actor)) & (m[1] == verb))
        return F.transform(own, lambda m: m[2])

    split = named.withColumns({
        "_bans_a": moves("_a", "ban"), "_bans_b": moves("_b", "ban"),
        "_picks_a": moves("_a", "pick"), "_picks_b": moves("_b", "pick"),
    })
    counts = (
        (F.size("_actors") == 2) & (F.size("_bans_a") == 2) & (F.size("_bans_b") == 2)
        & (F.size("_picks_a") == 1) & (F.size("_picks_b") == 1) & (F.col("_rest") != "")
    )
    known = F.array(*[F.lit(name) for name in arenas])
    names = F.concat("_bans_a", "_bans_b", "_picks_a", "_picks_b", F.array("_rest"))
    placed = split.withColumn("_places", F.when(counts, F.transform(names, lambda n: F.array_position(known, n))))
    whole = placed.withColumn("complete", F.coalesce(~F.array_contains("_places", F.lit(0).cast("bigint")), F.lit(False)))
    ids = {f: F.when(F.col("complete"), (F.get("_places", F.lit(i)) - 1).cast("int")) for i, f in enumerate(FIELDS)}
    helpers = ["_actors", "_moves", "_rest", "_a", "_b", "_bans_a", "_bans_b", "_picks_a", "_picks_b", "_places"]
    return whole.withColumns(ids).drop(*helpers)
