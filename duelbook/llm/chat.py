"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are context, only its text is under the loss. A turn is
``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (in roles a
line end becomes ``\\n`` too), so marks in them are ordinary text, and reading back is exact.

Turns after the last assistant turn, or of a conversation without one, are kept in a last example without a loss span.

A null text or role is empty. Rows of a conversation are ordered by turn, then role and text; repeated rows stay. Rows with a null
conversation are one conversation. A conversation is one record: its examples hold all of it, so it has to fit in a task;
examples are made one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # between doubled backslashes, a backslash stands before n or | only
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda s: F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv, example, n_turns, text, loss_start, loss_end): offsets in code points, end exclusive; null without a target.

    Other columns of the input are not carried.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    gathered = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
    marked = gathered.select("conv", F.transform("turns", lambda s: F.struct(
        (s["r"] == trained).alias("own"), F.concat(F.lit(START), escape_role(s["r"]), F.lit("\n")).alias("head"), escape(s["x"]).alias("body"))).alias("turns"))
    upto = F.posexplode(F.transform("turns", lambda s: s["own"])).alias("place", "own")
    placed = marked.select("conv", "turns", upto).where(F.col("own") | (F.col("place") == F.size("turns") - 1))

    def whole(part):
        return F.array_join(F.transform(part, lambda s: F.concat(s["head"], s["body"], F.lit(END + "\n"))), "")

    last = F.element_at("turns", F.col("place") + 1)
    made = placed.select(
        "conv", F.col("place").cast("long").alias("example"), (F.col("place") + 1).cast("long").alias("n_turns"), "own",
        F.concat(whole(F.slice("turns", 1, F.col("place"))), last["head"]).alias("context"), last["body"].alias("body"))
    begin = F.length("context").cast("long")
    return made.select(
        F.col("conv").alias(conv), "example", "n_turns", F.concat("context", "body", F.lit(END + "\n")).alias("text"),
        F.when(F.col("own"), begin).alias("loss_start"), F.when(F.col("own"), begin + F.length("body")).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(
        unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(s, F.locate("\n", s) + 1, F.length(s) - F.locate("\n", s) - len(END) - 1)).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss; null without a target."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def digest(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads examples back: turns from the longest example of a conversation, loss texts in order of the examples."""
    turns = F.array_join(F.transform(read_turns(F.max_by("text", "example")), lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    loss = F.transform(F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct(
        "example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("x"))))), lambda s: s["x"])
    read = made.groupBy(conv).agg(
        F.max("n_turns").alias("n_turns"), turns.alias("turns"), F.array_join(loss, "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    return read.select(
        conv, "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
