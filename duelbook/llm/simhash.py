"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint is described by its Hamming distances to reference fingerprints. The references 0 and the 16
masks of four neighbouring bits give a cell: how many bits of each block are set. Fingerprints that differ in at most two
bits have cells at L1 distance two at most, so both lie within one step of a common cell: each is entered in its own cell
and the cells one step away, and only fingerprints entered in the same cell are compared. A pair is discarded if its
distances to any reference differ by more than the radius, and survivors are verified by their real distance.

A cell with more than ``crowd`` entries is not compared in pairs. Its fingerprints go to the finest table, one reference
for each bit: there two fingerprints share a cell exactly if they are linked, so an edge to the smallest of the cell is
enough. Copies count once, whatever their number.

Links are joined to components by rounds of joins on edges, the smallest document id of a component names it.

Null and empty texts have no words and fingerprint 0. A null id is kept; it names a component only if no id in it is known.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns, without
from duelbook.llm.components import components
from duelbook.session import cut

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCK = 4
#: Further references for the filter: repeated 01, 0011, ... and bits of the golden ratio and of pi. Any would do.
REFERENCES = [
    0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF,
    0x9E3779B97F4A7C15, 0x243F6A8885A308D3,
]
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is in more than half of the shingles' hashes; without words 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[start:start + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, text: str = "text", name: str = "fingerprint_bits") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number; an input column of that name is replaced."""
    def start():
        return lambda texts: [[fingerprint(t) for t in texts]]

    return add_columns(documents, text, [T.StructField(name, T.LongType())], start)


def hex_of(bits) -> F.Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _distance(bits, reference: int):
    return F.bit_count(bits.bitwiseXOR(F.lit(_signed(reference))))


def cells(bits, block: int = BLOCK) -> F.Column:
    """The cell of a fingerprint and those one step away, as numbers: one digit for the set bits of each block.

    The set bits of a block follow from the distances to 0 and to the block's mask.
    """
    base, steps = None, []
    for k in range(64 // block):
        weight, mask = (block + 1) ** k, ((1 << block) - 1) << (k * block)
        count = F.shiftright(_distance(bits, 0) - _distance(bits, mask) + F.lit(block), 1).cast("long")
        base = count * F.lit(weight) if base is None else base + count * F.lit(weight)
        steps += [F.when(count < block, F.lit(weight)), F.when(count > 0, F.lit(-weight))]
    moves = F.filter(F.array(F.lit(0).cast("long"), *[s.cast("long") for s in steps]), lambda s: s.isNotNull())
    return F.transform(moves, lambda s: base + s)


def links(distinct: DataFrame, bits: str = "bits", radius: int = RADIUS, crowd: int = 512) -> DataFrame:
    """Edges (src < dst, by number) among distinct fingerprints, enough to connect all that are within the radius."""
    if radius != RADIUS:
        raise ValueError("cells are laid out for a radius of 2")
    # a row becomes one for each cell: it is dealt out again first, as few tasks may hold the stored fingerprints
    spread = distinct.select(bits).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), bits)
    entered = spread.select(F.col(bits).alias("x"), F.explode(cells(F.col(bits))).alias("cell"))
    sizes = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark counts rows that are exploded behind a shuffle as the rows before: it would broadcast them, so both joins are to be merges
    placed = cut(entered.join(sizes.hint("merge"), "cell"))
    left = placed.where(F.col("n") <= crowd).select("cell", "x")
    right = left.withColumnRenamed("x", "y")
    near = F.col("x") < F.col("y")
    for reference in REFERENCES:
        near &= F.abs(_distance(F.col("x"), reference) - _distance(F.col("y"), reference)) <= radius
    near &= F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    pairs = left.alias("a").join(right.alias("b"), (F.col("a.cell") == F.col("b.cell")) & near).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    fine = placed.where(F.col("n") > crowd).select("x").distinct().select(
        "x", F.explode(F.array(F.col("x"), *[F.col("x").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("cell"))
    smallest = fine.groupBy("cell").agg(F.min("x").alias("src"))
    stars = fine.join(smallest.hint("merge"), "cell").where("src < x").select("src", F.col("x").alias("dst"))
    return pairs.union(stars).distinct()


def _groups(slim: DataFrame, doc_id: str, crowd: int) -> tuple[DataFrame, DataFrame]:
    """From (id, _bits): the distinct fingerprints with their labels, and for each label its smallest (unknown, id, bits)."""
    keys = cut(slim.groupBy("_bits").agg(F.min(doc_id).alias("first")))
    found = components(links(keys, "_bits", crowd=crowd))
    named = keys.join(found.withColumnRenamed("node", "_bits"), "_bits", "left").withColumn("label", F.coalesce("label", "_bits"))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("unknown"), F.col("first").alias("id"), F.col("_bits").alias("bits"))).alias("best"))
    return named, best


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = 512) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): one row for each document, without its other columns.

    component_id is the smallest id reachable by links.
    """
    slim = cut(fingerprints(documents.select(doc_id, text), text, "_bits").select(doc_id, "_bits"))
    named, best = _groups(slim, doc_id, crowd)
    labels = named.join(best, "label").select("_bits", F.col("best.id").alias("component_id"))
    return slim.join(labels, "_bits").select(doc_id, hex_of(F.col("_bits")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = 512) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest id.

    Of rows that repeat that id with the same fingerprint the first by text stays. A component without known ids keeps
    one row too. Input columns named _bits, _key, _unknown or _place are dropped.
    """
    marked = fingerprints(without(documents, ["_key", "_unknown", "_place"]), text, "_bits")
    slim = cut(marked.select(doc_id, "_bits"))
    _, best = _groups(slim, doc_id, crowd)
    key = ["_key", "_unknown", "_bits"]
    kept = best.select(F.coalesce(F.col("best.id").cast("string"), F.lit("")).alias("_key"), F.col("best.unknown").alias("_unknown"), F.col("best.bits").alias("_bits"))
    keyed = marked.withColumns({"_key": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "_unknown": F.col(doc_id).isNull()})
    rows = keyed.join(kept, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(text).asc_nulls_last()))
    return rows.withColumn("_place", first).where("_place = 1").drop("_place", *key)
