"""Exact top-k by Hamming distance with incremental multi-index hashing.

A binary code is cut into segments, each with an index from its values to buckets of codes, wide enough that a bucket holds
about ``bucket`` codes. Round r looks up, in the indexes, the values that differ from the query's segment in exactly r bits; they
are grown from those of round r - 1 by one more flipped bit. When e segments are searched up to r and the other s - e up to
r - 1, a code that was not met differs by s r + e bits at least: a query whose k-th verified distance is smaller has its exact
answer. Others go on, with as many segments as their k-th distance still asks for. Codes are verified by their whole distance.

Equal codes are indexed once with their k smallest ids, and equal queries are searched once. A bucket is stored in parts of about
``bucket`` codes, so a common value is many rows and not one. A code that several lookups meet is counted by the first only
(smallest difference, then first segment), so nothing has to be made distinct.

Neighbours are ordered by distance, then id (a null id first); the query itself is a row like any other. A null vector has no
code and is neither query nor neighbour; a null or missing component is bit 0. With fewer than k rows all are returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.session import cut

WORD, BUCKET = 64, 128


def words_of(vector: Column, words: int) -> Column:
    """The signs of a vector (1 if above 0) as 64-bit numbers."""
    bit = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % WORD).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.array(*[F.aggregate(F.slice(bit, 1 + k * WORD, WORD), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)) for k in range(words)])


class Segments:
    """Segments of ``width`` bits; the last of a word may have fewer."""

    def __init__(self, words: int, each: int):
        self.words, self.width = words, -(-WORD // each)
        starts = range(0, WORD, self.width)
        self.places = [(w, s, min(self.width, WORD - s)) for w in range(words) for s in starts]

    def values(self, code: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(code[w], s).bitwiseAND(F.lit((1 << n) - 1)) for w, s, n in self.places])

    def distance(self, a: Column, b: Column) -> Column:
        return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(1, self.words)), F.bit_count(a[0].bitwiseXOR(b[0])))

    def met_earlier(self, a: Column, b: Column, segment: Column, radius: int) -> Column:
        """Whether another lookup met the code before: a segment is nearer, or an earlier one as near."""
        out = F.lit(False)
        for j, (w, s, n) in enumerate(self.places):
            mask = ((1 << n) - 1) << s
            apart = F.bit_count(a[w].bitwiseXOR(b[w]).bitwiseAND(F.lit(mask - (1 << WORD) if mask >> 63 else mask)))
            out |= (apart < radius) | ((apart == radius) & (F.lit(j) < segment))
        return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", row_id: str = "vec_id", bucket: int = BUCKET) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for every row of ``queries``; both inputs have ``vector`` and ``row_id``."""
    bits, count = rows.agg(F.max(F.size(vector)), F.count(vector)).first()
    words = max(1, -(-(bits or 1) // WORD))
    room = max(1.0, math.log2(max(count, 2) / bucket)) if count else 1.0
    cuts = Segments(words, math.ceil(WORD / min(room, 32.0)))
    total = len(cuts.places)

    def coded(df):
        return df.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), words_of(F.col(vector), words).alias("code"))

    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = coded(rows).withColumn("place", first).where(F.col("place") <= k).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("ids"))
    entries = cut(codes.select("code", "ids", F.posexplode(cuts.values(F.col("code"))).alias("segment", "value")))
    sizes = entries.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("code"), F.ceil(F.col("n") / bucket))
    index = cut(entries.join(sizes, ["segment", "value"]).groupBy("segment", "value", part.alias("part")).agg(F.collect_list(F.struct("code", "ids")).alias("held")).drop("part"))
    asked = cut(coded(queries))
    open_ = asked.select(F.col("code").alias("q")).distinct().withColumns({"far": F.lit(None).cast("int"), "wanted": F.lit(total)})
    frontier = open_.select("q", "far", F.posexplode(cuts.values(F.col("q"))).alias("segment", "value"), F.lit(-1).alias("last"))
    best, done = None, None
    for radius in range(cuts.width + 1):
        frontier, open_ = cut(frontier), cut(open_)
        lookups = frontier.join(index, ["segment", "value"])
        told = F.transform("held", lambda c: F.struct(cuts.distance(F.col("q"), c["code"]).alias("distance"), c["ids"][0].alias("first"), c["ids"].alias("ids"), c["code"].alias("code")))
        near = F.filter(told, lambda c: c["distance"] <= F.col("far")) if radius else told
        # no code of a bucket's part beyond its k first by distance and smallest id can be among the k nearest, also if some
        # of those k are counted by another lookup
        kept = F.filter(F.slice(F.array_sort(near), 1, k), lambda c: ~cuts.met_earlier(F.col("q"), c["code"], F.col("segment"), radius))
        found = lookups.select("q", F.explode(kept).alias("c")).select(
            "q", F.col("c.distance").cast("long").alias("distance"), F.explode("c.ids").alias("n")).select("q", "distance", F.col("n.id").alias("id"))
        pool = found if best is None else best.unionByName(found)
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        best = cut(pool.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        state = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").cast("int").alias("reach"))
        # short of k: all segments; else as many as the k-th distance asks for
        after = open_.select("q", "wanted").join(state, "q", "left").withColumn("covered", F.lit(total * radius) + F.col("wanted"))
        enough = F.coalesce((F.col("n") >= k) & (F.col("reach") < F.col("covered")), F.lit(False))
        missing = F.when(F.col("n") >= k, F.least(F.lit(total), F.col("reach") - total * (radius + 1) + 1)).otherwise(F.lit(total))
        open_ = cut(after.where(~enough).select("q", F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(words * WORD)).alias("far"), missing.alias("wanted")))
        ended = radius == cuts.width or open_.isEmpty()
        settled = best if ended else best.join(open_, "q", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if ended:
            break
        best = best.join(open_, "q", "left_semi")
        grown = frontier.drop("far").join(open_, "q").where((F.col("last") < cuts.width - 1) & (F.col("segment") < F.col("wanted")))
        frontier = grown.select("q", "far", "segment", "value", F.explode(F.sequence(F.col("last") + 1, F.lit(cuts.width - 1))).alias("bit")).select(
            "q", "far", "segment", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("value"), F.col("bit").alias("last"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")).cast("long")
    named = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return named.join(done.withColumn("rank", rank), "q").select("query_id", F.col("id").alias("neighbor_id"), "distance", "rank")
