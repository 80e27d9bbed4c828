"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component that gives all of them the length of the longest one; queries are stretched to that length. The
nearest by distance is then the largest by inner product, also if lengths differ. A table's hash is several Gaussian projections
(2-stable: a difference of length r is projected to a normal with deviation r), each cut into slots; its bucket is the slots' tuple.
Slots are as wide as ``WIDTH`` deviations of that projection over all rows, and there are as many projections as make a bucket
hold about ``BLOCK`` rows.

A query visits its own bucket and perturbed ones in the order of estimated success: given the query's projections, a row at
an angle t to it is projected to a normal around cos t of them, so each slot, and each bucket as the product of its slots, has a
probability to hold it. A heap over all tables hands out buckets in that order until the probability that a row at the
distance of the query's k-th neighbour is in none of them is at most 1 - ``target``. That distance is estimated from a bounded
sample of rows first. When the k-th neighbour found is farther than estimated, the query goes on with the measured distance.
So the visits follow from the data: no number of probes is fixed.

Equal vectors are indexed once with their k + 1 smallest ids. A bucket is dealt out in parts of about ``BLOCK`` rows and the parts
to cells of about ``CELL`` rows, so a bucket with a third of all rows is many cells. A query comes once to each cell it has visits in;
a cell with many visits is joined in slices of ``SLICE`` queries. Candidates of all tables are merged by query. Scores are inner
products of the original vectors, products in double precision and summed exactly, so ties are ties.

The order is by score, then smaller id. A null vector, an empty or zero one, one with null or non-finite components and a row
without id take no part. Vectors shorter than the longest are filled up with zeros. Repeated rows (same id and vector) are one
row; rows with the query's id are not its neighbours. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.session import cut

#: Rows of a bucket's part, of a cell, and queries joined with a cell at once.
BLOCK, CELL, SLICE = 512, 4096, 2048
TABLES, WIDTH, TARGET = 4, 1.5, 0.95
#: Rows of the sample that distances are estimated from, and its bytes at most.
SAMPLE, SAMPLE_BYTES = 2048, 4 << 20
SEED = 20

FOUND = "array<struct<away:double,ids:array<long>>>"
_FOUND = pa.list_(pa.struct([("away", pa.float64()), ("ids", pa.list_(pa.int64()))]))


def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


@dataclass
class Hashes:
    """The projections of all tables, (tables, axes, dimensions + 1), and their slots."""

    axes: np.ndarray
    centre: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    length: float

    @classmethod
    def drawn(cls, tables: int, each: int, size: int, length: float) -> Hashes:
        rng = np.random.default_rng(SEED)
        axes, flat = rng.standard_normal((tables, each, size + 1)), np.ones((tables, each))
        return cls(axes, 0 * flat, flat, rng.random((tables, each)), length)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows, lengthened: (rows, tables, axes)."""
        more = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(1), 0))
        return np.einsum("nd,tmd->ntm", x, self.axes[:, :, :-1]) + more[:, None, None] * self.axes[None, :, :, -1]

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Projections of queries, stretched."""
        stretched = x * (self.length / np.sqrt((x * x).sum(1)))[:, None]
        return np.einsum("nd,tmd->ntm", stretched, self.axes[:, :, :-1])

    def slots(self, projected: np.ndarray) -> np.ndarray:
        return np.floor((projected - self.centre) / self.width + self.shift).astype("<i2")

    def bucket(self, table: int, slots: Iterable[int]) -> bytes:
        return bytes([table]) + np.fromiter(slots, "<i2").tobytes()

    def order(self, table: int, projected: np.ndarray, cosine: float) -> Iterator[tuple[float, bytes]]:
        """(probability, bucket) of a table's buckets, most probable first, for a row at that cosine to the query."""
        middle = projected * cosine
        spread = max(self.length * math.sqrt(max(1 - cosine * cosine, 0)), 1e-9 * self.length) * math.sqrt(2)
        lists = []
        for f, c, w, b in zip(middle, self.centre[table], self.width[table], self.shift[table]):
            first, last = (math.floor((f + sign * 4 * spread - c) / w + b) for sign in (-1, 1))
            edges = [math.erf(((s - b) * w + c - f) / spread) for s in range(first, last + 2)]
            lists.append(sorted(((hi - lo) / 2, s) for lo, hi, s in zip(edges, edges[1:], range(first, last + 1)))[::-1])
        heap = [(-math.prod(x[0][0] for x in lists), (0,) * len(lists), 0)]
        while heap:
            chance, at, least = heapq.heappop(heap)
            if chance == 0:
                return
            yield -chance, self.bucket(table, (x[k][1] for x, k in zip(lists, at)))
            for axis in range(least, len(at)):  # every bucket has one predecessor: the one a step nearer on its last axis
                k = at[axis] + 1
                if k < len(lists[axis]) and lists[axis][k - 1][0]:
                    heapq.heappush(heap, (chance * lists[axis][k][0] / lists[axis][k - 1][0], at[:axis] + (k,) + at[axis + 1:], axis))

    def visits(self, projected: np.ndarray, cosine: float, target: float) -> list[bytes]:
        """Buckets of all tables in the order of success, until the target is met."""
        tables = [self.order(t, projected[t], cosine) for t in range(len(projected))]
        caught, heap, out = [0.0] * len(tables), [], []
        for t, buckets in enumerate(tables):
            if (first := next(buckets, None)) is not None:
                heapq.heappush(heap, (-first[0], t, first[1]))
        while heap and math.prod(1 - c for c in caught) > 1 - target:
            chance, t, bucket = heapq.heappop(heap)
            out.append(bucket)
            caught[t] -= chance
            if (after := next(tables[t], None)) is not None:
                heapq.heappush(heap, (-after[0], t, after[1]))
        return out


def nearest_of(x: np.ndarray, ids: list[list[int]], q: np.ndarray, scores: np.ndarray, floor: np.ndarray, k: int) -> list[list[dict]]:
    """For each query its k best rows by exact score, from a matrix of scores that are right but for rounding; -inf is no candidate."""
    near = 1e-12 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max()) * q.shape[1]
    if len(x) > k:
        floor = np.maximum(floor, np.partition(scores, len(x) - k, axis=1)[:, len(x) - k])
    found = []
    for place in range(len(q)):
        best = np.flatnonzero((scores[place] >= floor[place] - near[place]) & (scores[place] > -np.inf))
        exact = [-math.fsum(r) for r in (x[best] * q[place]).tolist()]
        told = sorted((away + 0.0, ids[b]) for away, b in zip(exact, best.tolist()))[:k]
        found.append([{"away": away, "ids": i} for away, i in told])
    return found


def usable(df: DataFrame, vector: str, row_id: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    return df.where(F.coalesce(fine, F.lit(False)) & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), x.alias("x"))


def packed(df: DataFrame, size: int, kind: str) -> DataFrame:
    """(id, v): the vectors as bytes, filled up with zeros; -0.0 is 0.0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            full = np.zeros((len(column), size), kind)
            full[np.arange(size)[None, :] < lengths[:, None]] = values
            full += 0.0
            raw = full.tobytes()
            each = size * full.itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i * each:(i + 1) * each] for i in range(len(column))], pa.binary())], names=["id", "v"])

    return df.mapInArrow(run, "id long, v binary")


def _lengths(vectors: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(0), kind)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max(initial=0))]), pa.array([len(x)])], names=["longest", "rows"])

    return vectors.select("v").mapInArrow(run, "longest double, rows long").agg(F.max("longest").alias("longest"), F.sum("rows").alias("rows"))


def fitted(vectors: DataFrame, hashes: Hashes, kind: str, width: float) -> Hashes:
    """Slots by the mean and the deviation of each projection over all rows."""
    shape = hashes.centre.shape

    def run(batches):
        for batch in batches:
            p = hashes.rows(matrix(batch.column(0), kind)).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(p.shape[1]), pa.int32()), pa.array(p.sum(0)), pa.array((p * p).sum(0)), pa.array([len(p)] * p.shape[1])], names=["axis", "s", "ss", "n"])

    sums = vectors.select("v").mapInArrow(run, "axis int, s double, ss double, n long").groupBy("axis").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    told = sorted(sums.collect())
    centre = np.array([r.s / r.n for r in told]).reshape(shape)
    deviation = np.sqrt(np.maximum(np.array([r.ss / r.n for r in told]).reshape(shape) - centre ** 2, 0))
    # equal rows have no deviation; slots are not so narrow that their numbers outgrow two bytes
    return Hashes(hashes.axes, centre, width * np.maximum(deviation, 1e-3 * hashes.length), hashes.shift, hashes.length)


def _cells(vectors: DataFrame, hashes: Hashes, kind: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (cell, bucket, part, v, ids) and the directory (bucket, parts, cells)."""

    def run(batches):
        for batch in batches:
            slots = hashes.slots(hashes.rows(matrix(batch.column(0), kind)))
            for t in range(slots.shape[1]):
                raw = [bytes([t]) + s.tobytes() for s in np.ascontiguousarray(slots[:, t])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(0), batch.column(1)], names=["bucket", "v", "ids"])

    rows = vectors.select("v", "ids").mapInArrow(run, "bucket binary, v binary, ids array<long>")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    sizes = cut(sizes)
    cells = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // CELL))
    cell = F.pmod(F.xxhash64("bucket", "part"), F.lit(cells))
    index = rows.join(sizes.drop("n"), "bucket").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).select(cell.alias("cell"), "bucket", "part", "v", "ids")
    directory = sizes.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("bucket", "part", cell.alias("cell"))
    return index, directory


def _searched(index: DataFrame, directory: DataFrame, queries: DataFrame, probes: DataFrame, k: int, kind: str) -> DataFrame:
    """(id, v, found) for each query (id, h, v, floor) and cell: its k + 1 best vectors among the visited buckets (id, h, bucket) there."""
    visits = cut(probes.join(directory, "bucket").groupBy("cell", "id", "h").agg(F.collect_list(F.struct("bucket", "part")).alias("parts")))
    load = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    dealt = visits.join(load, "cell").select(F.col("cell").alias("at"), F.pmod(F.xxhash64("id", "h"), F.col("slices")).alias("lot"), "id", "h", "parts")
    dealt = dealt.join(queries.select("id", "h", "v", "floor"), ["id", "h"])
    held = index.join(load, "cell").select("cell", "bucket", "part", "v", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.binary()), "found": pa.array([], _FOUND)})
        x, q = matrix(rows.column("v"), kind), matrix(asked.column("v"), kind)
        places: dict[tuple[bytes, int], list[int]] = {}
        for place, key in enumerate(zip(rows.column("bucket").to_pylist(), rows.column("part").to_pylist())):
            places.setdefault(key, []).append(place)
        wanted: dict[tuple[bytes, int], list[int]] = {}
        for place, parts in enumerate(asked.column("parts").to_pylist()):
            for p in parts:
                wanted.setdefault((p["bucket"], p["part"]), []).append(place)
        scores = np.full((len(q), len(x)), -np.inf)
        for key, who in wanted.items():
            if key in places:
                scores[np.ix_(who, places[key])] = q[who] @ x[places[key]].T
        floor = np.array([-np.inf if f is None else f for f in asked.column("floor").to_pylist()])
        found = nearest_of(x, rows.column("ids").to_pylist(), q, scores, floor, k + 1)
        return pa.table({"id": asked.column("id"), "v": asked.column("v"), "found": pa.array(found, _FOUND)})

    return held.groupBy("cell", "slice").cogroup(dealt.groupBy("at", "lot")).applyInArrow(run, f"id long, v binary, found {FOUND}")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each query: its k + 1 best vectors of all cells; first in salted parts, so no group is long."""
    def best(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))

    return best(best(found.withColumn("salt", F.pmod(F.xxhash64("found"), F.lit(32))), "id", "v", "salt"), "id", "v")


def _named(found: DataFrame, k: int) -> DataFrame:
    """Adds ``near``: the k best (away, id), without the query's own id."""
    pairs = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(c["away"].alias("away"), i.alias("id")))))
    return found.withColumn("near", F.slice(F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p["id"] != F.col("id")))), 1, k))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", row_id: str = "vec_id", target: float = TARGET,
           tables: int = TABLES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, <row_id>, score) of each query's k nearest found; ranks from 1. Both inputs have ``vector`` and ``row_id``."""
    out = f"query_id long, rank int, {row_id} long, score double"
    kind = "<f4" if isinstance(rows.schema[vector].dataType, T.ArrayType) and isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    candidates, asked = usable(rows, vector, row_id), usable(queries, vector, row_id)
    size = max(candidates.agg(F.max(F.size("x"))).first()[0] or 0, asked.agg(F.max(F.size("x"))).first()[0] or 0)
    if not size:
        return rows.sparkSession.createDataFrame([], out)
    # a vector that a third of the rows have goes on with k + 1 ids; ranks are cut before the shuffle
    each = packed(candidates, size, kind).groupBy("id", "v").agg(F.lit(1).alias("_"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    vectors = cut(each.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut(packed(asked, size, kind).distinct())
    longest, count = _lengths(vectors, kind).first()
    if not count:
        return rows.sparkSession.createDataFrame([], out)
    bits = math.log2(max(count / block, 1))
    axes = math.ceil(bits / max(2.05 - math.log2(width), 0.5))
    hashes = Hashes.drawn(tables if axes else 1, axes, size, math.sqrt(longest))
    if axes:
        hashes = fitted(vectors, hashes, kind, width)
    index, directory = _cells(vectors, hashes, kind, block)
    index, directory = cut(index), cut(directory)

    most = max(k + 1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    sampled = vectors.orderBy(F.xxhash64("v"), "v").limit(most).collect()
    sample, sample_ids = np.frombuffer(b"".join(bytes(r.v) for r in sampled), kind).reshape(len(sampled), -1).astype(np.float64), [r.ids for r in sampled]
    share = k * len(sampled) / count
    expected = math.ceil(share + math.sqrt(share))

    def first(batches):
        """Each query's best rows of the sample: their k-th score is a floor, and they tell the cosine to expect of its k-th neighbour."""
        for batch in batches:
            ids, q = batch.column(0).to_pylist(), matrix(batch.column(1), kind)
            floor = np.full(len(q), -np.inf)
            found = nearest_of(sample, sample_ids, q, q @ sample.T, floor, k + 1)
            norms = (np.sqrt((q * q).sum(1)) * hashes.length).tolist()
            others = [[-c["away"] for c in f if c["ids"] != [i]] for i, f in zip(ids, found)]
            guess = [min(1.0, max(0.0, o[min(expected, len(o)) - 1] / n)) if o else 0.0 for o, n in zip(others, norms)]
            floors = [o[k - 1] if len(o) >= k else None for o in others]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _FOUND), pa.array(guess, pa.float64()), pa.array(norms, pa.float64()), pa.array(floors, pa.float64())],
                                             names=["id", "v", "found", "cosine", "norm", "floor"])

    guessed = cut(asked.mapInArrow(first, f"id long, v binary, found {FOUND}, cosine double, norm double, floor double").withColumn("h", F.xxhash64("v")))

    def probe(batches):
        """The buckets that a query (id, h, v, cosine, before) visits, less those it visited for the cosine before."""
        for batch in batches:
            projected = hashes.asked(matrix(batch.column(2), kind))
            for i, (row, h, cosine, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                buckets = hashes.visits(projected[i], cosine, target)
                if before is not None:
                    done = set(hashes.visits(projected[i], before, target))
                    buckets = [b for b in buckets if b not in done]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(buckets), pa.int64()), pa.array([h] * len(buckets), pa.int64()), pa.array(buckets, pa.binary())], names=["id", "h", "bucket"])

    def visited(df):
        return df.select("id", "h", "v", "cosine", "before").mapInArrow(probe, "id long, h long, bucket binary")

    fresh = guessed.withColumn("before", F.lit(None).cast("double"))
    met = _searched(index, directory, guessed, visited(fresh), k, kind).unionByName(guessed.select("id", "v", "found"))
    found = cut(_named(_merged(met, k), k))
    # farther than estimated: on with the measured distance
    last = F.get("near", F.lit(k - 1))["away"]
    measured = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -last / F.col("norm"))), F.lit(0.0))
    asked_again = guessed.select("id", "h", "v", "norm", F.col("cosine").alias("before")).join(found.drop("found"), ["id", "v"])
    left = cut(asked_again.select("id", "h", "v", measured.alias("cosine"), (-last).alias("floor"), "before").where("cosine < before"))
    if axes and not left.isEmpty():
        more = _searched(index, directory, left, visited(left), k, kind)
        found = _named(_merged(found.select("id", "v", "found").unionByName(more), k), k)
    ranked = found.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "n"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias(row_id), (F.lit(0.0) - F.col("n.away")).alias("score"))
