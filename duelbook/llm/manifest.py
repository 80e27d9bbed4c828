"""A Merkle manifest of a dataset: digests go up and proofs come down by time-forward processing.

Every row is a leaf; the leaves of a source, in the order of their keys, are hashed into a tree of fan-out 16, and the trees'
roots, in the order of the sources, into one more. A node is computed when its label is reached: it takes the digests that its
children sent to that label out of a priority queue and sends its own to its parent. The queue is external. Between tasks its
messages are rows, which Spark's shuffle deals out and sorts by (tree, label) and spills to disk where they are many; a task gets
the messages of ``SPAN`` consecutive nodes and works off the labels above them with a heap, which holds at most 16 messages a
level, because a parent is labelled by its last child and so comes right behind it. A round goes up ``DEPTH`` levels, so
n leaves take log_256(n) rounds and the next one has 1/256 of the rows. The second sweep runs through the labels in reversed order:
the root's empty proof is sent down, each node prepends its children's siblings to what it got, and the leaves get whole proofs.

A tree of any size, such as one source with a third of all rows, is spread over tasks by its spans; no task sees a whole tree, and
texts are read once, to be hashed, and never shuffled.

A null source is a tree of its own before all others; a null key comes first in its source, and rows with equal keys are
ordered by their digests. Repeated rows are leaves each. A source with one row has its leaf as root. An empty table has no rows.
Input columns with the names of results are replaced, also if names differ by case only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.llm.batches import give_back, without
from duelbook.session import cut

FAN, DEPTH = 16, 2
SPAN = FAN ** DEPTH

RESULTS = ["subroot", "root", "proof"]
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
TOLD = [T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("proof", T.ArrayType(STEP)),
        T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]
_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def hashed(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(digests: Sequence[str], levels: int) -> list[list[list[str]]]:
    """The children of every node over consecutive nodes, by level: labels are worked off in their order.

    A label is (last node below, level); a message is a child's digest sent to its parent's label.
    """
    last, runs = len(digests) - 1, [[] for _ in range(levels)]
    if not levels:
        return runs
    queue: list[tuple[tuple[int, int], int, str]] = []

    def send(node: int, level: int, digest: str) -> None:
        wide = FAN ** level
        heapq.heappush(queue, ((min(last, (node // FAN + 1) * FAN * wide - 1), level + 1), node, digest))

    for place, digest in enumerate(digests):
        send(place, 0, digest)
        while queue and queue[0][0][0] == place:
            label, children = queue[0][0], []
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[1:])
            runs[label[1] - 1].append([d for _, d in children])
            if label[1] < levels:
                send(children[0][0] // FAN, label[1], hashed([d for _, d in children]))
    return runs


def descend(runs: list[list[list[str]]], proof: list[dict]) -> list[list[dict]]:
    """The proofs of the lowest nodes, given that of the node above them all: labels in reversed order send them down."""
    if not runs:
        return [proof]
    queue = [(-len(runs), 0, proof)]
    out: list[list[dict]] = []
    while queue:
        level, node, above = heapq.heappop(queue)
        children = runs[-level - 1][node]
        for k in range(len(children)):
            own = [{"before": "".join(children[:k]), "after": "".join(children[k + 1:])}, *above]
            if level == -1:
                out.append(own)
            else:
                heapq.heappush(queue, (level + 1, node * FAN + k, own))
    return out


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its ``tree`` by the order, and ``n``, the rows of the tree.

    Rows are dealt out by ranges; the offsets are sums over one row for each range and tree.
    """
    dealt = nodes.withColumn("_salt", F.rand(7)).repartitionByRange("tree", *order, "_salt").sortWithinPartitions("tree", *order, "_salt")
    held = cut(dealt.drop("_salt").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = held.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    ranges = ranges.withColumns({"_before": before, "n": F.sum("_rows").over(tree)}).drop("_rows")
    return held.join(ranges, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_before", "_first")


def _levels(n: Column) -> Column:
    """Levels of this round: none above a single node, and up to DEPTH until one is left."""
    return F.least(F.lit(DEPTH), sum((F.when(n > FAN ** k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))).cast("int")


def _up(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the nodes a round higher."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        levels, n = table.column("levels")[0].as_py(), table.column("n")[0].as_py()
        by = sorted(zip(table.column("pos").to_pylist(), table.column("digest").to_pylist()))
        runs = climb([d for _, d in by], levels)
        top = hashed(runs[-1][0]) if levels else by[0][1]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // FAN ** levels)], "digest": [top]})

    rows = nodes.select("tree", "pos", "n", "digest", _levels(F.col("n")).alias("levels"), F.expr(f"pos div {SPAN}").alias("span"))
    return rows.groupBy("tree", "span").applyInArrow(run, "tree string, pos long, n long, digest string")


def _down(nodes: DataFrame, above: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(tree, pos, proof, subroot, root) of the nodes from the messages (tree, pos, proof, subroot, root) of those a round higher.

    ``also`` names further columns of the nodes to keep.
    """

    def run(table: pa.Table, message: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        runs = climb(table.column("digest").to_pylist(), table.column("levels")[0].as_py())
        proofs = descend(runs, message.column("proof")[0].as_py())
        told = {c: pa.array([message.column(c)[0].as_py()] * len(table), pa.string()) for c in ("subroot", "root")}
        out = pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "proof": pa.array(proofs, _STEP)} | told | {c: table.column(c) for c in also})
        del runs, proofs
        give_back()
        return out

    rows = nodes.select("tree", "pos", "digest", *[c for c in also if c != "digest"], _levels(F.col("n")).alias("levels"), F.expr(f"pos div {SPAN}").alias("span"))
    messages = above.select(F.col("tree").alias("t"), F.col("pos").alias("s"), "proof", "subroot", "root")
    schema = T.StructType(TOLD + [T.StructField(c, nodes.schema[c].dataType) for c in also])
    return rows.groupBy("tree", "span").cogroup(messages.groupBy("t", "s")).applyInArrow(run, schema)


def _forest(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of every round, from the leaves (tree, pos, n, digest) up to one node for each tree."""
    rounds = [leaves.select("tree", "pos", "n", "digest")]
    while not rounds[-1].where("n > 1").isEmpty():
        rounds.append(cut(_up(rounds[-1])))
    return rounds


def manifest(rows: DataFrame, source: str = "source", key: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """Adds subroot, root and proof, the siblings on the way up as (before, after) for each level, to rows with a leaf digest.

    All columns go through two shuffles, so select what is wanted: digests instead of texts.
    """
    rows = without(rows, RESULTS)
    # the input's columns go through as one struct, so none clashes with the operator's own
    held = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{leaf}`").alias("digest"), F.col(f"`{key}`").alias("key"),
        F.when(F.col(f"`{source}`").isNull(), "").otherwise(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string"))).alias("tree"))
    leaves = placed(held, ["key", "digest"]).drop("key")
    trees = _forest(leaves)
    tops = placed(trees[-1].select(F.col("tree").alias("name"), "digest", F.lit("").alias("tree")), ["name"])
    crown = _forest(tops)
    # the reversed sweep: from the root to the sources' roots, and from those to the leaves
    told = crown[-1].select("tree", "pos", F.array().cast(T.ArrayType(STEP)).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in crown[-2:0:-1]:
        told = _down(nodes, told)
    told = _down(tops, told, ["name", "digest"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    for nodes in trees[-2:0:-1]:
        told = _down(nodes, told)
    return _down(leaves, told, ["row"]).select("row.*", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)
