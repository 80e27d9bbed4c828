"""Neighbour search, periodic runs and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from duelbook.llm import lsh_search, manifest, queries, runs

SMALL = "/root/testdata/sf0.001"


# neighbour search

def exact_neighbours(rows, k):
    """{query id: [(rank, id, score)]} over all pairs; scores are summed exactly."""
    import math
    rows = sorted(set(rows))
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            told = sorted((-math.fsum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:k]
            out[q] = [(n, i, -away + 0.0) for n, (away, i) in enumerate(dict.fromkeys(told), 1)]
    return out


def searched(spark, rows, k, **more):
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in rows], "vec_id long, embedding array<double>")
    out = {}
    for r in lsh_search.search(df, df.where(F.col("vec_id") % 20 == 0), k, **more).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_search_is_exact_where_all_rows_are_one_bucket(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-3, 4, (150, 5)).astype(float)  # many ties and copies
    rows = [(i, tuple(x)) for i, x in enumerate(base) if any(x)] + [(500, (1.0, 0, 0, 0, 0)), (520, (1.0, 0, 0, 0, 0))]
    rows = [(i, tuple(map(float, x))) for i, x in rows]
    assert searched(spark, rows + rows[:30], 7) == exact_neighbours(rows, 7)
    assert searched(spark, rows[:5] + rows[-1:], 20) == exact_neighbours(rows[:5] + rows[-1:], 20)  # fewer than k


def test_recall_of_small_buckets_and_lengths_that_differ(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    x[700:1100] = x[700] + rng.standard_normal((400, 24)) * 0.01  # a crowd of near copies
    rows = [(i, tuple(map(float, v))) for i, v in enumerate(x)]
    want, got = exact_neighbours(rows, 10), searched(spark, rows, 10, block=64)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    scores = {q: {i: s for _, i, s in v} for q, v in exact_neighbours(rows, 1499).items()}
    assert all(s == scores[q][i] for q, v in got.items() for _, i, s in v)
    recall = [len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) / 10 for q in want]
    assert sum(recall) / len(recall) >= 0.9


def test_recall_of_the_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in queries.op11_lsh_search(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        hits += len(best & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_buckets_come_by_success_and_once():
    rng = np.random.default_rng(3)
    hashes = lsh_search.Hashes.drawn(2, 3, 8, 1.0)
    x = rng.standard_normal((1, 8))
    projected = hashes.asked(x)[0]
    for cosine in (0.0, 0.4, 0.99, 1.0):
        told = list(hashes.order(0, projected[0], cosine))
        assert [p for p, _ in told] == sorted((p for p, _ in told), reverse=True)
        assert len({b for _, b in told}) == len(told) and abs(sum(p for p, _ in told) - 1) < 1e-3
    assert hashes.visits(projected, 1.0, 0.95) in ([hashes.bucket(t, hashes.slots(hashes.rows(x / np.linalg.norm(x)))[0, t])] for t in (0, 1))


def test_search_leaves_out_what_has_no_direction(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [2.0]), (40, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = sorted(tuple(r) for r in lsh_search.search(df, df.where("vec_id % 20 = 0"), 3).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
    assert lsh_search.search(df.where("vec_id = 2"), df.where("vec_id = 2"), 3).collect() == []
    assert lsh_search.search(df.limit(0), df.limit(0), 3).columns == ["query_id", "rank", "vec_id", "score"]


# periodic runs

def all_runs(words, least, times):
    seen = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in seen.items() if e - s >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(4)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(1, 3)):
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 50))]
            if rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            docs.append(words)
        least, times = rng.choice([(2, 2), (6, 4), (6, 2)])
        symbols = np.concatenate([np.array(w) + 100 * k for k, w in enumerate(docs)])
        want, before = [], 0
        for words in docs:
            want += [(s + before, n, q) for s, n, q in all_runs(words, least, times)]
            before += len(words)
        assert [tuple(r) for r in runs.runs_of(symbols, least, times).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_many_runs_in_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 100_000:  # a Fibonacci word is as full of squares as can be
        a, b = b, b + a
    found = runs.runs_of(np.array(b), 6, 2)
    assert len(found) > 30_000 and (found[:, 1] >= 2 * found[:, 2]).all()
    assert runs.runs_of(np.zeros(300_000, np.int64), 6, 4).tolist() == [[0, 300_000, 1]]
    assert runs.runs_of(np.arange(300_000), 6, 4).tolist() == []


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told_runs(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, 6, 4)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark, tmp_path):
    odd = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x b b b b b b b b", "a b a b a b a b c c c c c c a b a b a b a b", "a\x0bb\x1ca b" * 9, "é " * 1000]
    texts = [t for t in odd for _ in range(12)] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 4000]
    rows = list(enumerate(texts)) + [(5, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect())
    assert got == sorted(((d, *told_runs(d, t)) for d, t in rows), key=str) or got == sorted((d, *told_runs(d, t)) for d, t in rows)


def test_runs_keep_columns_and_small_shards(spark):
    rows = [(1, "a b a b a b a b c", "old", 1), (None, None, None, None), (1, "a b a b a b a b c", "old", 1)]
    df = spark.createDataFrame(rows, "id long, text string, runs string, N_words int")
    for shard in (1, 1 << 18):
        found = runs.find_runs(df, shard=shard).orderBy(F.col("id").desc()).collect()
        assert [sorted(r.asDict()) for r in found] == [["collapsed", "densest", "id", "n_words", "runs", "text"]] * 3
        assert [(r.collapsed, [tuple(x) for x in r.runs], r.n_words) for r in found] == [("a b c", [(0, 8, 2)], 9)] * 2 + [("", [], 0)]
    assert runs.find_runs(df.limit(0)).collect() == []


# Merkle manifest

def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i:i + 16])) for i in range(0, len(low), 16)])
    return levels


def path_in(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + 16])))
        i //= 16
    return out


def plain_manifest(leaves):
    """{(source, key, leaf): [(subroot, root, path)]} of (source, key, leaf) rows."""
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = sorted({s for s, _, _ in leaves}, key=order)
    rows = {s: sorted(((k, d) for x, k, d in leaves if x == s), key=lambda r: (order(r[0]), r[1])) for s in sources}
    trees = {s: tree_of([d for _, d in rows[s]]) for s in sources}
    top, out = tree_of([trees[s][-1][0] for s in sources]), []
    for n, s in enumerate(sources):
        for i, (k, d) in enumerate(rows[s]):
            out.append((s, k, d, trees[s][-1][0], top[-1][0], path_in(trees[s], i) + path_in(top, n)))
    return out


def test_manifest_against_whole_trees(spark):
    rng = random.Random(6)
    leaves = [("hot", rng.randrange(4000), digest(str(i))) for i in range(4400)]  # more than one round, keys repeat
    leaves += [(f"s{i % 40}é", i, digest(f"x{i}")) for i in range(300)] + [(None, None, digest("n1")), (None, 1, digest("n2")), ("", 3, digest("e")), ("lone", 9, digest("l"))]
    leaves += [("hot", 17, digest("same"))] * 20
    df = spark.createDataFrame(leaves, "source string, doc_id long, leaf string").withColumns({"Root": F.lit("mine"), "tree": F.lit(1), "pos": F.lit(2)})
    found = manifest.manifest(df)
    assert found.columns == ["source", "doc_id", "leaf", "tree", "pos", "subroot", "root", "proof"]
    got = [(r.source, r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof], r.folded, r.told)
           for r in found.withColumns({"folded": manifest.folded(F.col("leaf"), F.col("proof")), "told": manifest.proof_digest(F.col("proof"))}).collect()]
    want = plain_manifest(leaves)
    assert sorted(map(str, (g[:6] for g in got))) == sorted(map(str, want))
    assert all(g[6] == g[4] and g[7] == digest("".join(a + b for a, b in g[5])) for g in got)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(None, None, "d" * 64)], "source string, doc_id long, leaf string")
    assert [tuple(r) for r in manifest.manifest(df).collect()] == [(None, None, "d" * 64, "d" * 64, "d" * 64, [])]
    assert manifest.manifest(df.limit(0)).collect() == []


def test_messages_wait_in_a_short_queue():
    import heapq
    most, push = 0, heapq.heappush

    def counted(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    manifest.heapq = type("heap", (), {"heappush": staticmethod(counted), "heappop": staticmethod(heapq.heappop)})
    try:
        assert [len(level) for level in manifest.climb([str(i) for i in range(16 ** 3 + 1)], 4)] == [257, 17, 2, 1]
    finally:
        manifest.heapq = heapq
    assert most <= 16 * 4


def test_tampering_shows_where_text_has_capitals(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op13_manifest(spark, SMALL).collect():
        text = rows[r.doc_id].text or ""
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text)
        assert r.verified == (not changed) == (r.folded_root == r.root)


def test_new_queries_on_empty_and_null_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        empty = spark.createDataFrame([], kind)
        empty.write.parquet(f"{tmp_path}/none/{name}.parquet")
        spark.createDataFrame([(None,) * len(empty.columns)] * 3, kind).write.parquet(f"{tmp_path}/nulls/{name}.parquet")
    for name in ("op11_lsh_search", "op12_runs", "op13_manifest"):
        assert queries.REGISTRY[name](spark, f"{tmp_path}/none").count() == 0
        assert queries.REGISTRY[name](spark, f"{tmp_path}/nulls").count() == (0 if name == "op11_lsh_search" else 3)
