"""Periodic runs of words by an enhanced suffix array: branching tandem repeats in LCP intervals, rotated and merged into runs.

A shard is a series of documents in one task. A symbol stands for a word in its document, so suffixes of different documents part
at once. The suffix array comes from ranks doubled round by round, and the same ranks give the LCP array. Every LCP
interval of depth d holds the suffixes that share their first d words; its children part at the word behind them. For each suffix i
of all children but the largest, the inverse suffix array tells whether i + d or i - d lies in the same interval, but in another
child: then the d words before and behind the later of both are equal and the word behind them differs (a branching tandem repeat).
Intervals are rows of numpy arrays, their bounds are found by pointer jumping, and no tree is built. Leaving out the
largest child makes it O(n log n) suffixes. A repeat ends where its run ends; rotating it to the left as long as the words a
period apart are equal gives the run's start. Repeats of one stretch are merged into the run of the smallest period.

A run counts if it has ``least`` words and ``times`` periods or more (with two periods or more every run is found).

Words are what stands between ASCII white space. Null, empty and blank texts have no words, no runs and an empty collapsed text.
Repeated rows each get their runs. A document is worked on whole, in one task: the arrays take some 200 bytes a word and 4
more for each doubling of the longest repeat, so a text of ten million words needs 2 to 3 GB. Input columns with the names of results are replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns

#: Words of a shard, and suffixes looked up at once.
SHARD, BLOCK = 1 << 18, 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("densest", RUN), T.StructField("collapsed", T.StringType())]


def ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 .. symbols; the last ones are distinct. A shorter suffix comes first."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=first[1:])

    def tied(first: np.ndarray) -> np.ndarray:
        return ~(first & np.append(first[1:], True))

    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rounds = [rank]
    slots = np.flatnonzero(tied(first))
    step = 1
    while len(slots):
        here = order[slots]
        later = here + step
        follower = np.where(later < n, rounds[-1][np.minimum(later, n - 1)].astype(np.int64) + 1, 0)
        key = rounds[-1][here].astype(np.int64) * (n + 1) + follower
        by = np.argsort(key, kind="stable")
        here, key = here[by], key[by]
        order[slots] = here
        first = np.empty(len(key), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        rank = rounds[-1].copy()
        rank[here] = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        rounds.append(rank)
        slots = slots[tied(first)]
        step *= 2
    return rounds


def common(rounds: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of each two different suffixes."""
    n = len(rounds[0])
    a, b = a.copy(), b.copy()
    total = np.zeros(len(a), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (rounds[k][np.minimum(a, n - 1)] == rounds[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        total += step
        a += step
        b += step
    return total


def nearest(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place above the least value the next one with a smaller value (or, not strict, with one as small).

    Pointers jump over what is larger. The last value has to be the least.
    """
    n = len(values)
    to = np.minimum(np.arange(1, n + 1), n - 1)
    live = np.flatnonzero(values > values[-1])
    while len(live):
        there = values[to[live]]
        wrong = there >= values[live] if strict else there > values[live]
        live = live[wrong]
        to[live] = to[to[live]]
    return to


def tandems(rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, period) of branching tandem repeats; some come up twice."""
    n = len(rounds[0])
    inverse = rounds[-1].astype(np.int64)
    order = np.empty(n, np.int64)
    order[inverse] = np.arange(n)
    # lcp[j]: what suffixes j - 1 and j of the order share; both ends are below all others
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = common(rounds, order[:-1], order[1:])
    right, right_child = nearest(lcp, True), nearest(lcp, False)
    left = n - nearest(lcp[::-1], True)[::-1]
    places = np.flatnonzero(lcp[:n] > 0)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high, depth = left[places], right[places], lcp[places]
    # an interval's children: one behind each of its boundaries, and the one before its first boundary
    by = np.lexsort((places, depth, low))
    low, high, depth, places = low[by], high[by], depth[by], places[by]
    new = np.empty(len(by), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    owner = np.concatenate([number, np.arange(len(heads))])
    begin = np.concatenate([places, low[heads]])
    end = np.concatenate([right_child[places], places[heads]])
    size = end - begin
    largest = np.lexsort((begin, -size, owner))
    keep = np.ones(len(owner), bool)
    keep[largest[np.concatenate([[True], owner[largest][1:] != owner[largest][:-1]])]] = False
    owner, begin, end, size = owner[keep], begin[keep], end[keep], size[keep]
    low, high, depth = low[heads], high[heads], depth[heads]
    starts, periods = [], []
    upto = np.cumsum(size)
    first = 0
    while first < len(size):  # as many children as make a block of suffixes; a larger child goes alone, in parts
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK, "right")))
        for part in range(0, int(size[first]) if last == first + 1 else 1, BLOCK):
            if last == first + 1:
                slot = np.arange(begin[first] + part, min(end[first], begin[first] + part + BLOCK))
                child = np.full(len(slot), first)
            else:
                child = np.repeat(np.arange(first, last), size[first:last])
                slot = np.arange(len(child)) - np.repeat(upto[first:last] - size[first:last] - (upto[first - 1] if first else 0), size[first:last]) + begin[child]
            own, at = owner[child], order[slot]
            d = depth[own]
            for other, start in ((at + d, at), (at - d, at - d)):
                good = (other >= 0) & (other < n)
                place = inverse[np.where(good, other, 0)]
                good &= (place >= low[own]) & (place < high[own]) & ((place < begin[child]) | (place >= end[child]))
                starts.append(start[good])
                periods.append(d[good])
        first = last
    return np.concatenate(starts), np.concatenate(periods)


def rotated(rounds: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first words of the runs: repeats are rotated to the left while the words a period apart are equal, in leaps of 2^k words."""
    start = start.copy()
    for k in range(len(rounds) - 1, -1, -1):
        before = start - (1 << k)
        inside = before >= 0
        place = np.where(inside, before, 0)
        start[inside & (rounds[k][place] == rounds[k][place + np.where(inside, period, 0)])] -= 1 << k
    return start


def runs_of(symbols: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) by start, then period."""
    rounds = ranks(symbols)
    first, period = tandems(rounds)
    end = first + 2 * period
    start = rotated(rounds, first, period)
    # of the repeats of one stretch that with the smallest period is the run: others repeat it twice, three times ..
    by = np.lexsort((period, end, start))
    start, period, end = start[by], period[by], end[by]
    fresh = np.ones(len(end), bool)
    fresh[1:] = (end[1:] != end[:-1]) | (start[1:] != start[:-1])
    length = end - start
    fresh &= (length >= least) & (length >= times * period)
    rows = np.stack([start, length, period], 1)[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def densest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, then smallest start, then period; fractions are compared exactly."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _told(run: tuple[int, int, int] | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run))


def find_runs(documents: DataFrame, text: str = "text", least: int = 6, times: int = 4, shard: int = SHARD) -> DataFrame:
    """Adds n_words, runs (start, length, period in words; by start, then period), densest (one of them) and collapsed.

    ``collapsed`` is the text with one period of each run: words that a run contains after its first period are dropped, what is
    left is joined by single spaces.
    """
    if times < 2:
        raise ValueError("a run has two periods or more")

    def told(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        if runs:
            change = np.zeros(len(words) + 1, np.int32)
            for first, length, period in runs:
                change[first + period] += 1
                change[first + length] -= 1
            words_left = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        else:
            words_left = words
        structs = [dict(zip(("start", "length", "period"), run)) for run in runs]
        best = densest(runs)
        return len(words), structs, None if best is None else structs[runs.index(best)], b" ".join(words_left).decode("utf-8", "replace")

    def found(held: list[list[bytes]]) -> list[tuple]:
        numbers: dict[bytes, int] = {}
        sizes = [len(words) for words in held]
        ids = np.fromiter((numbers.setdefault(word, len(numbers)) for words in held for word in words), np.int64, sum(sizes))
        if not len(ids):
            return [told(words, []) for words in held]
        runs = runs_of(ids + np.repeat(np.arange(len(held)), sizes) * len(numbers), least, times)
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        bounds = np.searchsorted(runs[:, 0], edges)
        out = []
        for words, edge, a, b in zip(held, edges.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            out.append(told(words, [(first - edge, length, period) for first, length, period in runs[a:b].tolist()]))
        return out

    def start():
        def work(texts):
            out, held, total = [], [], 0
            for text in texts:
                words = text.split()
                if held and total + len(words) > shard:
                    out += found(held)
                    held, total = [], 0
                held.append(words)
                total += len(words)
            if held:
                out += found(held)
            return list(zip(*out)) if out else [[] for _ in FIELDS]
        return work

    return add_columns(documents, text, FIELDS, start)
