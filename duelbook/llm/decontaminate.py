"""Benchmark decontamination with an FM-index over each training shard.

A shard is a run of documents in one task. Its words become symbols: the benchmark's words are numbered, every run of
other words and every document end is one separator. Separators are ordered by place, so no comparison of suffixes
crosses one. The Burrows-Wheeler transform is held in a wavelet matrix; all windows of the benchmark are searched backward
at once, and their occurrences are located by walking to sampled suffix positions. Spans of hit words are merged.

The benchmark is the query set. It is measured first and handled in blocks of about ``block_bytes`` of text, one pass
over the documents for each block, so what a task holds does not grow with it. Long items are cut into pieces that overlap by all
but one word of a window, so blocks hold ranges of windows, not whole items.

Nulls, empty texts and texts without words have no words and no hits. Repeated documents are each reported. Repeated
item ids are one item; an item id of null counts as ''. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns
from duelbook.session import cut

WINDOW = 10
#: Lower-cases A-Z; every byte that is no word byte becomes a space. UTF-8 bytes from 0x80 on are word bytes.
TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Symbols of a shard.
SHARD = 1 << 20
SAMPLE = 8
#: Benchmark text of one pass over the documents; a task then holds under a million windows.
BLOCK_BYTES = 4 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence that ends in a separator (0). Separators are distinct and ordered by place.

    Each round orders by three times as many symbols and only sorts what is still tied. Ranks are places in the sequence, not
    symbols, so a sort key of three ranks has its 63 bits for any vocabulary; a sequence of 2^21 symbols or more is sorted by two.
    """
    n = len(symbols)
    bits = max(1, n.bit_length())
    if 2 * bits > 63:
        raise ValueError(f"a shard of {n} symbols is too long for a sort key of two ranks")
    rank = np.zeros(n, np.int64)
    zero = symbols == 0
    count = int(zero.sum())
    rank[zero] = np.arange(count)
    rank[~zero] = np.unique(symbols[~zero], return_inverse=True)[1] + count
    wide = 3 * bits <= 63

    def at(places: np.ndarray, step: int) -> np.ndarray:
        later = places + step
        return np.where(later < n, rank[np.minimum(later, n - 1)], 0)

    order = np.arange(n)
    slots, step = np.arange(n), 1
    while len(slots):
        here = order[slots]
        key = (rank[here] << bits) | at(here, step)
        if wide:
            key = (key << bits) | at(here, 2 * step)
        by = np.argsort(key, kind="stable")
        here, key = here[by], key[by]
        order[slots] = here
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[here] = slots[first]
        last = np.append(new[1:], True)
        slots = slots[~(new & last)]
        step *= 3 if wide else 2
    return order


@dataclass
class Index:
    """FM-index: wavelet matrix of the transform, symbol starts, sampled suffix positions."""

    levels: int
    ones: list[np.ndarray]
    zeros: list[int]
    base: np.ndarray
    less: np.ndarray
    marked: np.ndarray
    sampled: np.ndarray

    @classmethod
    def build(cls, symbols: np.ndarray, alphabet: int) -> Index:
        order = suffix_array(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        levels = max(1, int(alphabet).bit_length())
        ones, zeros, current = [], [], before
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1
            ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            set_ = bit.astype(bool)
            left = current[~set_]
            zeros.append(len(left))
            current = np.concatenate([left, current[set_]])
        counts = np.bincount(symbols, minlength=alphabet + 2)
        less = np.concatenate([[0], np.cumsum(counts)])
        # a walk to earlier symbols never has to cross a separator: what follows one is sampled too
        keep = (order % SAMPLE == 0) | (before == 0)
        index = cls(levels, ones, zeros, np.zeros(0, np.int64), less, np.concatenate([[0], np.cumsum(keep, dtype=np.int32)]), order[keep])
        every = np.arange(alphabet + 1)
        index.base = index.down(every, np.zeros(len(every), np.int64))
        return index

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            up = self.ones[k][place]
            place = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + up, place - up)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self.down(symbol, place) - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes begin with each pattern (rows of ``patterns``, ends aligned right)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.less[-1], np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, -back].astype(np.int64)
            low[live] = self.less[symbol] + self.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(self.marked[rows + 1] == self.marked[rows])
        while len(live):
            place, symbol = rows[live], np.zeros(len(live), np.int64)
            for k in range(self.levels):
                up = self.ones[k][place]
                bit = self.ones[k][place + 1] - up
                symbol = (symbol << 1) | bit
                place = np.where(bit == 1, self.zeros[k] + up, place - up)
            rows[live] = self.less[symbol] + place - self.base[symbol]
            steps[live] += 1
            live = live[self.marked[rows[live] + 1] == self.marked[rows[live]]]
        return self.sampled[self.marked[rows]] + steps


@dataclass
class Windows:
    """The distinct windows of some items, as symbol rows aligned right, and the items of each."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], size: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        names = sorted({name for name, _ in rows})
        number = {name: i for i, name in enumerate(names)}
        having: dict[tuple[int, ...], set[int]] = {}
        for name, text in rows:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                having.setdefault(ids[i:i + size], set()).add(number[name])
        patterns = np.zeros((len(having), size), np.int32)
        for row, key in enumerate(having):
            patterns[row, size - len(key):] = key
        groups = [sorted(v) for v in having.values()]
        return cls(
            vocabulary, patterns, np.array([len(k) for k in having], np.int64),
            np.concatenate([[0], np.cumsum([len(g) for g in groups], dtype=np.int64)]),
            np.array([x for g in groups for x in g], np.int64), names,
        )


def symbols_of(text: bytes, get) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words; the symbols with one separator for each run of other words; the word number of each symbol."""
    words = words_of(text)
    ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
    if not len(ids):
        return 0, ids, np.zeros(0, np.int64)
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    keep[0] = True
    return len(ids), ids[keep], np.flatnonzero(keep)


def find(shard: list[tuple[int, np.ndarray, np.ndarray]], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in (document, symbols, word numbers): document, first word, window."""
    parts, places, owners = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for document, symbols, at in shard:
        parts += [symbols, np.zeros(1, np.int32)]
        places += [at, np.zeros(1, np.int64)]
        owners.append(np.full(len(symbols) + 1, document, np.int64))
    index = Index.build(np.concatenate(parts), len(windows.vocabulary))
    low, high = index.search(windows.patterns, windows.lengths)
    width = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(width)), width)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(width) - width, width) + low[window]
    found = index.locate(rows)
    return np.concatenate(owners)[found], np.concatenate(places)[found], window


def hits(texts: list[bytes], windows: Windows, shard_symbols: int = SHARD) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: number of words, merged spans of hit words, sorted item names."""
    get, size = windows.vocabulary.get, windows.patterns.shape[1]
    counts, shard, held, found = [], [], 0, []

    def flush() -> None:
        if shard and len(windows.lengths):
            found.append(find(shard, windows))
        shard.clear()

    for document, text in enumerate(texts):
        count, symbols, at = symbols_of(text, get)
        counts.append(count)
        for start in range(0, len(symbols), shard_symbols):  # a longer text goes in overlapping parts
            part = slice(start, start + shard_symbols + size)
            if held + len(symbols[part]) > shard_symbols + size:
                flush()
                held = 0
            shard.append((document, symbols[part], at[part]))
            held += len(symbols[part]) + 1
    flush()
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not found:
        return counts, spans, items
    document, word, window = (np.concatenate(x) for x in zip(*found))
    if not len(document):
        return counts, spans, items
    by = np.lexsort((word, document))
    document, word, window = document[by], word[by], window[by]
    ends = word + windows.lengths[window]
    for d, a, b in zip(document.tolist(), word.tolist(), ends.tolist()):
        own = spans[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
    pairs = np.unique(np.stack([document, window], 1), axis=0)
    for d, w in pairs.tolist():
        items[d].extend(windows.items[windows.first[w]:windows.first[w + 1]].tolist())
    return counts, spans, [[windows.names[i] for i in sorted(set(x))] for x in items]


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:places[a][0]])
        last = places[b - 1][1]
    return b"".join(out) + text[last:]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> list[DataFrame]:
    """(item, text) by blocks: the windows of a long text come in pieces of at most an eighth of a block."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // block_bytes))
    if parts == 1:
        return [rows]
    room = max(1, block_bytes // 8)

    def cut_up(batches):
        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _pieces(name, whole, window, room)

    pieces = cut(rows.mapInArrow(cut_up, "item string, text binary"))
    return [pieces.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) for k in range(parts)]


def _pieces(name: str, text: bytes, window: int, room: int) -> Iterator[pa.RecordBatch]:
    """The words of a text in pieces of about ``room`` bytes, which overlap so that each window is whole in one of them."""
    words, first = words_of(text) if len(text) > room else [], 0
    if len(words) <= window:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.binary())], names=["item", "text"])
        return
    while first == 0 or first + window <= len(words):
        last, size = first + window, sum(map(len, words[first:first + window]))
        while last < len(words) and size < room:
            size += len(words[last]) + 1
            last += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b" ".join(words[first:last])], pa.binary())], names=["item", "text"])
        first = last - window + 1


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
               window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, hit_spans (merged, in words, end exclusive) and items (sorted names) to the documents.

    Input columns of these names are replaced.
    """
    results = None
    for k, block in enumerate(_blocks(benchmark, item, item_text, window, block_bytes)):
        windows = Windows.of([(r["item"], bytes(r["text"])) for r in block.toLocalIterator()], window)

        def start(windows=windows):
            def work(texts):
                counts, spans, items = hits(texts, windows)
                return [counts, [sum(b - a for a, b in s) for s in spans], [[{"start": a, "end": b} for a, b in s] for s in spans], items]
            return work

        if results is None:
            results = add_columns(documents, text, FIELDS, start)
            continue
        # a further block: its hits are merged with those so far
        names = {f.name: f"{f.name}_so_far" for f in FIELDS}
        both = add_columns(cut(results.withColumnsRenamed(names)), text, FIELDS, start)
        merged = F.udf(lambda x, y: _merge([(s["start"], s["end"]) for s in [*x, *y]]), FIELDS[2].dataType)
        results = both.withColumn("hit_spans", merged("hit_spans", names["hit_spans"])).withColumns({
            "items": F.array_sort(F.array_union("items", names["items"])),
            "n_hit": F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
        }).drop(*names.values())
    return results


def remove_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every occurrence of a window cut out of the text, and ``n_hit``, the words cut.

    Cutting goes on until the text has none, as a cut may join the ends of another window. Clean texts stay as they are,
    null texts too.
    """
    blocks = _blocks(benchmark, item, item_text, window, block_bytes)
    out = documents.withColumn("n_hit", F.lit(0).cast("long"))
    return _remove_one(out, blocks[0], text, window) if len(blocks) == 1 else _remove_blocks(out, blocks, text, window)


def _windows(block: DataFrame, window: int) -> Windows:
    return Windows.of([(r["item"], bytes(r["text"])) for r in block.toLocalIterator()], window)


def _remove_one(out: DataFrame, block: DataFrame, text: str, window: int) -> DataFrame:
    """A task that has all windows cuts a text until it is clean."""
    windows = _windows(block, window)

    def start():
        def work(texts):
            out, cuts, left = list(texts), [0] * len(texts), list(range(len(texts)))
            while left:
                _, spans, _ = hits([out[i] for i in left], windows)
                hit = [(i, s) for i, s in zip(left, spans) if s]
                for i, s in hit:
                    out[i] = without_spans(out[i], s)
                    cuts[i] += sum(b - a for a, b in s)
                left = [i for i, _ in hit]
            return [[t.decode("utf-8", "replace") if c else None for t, c in zip(out, cuts)], cuts]
        return work

    fields = [T.StructField("_cut_text", T.StringType()), T.StructField("_cut_words", T.LongType())]
    return add_columns(out, text, fields, start).withColumns({
        text: F.coalesce("_cut_text", F.col(text)), "n_hit": F.col("n_hit") + F.col("_cut_words"),
    }).drop("_cut_text", "_cut_words")


def _remove_blocks(left: DataFrame, blocks: list[DataFrame], text: str, window: int) -> DataFrame:
    """The spans of all blocks are found in the same text and cut at once; texts that were cut are searched again for all blocks."""
    merged = F.udf(lambda x, y: _merge([(s["start"], s["end"]) for s in [*x, *y]]), T.ArrayType(SPAN))
    shorter = F.udf(lambda t, spans: without_spans(t.encode("utf-8", "replace"), [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace"), T.StringType())
    done = None
    while True:
        for k, block in enumerate(blocks):  # a task holds the index of one block only
            windows = _windows(block, window)

            def start(windows=windows):
                def work(texts):
                    return [[[{"start": a, "end": b} for a, b in s] for s in hits(texts, windows)[1]]]
                return work

            found = add_columns(left, text, [T.StructField("_cut_new", T.ArrayType(SPAN))], start)
            left = cut(found.withColumn("_cut_spans", merged("_cut_spans", "_cut_new") if k else F.col("_cut_new")).drop("_cut_new"))
        hit = F.size("_cut_spans") > 0
        clean = left.where(~hit).drop("_cut_spans")
        done = clean if done is None else done.unionByName(clean)
        left = left.where(hit)
        if left.isEmpty():
            return done
        words = F.aggregate("_cut_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        left = left.withColumns({text: shorter(F.col(text), F.col("_cut_spans")), "n_hit": F.col("n_hit") + words}).drop("_cut_spans")
