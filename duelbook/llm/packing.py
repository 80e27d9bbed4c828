"""Sum-of-squares online packing of documents into sequences of at most ``capacity`` tokens.

A level array counts the open sequences of each fill. A document goes to the fill level that leaves the smallest sum of
squared counts, a new sequence included; of equal levels the fullest is taken. A document longer than a sequence fills whole
ones first, and its rest is placed. A sequence that is full is written out. What is open at the end of a task, or when
``most_open`` are open, is joined end to end and cut at the capacity; the last rest of a task is cut at powers of two, which
need no padding. So no sequence is padded, and a task holds no more than its open sequences.

Each task packs its own documents, as they come; sequence ids hold the partition number. The input should be read from
files (or a written table), so that a lost task finds the same rows again.

A null text is empty: its document is the end token alone. A null id is carried. Repeated rows are packed each. An empty table has no
sequences. Only the id column of the input is carried.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from duelbook.llm.batches import give_back, pieces

CAPACITY, END = 2048, 1
#: Parts of chunks whose ids a task remembers; more only while they are in use.
REMEMBERED = 250_000
#: Signs split off a chunk's end after a letter or digit: there the tokenizer always begins a new token. A special token ends in ">".
STOPS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != ">")
#: Bytes of ASCII letters and digits, and second bytes of Latin letters after C3.
SINGLE = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
SECOND = np.array([128 <= b < 192 and b not in (0x97, 0xb7) for b in range(256)])
#: A word of lower-case Latin letters is one word to the tokenizer too, so it can go to its model as it is.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The characters that byte-level models have for bytes: printable ones as they are, others from 256 on. A newline parts words.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
LINES = BYTES | {10: 10}


def parts_of(chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
    """Two parts of each chunk, over the same bytes: what the signs at its end follow, and these; the second may be empty."""
    bounds = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    data = chunks.buffers()[2] or pa.py_buffer(b"")
    raw, starts, ends = np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:]
    cut = starts + pc.binary_length(pc.ascii_rtrim(chunks, characters=STOPS)).to_numpy()
    split = (cut > starts) & (cut < ends)
    at = cut[split] - 1
    split[split] = SINGLE[raw[at]] | (SECOND[raw[at]] & (raw[at - 1] == 0xc3) & (at > starts[split]))
    offsets = np.empty(2 * len(chunks) + 1, np.int64)
    offsets[:-1:2], offsets[1::2], offsets[-1] = starts, np.where(split, cut, ends), bounds[-1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(chunks), [None, pa.py_buffer(offsets), data])


class Ids:
    """Token ids of texts as little-endian 32-bit numbers.

    The tokenizer drops white space, never joins over it and lower-cases, so a text's ids are those of its lower-case chunks
    between ASCII white space. Chunks are looked up by their distinct parts, all of a batch at once; a part is encoded once and
    then remembered. A text that might hold a special token, which keeps its case, isn't lower-cased here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for plain words, whose last tokens end in its suffix
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known = pa.array([b""], pa.large_binary())
        self.ids = pa.array([b""], pa.large_binary())
        self.used = np.zeros(1, bool)

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        lines = [b"\n".join(words[i:i + 1000]).decode("latin-1").translate(LINES) for i in range(0, len(words), 1000)]
        found = self.words.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, "<u4") for f in found])
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        out = []
        for start in range(0, len(chunks), 4000):
            part = chunks[start:start + 4000]
            decoded = [c.decode("utf-8", "replace") for c in part]
            found = self.tokenizer.encode("\n".join(decoded), add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = np.cumsum(np.fromiter(map(len, decoded), np.int64, len(part)) + 1)
            last = (4 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), ends)).tolist()
            out += [raw[i:j] for i, j in zip([0, *last], last)]
        return out

    def learn(self, parts: pa.LargeBinaryArray) -> None:
        """Adds parts that aren't known, in this order."""
        rows = parts.to_pylist()
        plain = [p for p in rows if PLAIN.fullmatch(p)]
        found = dict(zip(plain, self.encode_plain(plain), strict=True)) if plain else {}
        other = [p for p in rows if p not in found]
        found.update(zip(other, self.encode(other), strict=True))
        self.known = pa.concat_arrays([self.known, parts])
        self.ids = pa.concat_arrays([self.ids, pa.array([found[p] for p in rows], pa.large_binary())])
        self.used = np.concatenate([self.used, np.zeros(len(parts), bool)])

    def forget(self) -> None:
        """Keeps what was used since the last time."""
        self.used[0] = True
        kept = pa.array(self.used)
        self.known, self.ids = self.known.filter(kept), self.ids.filter(kept)
        self.used = np.zeros(len(self.known), bool)

    def of(self, texts: pa.Array) -> list[bytes]:
        # copied, as Arrow lower-cases a cast slice wrongly
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()).view(pa.large_string()), "")])
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        chunks = pc.ascii_split_whitespace(texts)
        parts = parts_of(chunks.values).dictionary_encode()
        places = pc.index_in(parts.dictionary, value_set=self.known)
        missing = places.is_null()
        places = pc.fill_null(places, 0).to_numpy().copy()
        if new := pc.sum(missing).as_py():
            places[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + new)
            self.learn(parts.dictionary.filter(missing))
        self.used[places] = True
        ids = self.ids.take(pa.array(places)).take(parts.indices)
        if len(self.known) > REMEMBERED:
            self.forget()
        ends = np.frombuffer(ids.buffers()[1], np.int64)[2 * chunks.offsets.to_numpy().astype(np.int64)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[i:j]) for i, j in zip(ends, ends[1:])]


class Levels:
    """Open sequences by fill. A piece is (id, start, ids, length of its document)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        """0 is a new sequence."""
        levels = np.arange(self.capacity - size + 1)
        counts = self.counts
        after = 2 * counts[size:] + 1
        after[-1] = 0  # a full sequence is not open
        gain = after - np.where(levels > 0, 2 * counts[: len(levels)] - 1, 0)
        usable = counts[: len(levels)] > 0
        usable[0] = True
        gain = np.where(usable, gain, np.iinfo(np.int64).max)
        return int(len(gain) - 1 - np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list[tuple] | None:
        """The sequence if it is full now."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        held: list[tuple] = []
        if level:
            held = self.open[level].pop()
            self.counts[level] -= 1
        held.append(piece)
        level += size
        if level == self.capacity:
            return held
        self.open.setdefault(level, []).append(held)
        self.counts[level] += 1
        return None

    def empty(self) -> list[tuple]:
        """Takes out the pieces of all open sequences, the fullest first."""
        out = [p for level in sorted(self.open, reverse=True) for held in self.open[level] for p in held]
        self.open, self.counts[:] = {}, 0
        return out


def cut_at(stream: list[tuple], sizes: Iterable[int]) -> Iterator[list[tuple]]:
    """Sequences of the given sizes from pieces joined end to end; pieces are cut where a sequence ends."""
    stream = stream[::-1]
    for size in sizes:
        held, free = [], size
        while free:
            key, start, ids, total = stream.pop()
            if len(ids) > 4 * free:
                stream.append((key, start + free, ids[4 * free:], total))
                ids = ids[: 4 * free]
            held.append((key, start, ids, total))
            free -= len(ids) // 4
        yield held


def drain(levels: Levels, last: bool) -> Iterator[list[tuple]]:
    stream = levels.empty()
    total = sum(len(p[2]) // 4 for p in stream)
    whole, rest = divmod(total, levels.capacity)
    sizes = [levels.capacity] * whole
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    if last:
        yield from cut_at(stream, sizes + powers)
        return
    full = list(cut_at(stream, sizes + powers))
    yield from full[:whole]
    for held in full[whole:]:
        for piece in held:
            levels.place(piece)


def pack(documents: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END,
         most_open: int = 4096) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    source = documents.select(doc_id, text)
    kind = source.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField(doc_id, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    last_id = np.array([end], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, levels = Ids(path), Levels(capacity)
        number = TaskContext.get().partitionId() << 33

        def rows(sequences: Iterable[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in schema.fields]
            for held in sequences:
                offset = 0
                for key, start, ids, total in held:
                    length = len(ids) // 4
                    for column, value in zip(out, (key, start, length, ids, total, number, offset)):
                        column.append(value)
                    offset += length
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=schema.names)

        for batch in batches:
            for piece in pieces(batch, text):
                full = []
                keys = piece.column(0).to_pylist()
                for key, ids in zip(keys, known.of(piece.column(1))):
                    ids += last_id
                    total, step = len(ids) // 4, 4 * capacity
                    for at in range(0, len(ids), step):
                        part = (key, at // 4, ids[at:at + step], total)
                        done = [part] if len(part[2]) == step else levels.place(part)
                        if done:
                            full.append(done)
                    if levels.counts.sum() >= most_open:
                        full += drain(levels, last=False)
                yield rows(full)
        yield rows(drain(levels, last=True))
        del known, levels
        give_back()

    return source.mapInArrow(run, schema)
