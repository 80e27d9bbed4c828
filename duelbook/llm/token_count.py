"""Count-only Viterbi over a unigram vocabulary.

The text is split as unigram tokenizers with a metaspace do: every space becomes U+2581, one is put in front, and each
U+2581 begins a word. In a word an Aho-Corasick automaton names all vocabulary pieces by their ends, and for every place
the best score and its number of tokens are carried; no lattice and no back pointers are kept. Rules of the exact tokenizer:
scores are added in double precision from the left; among equal scores the longest last piece wins; a character without a
piece of its own can be an unknown of (lowest score - 10), which counts as its UTF-8 bytes (byte fallback).

Empty and null texts have no tokens. Every row is counted; other columns pass through.
"""

from __future__ import annotations

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 100


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], lowest: float | None = None):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.find = self.automaton.iter if pieces else lambda word: ()
        self.unknown = (min((s for _, s in pieces), default=0.0) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of the best segmentation of one word."""
        scores, counts = [0.0], [0]
        found = iter(self.find(word))
        nxt = next(found, None)
        for end, char in enumerate(word):
            best, tokens, longest = None, 0, 0
            while nxt is not None and nxt[0] == end:
                length, score = nxt[1]
                start = end + 1 - length
                score += scores[start]
                if best is None or score > best or (score == best and length > longest):
                    best, tokens, longest = score, counts[start] + 1, length
                nxt = next(found, None)
            if char not in self.single:
                score = scores[end] + self.unknown
                if best is None or score > best:
                    best, tokens = score, counts[end] + len(char.encode("utf-8", "replace"))
            scores.append(best)
            counts.append(tokens)
        return counts[-1]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = marked.split(SPACE)
        if marked.startswith(SPACE):
            words = words[1:]
        known, total = self.known, 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.word(SPACE + word)
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = count
            total += count
        return total


def count_tokens(documents: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens; an input column of that name is replaced. ``path``: a sentencepiece model file."""
    def start():
        counter = Counter(vocabulary(path))
        return lambda texts: [[counter.text(t.decode("utf-8", "replace")) for t in texts]]

    return add_columns(documents, text, [T.StructField(name, T.LongType())], start)
