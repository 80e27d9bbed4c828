"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (one to three letters, lower-cased, words padded on both sides) in order
of frequency, ties by code. A text gets the language whose profile has the smallest out-of-place distance to its own: the
sum over its n-grams of how far the two ranks differ, or the profile's length where an n-gram is missing there.

Profiles are learned from a sample of about ``train_rows`` distinct labelled texts of each language, chosen by their hash,
or from all if there are fewer; copies count once. Prediction reads whole texts and nothing but the text. The score is 1 - distance / largest
possible distance, from 0 to 1; of equal distances the first language by name wins.

A null text, or one without letters, is ``und`` with score 0; so is every text if nothing was learned. Rows with a null label
are not learned from. Repeated rows are each predicted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.llm.batches import add_columns, pieces, texts_of

PROFILE, TRAIN_ROWS, MOST_LANGUAGES = 400, 5000, 1000
UNKNOWN = "und"
PAD = 1


def letters() -> np.ndarray:
    """Code point to lower-case code point for letters, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as numbers (21 bits for a character), and how often each occurs."""
    codes = table[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")].astype(np.int64)
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = codes[1] != 0
    codes = codes[keep]
    codes[codes == 0] = PAD
    middle = codes != PAD
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    return np.unique(np.concatenate([codes[middle], two, three[middle[1:-1]]]), return_counts=True)


def most_frequent(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:size]]


def sample(rows: DataFrame, text: str, lang: str, train_rows: int) -> DataFrame:
    """About ``train_rows`` distinct texts of each language, chosen by their hash; all of a language with fewer.

    The numbers of distinct texts, one for each of at most MOST_LANGUAGES languages, become a filter, so texts are chosen where they are
    read; only hashes and the chosen texts are shuffled.
    """
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("hash", F.xxhash64("text"))
    sizes = labelled.groupBy("lang").agg(F.count_distinct("hash").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the labels are no languages")
    if not sizes:
        return labelled.select("lang", "text")
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(parts, -(-parts * train_rows // r["n"])))])
    chosen = labelled.where(F.pmod("hash", F.lit(parts)) < F.element_at(share, F.col("lang")))
    return chosen.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")


def profiles(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE, train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """The n-grams of each language by rank. At most MOST_LANGUAGES x ``size`` numbers come to the driver."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            for piece in pieces(batch, "text"):
                held: dict[str, list] = {}
                for name, value in zip(piece.column(0).to_pylist(), texts_of(piece.column(1))):
                    held.setdefault(name, []).append(grams(value, table))
                for name, found in held.items():
                    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counted = sample(rows, text, lang, train_rows).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").toLocalIterator():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Model:
    def __init__(self, learned: dict[str, list[int]], size: int):
        self.names, self.size, self.table = sorted(learned), size, letters()
        self.codes = np.unique(np.array([g for v in learned.values() for g in v], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)  # the last row: nowhere
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, learned[name]), k] = np.arange(len(learned[name]))

    def predict(self, text: bytes) -> tuple[str, float]:
        own = most_frequent(*grams(text, self.table), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (len(own) * self.size))


def identify(documents: DataFrame, learned: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score; input columns of these names are replaced."""
    def start():
        model = Model(learned, size)

        def work(texts):
            found = [model.predict(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]
        return work

    return add_columns(documents, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
