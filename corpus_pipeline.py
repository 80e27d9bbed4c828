"""A training corpus in five stages. Each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm import decontaminate, language, packing, pii, simhash
from duelbook.session import remove_path, scratch_path

#: A text whose n-grams are this unlike every learned profile is in none of the languages.
LEAST_SCORE = 0.2
#: The key of this pipeline's surrogates; a real run brings its own.
KEY = "pipeline-key"


#: The columns of documents that stages work on.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeps_columns(stage: Stage) -> Stage:
    """A stage that returns the columns it was given, in their order, with the length of the text as it is now.

    Columns other than ``OWN`` go through as one struct, so a name of theirs that an operator uses too (score, n_hit, _parts ..) neither
    vanishes nor is overwritten.
    """
    @functools.wraps(stage)
    def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in OWN]
        others = {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c not in OWN)}
        besides = [F.struct(*[F.col(f"`{c}`").alias(k) for c, k in others.items()]).alias("besides")] if others else []
        done = stage(spark, docs.select(*own, *besides), sf_dir)
        if "n_chars" in own:
            done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return done.select([F.col("besides")[others[c]].alias(c) if c in others else F.col(c) for c in docs.columns])

    return kept


@keeps_columns
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language that the labels teach, go; a missing label is filled in."""
    learned = language.profiles(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, learned).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred"))


@keeps_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


@keeps_columns
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that was nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cleaned = decontaminate.remove_spans(docs, benchmark)
    return cleaned.where((F.col("n_hit") == 0) | F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")))


@keeps_columns
def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return pii.pseudonymise(docs, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("pii", pseudonymised), ("packing", packed),
]

#: The profiles, the XXH64 fingerprints, the surrogates and the token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted when the next one has written; the last input stays."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            remove_path(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
