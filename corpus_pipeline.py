"""A corpus pipeline: toxicity filter, near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results of every stage: repeated rows are rows; very long texts are read whole; further columns, whatever
their names, are kept as they are, by all but the last: they travel as one struct, so none meets an operator's own
columns. An empty table gives an empty result. What null ids, texts and sources mean is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import bpe, toxicity
from seqlens.llm.mixing import mix_sources
from seqlens.llm.near_dups import drop_near_duplicates
from seqlens.session import shared_table


READ = ("doc_id", "text", "source")


def _shielded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with docs' columns: the stage sees READ and a struct of all others."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    more = [c for c in docs.columns if c not in READ]
    rest = [F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(more)]).alias("rest")] if more else []
    done = stage(docs.select(*[c for c in READ if c in docs.columns], *rest))
    return done.select(*[F.col(f"rest.c{more.index(c)}").alias(c) if c in more else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts score low and stay; a null id is never learnt from but is scored; ties at one half go.
    """
    tagger = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _shielded(docs, lambda rows: toxicity.score_documents(rows, tagger, out="toxicity").where(F.col("toxicity.score") < 0.5))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest id stays. Texts without words, null or empty, are copies of nothing and stay.
    """
    return _shielded(docs, lambda rows: drop_near_duplicates(rows, shingle=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes it (a row for each time).

    A null source is a source of its own, ranked last; a text without words has size 0.
    """
    return _shielded(docs, lambda rows: mix_sources(rows, out="mix").withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("mix.repeats")))))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, a row for each row.

    A null text is the empty text; a null id stays null.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("mixing", mix), ("bpe", tokenise)]

#: The learned filter and the hash thresholds have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
