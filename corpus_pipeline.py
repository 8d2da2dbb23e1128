"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`.  Null and empty texts pass all stages; extra columns of the input are carried along, and
empty tables give empty tables.  Rows that repeat both id and text are one document and stay together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostloom.llm import bpe, mixing, toxicity
from boostloom.llm.near_dups import near_dups
from boostloom.llm.shared import written
from boostloom.llm.substrings import substring_dedup


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return toxicity.reject(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates (similarity 0.8, five words)."""
    kept = near_dups(docs).filter("kept").select("doc_id").distinct()
    return docs.alias("every").join(kept.alias("kept"), F.col("every.doc_id").eqNullSafe(F.col("kept.doc_id")), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that stand earlier; a text that loses some is joined by spaces."""
    cut = substring_dedup(docs, width=20, with_row=True)
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row")["n_chars"])}
    return cut.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; rates are at least 1, so that rare domains gain and none loses documents."""
    model, solution, _ = mixing.fit(docs, _labels(spark, sf_dir), lower=1.0)
    return mixing.resample(docs, model, solution)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that decoding the ids gives back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_dups),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Fitted classifiers and exact tokenisation aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
