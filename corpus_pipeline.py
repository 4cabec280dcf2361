"""A corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcoder.llm import bpe, exact_dedup, language_id, mixing, simhash_dedup
from textcoder.llm.queries import tokenizer_path
from textcoder.llm.util import documents, stored
from textcoder.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no language (``und``: no letter, or nothing to learn from)."""
    _ready(spark)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model, out="__language")
    return found.filter(F.col("__language.lang") != language_id.UNKNOWN).drop("__language")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _ready(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    _ready(spark)
    return simhash_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    _ready(spark)
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, their token ids, and whether decoding gives the tokens' text."""
    _ready(spark)
    path = tokenizer_path()
    # Stored in between, so that a core has one Python worker at a time and not one that encodes beside one that decodes.
    encoded, _ = stored(bpe.encode(docs, path, out="token_ids"), "token-ids")
    both = bpe.decode(encoded, path, ids_col="token_ids", out="decoded")
    return both.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Similarity components and trained language models have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    _ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
