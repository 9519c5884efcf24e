"""Training-data pipeline: from raw documents to token ids, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.llm import divergence_rules, exact_copies, piece_lattice, prefix_join, source_mix
from trackfold.llm.base import documents
from trackfold.session import cut

MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble one of the corpus' languages."""
    return divergence_rules.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (A-Z in lower case), the one with the largest id."""
    return exact_copies.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, one stays: the smallest id."""
    return prefix_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may be there up to three times."""
    return source_mix.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number; the text is what the ids decode to."""
    model = public_tokenizers.path(MODEL)
    encoded = piece_lattice.encode_documents(docs, model, decode=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("to_pieces", to_pieces),
]

# hashes decide the order of the mix and the pieces come from a model file
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
