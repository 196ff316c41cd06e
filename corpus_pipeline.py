"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mix, packing.

Every stage takes (spark, docs, sf_dir), where docs is its predecessor's output read from Parquet, and works on all
of it. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitetable.llm import histogram_packing, risk_rules, secret_owners, threshold_mixing, weighted_minhash
from sitetable.llm.common import Scratch, read_table
from sitetable.llm.queries import prepared, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or an admitted cutoff rejects go."""
    return risk_rules.keep_good(docs, read_table(prepared(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    prepared(spark)
    return weighted_minhash.unique(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; every document stays."""
    prepared(spark)
    return secret_owners.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepared(spark)
    return threshold_mixing.mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    prepared(spark)
    return histogram_packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("source_mix", source_mix), ("packing", packing)]

# SQL has neither consistent sampling nor the tokenizer; the stages are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is stored before the next reads it."""
    scratch = Scratch(prepared(spark), "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name, result=True)
    return docs
