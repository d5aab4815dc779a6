"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again. All but the last return the columns of ``documents``.

In every stage a missing text is empty, rows that repeat each other are rows of their own, extra columns may have any name, a
very long text is worked on whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import mixing, packing, quality_rules, secrets, simhash
from txrisk.llm.common import table
from txrisk.session import reliable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, empty ones among them. A missing language or source is a group of its own."""
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Texts without a word are a group."""
    return simhash.first_of_groups(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what looks like a secret is masked, in each row that has it. A missing text stays missing."""
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out, so that sources come near their targets. A missing source is the last one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences; an empty document is its closing id."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = reliable(docs)
    return docs


#: Packing counts the tokens of a vocabulary file, which SQL can't express; tests/llm compares every stage with brute force.
ORACLE_SQL = None
