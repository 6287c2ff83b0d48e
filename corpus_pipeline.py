"""From raw documents to packed sequences: five stages, each of which rewrites the table of the one before.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of `documents`.  SQL cannot express the classifier, so ORACLE_SQL is None; tests compare run() with
a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loftline.llm.common import staged, table
from loftline.llm.exactdedup import drop_exact_duplicates
from loftline.llm.packing import pack
from loftline.llm.quality_model import drop_low_quality
from loftline.llm.quality_rules import drop_rejected
from loftline.llm.simhash import drop_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.5 go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: three bits or a five-word Jaccard similarity of 0.8 link."""
    return drop_near_duplicates(docs, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
