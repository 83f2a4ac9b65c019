"""The corpus pipeline: each stage works on all that the one before it kept.

Stages are named functions of (spark, docs, sf_dir). ``run`` applies them to
``documents``; between stages the documents are checkpointed, so a lost executor
costs no more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netlens.llm import decontaminate, nearcopies, pieces, pii, toxicity
from netlens.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the toxicity threshold; learnt from labels that are not held out."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised and disclosing terms too."""
    return pii.sanitise(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of its pieces, and whether they decode to the text."""
    return pieces.encode(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("pieces", segment),
]

#: Regressions, components and segmentation are beyond SQL. The tests hold the parts of each stage against brute force: the
#: lattice of toxicity path by path, near copies by all pairs of shingle sets, decontamination by all windows, base spans and
#: counts of terms by the stated rules, pieces by an agenda that looks at every pair anew.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
