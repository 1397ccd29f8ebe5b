"""A corpus pipeline: quality rules, near duplicates, decontamination, personal data, token ids.

Each stage works on all that the one before it kept. Columns of the documents beyond the known ones
are carried through; they may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.llm import bpe, decontaminate, fertility, jaccard, pii
from tastemill.llm.common import table
from tastemill.session import TEXT_SETTINGS, stage, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` with the columns beyond the known ones under names that clash with none."""
    others = {c: f"_other_{k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
    done = work(docs.withColumnsRenamed(others))
    back = {v: k for k, v in others.items()}
    return done.withColumnsRenamed({v: k for v, k in back.items() if k not in done.columns})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the bands come from this stage's own input."""
    return apart(docs, lambda d: fertility.verdicts(d).where("kept").select(*d.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of 5-word shingles), that with the smallest id."""
    return apart(docs, lambda d: jaccard.representatives(d, rule=jaccard.NEAR).select(*d.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark passages."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return apart(docs, lambda d: decontaminate.find(d, items).where(~decontaminate.contaminated()).select(*d.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""

    def work(d: DataFrame) -> DataFrame:
        masked = pii.find(d, pii.learn(d), carry=[c for c in d.columns if c != "text"], masked="text")
        return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*d.columns)

    return apart(docs, work)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and the digest of what the ids decode to."""

    def work(d: DataFrame) -> DataFrame:
        both = bpe.decode(bpe.encode(d))
        return both.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")

    return apart(docs, work)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: Bands of token measures, a trained tagger and token ids are beyond SQL; tests use plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes its result to the shared folder for the next."""
    docs = table(tune(spark, TEXT_SETTINGS), sf_dir, "documents")
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
