"""A training corpus from raw documents, in five stages.

Each stage works on all rows that its predecessor kept; all but the last return the
columns of ``documents``, whatever further columns there are. run() writes every stage to
the shared folder and reads it again, so that a lost executor costs one stage at most; a
stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import importance, mixing, pieces, pii, simhash
from meridian.llm.common import stored_alone, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go.

    Null and blank texts are weighed as neither good nor bad, so most stay; repeated rows are drawn together; without
    good labels all rows stay; no rows give none.
    """
    return importance.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are at least 0.8 alike, the one with the smallest doc_id.

    Null and blank texts are one group; repeated rows become one; a null doc_id is larger than any; no rows give none.
    """
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and n_chars after it.

    Null texts stay null, with a null n_chars; repeated rows stay alike; no rows give none.
    """
    out = pii.redacted(docs, pii.trained(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the schedule: documents repeated, cut or left out as it says.

    Null and blank texts hold no words and are left out; a null source is a source; repeated rows are documents of
    their own; no rows give none.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by SentencePiece pieces with merge-dropout, in the order of the mix.

    Null texts have null ids and empty ones none; repeated rows are encoded alike; no rows give none.
    """
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

# Hashed models, sketches and pieces are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which reads the table of the stage before it."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, spent = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spent)
    return STAGES[-1][1](spark, docs, sf_dir)
