"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's result
as Parquet in the shared folder and reads it again, so a lost executor costs no more than the stage at hand.

All stages but the last return the columns they get, whatever else these are named; an empty table gives an empty one; long texts
are read whole. What each does with null, blank, equal and repeated rows stands at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelspan.llm import decontaminate, near_dup, packing, quality, secret_scan
from voxelspan.llm.shared import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio accept.

    Null and blank texts have no words and go; repeated rows and rows without an id are judged each for itself; a score equal to the threshold stays.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id.

    Texts without words, null ones among them, are classes of their own and stay; of rows with one id one stays, by a hash of its text; rows without an id stay.
    """
    return near_dup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the error budget.

    Null and blank texts hold none and stay; a distance equal to the budget counts as held; repeated rows go or stay together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan found replaced by a mark.

    A null text stays null; of findings that overlap the first starts the mark and the last ends it; repeated rows are redacted alike.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    A null or empty text is one piece, the end id; repeated rows and rows without an id are packed each for itself.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: None: the signatures, the network and the packing cannot be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
