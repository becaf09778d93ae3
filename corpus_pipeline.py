"""A corpus pipeline over ``documents``: classify, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the
last return the columns of documents. ``run`` writes every stage as Parquet to the shared
folder that the session names in spark.checkpoint.dir and rereads it as the next one's
docs, so lineage is cut and a lost executor costs one stage's tasks at most. A stage's
files go once its successor is written; the last one's are the result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import op02_secrets, op05_mixing, op07_quality, op09_jaccard, op10_packing
from tideline.llm.common import read, ready


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model keeps. It is trained on the labelled rows of docs,
    at most ``op07_quality.MAX_LABELS``; null and blank texts go; without labels of both kinds all
    others stay."""
    return op07_quality.keep(docs, op07_quality.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the least doc_id. Rows of
    one doc_id stay or go together, repeated rows stay; rows without doc_id or without words stay;
    texts of any length are compared whole; an empty table stays empty."""
    ready(spark)
    # The ids to drop are a few bytes each; the texts aren't shuffled unless there are too many.
    drop = op09_jaccard.dropped(op09_jaccard.classes(docs, threshold=op09_jaccard.NEAR))
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that are reported masked and n_chars brought up to date.
    A row's own text decides, whatever its doc_id (see ``op02_secrets.redact``)."""
    return op02_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to their source's target weight, in a global random order. A null source is
    one of its own; null and empty texts weigh nothing; rows of equal or no doc_id get equal counts."""
    return op05_mixing.mix(docs, replica=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(sequence, slot, doc_id, start, n_tokens): the packed sequences. Null and blank texts have no
    row, a null doc_id is kept, repeated rows are packed as often as they occur."""
    return op10_packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

#: The classifier is trained, which SQL can't say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4()}")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = os.path.join(folder, str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            _remove(spark, os.path.join(folder, str(number - 1)))
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
