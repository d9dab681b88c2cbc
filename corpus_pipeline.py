"""The corpus pipeline: from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.llm.common import columns, every, fresh, hinted, quoted, shared_dir, table, written
from tidewind.llm.decontamination import uncontaminated
from tidewind.llm.line_dedup import line_dedup
from tidewind.llm.near_dedup import near_dedup
from tidewind.llm.packing import pack_documents
from tidewind.llm.toxicity import without_toxic

BROADCAST_ROWS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below one half; labels are learned outside the held-out rows."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars follows the text."""
    (before,) = fresh(docs.columns, "before")
    cleaned = line_dedup(docs.withColumn(before, F.length("text")), counts=False)
    n_chars = F.when(F.length("text") < F.col(before), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[F.col(quoted(c)) if c != "n_chars" else n_chars.alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    (gone_id,) = fresh(docs.columns, "gone_id")
    gone = written(near_dedup(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone", shared_dir(spark))
    return docs.join(hinted(gone, BROADCAST_ROWS), F.col("doc_id") == F.col(gone_id), "left_anti").select(*every(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: benchmark windows hit less than a twentieth of their words."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where it is in which sequence."""
    return pack_documents(columns(docs, doc_id="doc_id", text="text"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: The first and the last stage can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name, folder)
    return docs
