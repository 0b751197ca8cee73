"""Training-data pipeline: quality, line dedup, near duplicates, decontamination, BPE ids.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the docs of the
next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.bpe import BpeCodec, default_vocabulary
from grantlens.llm.decontaminate import Decontaminator
from grantlens.llm.line_dedup import dedup_lines
from grantlens.llm.ngram_join import JaccardJoin
from grantlens.llm.quality import QualityClassifier
from grantlens.llm.shared import Workspace, held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the ids that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 5))
    model = QualityClassifier().fit(docs, labels)
    return model.score(docs.select(*COLUMNS)).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without the lines that a smaller doc_id has; a text that loses all is empty."""
    out = dedup_lines(docs, rest=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of texts that share 0.8 of their five-word shingles."""
    gone = JaccardJoin(words=5, percent=80).classes(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = Decontaminator().contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids"""
    return BpeCodec(spark, default_vocabulary()).encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", bpe),
]

#: The learned stages have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.store(stage(spark, docs, sf_dir), f"stage-{k}")
        space.keep(f"stage-{k}")
    return docs
