"""A corpus pipeline of five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.

Defined results: what the operators' docstrings say of nulls, ties, repeated rows and
very long texts holds for their stages.  Without labels of both kinds every document
scores 0.5, below the threshold, and goes; an empty ``benchmark`` contaminates nothing;
an empty ``documents`` gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import decontam, mixing, neardup, quality, secrets
from driftloom.llm.common import crc_mod, load, materialize

#: Near duplicates of the pipeline: five-word shingles, similarity of 0.8 or more.
LINK = (80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels
    of ids whose crc32 mod 4 is not 2."""
    labels = load(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return quality.keep_good(docs, quality.train(docs, labels))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document of the smallest id stays."""
    return neardup.keep_one(docs, link=LINK)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order, go."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with their number of copies (which replaces
    a column of that name)."""
    mixed = mixing.mix_sources(docs)
    return mixed.filter(F.col(mixing.P + "copies") > 0).select(*(c for c in docs.columns if c != "copies"), F.col(mixing.P + "copies").alias("copies"))


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets_stage), ("mix", mix_stage)]

#: SQL can't express the learned classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
