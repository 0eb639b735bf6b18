"""A training-corpus pipeline: quality rules, near copies, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows to the shared scratch folder and
reads them again for the next. All stages but the last return the columns of ``documents``:

* quality: documents that the quality rules reject go;
* near_copies: of each component of near copies (5-word shingles, Jaccard 0.8) one document stays;
* decontamination: documents that hold a window of a benchmark item go;
* secrets: secrets are replaced in the texts;
* mixing: adds sizes, targets, words taken and training positions, sorted by position; documents of which nothing is taken go.

Defined results: null, empty and short texts are rejected by the quality stage (under ten words); texts of any length are read
whole; of rows that agree in doc_id and text one stays; a null doc_id is a document like others and comes last where ids decide;
ties are decided by the text, so runs agree; extra columns pass through all stages, whatever their names, but for those named like
one that mixing adds, which it replaces; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoagg.llm import common, decontam, jaccard, mixing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("quality", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
]

#: SQL cannot express the forest of the secret stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(spark, stage(spark, docs, sf_dir), name)
    return docs
