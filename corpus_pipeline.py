"""A training corpus from raw documents: five stages, each over all that the one before kept.

Stages keep the columns that they are given, whatever their names; only the last returns its own.  An empty
table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, decontam, pii, quality, simhash
from lorekeep.llm.cluster import new_path
from lorekeep.llm.queries import table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from ``labels``, does not reject.

    Each row is judged by its own whole text (null: empty), repeats alike, rows without an id too.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id.

    Rows without an id all stay; of rows that repeat an id within a group one stays; null and
    wordless texts are one group; very long texts are compared whole.
    """
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, null texts and rows without an id among them; texts are searched whole."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their whole texts replaced by its kind; a null text stays null."""
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each remaining document, repeats too: token count and digests of its whole text (null: empty), encoded and decoded again."""
    return bpe.digests(bpe.round_trip(docs, vocabulary()))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", distinct_documents),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]

#: No stage but the masking could be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
