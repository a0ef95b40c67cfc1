"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playseq.llm import decontaminate, langid, mixing, ngram_join, secret_scan
from playseq.llm.common import ARROW_ROWS, table
from playseq.operators.storage import written

#: Least score of a language; with four languages, chance is a quarter.
LEAST_SCORE = 0.35
#: Words of a shingle, and the percentage of common shingles from which documents are near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows that go to a Python worker at a time. Stages follow each other on the same executors, which keep what they have taken.
ROWS_AT_A_TIME = 1000


def _packed(docs: DataFrame) -> DataFrame:
    """All columns in one, so that results cannot clash with them."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no known language, go."""
    spark.conf.set(ARROW_ROWS, str(ROWS_AT_A_TIME))
    known = langid.predict(_packed(docs), langid.fit(docs), ["_row"])
    return known.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; repeated rows of an id stay once."""
    found = written(ngram_join.near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT), "groups")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= ngram_join.SMALL else gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return kept
    again = written(again, "again")
    # The same row on every run: the smallest by a hash of its text, then by all its columns.
    repeated = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    once = repeated.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), F.struct(*docs.columns).alias("_row"))).alias("_least"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once.select("_least._row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    spark.conf.set(ARROW_ROWS, str(ROWS_AT_A_TIME))
    found = decontaminate.find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return found.where("not contaminated").select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training manifest: documents that give words to the mix, range-sorted by their place in training."""
    return mixing.in_training_order(mixing.mix(docs).where("taken > 0"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained network decides in the first stage: SQL cannot express it. tests/llm compares the other stages.
ORACLE_SQL = None
