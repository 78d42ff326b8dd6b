"""Corpus cleaning from end to end: five stages, each one of the numbered operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and gives what it reads there to the next. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm import decontaminate, minhash, packing, suffixes, toxicity
from wiretide.llm.queries import tokenizer_path
from wiretide.llm.store import delete, delete_made, made, new_path, read

#: Tables behind the result of each stage, by the stage's place.
_BEHIND: dict[int, list[str]] = {}


def stage(place: int) -> Callable:
    """A stage that deletes the tables behind the result of the stage before, which is stored by now.

    Tables of the last stage, of operators outside the pipeline and of other runs' later stages stay.
    """

    def of(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            delete_made(spark, _BEHIND.pop(place - 1, []))
            with made(_BEHIND.setdefault(place, [])):
                return f(spark, docs, sf_dir)

        return run_stage

    return of


@stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out fold."""
    train = ~toxicity.in_fold(5, 0)
    return toxicity.accepted(docs, toxicity.model(docs.where(train), read(spark, sf_dir, "labels").where(train)), limit=0.5)


@stage(1)
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash.one_of_each(docs, n=5, threshold=0.8)


@stage(2)
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them."""
    return suffixes.without_repeats(docs, min_words=50)


@stage(3)
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), size=10)


@stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in their packed sequences."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Neither a trained classifier nor the packing can be written in SQL; tests hold the rows of ``run``
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "_"))
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
