"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept; between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fragmatch.llm import arrow, langid, linededup, minhash, packing, pii
from fragmatch.plans import scratch


def _stage(run, made: set[str]):
    """A stage that first deletes what the stages before it saved for themselves (``made``): their results are written by then."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        arrow.bound_batches(spark)  # workers of several stages live side by side
        scratch.forget(spark, made)
        made.clear()
        before = scratch.live(spark)
        out = run(spark, docs, sf_dir)
        made.update(scratch.live(spark) - before)
        return out

    return call


def stages() -> list:
    """(name, function) of the stages of one run, which share nothing with another run's."""
    made: set[str] = set()
    plain = [("language_id", langid.stage), ("line_dedup", linededup.stage), ("minhash_dedup", minhash.stage), ("pii", pii.stage), ("packing", packing.stage)]
    return [(name, _stage(f, made)) for name, f in plain]


STAGES = stages()

#: Naive Bayes and tokenization can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what all stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = stages()
    for _, stage in own[:-1]:
        was, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(was)
    return own[-1][1](spark, docs, sf_dir)
