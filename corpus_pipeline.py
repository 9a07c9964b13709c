"""A training corpus from raw documents: toxicity, lines, near duplicates, benchmark, mixture.

Each stage works on all that the one before it kept; its result is written as Parquet and
read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strikeforge.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from strikeforge.llm.queries import SCHEDULES
from strikeforge.sources.bridge import table
from strikeforge.sources.tables import Stage

#: Toxicity, near duplicates and the mixture come from models, graphs and running totals.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 and more go. The labels of the corpus train the scorer."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the one with the largest id."""
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints three bits apart the one with the smallest id stays."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, with what the mixture takes of each and when."""
    return mixing.mix_sources(mixing.with_size(docs), SCHEDULES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    stage, docs = Stage(spark), table(spark, sf_dir, "documents")
    for name, step in STAGES:
        stage.write(name, step(spark, docs, sf_dir))
        docs = stage.read(name)
    return docs
