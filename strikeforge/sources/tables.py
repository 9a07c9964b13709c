"""Reading and writing the engine's tables."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeforge.schema import CHAIN_SCHEMA, KEY_TYPES, RESULT_COLUMNS

log = logging.getLogger(__name__)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: Any
) -> DataFrame:
    """Landed quotes, listings or chains with a fixed schema, nothing inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def chain_from_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
    """A small chain from Python records; a missing nullable field becomes NULL."""
    names = CHAIN_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CHAIN_SCHEMA)


def write_table(
    df: DataFrame, path: str, order: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> int:
    """Overwrite a Parquet dataset and return its row count, taken during the write.

    ``order`` sorts inside each file, so that row-group statistics prune symbol filters;
    there is no global sort. With ``partition_by`` only the partitions that ``df`` has rows of are
    replaced, and a filter on these columns reads no other folder.
    """
    return write_profiled(df, path, order, partition_by).n_rows


@dataclass(frozen=True)
class Profile:
    """What was seen of a dataset while it was written."""

    n_rows: int
    null_counts: dict[str, int]
    folders: frozenset[str] = frozenset()  # values of the first column it is partitioned by

    def rows(self, dataset: str) -> list[tuple]:
        return [
            (dataset, place, column, self.n_rows, n)
            for place, (column, n) in enumerate(self.null_counts.items())
        ]


STATISTICS = "statistics"
STATISTICS_SCHEMA = "dataset string, place int, column string, n_rows long, null_count long"


def write_profiled(
    df: DataFrame, path: str, order: Sequence[str] = (), partition_by: Sequence[str] = (),
    profiled: Sequence[str] = (),
) -> Profile:
    """``write_table`` that also counts the NULLs of the ``profiled`` columns, in the same pass."""
    seen = Observation()
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(profiled)]
    folders = [F.collect_set(F.col(c).cast("string")).alias("folders") for c in partition_by[:1]]
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"), *nulls, *folders)
    if partition_by:
        # Rows of one partition come together; adaptive execution splits a large one.
        counted = counted.hint("rebalance", *partition_by)
    if order:
        counted = counted.sortWithinPartitions(*partition_by, *order)
    writer = counted.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    try:
        got = seen.get
    except Py4JError:
        # Adaptive execution drops a plan that turns out to have no rows, counters included.
        return Profile(0, dict.fromkeys(profiled, 0))
    nulls = {c: got[f"nulls_{i}"] for i, c in enumerate(profiled)}
    return Profile(got["n"], nulls, frozenset(got.get("folders", ())))


def remove_folders(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> None:
    """Remove the folders that a dataset partitioned by ``column`` has of these values."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in values:
        remove(spark, f"{path}/{column}={escaped(value)}")


def write_statistics(spark: SparkSession, folder: str, profiles: Mapping[str, Profile]) -> None:
    """Keep what the writes have seen as one small table next to the datasets."""
    rows = [row for name, profile in profiles.items() for row in profile.rows(name)]
    stored = spark.createDataFrame(rows, STATISTICS_SCHEMA).coalesce(1)
    stored.write.mode("overwrite").parquet(f"{folder}/{STATISTICS}")


def load_statistics(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row per dataset and column, or None if the datasets were written without."""
    return load_dataset(spark, folder, STATISTICS)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path and its own file system, whichever it is."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    location, system = file_system(spark, path)
    return system.exists(location)


def is_folder(spark: SparkSession, path: str) -> bool:
    location, system = file_system(spark, path)
    return system.getFileStatus(location).isDirectory()


def folder_bytes(spark: SparkSession, path: str) -> int:
    location, system = file_system(spark, path)
    return system.getContentSummary(location).getLength()


def remove(spark: SparkSession, path: str) -> None:
    location, system = file_system(spark, path)
    system.delete(location, True)


def load_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A stored dataset by name, or None if it is missing or unreadable.

    Columns come in the order of the dataset's contract, also if some of them are folders; their
    types are those of the contract, whatever the folders' names look like.
    """
    path = f"{folder}/{name}"
    if not path_exists(spark, path):
        return None
    try:
        found = spark.read.parquet(path)
        if any(f.dataType != KEY_TYPES.get(f.name, f.dataType) for f in found.schema):
            fixed = [T.StructField(f.name, KEY_TYPES.get(f.name, f.dataType)) for f in found.schema]
            found = spark.read.schema(T.StructType(fixed)).parquet(path)
        order = RESULT_COLUMNS.get(name)
        return found.select(*order) if order and set(order) == set(found.columns) else found
    except (PySparkException, Py4JError) as problem:
        log.warning("%s cannot be read from %s: %s", name, folder, str(problem).split("\n")[0])
        return None


def load_datasets(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    found = {name: load_dataset(spark, folder, name) for name in names}
    return {name: df for name, df in found.items() if df is not None}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="strikeforge-"))
    return context.getCheckpointDir().rstrip("/")


class Stage:
    """A fresh folder of intermediate tables under the shared folder.

    A table written here cuts the lineage: what reads it does not depend on executors that
    computed it, and reads only the columns it needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, order: Sequence[str] = ()) -> int:
        return write_table(df, f"{self.path}/{name}", order)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        """Remove the folder once nothing reads it any more."""
        remove(self.spark, self.path)
