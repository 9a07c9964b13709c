"""Landed text files with a fixed schema: good rows typed, bad rows set aside with a reason."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNREADABLE = "unreadable"
MISSING = "{} missing"
TEXT_FORMATS = ("json", "csv")
REFUSED_COLUMNS = ("reason", "record")


@dataclass(frozen=True)
class Landed:
    """What a landed folder holds: rows that fit the schema, and refused ones."""

    rows: DataFrame

    @property
    def good(self) -> DataFrame:
        return self.rows.filter("refused IS NULL").select("row.*")

    @property
    def refused(self) -> DataFrame:
        """``reason, record``: why, and the record as it was found."""
        return self.rows.filter("refused IS NOT NULL").select("refused.*")

    def write(self, good: str, refused: str) -> dict[str, int]:
        """Store both; returns how many rows were stored as ``good`` and refused by reason.

        The rows are counted while the good ones are written. The folder of refused rows is
        replaced, too, so that what it holds is always of the same landing.
        """
        seen = Observation()
        is_good = F.col("refused").isNull()
        reasons = self._reasons()
        counts = [F.count_if(F.col("refused.reason") == r).alias(f"n_{i}") for i, r in enumerate(reasons)]
        counted = self.rows.observe(seen, F.count_if(is_good).alias("good"), *counts)
        counted.filter(is_good).select("row.*").write.mode("overwrite").parquet(good)
        self.refused.write.mode("overwrite").parquet(refused)
        found = seen.get
        by_reason = {r: found[f"n_{i}"] for i, r in enumerate(reasons)}
        return {"good": found["good"], **{r: n for r, n in by_reason.items() if n}}

    def _reasons(self) -> list[str]:
        required = [f.name for f in self.rows.schema["row"].dataType if f.metadata.get("required")]
        return [UNREADABLE, *(MISSING.format(c) for c in required)]


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: Any
) -> Landed:
    """Rows of ``path`` with the types of ``schema``, nothing inferred, no row lost.

    A JSON or CSV record that cannot be read as the schema says is refused with its text. A
    row without a value in a column that the schema says is never NULL is refused whatever the
    format; the first such column is its reason. Other files carry their types and fail to
    read where these differ.
    """
    broken = "_record"
    while broken in schema.fieldNames():
        broken = f"_{broken}"
    reader = spark.read.format(fmt).options(**options)
    if fmt in TEXT_FORMATS:
        # A field that is never NULL would make the reader fill in a default for it.
        lenient = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        reader = reader.schema(lenient.add(broken, T.StringType())) \
            .options(mode="PERMISSIVE", columnNameOfCorruptRecord=broken)
        text, unreadable = F.col(broken), F.col(broken).isNotNull()
    else:
        reader = reader.schema(schema)
        text, unreadable = F.lit(None).cast("string"), F.lit(False)
    rows = reader.load(path)
    required = [f.name for f in schema if not f.nullable]
    reason = F.when(unreadable, UNREADABLE)
    for column in required:
        reason = reason.when(F.col(column).isNull(), MISSING.format(column))
    fields = [
        F.col(f.name).alias(f.name, metadata={"required": f.name in required}) for f in schema
    ]
    row = F.struct(*fields)
    record = F.coalesce(text, F.to_json(row))
    refused = F.when(reason.isNotNull(), F.struct(reason.alias("reason"), record.alias("record")))
    return Landed(rows.select(row.alias("row"), refused.alias("refused")))
