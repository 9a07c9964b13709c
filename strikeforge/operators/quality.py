"""Data-quality profiles of the chain and of all stored datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeforge.sources.tables import Stage

QUALITY_FIELDS = ["bid", "ask", "mid", "delta", "close"]


def _nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def quote_quality(chain: DataFrame) -> DataFrame:
    """How many quotes are missing, and whether closing prices could stand in.

    A chain stored without the close column counts as having no close at all.
    """
    total = F.count(F.lit(1))
    counts = [
        (_nulls(c) if c in chain.columns else total).alias(f"{c}_null") for c in QUALITY_FIELDS
    ]
    shares = [
        (F.try_divide(F.col(f"{c}_null"), F.col("total")) * 100).alias(f"{c}_null_pct")
        for c in QUALITY_FIELDS
    ]
    bid_share = F.try_divide(F.col("bid_null"), F.col("total"))
    close_share = F.try_divide(F.col("close_null"), F.col("total"))
    return chain.agg(total.alias("total"), *counts).select(
        "*",
        *shares,
        F.coalesce(bid_share > 0.5, F.lit(False)).alias("bids_mostly_missing"),
        F.coalesce(close_share < 0.5, F.lit(False)).alias("close_available"),
    )


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_profile(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Columns with missing values: one aggregate per dataset, turned to rows."""
    profiles = [
        df.agg(*(_nulls(c).alias(c) for c in df.columns))
        .unpivot([], df.columns, "column", "null_count")
        .filter("null_count > 0")
        .select(F.lit(name).alias("dataset"), "column", "null_count")
        for name, df in datasets.items()
    ]
    return _union(profiles)


def dataset_sizes(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each dataset; the row count comes from the Parquet footers."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in datasets.items()
        ]
    )


def stored_null_profile(statistics: DataFrame) -> DataFrame:
    """``null_profile`` out of what the writes have counted; no dataset is read."""
    return statistics.filter("null_count > 0").select("dataset", "column", "null_count")


def stored_sizes(statistics: DataFrame) -> DataFrame:
    """``dataset_sizes`` out of what the writes have counted; no dataset is read."""
    return statistics.groupBy("dataset").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_columns")
    )


QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
SKETCH_ACCURACY = 10_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each numeric column.

    Quartiles interpolate linearly and are found without gathering a column anywhere, the same
    way at every size. A column without values has a count of zero and NULL elsewhere.
    """
    columns = numeric_columns(df)
    quartiles = _quartiles(df, columns)
    return _moments(df, columns).join(quartiles, "column", "left").select(*DESCRIBED)


DESCRIBED = ["column", "n", "mean", "std", "min", *QUARTILES, "max"]


def _moment_columns(column: str) -> list[Column]:
    value = F.col(column).cast("double")
    return [
        F.lit(column).alias("column"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = F.array(*(F.struct(*_moment_columns(c)) for c in columns))
    return df.agg(rows.alias("all")).select(F.inline("all"))


def _quartiles(
    df: DataFrame, columns: Sequence[str], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Exact quartiles in three scans.

    1. Count the values. 2. A bounded sketch brackets each wanted rank between two values
    that are sure to enclose it. 3. Count the values under each bracket, and look for the rank
    among the distinct values inside it, a few ten-thousandths of the table, dealt by range.
    Only one number per column and quartile passes through the driver.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    counts = df.agg(*(F.count(value[c]).alias(c) for c in columns)).first().asDict()
    wanted = [(c, n, q) for c in columns if counts[c] for n, q in QUARTILES.items()]
    if not wanted:
        fields = ", ".join(f"{n} double" for n in QUARTILES)
        return df.sparkSession.createDataFrame([], f"column string, {fields}")

    def bounds(c: str, q: float) -> list[float]:
        slack = 2.0 / accuracy + 2.0 / counts[c]
        return [max(0.0, q - slack), min(1.0, q + slack)]

    brackets = df.agg(
        *(
            F.percentile_approx(value[c], bounds(c, q), accuracy).alias(f"{c}_{n}")
            for c, n, q in wanted
        )
    ).first().asDict()

    targets, inside = [], []
    for c, n, q in wanted:
        low, high = brackets[f"{c}_{n}"]
        rank = (counts[c] - 1) * q
        targets.append((c, n, rank, low, high))
        inside.append(
            F.when(
                value[c].between(low, high),
                F.struct(F.lit(c).alias("column"), F.lit(n).alias("name"), value[c].alias("value")),
            )
        )
    under = df.agg(
        *(F.count_if(value[c] < low).alias(f"{c}_{n}") for c, n, _, low, _ in targets)
    ).first().asDict()

    spec = F.create_map(
        *(
            part
            for c, n, rank, _, _ in targets
            for part in (F.lit(f"{c}_{n}"), F.lit(float(rank - under[f"{c}_{n}"])))
        )
    )
    counted = (
        df.select(F.explode(F.array_compact(F.array(*inside))).alias("hit"))
        .select("hit.*")
        .groupBy("column", "name", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    wanted_rank = spec[F.concat_ws("_", "column", "name")]
    ranked = around_ranks(counted, ["column", "name"], wanted_rank)
    lower, upper = F.floor("rank"), F.ceil("rank")

    def value_at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("first"), F.col("last")), F.col("value")))

    picked = ranked.groupBy("column", "name").agg(
        value_at(lower).alias("low"),
        value_at(upper).alias("high"),
        F.max(F.col("rank") - lower).alias("share"),
    )
    quartile = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return (
        picked.withColumn("quartile", quartile)
        .groupBy("column")
        .pivot("name", list(QUARTILES))
        .agg(F.max("quartile"))
    )


def around_ranks(
    counted: DataFrame, groups: Sequence[str], rank: Column, n_parts: int | None = None
) -> DataFrame:
    """Values near a wanted rank of their group, each with the ranks of its first and last copy.

    ``counted`` has one row per group and value, with ``copies``; ``rank`` counts from 0 and
    may lie between two. Values are dealt to ranges and stored; the counts of the ranges, added up,
    tell in which one or two of them a rank falls, and only these are ordered. So no task
    sees all values of a group, whatever their number.
    """
    stage = Stage(counted.sparkSession)
    by = [*groups, "value"]
    dealt = counted.repartitionByRange(n_parts, *by) if n_parts else counted.repartitionByRange(*by)
    stage.write("values", dealt.withColumn("part", F.spark_partition_id()))
    values = stage.read("values")
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        values.groupBy(*groups, "part")
        .agg(F.sum("copies").alias("held"))
        .withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
        .withColumn("rank", rank)
        .filter("before <= ceil(rank) AND floor(rank) < before + held")
    )
    inside = Window.partitionBy(*groups, "part").orderBy("value")
    return (
        values.join(parts.select(*groups, "part", "before", "rank"), [*groups, "part"])
        .withColumn("last", F.col("before") + F.sum("copies").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("copies") + 1)
    )
