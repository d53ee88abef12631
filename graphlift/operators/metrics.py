"""Evaluation of estimates against true counts. Input rows: dataset, method, query, estimate, truth, seconds, size, ... as there are."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Pattern
from ..plans.order import pattern_width

#: Estimates and truths are compared within these limits.
LEAST, MOST = 1.0, 1e30
#: Upper limits of the size classes of queries.
SIZES = (3, 4, 6, 9, 12, 16, 24, 32)


def clamped(column) -> Column:
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.col(column) if isinstance(column, str) else column))


def relative_error(estimate: str = "estimate", truth: str = "truth") -> Column:
    return clamped(estimate) / clamped(truth)


def q_error(estimate: str = "estimate", truth: str = "truth") -> Column:
    return F.greatest(relative_error(estimate, truth), 1 / relative_error(estimate, truth))


def failed(estimate: str = "estimate") -> Column:
    """Not a number, infinite, zero or missing."""
    e = F.col(estimate)
    return e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")) | (e == 0)


def usable(estimate: str = "estimate") -> Column:
    """The estimate as it counts in comparisons: 1 at least, 1e35 for infinite ones."""
    e = F.col(estimate)
    return F.when(e.isNull() | F.isnan(e), F.lit(LEAST)).otherwise(F.least(F.lit(1e35), F.greatest(F.lit(LEAST), e)))


def size_class(size: str = "size") -> Column:
    """The least class limit that the size fits in; the largest for all beyond."""
    out = F.when(F.col(size) <= SIZES[0], SIZES[0])
    for limit in SIZES[1:-1]:
        out = out.when(F.col(size) <= limit, limit)
    return out.otherwise(SIZES[-1])


def failure_rates(rows: DataFrame, by: Iterable[str] = ("method", "dataset")) -> DataFrame:
    """n, failures, missing, zeros and the rate by group."""
    e = F.col("estimate")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed()).alias("failures"), F.count_if(e.isNull()).alias("missing"), F.count_if(e == 0).alias("zeros"), F.avg(failed().cast("double")).alias("failure_rate"))


def quantiles(rows: DataFrame, column: str, by: Iterable[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles, interpolated, as p50, p95, ..."""
    return rows.groupBy(*by).agg(*[F.percentile(column, q).alias(f"p{round(q * 100)}") for q in at])


def box(rows: DataFrame, column: str, by: Iterable[str], whisker: float = 2.0) -> DataFrame:
    """q1, med, q3 and whiskers' limits at `whisker` times the range between the quartiles."""
    out = rows.groupBy(*by).agg(*[F.percentile(column, q).alias(n) for n, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))], F.min(column).alias("lo"), F.max(column).alias("hi"))
    spread = whisker * (F.col("q3") - F.col("q1"))
    return out.withColumn("low", F.greatest("lo", F.col("q1") - spread)).withColumn("high", F.least("hi", F.col("q3") + spread)).drop("lo", "hi")


def median_seconds(rows: DataFrame, by: Iterable[str]) -> DataFrame:
    """Median over replications."""
    return rows.groupBy(*by).agg(F.median("seconds").alias("seconds"))


def with_competitors(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("dataset", "query")) -> DataFrame:
    """Each row with the other method's value and runtime; missing ones get the value 1 and no time."""
    known = others.select(*keys, F.col("value").alias("other_value"), F.col("runtime").alias("other_seconds"))
    return rows.join(known, list(keys), "left").withColumn("other_missing", F.col("other_value").isNull()).withColumn("other_value", F.coalesce("other_value", F.lit(LEAST)))


def missing_from(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("dataset", "query")) -> DataFrame:
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def verified(truths: DataFrame, again: DataFrame, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """Stored counts next to recounted ones: stored, recounted, same."""
    return truths.select(*keys, F.col("truth").alias("stored")).join(again.select(*keys, F.col("truth").alias("recounted")), list(keys), "full").withColumn("same", F.coalesce(F.col("stored") == F.col("recounted"), F.lit(False)))


def width_distribution(spark, patterns: dict[str, Pattern], max_exact: int = 10) -> DataFrame:
    """(width, n) over a query set."""
    rows = [(name, pattern_width(p, max_exact)) for name, p in patterns.items()]
    return spark.createDataFrame(rows, "query string, width int").groupBy("width").agg(F.count("*").alias("n"))


def query_type(path: str) -> str:
    """The family in a query's file name: letters before the first digit or sign of the last folder or name."""
    parts = [p for p in re.split(r"[/\\]", path) if p]
    for p in [*parts[-2:-1], parts[-1]]:
        m = re.match(r"([A-Za-z]+)", p)
        if m:
            return m[1].capitalize()
    return ""
