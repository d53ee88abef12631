"""Sampling of partial matches, with weights made up for those left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import drawn
from .exact import WEIGHT
from .store import written

STRATEGIES = ("uniform", "weighted", "redistributive")


def limited(cap: int | None) -> bool:
    """None, zero or less: no limit."""
    return cap is not None and cap > 0


def sample_paths(rows: DataFrame, cap: int | None, strategy: str = "redistributive", seed: int = 0, state: tuple[str, ...] = (WEIGHT,)) -> DataFrame:
    """`cap` of the partial matches with a weight over 0.

    uniform: any, scaled by how many there were for each kept. weighted: without replacement, by weight (exponential keys), each
    then standing for an equal share of the whole weight. redistributive: the same draw, weights kept and scaled so
    that their sum is the whole. The top `cap` are found by partial sorts; totals are one aggregation. The rows are written once, so
    that a plan of many steps grows with their number alone. No more rows than `cap` stay as they are.
    """
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    if not limited(cap):
        return rows
    live = written(rows.where(F.col(WEIGHT) > 0))
    names = [c for c in rows.columns if c not in state]
    u = (drawn(*names, seed=seed) + 1) / 2_147_483_648.0
    key = u if strategy == "uniform" else -F.log(u) / F.col(WEIGHT)
    n, whole = live.agg(F.count("*"), F.sum(F.col(WEIGHT).cast("double"))).first()
    if n <= cap:
        return live
    kept = live.orderBy(key, *names).limit(cap)
    if strategy == "uniform":
        by = F.lit(n / cap)
    elif strategy == "weighted":
        by = F.lit(whole / cap) / F.col(WEIGHT)
    else:
        kept = kept.crossJoin(F.broadcast(kept.agg(F.sum(F.col(WEIGHT).cast("double")).alias("_sum"))))  # one row
        by = F.lit(whole) / F.col("_sum")
    scaled = {WEIGHT: F.col(WEIGHT) * by} | ({"var": F.col("var") * by * by} if "var" in state else {})
    return kept.withColumns(scaled).drop("_sum")


def sample_matches(rows: DataFrame, cap: int | None, seed: int = 0) -> DataFrame:
    """`cap` exact partial matches, chosen alike; the weight of the rest is shared out, rounded up."""
    if not limited(cap):
        return rows
    sampled = sample_paths(rows, cap, "uniform", seed)
    return sampled.withColumn(WEIGHT, F.ceil(WEIGHT).cast("bigint"))


def random_walk(graph, pattern, seed: int = 0, cap: int | None = None) -> DataFrame:
    """One row, `cnt`: an unbiased estimate where every partial match keeps one of its extensions, chosen alike, and multiplies its
    weight by their number. cap also limits the walks."""
    from .exact import matches

    def thin(rows: DataFrame, step: int) -> DataFrame:
        names = [c for c in rows.columns if c != WEIGHT]
        rows = sample_matches(rows, cap, seed + step)
        if step < 2:  # the first edges are the starts of the walks
            return rows
        # the least draw of each partial match's extensions, by partial aggregation: a hub's are never in one place
        best = F.min(F.struct(drawn(*names, seed=seed + step).alias("_draw"), F.col(names[-1]).alias("_to"))).alias("_best")
        kept = rows.groupBy(*names[:-1]).agg(best, F.sum(WEIGHT).alias(WEIGHT))
        return kept.select(*names[:-1], F.col("_best._to").alias(names[-1]), WEIGHT)

    rows = matches(graph, pattern, partial_sums=False, cap=thin)
    return rows.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("bigint").alias("cnt"))


def sampled_count(graph, pattern, cap: int, seed: int = 0) -> DataFrame:
    """One row, `cnt`: an estimate from `cap` partial matches after each step, chosen alike."""
    from .exact import matches

    rows = matches(graph, pattern, cap=lambda r, k: sample_matches(r, cap, seed + k))
    return rows.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("bigint").alias("cnt"))
