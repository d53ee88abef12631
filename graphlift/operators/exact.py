"""Exact counts of homomorphisms: a chain of equi-joins with sums pushed between them.

A pattern becomes steps (plans.steps). Each step joins the partial matches, one row for each
combination of live vertices with a weight, to the edges of one label; closing edges are semi-joins; a
vertex without open edges is summed out at once, so a long path never holds more than its live ends, and
a vertex that ends a branch is counted before the join.
Filters of labels and ids stand before the joins, where Spark pushes them to the scan.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Pattern, PatternEdge, PropertyGraph
from ..plans.steps import steps

WEIGHT = "weight"


def _q(v: int) -> str:
    return f"q{v}"


def edges_of(graph: PropertyGraph, edge: PatternEdge) -> DataFrame:
    """(src, dst) of the edges that a pattern edge can match."""
    if edge.label is None:
        return graph.edges.select("src", "dst")
    if graph.by_label is not None:
        return graph.by_label.where(F.col("label") == edge.label).select("src", "dst")
    return graph.edges.where(F.array_contains("labels", edge.label)).select("src", "dst")


def _constrained(pattern: Pattern, v: int) -> bool:
    return pattern.vertices[v].label is not None or pattern.vertices[v].ids is not None


def vertices_of(graph: PropertyGraph, pattern: Pattern, v: int) -> DataFrame:
    """Ids of the vertices that a pattern vertex can match."""
    rows, vertex = graph.vertices, pattern.vertices[v]
    if vertex.ids is not None:
        rows = rows.where(F.col("id").isin(*sorted(vertex.ids))) if vertex.ids else rows.where(F.lit(False))
    if vertex.label is not None:
        rows = rows.where(F.array_contains("labels", vertex.label))
    return rows.select("id")


def _allowed(graph: PropertyGraph, pattern: Pattern, rows: DataFrame, v: int, column: str) -> DataFrame:
    """Rows whose column holds a match of v. An id list is a filter of its own, so that it reaches the edge scan too."""
    vertex = pattern.vertices[v]
    if vertex.ids is not None:
        rows = rows.where(F.col(column).isin(*sorted(vertex.ids))) if vertex.ids else rows.where(F.lit(False))
    if vertex.label is not None:
        rows = rows.join(vertices_of(graph, pattern, v).withColumnRenamed("id", column), column, "left_semi")
    return rows


def _closed(graph: PropertyGraph, rows: DataFrame, closing: Iterable[PatternEdge]) -> DataFrame:
    for e in closing:
        edges = edges_of(graph, e)
        if e.src == e.dst:
            rows = rows.join(edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias(_q(e.src))), _q(e.src), "left_semi")
        else:
            rows = rows.join(edges.select(F.col("src").alias(_q(e.src)), F.col("dst").alias(_q(e.dst))), [_q(e.src), _q(e.dst)], "left_semi")
    return rows


def _summed(rows: DataFrame, live: tuple[int, ...]) -> DataFrame:
    columns = [_q(v) for v in live]
    return rows.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT))


def _joined_once(rows: DataFrame, edges: DataFrame, middle: str, kept: list[str], end: str) -> DataFrame:
    """rows(kept, middle, weight) joined to edges(middle, end) and summed by kept and end; both are unique by their vertices.

    Where the kept side or the end has one middle alone, a pair of them comes once and nothing is to be summed: only
    pairs of sides that both have several go through an exchange.
    """
    several = lambda df, *by: df.withColumn("_" + by[-1], F.count("*").over(Window.partitionBy(*by)) > 1)
    left, right = several(rows, *kept), several(edges, end)
    a, b = F.col("_" + kept[-1]), F.col("_" + end)
    columns = [*kept, end, WEIGHT]
    once = left.join(right, middle).where(~(a & b)).select(*columns)
    again = left.where(a).join(right.where(b), middle).groupBy(*kept, end).agg(F.sum(WEIGHT).alias(WEIGHT))
    return once.unionByName(again.select(*columns))


def matches(graph: PropertyGraph, pattern: Pattern, keep: tuple[int, ...] = (), partial_sums: bool = True, one: Column | None = None, cap=None, summed: bool = False) -> DataFrame:
    """Weighted partial matches of a connected pattern, with a column for each kept vertex; with `summed` one row for each combination of these.

    `one` is the weight of a single match (a bigint 1 by default). cap(rows, step), if given, thins the
    partial matches after a step (sampling).
    """
    one = F.lit(1).cast("bigint") if one is None else one
    plan = steps(pattern, keep)
    rows: DataFrame | None = None
    bound: list[int] = []
    for k, step in enumerate(plan):
        v = step.vertex
        if step.parent is None:
            if len(plan) > 1 and not step.closing:  # the first join's edges bring this vertex
                bound.append(v)
                continue
            rows = vertices_of(graph, pattern, v).select(F.col("id").alias(_q(v)), one.alias(WEIGHT))
        else:
            near, far = ("src", "dst") if step.forward else ("dst", "src")
            edges = edges_of(graph, step.edge).select(F.col(near).alias(_q(step.parent)), F.col(far).alias(_q(v)))
            edges = _allowed(graph, pattern, edges, v, _q(v))
            if rows is None:
                rows = _allowed(graph, pattern, edges, step.parent, _q(step.parent)).withColumn(WEIGHT, one)
            elif partial_sums and cap is None and not step.closing and v not in step.live:
                # a leaf: its edges are counted before the join, which then adds no rows
                counted = edges.groupBy(_q(step.parent)).agg(F.count("*").alias("_n"))
                rows = rows.join(counted, _q(step.parent)).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_n")).drop("_n")
            elif summed and partial_sums and cap is None and not step.closing and k == len(plan) - 1 and v in keep and {*rows.columns} - {_q(u) for u in keep} == {_q(step.parent), WEIGHT} and len(rows.columns) > 2:
                return _joined_once(rows, edges, _q(step.parent), [c for c in rows.columns if c not in (_q(step.parent), WEIGHT)], _q(v))
            else:
                rows = rows.join(edges, _q(step.parent))
        bound.append(v)
        rows = _closed(graph, rows, step.closing)
        if cap is not None:
            rows = cap(rows, k)
        if partial_sums and set(step.live) < {int(c[1:]) for c in rows.columns if c != WEIGHT} and k < len(plan) - 1:
            rows = _summed(rows, step.live)
    return _summed(rows, keep) if summed else rows


def grouped_counts(graph: PropertyGraph, pattern: Pattern, keep: tuple[int, ...], partial_sums: bool = True, weight_type: str = "bigint") -> DataFrame:
    """Exact counts by the data ids of the kept pattern vertices: q<v> for each, weight. Groups without a match have no row."""
    keep = tuple(keep)
    parts = []
    for component in pattern.components():
        part, number = pattern.restricted_to(component)
        own = tuple(number[v] for v in keep if v in number)
        rows = matches(graph, part, own, partial_sums, F.lit(1).cast(weight_type), summed=True)
        back = {number[v]: v for v in component}
        parts.append(rows.select(*[F.col(_q(x)).alias(_q(back[x])) for x in own], WEIGHT))
    out = parts[0]
    for k, other in enumerate(parts[1:]):
        # matches of unconnected parts combine freely: their counts multiply
        other = other.withColumnRenamed(WEIGHT, f"w{k}")
        out = out.crossJoin(other).withColumn(WEIGHT, F.col(WEIGHT) * F.col(f"w{k}")).drop(f"w{k}")
    return out.select(*[_q(v) for v in keep], WEIGHT) if keep else out


def count_frame(graph: PropertyGraph, pattern: Pattern, partial_sums: bool = True, weight_type: str = "bigint") -> DataFrame:
    """One row, `cnt`: the exact count, 0 if nothing matches. weight_type "decimal(38,0)" counts beyond 64 bits; a bigint that overflows raises."""
    total = grouped_counts(graph, pattern, (), partial_sums, weight_type)
    return total.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast(weight_type).alias("cnt"))


def exact_count(graph: PropertyGraph, pattern: Pattern, partial_sums: bool = True, weight_type: str = "bigint", timeout: float | None = None) -> int:
    """The exact count, or -1 if it took longer than `timeout` seconds."""
    return within(graph.edges.sparkSession, timeout, lambda: int(count_frame(graph, pattern, partial_sums, weight_type).first()[0]), -1)


def within(spark, timeout: float | None, job, default):
    """job() unless it runs out of time: its Spark jobs are then cancelled and default is returned."""
    if timeout is None:
        return job()
    tag, late, done = f"within-{threading.get_ident()}-{id(job)}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while True:  # a job that begins after the time is up ends too
            spark.interruptTag(tag) if not hasattr(spark, "sparkContext") else spark.sparkContext.cancelJobsWithTag(tag)
            if done.wait(0.2):
                break

    timer = threading.Timer(timeout, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        out = job()
        return default if late.is_set() else out
    except Exception:
        if late.is_set():
            return default
        raise
    finally:
        done.set()
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
