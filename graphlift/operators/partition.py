"""Partitions of the vertices into cells: composable stages (method, number).

The first stage of k gives k cells at most, every later stage of k up to k more. A stage ends early when nothing can be
split, no cell is empty, and cells are numbered 1..n. Loops run on compressed tables
(histograms, label sets) or on sums that Spark makes; ties go to the lowest cell, then label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .store import written
from .stats import neighbour_labels

#: Histograms of more rows than this are refused rather than brought to the driver.
MOST_HISTOGRAM_ROWS = 5_000_000


@dataclass(frozen=True)
class Stage:
    method: str
    cells: int


#: Short names of files: one letter or more for a method.
SHORT = {"quasi_stable": "QS", "hash": "H", "degree": "D", "neighbour_labels": "NNL", "node_labels": "NL"}


def one_cell(graph: PropertyGraph) -> DataFrame:
    return graph.vertices.select("id", F.lit(1).alias("cell"))


def cell_graph(graph: PropertyGraph, stages: list[Stage] | list[tuple[str, int]]) -> DataFrame:
    """cells(id, cell) after all stages, left to right."""
    cells = one_cell(graph)
    n = 1
    for k, stage in enumerate(stages):
        stage = stage if isinstance(stage, Stage) else Stage(*stage)
        goal = stage.cells if k == 0 else n + stage.cells
        cells = written(METHODS[stage.method](graph, cells, max(goal, n)))
        n = cells.agg(F.max("cell")).first()[0] or 0
    return cells


def hash_of(column) -> F.Column:
    """A multiplicative hash in plain integers, so that any SQL engine can make it again."""
    return F.pmod(F.pmod(column, F.lit(1_000_003)) * 48_271 + 12_345, F.lit(2_147_483_647))


def _renumbered(cells: DataFrame) -> DataFrame:
    """Cells 1..n in their order. The list of cells is small."""
    names = sorted(r[0] for r in cells.select("cell").distinct().collect())
    if names == list(range(1, len(names) + 1)):
        return cells
    table = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i + 1)])
    return cells.select("id", table[F.col("cell")].cast("int").alias("cell"))


def by_hash(graph: PropertyGraph, cells: DataFrame, goal: int) -> DataFrame:
    """Splits every cell into goal // n parts, the first goal % n into one more, by a hash of the id."""
    n = cells.agg(F.max("cell")).first()[0]
    if not n:
        return cells
    parts = F.lit(goal // n) + F.when(F.col("cell") <= goal % n, 1).otherwise(0)
    before = (F.col("cell") - 1) * (goal // n) + F.least(F.col("cell") - 1, F.lit(goal % n))
    return _renumbered(cells.select("id", (before + F.pmod(hash_of(F.col("id")), parts) + 1).cast("int").alias("cell")))


def _bounded(rows: DataFrame, what: str) -> list:
    out = rows.limit(MOST_HISTOGRAM_ROWS + 1).collect()
    if len(out) > MOST_HISTOGRAM_ROWS:
        raise ValueError(f"more than {MOST_HISTOGRAM_ROWS} {what}")
    return out


def by_degree(graph: PropertyGraph, cells: DataFrame, goal: int) -> DataFrame:
    """Splits the cell of the largest sum of squared deviations of the degree at its mean, again and again; the low side
    becomes the new cell. Runs on the (cell, degree) histogram: its rows are fewer than twice the root of the edges for each cell."""
    degrees = graph.degrees().select("id", (F.col("d_in") + F.col("d_out")).alias("deg")).join(cells, "id")
    histogram = _bounded(degrees.groupBy("cell", "deg").agg(F.count("*").alias("n")), "different degrees")
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for r in histogram:
        bins.setdefault(r["cell"], []).append((r["deg"], r["n"], r["cell"]))
    # integers all the way: score n * sum(d * d) - sum(d) ** 2, divided by n
    score = lambda rows: (sum(n for _, n, _ in rows) * sum(d * d * n for d, n, _ in rows) - sum(d * n for d, n, _ in rows) ** 2) / sum(n for _, n, _ in rows)
    while len(bins) < goal:
        c = max(bins, key=lambda c: (score(bins[c]), -c))
        n, total = sum(m for _, m, _ in bins[c]), sum(d * m for d, m, _ in bins[c])
        low = [b for b in bins[c] if b[0] * n <= total]
        high = [b for b in bins[c] if b[0] * n > total]
        if not low or not high:
            break
        bins[c], bins[max(bins) + 1] = high, low
    table = graph.edges.sparkSession.createDataFrame([(old, d, new) for new, rows in bins.items() for d, _, old in rows], "cell int, deg bigint, new int")
    return degrees.join(table, ["cell", "deg"]).select("id", F.col("new").alias("cell"))


def by_neighbour_labels(graph: PropertyGraph, cells: DataFrame, goal: int) -> DataFrame:
    """As by_degree, with the number of neighbours that carry a label (0 where none does), for the best cell and label of all."""
    counts = written(neighbour_labels(graph))
    cells = written(cells)
    sums: dict[tuple[int, int], tuple[int, int]] = {}
    sizes: dict[int, int] = {}

    def measure(which: list[int]) -> None:
        own = cells.where(F.col("cell").isin(which))
        for r in own.groupBy("cell").count().collect():
            sizes[r[0]] = r[1]
        for key in [k for k in sums if k[0] in which]:
            del sums[key]
        for r in _bounded(counts.join(own, "id").groupBy("cell", "label").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q")), "pairs of cell and label"):
            sums[r["cell"], r["label"]] = (r["s"], r["q"])

    measure([r[0] for r in cells.select("cell").distinct().collect()])
    while len(sizes) < goal and sums:
        score = {k: (sizes[k[0]] * q - s * s) / sizes[k[0]] for k, (s, q) in sums.items()}
        c, label = max(score, key=lambda k: (score[k], -k[0], -k[1]))
        if score[c, label] <= 0:
            break
        new, total, n = max(sizes) + 1, sums[c, label][0], sizes[c]
        of_label = counts.where(F.col("label") == label).select("id", "cnt")
        low = (F.col("cell") == c) & (F.coalesce("cnt", F.lit(0)) * n <= total)
        cells = written(cells.join(of_label, "id", "left").select("id", F.when(low, new).otherwise(F.col("cell")).cast("int").alias("cell")))
        measure([c, new])
    return cells


def _label_sets(graph: PropertyGraph, cells: DataFrame) -> tuple[DataFrame, dict[int, list]]:
    rows = graph.vertices.join(cells, "id").select("id", "cell", F.array_sort("labels").alias("labels"))
    sets: dict[int, list] = {}
    for r in _bounded(rows.groupBy("cell", "labels").count(), "different label sets"):
        sets.setdefault(r["cell"], []).append((frozenset(r["labels"]), r["count"], r["cell"], tuple(r["labels"])))
    return rows, sets


def _best_label(rows: list) -> tuple[int, int | None]:
    """(vertices on the smaller side, label) of the most even split."""
    n = sum(m for _, m, _, _ in rows)
    have: dict[int, int] = {}
    for labels, m, _, _ in rows:
        for x in labels:
            have[x] = have.get(x, 0) + m
    return max(((min(k, n - k), -x) for x, k in have.items()), default=(0, None))


def _apply_sets(graph, rows: DataFrame, sets: dict[int, list]) -> DataFrame:
    table = graph.edges.sparkSession.createDataFrame([(old, list(labels), new) for new, own in sets.items() for _, _, old, labels in own], "cell int, labels array<int>, new int")
    return rows.join(table, ["cell", "labels"]).select("id", F.col("new").alias("cell"))


def by_node_labels(graph: PropertyGraph, cells: DataFrame, goal: int) -> DataFrame:
    """Splits the cell and label whose smaller side (with or without the label) is largest; vertices with it become the new cell."""
    rows, sets = _label_sets(graph, cells)
    while sets and len(sets) < goal:
        side, c, label = max((_best_label(own)[0], -c, _best_label(own)[1] or 0) for c, own in sets.items())
        if side <= 0:
            break
        own, c, label = sets[-c], -c, -label
        sets[max(sets) + 1] = [r for r in own if label in r[0]]
        sets[c] = [r for r in own if label not in r[0]]
    return _apply_sets(graph, rows, sets)


def recursive_labels(graph: PropertyGraph, cells: DataFrame, depth: int) -> DataFrame:
    """Splits every cell on its most even label, `depth` times."""
    rows, sets = _label_sets(graph, cells)
    for _ in range(depth):
        for c in sorted(sets):
            side, label = _best_label(sets[c])
            if side > 0:
                own = sets[c]
                sets[max(sets) + 1] = [r for r in own if -label in r[0]]
                sets[c] = [r for r in own if -label not in r[0]]
    return _apply_sets(graph, rows, sets)


def by_quasi_stable(graph: PropertyGraph, cells: DataFrame, goal: int, weighted: bool = True) -> DataFrame:
    """Greedy quasi-stable partition: a cell whose members differ most in their number of edges to or from some cell is
    split at the mean of that number; the high side becomes the new cell.

    Each round splits the widest cells, up to as many as there are cells, at once, so k cells take about log2(k)
    rounds of two aggregations and not k. With weights the width counts times the cell's size.
    """
    cells = written(cells)
    n = cells.agg(F.max("cell")).first()[0] or 0
    while 0 < n < goal:
        tint = lambda key, name: cells.select(F.col("id").alias(key), F.col("cell").alias(name))
        sized = cells.groupBy("cell").agg(F.count("*").alias("size"))
        ends = graph.edges.join(tint("dst", "other"), "dst").select(F.col("src").alias("id"), "other", F.lit(True).alias("out"))
        ends = ends.unionByName(graph.edges.join(tint("src", "other"), "src").select(F.col("dst").alias("id"), "other", F.lit(False).alias("out")))
        per = written(ends.groupBy("id", "other", "out").agg(F.count("*").alias("d")).join(cells, "id"))
        width = per.groupBy("cell", "other", "out").agg(F.max("d").alias("hi"), F.min("d").alias("lo"), F.count("*").alias("m"), F.sum("d").alias("total")).join(sized, "cell")
        spread = F.col("hi") - F.when(F.col("m") < F.col("size"), F.lit(0)).otherwise(F.col("lo"))
        width = width.withColumn("width", spread * (F.col("size") if weighted else F.lit(1))).where(F.col("width") > 0)
        best = width.groupBy("cell").agg(F.max_by(F.struct("width", "other", "out", "total", "size"), F.struct("width", -F.col("other"), "out")).alias("b"))
        picked = [r["b"] | {"cell": r["cell"]} for r in (x.asDict(True) for x in best.collect())]  # a row for each cell
        picked = sorted(picked, key=lambda r: (-r["width"], r["cell"]))[: goal - n]
        if not picked:
            break
        table = graph.edges.sparkSession.createDataFrame([(r["cell"], r["other"], r["out"], r["total"], r["size"], n + 1 + i) for i, r in enumerate(picked)], "cell int, other int, out boolean, total bigint, size bigint, new int")
        high = per.join(table, ["cell", "other", "out"]).where(F.col("d") * F.col("size") > F.col("total")).select("id", "new")
        cells = written(cells.join(high, "id", "left").select("id", F.coalesce("new", "cell").alias("cell")))
        n += len(picked)
    return cells


def by_first_label(graph: PropertyGraph, k: int) -> DataFrame:
    """Groups of neighbouring labels: the vertex's least label decides (0 for none), k groups at most."""
    first = graph.vertices.select("id", F.coalesce(F.array_min("labels"), F.lit(0)).alias("label"))
    return _by_label_rank(first, first.groupBy("label").agg(F.lit(0.0).alias("key")), k)


def _by_label_rank(first: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """Chunks of labels ordered by key, then label. The list of labels is small."""
    labels = [r["label"] for r in sorted(_bounded(keyed, "labels"), key=lambda r: (r["key"] is None, r["key"] or 0.0, r["label"]))]
    size = max(1, math.ceil(len(labels) / k))
    table = first.sparkSession.createDataFrame([(x, i // size + 1) for i, x in enumerate(labels)] or [(0, 1)], "label int, cell int")
    return first.join(table, "label").select("id", "cell")


def by_label_degree(graph: PropertyGraph, k: int) -> DataFrame:
    """Labels ordered by the mean degree of their vertices, in k chunks."""
    first = graph.vertices.select("id", F.coalesce(F.array_min("labels"), F.lit(0)).alias("label"))
    return _by_label_rank(first, first.join(graph.degrees(), "id").groupBy("label").agg(F.avg(F.col("d_in") + F.col("d_out")).alias("key")), k)


def by_label_ratio(graph: PropertyGraph, k: int) -> DataFrame:
    """Labels ordered by in-edges over out-edges of their vertices, in k chunks; labels without out-edges last."""
    first = graph.vertices.select("id", F.coalesce(F.array_min("labels"), F.lit(0)).alias("label"))
    return _by_label_rank(first, first.join(graph.degrees(), "id").groupBy("label").agg(F.try_divide(F.sum("d_in"), F.sum("d_out")).alias("key")), k)


def by_ratio(graph: PropertyGraph, k: int) -> DataFrame:
    """Vertices ordered by in-degree over out-degree (none: last) in k chunks; equal ratios stay together, in the chunk of the last of them."""
    rows = graph.degrees().select("id", F.coalesce(F.try_divide("d_in", "d_out"), F.lit(float("inf"))).alias("ratio"))
    # running sums over the ratios: within ranges of them, and over the ranges
    counts = written(rows.groupBy("ratio").count().repartitionByRange("ratio").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.sum("count").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    parts = parts.select("part", before.alias("before"), F.sum("own").over(Window.partitionBy()).alias("n"))
    at = F.col("before") + F.sum("count").over(Window.partitionBy("part").orderBy("ratio"))
    table = counts.join(parts, "part").select("ratio", F.ceil(at / F.greatest(F.lit(1), F.ceil(F.col("n") / k))).cast("int").alias("cell"))
    return rows.join(table, "ratio").select("id", "cell")


def by_hubs(graph: PropertyGraph, k: int) -> DataFrame:
    """The k - 1 vertices of the highest degree are hubs 1..k-1; each vertex goes to the first hub among itself and its neighbours, the rest to k."""
    degree = graph.degrees().select("id", (F.col("d_in") + F.col("d_out")).alias("deg"))
    hubs = degree.orderBy(F.desc("deg"), "id").limit(max(0, k - 1)).collect()
    table = F.broadcast(graph.edges.sparkSession.createDataFrame([(r["id"], i + 1) for i, r in enumerate(hubs)] or [(None, 1)], "hub bigint, rank int"))  # k rows
    near = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("hub")).unionByName(graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("hub"))).join(table, "hub").select("id", "rank")
    own = graph.vertices.select("id", F.col("id").alias("hub")).join(table, "hub").select("id", "rank")
    rest = graph.vertices.select("id", F.lit(k).alias("rank"))
    return near.unionByName(own).unionByName(rest).groupBy("id").agg(F.min("rank").alias("cell"))


METHODS = {"hash": by_hash, "degree": by_degree, "neighbour_labels": by_neighbour_labels, "node_labels": by_node_labels, "quasi_stable": by_quasi_stable}
