"""Statistics of celled graphs: cell sizes, label counts, degrees between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import WILDCARD, PropertyGraph
from .store import sent_whole, written


def with_wildcard(labels) -> F.Column:
    """A label set and the wildcard, each once."""
    return F.array_distinct(F.concat(labels if not isinstance(labels, str) else F.col(labels), F.array(F.lit(WILDCARD))))


def cell_sizes(cells: DataFrame) -> DataFrame:
    """(cell, size)."""
    return cells.groupBy("cell").agg(F.count("*").alias("size"))


def cell_card(graph: PropertyGraph, cells: DataFrame) -> DataFrame:
    """(cell, label, cnt): vertices of a cell with a label; the wildcard has all."""
    return graph.vertices.join(cells, "id").select("cell", F.explode(with_wildcard("labels")).alias("label")).groupBy("cell", "label").agg(F.count("*").alias("cnt"))


def label_counts(graph: PropertyGraph, cells: DataFrame) -> DataFrame:
    """(cell, label, cnt) of real labels alone."""
    return cell_card(graph, cells).where(F.col("label") != WILDCARD)


def neighbour_labels(graph: PropertyGraph) -> DataFrame:
    """(id, label, cnt): how many different neighbours, in either direction, carry the label."""
    ends = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()
    labels = graph.vertices.select(F.col("id").alias("other"), F.explode("labels").alias("label"))
    return ends.join(labels, "other").groupBy("id", "label").agg(F.count("*").alias("cnt"))


def edge_deg(graph: PropertyGraph, cells: DataFrame, corr: bool = True) -> DataFrame:
    """Degrees between cells: a row for each (edge_label, vlabel, c1, c2), where vlabel is the label of the c2 side.

    avg_, min_, max_ and var_ are over all vertices of c1 (those without such an edge count 0), out for edges c1 -> c2 and in
    for c2 -> c1. corr_ is the Pearson correlation of the total degrees at the ends of the bucket's
    edges, 0 where one side doesn't vary. Exchanges by
    (label sets, cells, vertex), by vertex, then by bucket.
    """
    tinted = graph.vertices.join(cells, "id").select("id", "cell", with_wildcard("labels").alias("vlabels"))
    if corr:
        tinted = tinted.join(graph.degrees().select("id", (F.col("d_in") + F.col("d_out")).alias("total")), "id")
    else:
        tinted = tinted.withColumn("total", F.lit(0))
    tinted = written(tinted)
    sent = sent_whole(tinted)
    side = lambda c: sent.select(*[F.col(x).alias(f"{x}_{c}") for x in tinted.columns])
    edges = graph.edges.select("src", "dst", with_wildcard("labels").alias("elabels"))
    both = edges.join(side("s"), F.col("src") == F.col("id_s")).join(side("d"), F.col("dst") == F.col("id_d"))
    view = lambda near, far, out: both.select("elabels", F.col(f"vlabels_{far}").alias("vlabels"), F.col(f"cell_{near}").alias("c1"), F.col(f"cell_{far}").alias("c2"), F.col(f"id_{near}").alias("id"), F.col(f"total_{near}").alias("x"), F.col(f"total_{far}").alias("y"), F.lit(out).alias("is_out"))
    bucket = ["edge_label", "vlabel", "c1", "c2"]
    y = F.col("y").cast("double")
    # by whole label sets first: these are taken apart for each vertex, not for each edge
    sums = lambda *more: [F.max("x").alias("x"), *more] if corr else []
    sets = view("s", "d", True).unionByName(view("d", "s", False)).groupBy("elabels", "vlabels", "c1", "c2", "is_out", "id").agg(F.count("*").alias("d"), *sums(F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))
    # dealt by vertex before they are taken apart: sums by bucket and vertex then need no exchange of a row for each pair of labels
    flows = sets.repartition("id").withColumn("edge_label", F.explode("elabels")).withColumn("vlabel", F.explode("vlabels"))
    per = flows.groupBy(*bucket, "is_out", "id").agg(F.sum("d").alias("d"), *sums(F.sum("sy").alias("sy"), F.sum("syy").alias("syy")))
    if corr:
        per = per.withColumn("x", F.col("x").cast("double"))
    d = F.col("d").cast("double")
    when = lambda out, col: F.when(F.col("is_out") == out, col)
    aggs = []
    for name, out in (("out", True), ("in", False)):
        sums = [("sum", F.sum, F.col("d")), ("sq", F.sum, d * d), ("lo", F.min, F.col("d")), ("hi", F.max, F.col("d")), ("n", F.count, F.col("d"))]
        if corr:
            sums += [("sx", F.sum, d * F.col("x")), ("sxx", F.sum, d * F.col("x") * F.col("x")), ("sy", F.sum, F.col("sy")), ("syy", F.sum, F.col("syy")), ("sxy", F.sum, F.col("x") * F.col("sy"))]
        aggs += [f(when(out, col)).alias(f"{alias}_{name}") for alias, f, col in sums]
    found = per.groupBy(*bucket).agg(*aggs)
    sizes = cell_sizes(cells).select(F.col("cell").alias("c1"), "size")
    found = found.join(sizes, "c1")
    columns = [F.col(c) for c in bucket]
    for name in ("in", "out"):
        c = lambda alias, name=name: F.coalesce(F.col(f"{alias}_{name}"), F.lit(0))
        avg = c("sum") / F.col("size")
        columns += [
            avg.alias(f"avg_{name}"),
            F.when(F.col(f"n_{name}") == F.col("size"), c("lo")).otherwise(F.lit(0)).cast("double").alias(f"min_{name}"),
            c("hi").cast("double").alias(f"max_{name}"),
            F.greatest(F.lit(0.0), c("sq") / F.col("size") - avg * avg).alias(f"var_{name}"),
        ]
        if corr:
            cov = c("sum") * c("sxy") - c("sx") * c("sy")
            spread = (c("sum") * c("sxx") - c("sx") * c("sx")) * (c("sum") * c("syy") - c("sy") * c("sy"))
            columns.append(F.when(spread > 0, cov / F.sqrt(spread)).otherwise(F.lit(0.0)).alias(f"corr_{name}"))
    return found.select(*columns)


def degree_ranges(graph: PropertyGraph, cells: DataFrame) -> DataFrame:
    """(cell, spread): largest less smallest total degree within each cell."""
    total = graph.degrees().select("id", (F.col("d_in") + F.col("d_out")).alias("deg"))
    return total.join(cells, "id").groupBy("cell").agg((F.max("deg") - F.min("deg")).alias("spread"))
