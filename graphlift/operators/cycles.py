"""Cycle statistics: how often a walk of given directions between two cells is closed by an edge from its start to its end."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import WILDCARD, PropertyGraph, drawn
from .store import sent_whole, written
from .triangles import triangle_classes

MIN_SUPPORT = 25

#: Stands for the cell of a vertex that has none.
NO_CELL = -(2**31)


def both_ways(graph: PropertyGraph) -> DataFrame:
    """(n1, n2, sign): every edge along (F) and against (B) its direction."""
    edges = graph.edges
    return edges.select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.lit("F").alias("sign")).unionByName(edges.select(F.col("dst").alias("n1"), F.col("src").alias("n2"), F.lit("B").alias("sign")))


def walk_counts(graph: PropertyGraph, max_edges: int, most_starts: int | None = None, seed: int = 0, most_walks: int | None = None) -> DataFrame:
    """(path, n1, n2, w, closed): numbers of walks by their signs and ends, and whether the edge n1 -> n2 exists.

    Walks of k edges extend those of k - 1, summed by their ends, so hubs don't multiply rows. Of one-edge walks only those
    against an edge count, as one along an edge is closed by itself. most_starts samples start
    vertices (by a hash, all alike); counts are then scaled up by their share. most_walks bounds the rows after each step: of more, a share is
    drawn by a hash and its counts are scaled up, so sums stay right on the average and no step holds all pairs of vertices.
    """
    steps = both_ways(graph)
    starts = steps
    scale = F.lit(1.0)
    if most_starts and most_starts > 0:
        n = graph.vertices.count()
        if n > most_starts:
            starts = steps.where(drawn("n1", seed=seed) < int(2_147_483_647 * most_starts / n))
            scale = F.lit(n / most_starts)
    walks = starts.select("n1", "n2", F.col("sign").alias("path"), scale.alias("w"))
    out = walks.where(F.col("path") == "B")
    nexts = steps.select(F.col("n1").alias("n2"), F.col("n2").alias("n3"), "sign")
    for k in range(2, max_edges + 1):
        walks = walks.join(nexts, "n2").groupBy("n1", F.col("n3").alias("n2"), F.concat("path", "sign").alias("path")).agg(F.sum("w").alias("w"))
        if most_walks and most_walks > 0:
            walks = written(walks)
            n = walks.count()
            if n > most_walks:
                walks = walks.where(drawn("n1", "n2", F.crc32(F.col("path").cast("binary")), seed=seed + k) < int(2_147_483_647 * most_walks / n)).withColumn("w", F.col("w") * (n / most_walks))
        out = out.unionByName(walks)
    closing = graph.edges.select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.lit(True).alias("closed"))
    return out.join(closing, ["n1", "n2"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))


def short_sums(graph: PropertyGraph, cells: DataFrame, max_edges: int) -> DataFrame:
    """(path, c1, c2, total, closed) of all walks of one and, if max_edges > 1, two edges, as walk_counts() has them, without a row for each pair of ends.

    Walks through a vertex multiply its numbers of edges by cell. Closed ones are triangles, counted by class, or have a self-loop
    at one of their vertices and are told from the linked pairs.
    """
    edges = graph.edges.select("src", "dst")
    loops = edges.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    degree = graph.degrees().select("id", (F.col("d_in") + F.col("d_out")).alias("deg"))
    known = degree.join(cells, "id", "left").join(loops, "id", "left").select("id", "deg", F.coalesce("cell", F.lit(NO_CELL)).cast("int").alias("cell"), F.coalesce("loop", F.lit(False)).alias("loop"))
    known = written(known)
    # each linked pair of different vertices once; bit 1 of dirs: an edge from a to b, 2: back
    linked = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("dirs"))
    # the ends of an edge, from a table that is sent whole if it is small: edges aren't exchanged then
    sent = sent_whole(known)
    end = lambda x: sent.select(*[F.col(c).alias(f"{c}_{x}") for c in known.columns])
    linked = linked.join(end("a"), F.col("a") == F.col("id_a")).join(end("b"), F.col("b") == F.col("id_b"))
    swap = F.struct("deg_b", "b") < F.struct("deg_a", "a")  # the lower degree first
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    back = F.when(F.col("dirs") == 3, 3).otherwise(3 - F.col("dirs"))
    pairs = written(
        linked.select(
            either("a", "b").alias("lo"), either("b", "a").alias("hi"), F.when(swap, back).otherwise(F.col("dirs")).alias("dirs"),
            either("cell_a", "cell_b").alias("c_lo"), either("cell_b", "cell_a").alias("c_hi"), either("loop_a", "loop_b").alias("loop_lo"), either("loop_b", "loop_a").alias("loop_hi"),
        )
    )
    # both views of a pair, summed: x -> y is there, y -> x is there
    view = lambda x, y, there, again: pairs.select(F.col(f"c_{x}").alias("cx"), F.col(f"c_{y}").alias("cy"), F.col(f"loop_{x}").alias("lx"), F.col(f"loop_{y}").alias("ly"), (F.col("dirs").bitwiseAND(there) > 0).alias("f"), (F.col("dirs").bitwiseAND(again) > 0).alias("g"))
    views = written(view("lo", "hi", 1, 2).unionByName(view("hi", "lo", 2, 1)).groupBy("cx", "cy", "lx", "ly", "f", "g").agg(F.count("*").alias("n")))
    looped = known.where("loop").groupBy("cell").agg(F.count("*").alias("n"))
    row = lambda rows, path, c1, c2, total, closed: rows.select(path.alias("path"), F.col(c1).alias("c1"), F.col(c2).alias("c2"), total.cast("double").alias("total"), closed.cast("double").alias("closed"))
    n, none = F.col("n"), F.lit(0)
    out = row(views.where("g"), F.lit("B"), "cx", "cy", n, F.when(F.col("f"), n).otherwise(0)).unionByName(row(looped, F.lit("B"), "cell", "cell", n, n))
    if max_edges > 1:
        signs = lambda along, against: F.array_compact(F.array(F.when(along, F.lit("F")), F.when(against, F.lit("B"))))
        f, g, both = F.col("f"), F.col("g"), F.array(F.lit("F"), F.lit("B"))

        def closed(rows: DataFrame, c1: str, c2: str, first, second) -> DataFrame:
            rows = rows.select(c1, *([c2] if c2 != c1 else []), "n", first.alias("_s1"), second.alias("_s2"))
            rows = rows.withColumn("_s1", F.explode("_s1")).withColumn("_s2", F.explode("_s2"))
            return row(rows, F.concat("_s1", "_s2"), c1, c2, none, n)

        ways = [
            closed(views.where("lx"), "cx", "cx", signs(f, g), signs(g, f)),  # there and back to a looped vertex
            closed(views.where("lx AND f"), "cx", "cy", both, signs(f, g)),  # the loop first
            closed(views.where("ly AND f"), "cx", "cy", signs(f, g), both),  # the loop last
            closed(looped, "cell", "cell", both, both),
        ]
        classes = written(triangle_classes(pairs.select("lo", "hi", "dirs", "c_lo", "c_hi")))
        has = lambda x, y: F.col(x + y).bitwiseAND(1) > 0 if x < y else F.col(y + x).bitwiseAND(2) > 0
        for x, m, y in permutations("uvw"):
            ways.append(closed(classes.where(has(x, y)), f"c{x}", f"c{y}", signs(has(x, m), has(m, x)), signs(has(m, y), has(y, m))))
        # each pair by either end, and the loops
        i, o = (F.col("dirs").bitwiseAND(bit) / bit for bit in (2, 1))
        ends = pairs.select(F.col("lo").alias("m"), F.col("c_hi").alias("c"), i.alias("i"), o.alias("o")).unionByName(pairs.select(F.col("hi").alias("m"), F.col("c_lo").alias("c"), o.alias("i"), i.alias("o")))
        ends = ends.unionByName(known.where("loop").select(F.col("id").alias("m"), F.col("cell").alias("c"), F.lit(1.0).alias("i"), F.lit(1.0).alias("o")))
        # a row for each vertex and cell of its neighbours
        near = written(ends.groupBy("m", "c").agg(F.sum("i").alias("i"), F.sum("o").alias("o")))
        x, y = (near.select("m", *[F.col(c).alias(f"{c}{k}") for c in "cio"]) for k in (1, 2))
        through = {"FF": ("i1", "o2"), "FB": ("i1", "i2"), "BF": ("o1", "o2"), "BB": ("o1", "i2")}
        totals = x.join(y, "m").groupBy("c1", "c2").agg(*[F.sum(F.col(a) * F.col(b)).alias(path) for path, (a, b) in through.items()])
        ways += [row(totals.where(F.col(path) > 0), F.lit(path), "c1", "c2", F.col(path), none) for path in through]
        out = reduce(DataFrame.unionByName, ways, out)
    return out.where((F.col("c1") != NO_CELL) & (F.col("c2") != NO_CELL)).groupBy("path", "c1", "c2").agg(F.sum("total").alias("total"), F.sum("closed").alias("closed"))


def cycle_probabilities(graph: PropertyGraph, cells: DataFrame, max_cycle: int, min_support: float = MIN_SUPPORT, most_starts: int | None = None, seed: int = 0, most_walks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cycle_prob(path, c1, c2, prob), cycle_len_prob(len, prob)).

    (path, wildcard, wildcard) rows hold for any cells. Rows of less than min_support walks are left
    out; lengths are always there. max_cycle < 2: both are empty.
    """
    spark = graph.edges.sparkSession
    if max_cycle < 2:
        return spark.createDataFrame([], "path string, c1 int, c2 int, prob double"), spark.createDataFrame([], "len int, prob double")
    totals = written(cycle_totals(graph, cells, max_cycle, most_starts, seed, most_walks))  # read by both tables
    by_path = totals.where((F.col("level") < 3) & (F.col("total") >= min_support))
    by_len = totals.where(F.col("level") == 3)
    prob = F.col("closed") / F.col("total")
    return by_path.select("path", F.coalesce("c1", F.lit(WILDCARD)).alias("c1"), F.coalesce("c2", F.lit(WILDCARD)).alias("c2"), prob.alias("prob")), by_len.select("len", prob.alias("prob"))


def cycle_totals(graph: PropertyGraph, cells: DataFrame, max_cycle: int, most_starts: int | None = None, seed: int = 0, most_walks: int | None = None) -> DataFrame:
    """(path, len, c1, c2, level, total, closed) by (path, c1, c2), level 1, by path, 2, and by length, 3: one aggregation with grouping sets."""
    drawn_walks = bool(most_starts and most_starts > 0 or most_walks and most_walks > 0)
    sums = None if drawn_walks else short_sums(graph, cells, max_cycle - 1)
    if drawn_walks or max_cycle > 3:
        walks = walk_counts(graph, max_cycle - 1, most_starts, seed, most_walks)
        tint = lambda end, name: cells.select(F.col("id").alias(end), F.col("cell").alias(name))
        rows = (walks if drawn_walks else walks.where(F.length("path") > 2)).join(tint("n1", "c1"), "n1").join(tint("n2", "c2"), "n2")
        # sums by cells first: the three roll-ups then read a table of cells
        own = rows.groupBy("path", "c1", "c2").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("closed"), F.col("w")).otherwise(0.0)).alias("closed"))
        sums = own if sums is None else sums.unionByName(own)
    level = F.when(F.grouping("c1") == 0, 1).when(F.grouping("path") == 0, 2).otherwise(3)
    sets = sums.withColumn("len", F.length("path")).groupingSets([["path", "len", "c1", "c2"], ["path", "len"], ["len"]], "path", "len", "c1", "c2")
    return sets.agg(level.alias("level"), F.sum("total").alias("total"), F.sum("closed").alias("closed"))
