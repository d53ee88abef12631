"""Connected components of an edge table by alternating stars. Once FEW edges at most are left, one task ends the work; more are never held by one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


#: Edges of a file.
EDGES = 250_000
#: Of so many edges one task finds the components, some 200 bytes for each. Rounds cost a dozen exchanges whatever the rows.
FEW = 500_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least one: the larger neighbours (large star), or the smaller ones and the node (small star)."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def least_of_component(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, root) of each node of the edges; the root is the least node of its component."""
    ends = pa.concat_arrays([a, b]).dictionary_encode()
    order = pa.compute.array_sort_indices(ends.dictionary)
    nodes = ends.dictionary.take(order)
    rank = np.empty(len(nodes), np.int64)
    rank[order.to_numpy()] = np.arange(len(nodes))
    place = rank[ends.indices.to_numpy()]
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            return nodes, nodes.take(pa.array(root))
        np.minimum.at(root, high, low)  # roots under lower ones
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    ddl = ", ".join(f"{name} {edges.schema['a'].dataType.simpleString()}" for name in ("node", "root"))
    schema = frames.arrow_schema(ddl)

    def solve(batches):
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = [pa.concat_arrays(table[c].chunks) for c in ("a", "b")]
            nodes, roots = least_of_component(*whole)
            yield pa.RecordBatch.from_arrays([nodes.cast(schema.field(0).type), roots.cast(schema.field(1).type)], schema=schema)

    return frames.map_arrow(edges.select("a", "b").coalesce(1), solve, ddl)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type to (node, root): each node of an edge and the least node of its component.

    Ends when a round changes nothing, or when FEW edges at most are left, in one task; each round's edges are written to the shared folder. Rounds grow
    with the logarithm of the nodes; after most_rounds it is an error. Loops, repeated edges and both directions of one are fine, no edges give no rows; edges with a null end are ignored.
    """
    now = frames.written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= FEW:
        return frames.written(_in_one_task(now))
    sign = files = None
    for _ in range(most_rounds):
        now = frames.written(_stars(_stars(now, True), False), files)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        if after[0] <= FEW:
            return frames.written(_in_one_task(now))
        sign, files = tuple(after), max(1, -(-after[0] // EDGES))
    raise RuntimeError("components didn't settle")
