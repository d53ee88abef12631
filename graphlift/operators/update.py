"""Incremental maintenance of an average-degree summary, one batch at a time.

New vertices go to the cell that is largest when the batch begins; its averages are diluted by its growth. New
edges raise the averages between their ends' cells as far as the pair's capacity allows. All deltas of a batch are
sums, so their order within a batch doesn't matter.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import WILDCARD, clean, drawn
from .stats import with_wildcard
from .store import written
from .summary import CellSummary


def largest_cell(summary: CellSummary) -> int:
    """The cell of most vertices, the lowest of equals."""
    sizes = summary.cell_card.where(F.col("label") == WILDCARD)
    row = sizes.agg(F.max_by("cell", F.struct("cnt", -F.col("cell")))).first()
    return row[0] if row[0] is not None else 1


#: A table of the cells of up to so many vertices goes whole to each executor, some 50 bytes for each; edges of a batch aren't exchanged then.
MOST_SENT = 500_000


def _placed(summary: CellSummary, cell: str) -> F.Column:
    """The lowest cell that holds an id, or counts as full; the largest cell for unknown ids."""
    known = F.least(cell, F.lit(min(summary.full_cells))) if summary.full_cells else F.col(cell)
    return F.coalesce(known, F.lit(largest_cell(summary)))


def vertex_cells(summary: CellSummary, ids: DataFrame) -> DataFrame:
    """(id, cell) of each id."""
    known = ids.select("id").distinct().join(summary.cell_member, "id", "left")
    return known.groupBy("id").agg(F.min("cell").alias("cell")).select("id", _placed(summary, "cell").alias("cell"))


def add_vertices(summary: CellSummary, vertices: DataFrame) -> CellSummary:
    """vertices(id, labels): new ones."""
    cell = largest_cell(summary)
    fresh = written(vertices.select("id", clean("labels").alias("labels")).dropDuplicates(["id"]).join(summary.cell_member.select("id"), "id", "left_anti"))
    n_new = fresh.count()
    size = summary.cell_card.where((F.col("label") == WILDCARD) & (F.col("cell") == cell)).agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    if not n_new:
        return summary
    counts = fresh.select(F.lit(cell).alias("cell"), F.explode(with_wildcard("labels")).alias("label")).groupBy("cell", "label").agg(F.count("*").alias("cnt"))
    card = summary.cell_card.unionByName(counts).groupBy("cell", "label").agg(F.sum("cnt").alias("cnt"))
    by = size / (size + n_new)
    diluted = {c: F.when(F.col("c1") == cell, F.col(c) * by).otherwise(F.col(c)) for c in ("avg_in", "avg_out")}
    members = summary.cell_member.unionByName(fresh.select("id", F.lit(cell).alias("cell")))
    return replace(summary, cell_card=written(card), edge_deg=written(summary.edge_deg.withColumns(diluted)), cell_member=written(members), n_vertices=summary.n_vertices + n_new)


def add_edges(summary: CellSummary, edges: DataFrame) -> CellSummary:
    """edges(src, dst, labels) between vertices; the totals of the graph stay, added_edges grows."""
    batch = written(edges.select("src", "dst", "labels"))
    n_new = batch.count()
    if not n_new:
        return summary
    members = summary.cell_member.groupBy("id").agg(F.min("cell").alias("cell"))
    if summary.cell_member.count() <= MOST_SENT:
        members = F.broadcast(members)
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("cell").alias(name))
    celled = batch.join(side("src", "cs"), "src", "left").join(side("dst", "ct"), "dst", "left").withColumns({c: _placed(summary, c) for c in ("cs", "ct")})
    # by whole label sets first, which are few: sets aren't taken apart for each edge
    flows = celled.groupBy("labels", "cs", "ct").agg(F.count("*").alias("m"))
    flows = flows.withColumn("edge_label", F.explode(with_wildcard(clean("labels")))).groupBy("edge_label", "cs", "ct").agg(F.sum("m").alias("m"))
    card = summary.cell_card
    whole = card.where(F.col("label") == WILDCARD)

    def deltas(near: str, far: str, column: str) -> DataFrame:
        """Edges from near to far, shared out to the labels of far's cell."""
        rows = flows.select("edge_label", F.col(near).alias("c1"), F.col(far).alias("c2"), "m")
        labels = card.select(F.col("cell").alias("c2"), F.col("label").alias("vlabel"), F.col("cnt").alias("labelled"))
        far_size = whole.select(F.col("cell").alias("c2"), F.col("cnt").alias("far"))
        return rows.join(labels, "c2").join(far_size, "c2").select("edge_label", "vlabel", "c1", "c2", (F.col("m") * F.col("labelled") / F.col("far")).alias(column))

    keys = ["edge_label", "vlabel", "c1", "c2"]
    more = deltas("cs", "ct", "more_out").join(deltas("ct", "cs", "more_in"), keys, "full")
    size = whole.select(F.col("cell").alias("c1"), F.col("cnt").alias("near"))
    labelled = card.select(F.col("cell").alias("c2"), F.col("label").alias("vlabel"), F.col("cnt").alias("labelled"))
    rows = summary.edge_deg.join(more, keys, "full").join(size, "c1").join(labelled, ["c2", "vlabel"])

    def grown(side: str):
        have = F.coalesce(F.col(f"avg_{side}"), F.lit(0.0))
        add = F.coalesce(F.col(f"more_{side}"), F.lit(0.0))
        return F.when(add > 0, F.least(have * F.col("near") + add, F.col("near") * F.col("labelled")) / F.col("near")).otherwise(have)

    others = [c for c in summary.edge_deg.columns if c not in (*keys, "avg_in", "avg_out")]
    degrees = rows.select(*keys, grown("in").alias("avg_in"), grown("out").alias("avg_out"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in others]).select(*summary.edge_deg.columns)
    return replace(summary, edge_deg=written(degrees), added_edges=summary.added_edges + n_new)


def hold_out(graph, share: float, seed: int = 0):
    """(kept edges, held-out edges): a split by a hash of the pair, for update experiments."""
    draw = drawn("src", "dst", seed=seed) / 2_147_483_647.0
    return graph.edges.where(draw >= share), graph.edges.where(draw < share)
