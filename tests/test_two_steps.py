import random

import pytest
from pyspark.sql import functions as F

from graphlift import catalog, fixtures
from graphlift.operators import two_steps, update
from graphlift.operators.exact import within
from graphlift.operators.summary import SummaryParams, summarize


@pytest.mark.parametrize("task_edges, chunk", [(2_000_000, 1 << 22), (100, 1 << 22), (100, 7)])
def test_pairs_two_edges_apart(spark, monkeypatch, task_edges, chunk):
    """Self-loops, a hub, edges both ways; in one task and in many, by marks and by sorted numbers."""
    draw = random.Random(4)
    pairs = {(draw.randint(1, 60), draw.randint(1, 60)) for _ in range(150)} | {(v, 1) for v in range(2, 60)} | {(3, 3), (3, 4), (4, 3), (70, 71)}
    make = two_steps._finder
    monkeypatch.setattr(two_steps, "_finder", lambda: make(chunk, 5))
    found = [tuple(r) for r in two_steps.two_steps(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), task_edges).collect()]
    assert sorted(found) == sorted({(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs)


def test_a_few_starts_of_many_ends(spark):
    """Sparse: each start has one path, the ends are many."""
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    found = two_steps.two_steps(ring)
    assert found.count() == n and found.where((F.col("src") + 2) % n != F.col("dst")).count() == 0


def test_many_paths_between_the_same_pairs_end(spark):
    """2,000 starts, 2,000 middles, 100 ends: 400 million paths, which as rows don't end in this time, between 200,000 pairs."""
    n = 2_000
    edges = spark.range(n * n).select((F.col("id") % n).alias("src"), (n + F.col("id") / n).cast("bigint").alias("dst"))
    edges = edges.unionByName(spark.range(n * 100).select((n + F.col("id") % n).alias("src"), (2 * n + F.col("id") / n).cast("bigint").alias("dst")))
    assert within(spark, 60, lambda: two_steps.two_steps(edges).count(), None) == n * 100


@pytest.mark.parametrize("most_sent", [0, 500_000])
def test_batches_of_edges_with_label_sets_and_unknown_ends(spark, monkeypatch, most_sent):
    """The same by a sent table of cells and by joins: labels that repeat, the wildcard, no label, ends that the summary doesn't know."""
    monkeypatch.setattr(update, "MOST_SENT", most_sent)
    s = summarize(fixtures.small(spark, 6, [(1, 2), (2, 3), (4, 5)], edge_label=7), SummaryParams((("hash", 2),), "avg", 0))
    new = spark.createDataFrame([(1, 3, [7, 7, -1]), (1, 4, [7, 8]), (99, 2, []), (6, 99, [8])], "src bigint, dst bigint, labels array<int>")
    cells = {r["id"]: r["cell"] for r in update.vertex_cells(s, spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6, 99)], "id bigint")).collect()}
    grown = update.add_edges(s, new)
    size = {c: list(cells[v] for v in range(1, 7)).count(c) for c in cells.values()}
    flow = lambda rows, a, b: sum(cells[x] == a and cells[y] == b for x, y in rows)
    every = {-1: [(1, 2), (2, 3), (4, 5), (1, 3), (1, 4), (99, 2), (6, 99)], 7: [(1, 2), (2, 3), (4, 5), (1, 3), (1, 4)], 8: [(1, 4), (6, 99)]}
    expected = {(k, a, b): pytest.approx(min(n, size[a] * size[b]) / size[a]) for k, rows in every.items() for a in size for b in size if (n := flow(rows, a, b))}
    assert {(r.edge_label, r.c1, r.c2): r.avg_out for r in grown.edge_deg.where("vlabel = -1 AND avg_out > 0").collect()} == expected
    assert grown.added_edges == 4


def test_a_restarted_stream_reads_all_files_as_one_batch(spark, sf_dir, monkeypatch):
    """The new edges lie in several files, none of which one task has to write whole."""
    whole = catalog._new_edges
    monkeypatch.setattr(catalog, "_new_edges", lambda *a: whole(*a).repartition(5))
    rows = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect()))
    assert rows("update_stream_restarted") == rows("update_edges")
