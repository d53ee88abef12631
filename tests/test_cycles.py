import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlift import catalog, fixtures
from graphlift.operators import cycles, stats, store, summary, triangles
from graphlift.operators.exact import within


def walks(n: int, pairs: set, cell: dict) -> dict:
    """(path, c1, c2): (walks, closed ones), one step after the other."""
    near = {v: [(b, "F") for a, b in pairs if a == v] + [(a, "B") for a, b in pairs if b == v] for v in range(1, n + 1)}
    total, closed = Counter(), Counter()
    for v in near:
        for x, s in near[v]:
            for path, end in [(s, x)] * (s == "B") + [(s + t, y) for y, t in near[x]]:
                if v in cell and end in cell:
                    total[path, cell[v], cell[end]] += 1
                    closed[path, cell[v], cell[end]] += (v, end) in pairs
    return {k: (float(total[k]), float(closed[k])) for k in total}


@pytest.mark.parametrize("task_edges, most_sums", [(1_000_000, 1 << 22), (150, 1 << 22), (150, 10)])
def test_short_walks_are_those_of_a_plain_count(spark, monkeypatch, task_edges, most_sums):
    """Self-loops, edges both ways, a hub and vertices without a cell; in one task and in many, by arrays and by groups."""
    draw = random.Random(5)
    n = 40
    pairs = {(draw.randint(1, n), draw.randint(1, n)) for _ in range(220)} | {(v, 1) for v in range(2, n)} | {(3, 3), (4, 4), (3, 4), (4, 3)}
    cell = {v: v % 3 + 1 for v in range(1, n + 1) if v != 7}
    classes, counter = triangles.triangle_classes, triangles._counter
    monkeypatch.setattr(cycles, "triangle_classes", lambda p: classes(p, task_edges))
    monkeypatch.setattr(triangles, "_counter", lambda: counter(50, most_sums))
    g = fixtures.small(spark, n, sorted(pairs))
    found = cycles.short_sums(g, spark.createDataFrame(list(cell.items()), "id bigint, cell int"), 2)
    assert {(r.path, r.c1, r.c2): (r.total, r.closed) for r in found.collect()} == walks(n, pairs, cell)
    longer = cycles.cycle_totals(g, spark.createDataFrame(list(cell.items()), "id bigint, cell int"), 4).where("level = 3")
    assert sorted(r.len for r in longer.collect()) == [1, 2, 3]


def test_a_hub_does_not_make_all_pairs_of_its_neighbours(spark):
    """40,000 vertices with an edge to one: 1.6 billion walks over it, which as rows by their ends don't end in this time."""
    n = 40_000
    g = fixtures.PropertyGraph.from_edges(spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"), F.array().cast("array<int>").alias("labels")).unionByName(spark.createDataFrame([(1, 2, [])], "src bigint, dst bigint, labels array<int>")))
    cells = g.vertices.select("id", F.lit(1).alias("cell"))
    found = within(spark, 60, lambda: {r.path: (r.total, r.closed) for r in cycles.cycle_totals(g, cells, 3).where("level = 2").collect()}, None)
    # FB: n^2 over the hub and one over vertex 2; the one from 1 to 2 over the hub is closed
    assert found == {"B": (n + 1.0, 0.0), "FB": (n * n + 1.0, 1.0), "FF": (1.0, 1.0), "BF": (n + 3.0, 1.0), "BB": (1.0, 0.0)}


@pytest.mark.parametrize("chunk, most_marks", [(1, 1), (7, 60), (1 << 18, 1 << 22)])
def test_triangles_are_found_in_blocks_of_any_size(chunk, most_marks):
    """Edges come as compressed blocks of two colours; tables of marks and steps of one entry and of all."""
    draw = random.Random(8)
    n, cell = 30, [i % 4 for i in range(30)]
    have = {(a, b): draw.randint(1, 3) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.4}
    rows = [{"lo": a, "hi": b, "dirs": d, "c_lo": cell[a], "c_hi": cell[b], "p": 0, "q": b % 2} for (a, b), d in have.items()]
    schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("dirs", pa.int8()), ("c_lo", pa.int32()), ("c_hi", pa.int32()), ("p", pa.int32()), ("q", pa.int32())])
    blocks = pa.concat_tables(pa.Table.from_batches([b]) for b in triangles._packer(100)(pa.Table.from_pylist(rows, schema).to_batches(40)))
    assert {(r["p"], r["q"]) for r in blocks.to_pylist()} == {(0, 0), (0, 1)}
    table = pa.table({"edges": blocks["edges"], "same": pa.array([False] * len(blocks))})
    found = triangles._counter(chunk, 1 << 22, most_marks)([pa.scalar(0), pa.scalar(0), pa.scalar(1)], table)
    want = Counter((cell[a], cell[b], cell[c], have[a, b], have[a, c], have[b, c]) for a, b in have for c in range(b + 1, n) if (a, c) in have and (b, c) in have)
    assert {tuple(r.values())[:6]: r["n"] for r in found.to_pylist()} == want


def test_cycles_are_counted_when_a_query_needs_them(spark, sf_dir, monkeypatch):
    """An estimate that doesn't read the cycle statistics and an update of vertices don't make them; the rest of the summary is made once."""
    asked, make, build = [], summary.cycle_probabilities, summary.summarize
    monkeypatch.setattr(catalog, "_summaries", {})
    monkeypatch.setattr(summary, "cycle_probabilities", lambda g, cells, most, **options: asked.append(most) or make(g, cells, most, **options))
    built = []
    monkeypatch.setattr(summary, "summarize", lambda *a: built.append(1) or build(*a))
    for name in ("estimate_avg_triangle_indep", "update_nodes"):
        catalog.QUERIES[name](spark, sf_dir).collect()
    assert max(asked) < 2
    late = catalog.QUERIES["estimate_sampled_uniform"](spark, sf_dir).collect()
    assert max(asked) == 3 and len(built) == 1
    monkeypatch.setattr(catalog, "_summaries", {})
    assert catalog.QUERIES["estimate_sampled_uniform"](spark, sf_dir).collect() == late


def test_edges_are_not_exchanged_for_the_cells_of_few_vertices(spark, monkeypatch):
    """Statistics by joins with a table that is sent, and by plain ones, agree."""
    draw = random.Random(3)
    g = fixtures.small(spark, 30, sorted({(draw.randint(1, 30), draw.randint(1, 30)) for _ in range(200)}), {v: [v % 3, 9] for v in range(1, 31)}, 5)
    cells = g.vertices.select("id", (F.col("id") % 4 + 1).cast("int").alias("cell"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joins, rows = [], []
        for most in (store.MOST_SENT, 0):
            monkeypatch.setattr(store, "MOST_SENT", most)
            found = stats.edge_deg(g, cells)
            joins.append(found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin"))
            rows.append(sorted(tuple(round(x, 9) for x in r) for r in found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert joins[0] == 1 < joins[1] and rows[0] == rows[1]


def test_degrees_exchange_label_sets_not_labels(spark, sf_dir):
    """Label sets are taken apart after the last exchange by vertex; only sums of whole buckets are exchanged then."""
    g = fixtures.graph(spark, sf_dir)
    cells = g.vertices.select("id", F.lit(1).alias("cell"))
    plan = stats.edge_deg(g, cells)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x.split("Exchange hashpartitioning(")[1] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any(x.startswith("edge_label#") for x in exchanges)
    assert not any(x.startswith("edge_label#") and "id#" in x.split("ENSURE")[0] for x in exchanges)
