import pytest
from pyspark.sql import functions as F

from graphlift import fixtures
from graphlift.model import Pattern, PropertyGraph
from graphlift.operators import metrics
from graphlift.operators.estimate import estimate
from graphlift.operators.stats import cell_card
from graphlift.operators.store import opened, stored
from graphlift.operators.summary import CellSummary, SummaryParams, build_report, summarize
from graphlift.operators.update import add_edges, add_vertices, hold_out, largest_cell, vertex_cells
from graphlift.sources import results, text
from graphlift.streaming.update import SummaryStream

GCARE = "t # 0\nv 0 1 2\nv 1 -1\nv 2 3\n\ne 0 1 5\ne 0 1 6\ne 1 2 -1\n"
MATCHING = "t 3 2\nv 0 4 1\nv 1 4 2\nv 2 5 1\ne 0 1\ne 1 2\n"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gcare_graphs_and_back(spark, tmp_path):
    (tmp_path / "g.txt").write_text(GCARE)
    g = text.read_graph(spark, str(tmp_path / "g.txt"))
    assert rows(g.vertices, "id", "labels") == [(0, [1, 2]), (1, []), (2, [3])]
    assert rows(g.edges, "src", "dst", "labels") == [(0, 1, [5, 6]), (1, 2, [])]
    text.write_graph(g, str(tmp_path / "out"))
    again = text.read_graph(spark, str(tmp_path / "out"))
    assert rows(again.edges, "src", "dst", "labels") == rows(g.edges, "src", "dst", "labels")
    assert rows(again.vertices, "id", "labels") == rows(g.vertices, "id", "labels")


def test_matching_graphs_count_both_ways(spark, tmp_path):
    (tmp_path / "g.graph").write_text(MATCHING)
    g = text.read_graph(spark, str(tmp_path / "g.graph"), text.MATCHING)
    assert rows(g.edges, "src", "dst", "labels") == [(0, 1, [0]), (1, 0, [0]), (1, 2, [0]), (2, 1, [0])]
    text.convert_graph(spark, str(tmp_path / "g.graph"), str(tmp_path / "converted"))
    assert rows(text.read_graph(spark, str(tmp_path / "converted")).edges, "src", "dst") == rows(g.edges, "src", "dst")
    (tmp_path / "yeast.graph").write_text(MATCHING)
    assert text.read_dataset(spark, "yeast", str(tmp_path)).edges.count() == 4


def test_queries_and_true_counts(spark, tmp_path):
    p = text.parse_pattern("t # 1\nv 0 -1 7\nv 1 2 -1\ne 0 1 3\n".splitlines())
    assert p == Pattern.of(2, [(0, 1, 3)], {1: 2}, {0: [7]})
    assert text.parse_pattern(text.write_pattern(p).splitlines()) == p
    assert text.parse_pattern("v 0 4 1\nv 1 5 1\ne 0 1\n".splitlines(), text.MATCHING) == Pattern.of(2, [(0, 1, 0)], {0: 4, 1: 5})
    assert text.parse_true_count("x\n12 0.5\n\n") == 12
    for d in ("queries/Chain_3", "truths"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "queries/Chain_3/a.txt").write_text("v 0 1 -1\n")
    (tmp_path / "queries/Chain_3/b.txt").write_text("v 0 2 -1\n")
    (tmp_path / "truths/a.txt").write_text("5\n")
    found = text.read_query_set(spark, str(tmp_path / "queries"), str(tmp_path / "truths"))
    assert [(q["name"], q["type"], q["truth"]) for q in found] == [("a", "Chain", 5), ("b", "Chain", None)]
    assert len(text.read_query_set(spark, str(tmp_path / "queries"), str(tmp_path / "truths"), required=True)) == 1


def test_result_files(spark, tmp_path):
    (tmp_path / "alley_yeast.log").write_text("q/chain_1.txt\n12.5 0.25\nq/star_2.txt\nerror 1\n")
    parsed = results.parse_logs(spark, str(tmp_path / "alley_yeast.log"))
    assert rows(parsed, "Estimator", "Dataset", "Query", "Value", "Runtime") == [("alley", "yeast.log", "q/chain_1.txt", 12.5, 0.25), ("alley", "yeast.log", "q/star_2.txt", None, 1.0)]
    runtimes = spark.createDataFrame([("d", "q1", 2.0)], "Dataset string, Query string, Runtime double")
    more = spark.createDataFrame([("d", "q1", "7"), ("d", "q2", "error")], "Dataset string, Query string, Value string")
    old = spark.createDataFrame([("x", "d", "q1", 1.0, 1.0)], results.COMPETITORS)
    both = results.append_runtimes(old, more, runtimes, "lss")
    assert rows(both, "Estimator", "Value", "Runtime") == [("lss", 7.0, 2.0), ("x", 1.0, 1.0)]
    assert rows(results.combine(both, old, ["lss"]), "Estimator") == [("x",), ("x",)]
    both.write.parquet(str(tmp_path / "p"))
    assert results.read_competitors(spark, str(tmp_path / "p")).columns[-1] == "QueryType"
    results.write_csv(old, str(tmp_path / "csv"))
    assert rows(results.normalised(results.read_csv(spark, str(tmp_path / "csv"), results.COMPETITORS)), "estimator") == [("x",)]
    results.write_true_counts(spark.createDataFrame([("a", 3), ("b", 0), ("c", -1)], "query string, truth bigint"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 1


def test_graph_changes(spark):
    g = fixtures.small(spark, 3, [(1, 2), (1, 2), (2, 3)], {1: [4, -1, 4]}, edge_label=1)
    assert rows(g.vertices, "id", "labels") == [(1, [4]), (2, []), (3, [])]
    more = g.add_edges(spark.createDataFrame([(1, 2, [2]), (9, 1, [3])], "src bigint, dst bigint, labels array<int>"))
    assert rows(more.edges, "src", "dst", "labels") == [(1, 2, [1, 2]), (2, 3, [1]), (9, 1, [3])]
    assert (9, []) in rows(more.vertices, "id", "labels")
    assert more.add_vertices(spark.createDataFrame([(1, [8])], "id bigint, labels array<int>")).vertices.where("id = 1").first()["labels"] == [4, 8]
    assert PropertyGraph.from_edges(g.edges).totals() == (3, 2)


def test_stored_graphs_read_slices(spark, tmp_path):
    g = stored(fixtures.small(spark, 3, [(1, 2), (2, 3)], edge_label=6), str(tmp_path / "g"))
    again = opened(spark, str(tmp_path / "g"))
    assert again.by_label.where("label = 6").count() == 2 and again.by_label.where("label = 7").count() == 0
    plan = again.by_label.where("label = 6")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(label" in plan
    assert g.totals() == again.totals()


def test_summaries_are_stored_whole(spark, sf_dir, tmp_path):
    g = fixtures.graph(spark, sf_dir, "activity")
    params = SummaryParams((("hash", 4),), "corr", 3)
    s = summarize(g, params)
    s.save(str(tmp_path / params.name()))
    again = CellSummary.load(spark, str(tmp_path / params.name()))
    p = Pattern.of(3, [(0, 1, 50), (1, 2, 50), (2, 0, 50)])
    for kind in ("min", "avg", "max", "corr"):
        assert estimate(again, p, kind) == pytest.approx(estimate(s, p, kind))
    assert build_report(s, "activity", params).count() == 5
    # cells sum up to the whole, whatever the partition
    assert s.cell_card.where("label = -1").agg(F.sum("cnt")).first()[0] == g.vertices.count()


def test_updates_in_one_batch_and_in_many(spark, sf_dir, tmp_path):
    g = fixtures.graph(spark, sf_dir, "activity")
    kept, held = hold_out(g, 0.3, seed=4)
    early = PropertyGraph(g.vertices, kept)
    s = summarize(early, SummaryParams((("hash", 3),), "avg", 3))
    grown = add_edges(s, held)
    assert grown.added_edges == held.count() and grown.n_edges == s.n_edges
    before, after = (x.edge_deg.agg(F.sum("avg_out")).first()[0] for x in (s, grown))
    assert after > before
    caps = grown.edge_deg.join(grown.cell_card.select(F.col("cell").alias("c2"), F.col("label").alias("vlabel"), "cnt"), ["c2", "vlabel"])
    assert caps.where(F.col("avg_out") > F.col("cnt") + 1e-9).count() == 0
    held.repartition(2).write.parquet(str(tmp_path / "edges"))
    stream = SummaryStream(s)
    source = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edges"))
    stream.edges(source, checkpointLocation=str(tmp_path / "check")).awaitTermination()
    assert stream.summary.added_edges == grown.added_edges
    stream._apply("edges", add_edges)(held, 0)  # a batch that comes again counts once
    assert stream.summary.added_edges == grown.added_edges


def test_new_vertices_go_to_the_largest_cell(spark, sf_dir):
    g = fixtures.graph(spark, sf_dir, "activity")
    s = summarize(g, SummaryParams((("hash", 3),), "avg", 0))
    big = largest_cell(s)
    new = spark.createDataFrame([(77_000, [7, 7]), (77_001, [])], "id bigint, labels array<int>")
    grown = add_vertices(s, new)
    assert grown.n_vertices == s.n_vertices + 2
    assert {r["cell"] for r in vertex_cells(grown, new).collect()} == {big}
    gained = grown.cell_card.join(s.cell_card.withColumnRenamed("cnt", "old"), ["cell", "label"]).where("cnt > old")
    assert rows(gained.withColumn("more", F.col("cnt") - F.col("old")), "cell", "label", "more") == [(big, -1, 2), (big, 7, 1)]
    assert add_vertices(grown, new).n_vertices == grown.n_vertices
    assert cell_card(g, s.cell_member).count() == s.cell_card.count()


def test_metrics(spark):
    df = spark.createDataFrame([("m", "d", 1, 10.0, 5.0, 3), ("m", "d", 2, None, 5.0, 33), ("m", "d", 3, float("inf"), 5.0, 7), ("m", "d", 4, 0.0, 0.0, 4)], "method string, dataset string, query int, estimate double, truth double, size int")
    assert [r[0] for r in df.select(metrics.failed()).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(metrics.size_class()).collect()] == [3, 32, 9, 4]
    assert [r[0] for r in df.select(metrics.usable()).collect()] == [10.0, 1.0, 1e35, 1.0]
    assert df.where("query = 1").select(metrics.q_error()).first()[0] == 2
    assert df.where("query = 4").select(metrics.relative_error()).first()[0] == 1
    assert tuple(metrics.failure_rates(df).first())[2:] == (4, 3, 1, 1, 0.75)
    others = spark.createDataFrame([("d", 1, 3.0, 0.1)], "dataset string, query int, value double, runtime double")
    assert metrics.with_competitors(df, others).where("other_missing").count() == 3
    assert metrics.missing_from(df, others).count() == 3
    again = spark.createDataFrame([(1, 5), (2, 6)], "query int, truth bigint")
    assert rows(metrics.verified(again, spark.createDataFrame([(1, 5), (2, 7)], "query int, truth bigint")), "query", "same") == [(1, True), (2, False)]
    assert metrics.query_type("a/Star_6/q1.txt") == "Star"
    assert rows(metrics.width_distribution(spark, {"a": Pattern.of(2, [(0, 1)])}), "width", "n") == [(1, 1)]


def test_a_restarted_stream_goes_on_from_its_last_state(spark, sf_dir, tmp_path):
    """Two batches, a stop, a new object on the same path and checkpoint, two more: all four count, and none twice."""
    g = fixtures.graph(spark, sf_dir, "activity")
    s = summarize(g, SummaryParams((("hash", 3),), "avg", 0))
    path, source = str(tmp_path / "state"), tmp_path / "edges"
    pair = lambda k: spark.createDataFrame([(10**6 + k, 10**6 + k + 1, [50])], "src bigint, dst bigint, labels array<int>")
    for k in range(2):
        pair(k).coalesce(1).write.mode("append").parquet(str(source))
    for n in (2, 4):
        stream = SummaryStream(s, path)
        rows = spark.readStream.schema(pair(0).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.edges(rows, checkpointLocation=str(tmp_path / "check")).awaitTermination()
        assert stream.summary.added_edges == n
        for k in range(2, 4):
            pair(k).coalesce(1).write.mode("append").parquet(str(source))
    again = SummaryStream(s, path)
    assert again.summary.added_edges == 4 and again._last == {"edges": 3}
    again._apply("edges", add_edges)(pair(9), 3)
    assert again.summary.added_edges == 4


def test_null_values_keep_their_rows(spark, tmp_path):
    """Customers and events without a kind lose that label or edge alone, as in the SQL."""
    folder = "/root/testdata/sf0.001"
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{folder}/{t}.parquet")
    c = spark.read.parquet(f"{folder}/customer.parquet")
    c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    g = fixtures.commerce(spark, str(tmp_path))
    n = g.vertices.where(F.array_contains("labels", fixtures.CUSTOMER))
    assert n.count() == c.count() and n.where(F.size("labels") == 1).count() == c.where("c_custkey % 2 = 1").count()
