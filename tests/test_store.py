import pytest
from pyspark.sql import functions as F

from graphlift import fixtures
from graphlift.model import EDGE_SCHEMA, VERTEX_SCHEMA, PropertyGraph, merge_labels
from graphlift.operators.store import stored_rows

EDGES = [(1, 2, [20, 21]), (1, 2, [20, 23]), (1, 2, [20]), (2, 2, []), (2, 3, None), (3, 1, [-1, None, 21]), (3, 1, [21])]


def rows_of(df):
    return sorted((*r[:-1], list(r[-1])) for r in df.collect())


@pytest.mark.parametrize("known", [(20, 21, 23), (23, -1, 20, 5, 21), range(63)])
def test_known_labels_are_merged_as_bits(spark, known):
    edges = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    assert rows_of(merge_labels(edges, ["src", "dst"], known)) == rows_of(merge_labels(edges, ["src", "dst"])) == [(1, 2, [20, 21, 23]), (2, 2, []), (2, 3, []), (3, 1, [21])]


def test_a_label_that_is_not_among_the_known_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label 23"):
        merge_labels(spark.createDataFrame(EDGES, EDGE_SCHEMA), ["src", "dst"], (20, 21)).collect()
    with pytest.raises(ValueError):
        merge_labels(spark.createDataFrame(EDGES, EDGE_SCHEMA), ["src", "dst"], range(64))


def test_edges_are_merged_once_for_a_stored_graph(spark):
    """The same graph as that of its rows; each row of edges is read once, not for the vertices again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    vertices = spark.createDataFrame([(1, [7]), (1, [8]), (9, [7])], VERTEX_SCHEMA)
    edges = spark.createDataFrame(EDGES, EDGE_SCHEMA).mapInArrow(seen, EDGE_SCHEMA)
    g = stored_rows(vertices, edges, (7, 8), (20, 21, 23))
    assert read.value == len(EDGES)
    plain = PropertyGraph.of(vertices, spark.createDataFrame(EDGES, EDGE_SCHEMA))
    assert rows_of(g.vertices) == rows_of(plain.vertices) == [(1, [7, 8]), (2, []), (3, []), (9, [7])]
    assert rows_of(g.edges) == rows_of(plain.edges)
    assert sorted(map(tuple, g.by_label.collect())) == [(1, 2, 20), (1, 2, 21), (1, 2, 23), (3, 1, 21)]


@pytest.mark.parametrize("name", ["commerce", "activity"])
def test_stored_graphs_are_those_of_the_tables(spark, sf_dir, name):
    g, plain = fixtures.graph(spark, sf_dir, name), {"commerce": fixtures.commerce, "activity": fixtures.activity}[name](spark, sf_dir)
    text = lambda df: df.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), " "))
    for a, b in ((g.vertices, plain.vertices), (g.edges, plain.edges)):
        assert a.count() == b.count() and text(a).exceptAll(text(b)).isEmpty()


def test_stored_tables_leave_no_exchange_on_disk(spark):
    """Shuffle files of a graph's making are gone when it is stored, and the session's setting is as before."""
    import time

    from graphlift.operators.store import CLEANUP, written

    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in map(found.apply, range(found.size())) if f.getName().endswith(".data")}

    before, setting = files(), spark.conf.get(CLEANUP)
    vertices = spark.range(1000).selectExpr("id", "array(7) AS labels")
    edges = spark.range(5000).selectExpr("id % 100 AS src", "id % 77 AS dst", "array(20) AS labels")
    g = stored_rows(vertices, edges, (7,), (20,))
    many = written(g.edges.groupBy("src").count())
    assert spark.conf.get(CLEANUP) == setting
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert (g.vertices.count(), g.edges.count(), many.count()) == (1000, 5000, 100)
