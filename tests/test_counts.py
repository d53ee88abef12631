import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphlift import fixtures
from graphlift.model import EDGE_SCHEMA, VERTEX_SCHEMA, Pattern, PropertyGraph, random_graph
from graphlift.operators import partition, exact, sampling
from graphlift.operators.estimate import estimate
from graphlift.operators.summary import SummaryParams, summarize


def random_data(seed, n=9, m=22, labels=2):
    rng = random.Random(seed)
    v = {i: sorted(rng.sample(range(1, labels + 1), rng.randint(0, labels))) for i in range(n)}
    e = {(rng.randrange(n), rng.randrange(n)): sorted(rng.sample(range(1, labels + 1), rng.randint(0, labels))) for _ in range(m)}
    return v, e


def graph_of(spark, v, e):
    return PropertyGraph.of(spark.createDataFrame(list(v.items()), VERTEX_SCHEMA), spark.createDataFrame([(*k, x) for k, x in e.items()], EDGE_SCHEMA))


def brute(v, e, p):
    total = 0
    for h in itertools.product(v, repeat=len(p.vertices)):
        ok = all((x.label is None or x.label in v[h[i]]) and (x.ids is None or h[i] in x.ids) for i, x in enumerate(p.vertices))
        total += ok and all((h[x.src], h[x.dst]) in e and (x.label is None or x.label in e[h[x.src], h[x.dst]]) for x in p.edges)
    return total


PATTERNS = [
    Pattern.of(3, [(0, 1, 1), (2, 1)], {0: 1}),
    Pattern.of(3, [(0, 1), (1, 2), (2, 0)]),
    Pattern.of(3, [(0, 1), (1, 2), (0, 2, 2)], {2: 2}, {0: [1, 2, 3]}),
    Pattern.of(4, [(0, 1), (1, 2), (3, 2), (0, 3)]),
    Pattern.of(3, [(0, 0), (0, 1), (1, 0)]),
    Pattern.of(3, [(0, 1)], {2: 1}),
    Pattern.of(2, [(0, 1)], ids={0: []}),
]


@pytest.mark.parametrize("name", list(range(17)))
def test_golden_counts(spark, name):
    graph, pattern, expected = list(fixtures.golden(spark).values())[name]
    assert exact.exact_count(graph, pattern) == expected
    assert exact.exact_count(graph, pattern, partial_sums=False) == expected


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_brute_force(spark, seed):
    v, e = random_data(seed)
    g = graph_of(spark, v, e)
    for p in PATTERNS:
        assert exact.exact_count(g, p) == brute(v, e, p)
        assert exact.exact_count(g, p, partial_sums=False) == brute(v, e, p)


def test_grouped_counts_add_up_and_wide_weights(spark):
    v, e = random_data(7)
    g = graph_of(spark, v, e)
    p = PATTERNS[3]
    rows = exact.grouped_counts(g, p, (1, 3)).collect()
    assert sum(r["weight"] for r in rows) == brute(v, e, p)
    assert exact.exact_count(g, p, weight_type="decimal(38,0)") == brute(v, e, p)


def test_timeouts_give_minus_one(spark):
    g = random_graph(spark, 4000)
    slow = Pattern.of(2, [(0, 1)])

    assert exact.exact_count(g, slow, timeout=60) > 0
    assert exact.within(spark, 0.05, lambda: spark.range(10**10).selectExpr("sum(hash(id))").first()[0], -1) == -1


@pytest.mark.parametrize("seed", range(2))
def test_bounds_hold_for_any_partition(spark, seed):
    v, e = random_data(seed, n=12, m=30)
    g = graph_of(spark, v, e)
    for stages in ((("hash", 3),), (("degree", 3), ("node_labels", 2))):
        s = summarize(g, SummaryParams(stages, "corr", 3))
        for p in PATTERNS[:4]:
            low, mid, high = (estimate(s, p, k) for k in ("min", "avg", "max"))
            assert low <= brute(v, e, p) <= high + 1e-9
            if not p.vertices[0].ids:
                assert low <= mid + 1e-9
            assert estimate(s, p, "avg", partial_sums=False) == pytest.approx(mid)


def test_one_cell_for_each_vertex_is_exact_without_cycles(spark):
    v, e = random_data(5)
    g = graph_of(spark, v, e)
    own = g.vertices.select("id", (F.col("id") + 1).cast("int").alias("cell"))
    s = summarize(g, SummaryParams(kind="corr", max_cycle=0), own)
    for p in (PATTERNS[0], Pattern.of(4, [(0, 1), (1, 2), (1, 3)], {3: 1}), Pattern.of(2, [(0, 1)], ids={1: [2, 3]})):
        for kind in ("min", "avg", "max", "corr"):
            assert estimate(s, p, kind) == pytest.approx(brute(v, e, p))
    triangle = Pattern.of(3, [(0, 1), (1, 2), (2, 0)])
    assert estimate(s, triangle, "avg", stored_cycles=False) == pytest.approx(brute(v, e, triangle))


def test_guards_give_the_default(spark):
    v, e = random_data(5)
    s = summarize(graph_of(spark, v, e), SummaryParams((("hash", 4),), "avg", 0))
    assert estimate(s, PATTERNS[1], "avg", guard=True, most_partials=1) == 0
    assert estimate(s, PATTERNS[1], "max", guard=True, most_partials=1) == float("inf")


@pytest.mark.parametrize("strategy", sampling.STRATEGIES)
def test_samples_keep_the_whole_weight(spark, strategy):
    rows = spark.range(200).selectExpr("cast(id AS int) AS c0", "cast(id % 7 AS double) AS weight")
    sampled = sampling.sample_paths(rows, 40, strategy, seed=2)
    total = sampled.agg(F.sum("weight"), F.count("*"), F.min("weight")).first()
    assert total[1] == 40 and total[2] > 0
    whole = sum(i % 7 for i in range(200))
    assert total[0] == pytest.approx(whole, rel=1e-9 if strategy != "uniform" else 0.25)
    assert sampling.sample_paths(rows, None, strategy).count() == sampling.sample_paths(rows, -1, strategy).count() == 200
    again = sampling.sample_paths(rows, 40, strategy, seed=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sampled.collect()))


def test_sampled_counts_are_near(spark, sf_dir):
    g = fixtures.graph(spark, sf_dir)
    p = Pattern.of(4, [(1, 0, 20), (1, 2, 20), (3, 2, 20)])
    true = exact.exact_count(g, p)
    assert sampling.sampled_count(g, p, 3000, seed=1).first()[0] == pytest.approx(true, rel=0.2)
    assert sampling.random_walk(g, p, seed=1).first()[0] == pytest.approx(true, rel=0.2)


def test_partitions_keep_their_promises(spark, sf_dir):
    g = fixtures.graph(spark, sf_dir)
    n = g.vertices.count()
    before = None
    for k in (1, 4, 12):
        cells = partition.cell_graph(g, [("quasi_stable", k)])
        rows = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}
        assert sum(rows.values()) == n and sorted(rows) == list(range(1, len(rows) + 1)) and len(rows) <= k
        from graphlift.operators.stats import degree_ranges

        widest = degree_ranges(g, cells).agg(F.max("spread")).first()[0]
        assert before is None or widest <= before
        before = widest
    for stages in ([("hash", 5), ("degree", 4), ("neighbour_labels", 2), ("node_labels", 3)], [("node_labels", 50)]):
        cells = partition.cell_graph(g, stages)
        rows = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}
        assert sum(rows.values()) == n and sorted(rows) == list(range(1, len(rows) + 1)) and len(rows) <= sum(k for _, k in stages)


def test_empty_graphs(spark):
    g = PropertyGraph.empty(spark, 3)
    assert exact.exact_count(g, Pattern.of(2, [(0, 1)])) == 0
    assert exact.exact_count(g, Pattern.of(1, [])) == 3
    s = summarize(g, SummaryParams((("hash", 2),), "avg", 3))
    assert estimate(s, Pattern.of(2, [(0, 1)])) == 0


def test_plans_of_samples_grow_with_the_steps_alone(spark, sf_dir):
    """A path of twelve edges is sampled in some seconds, and its last plan is no longer than that of four edges."""
    import time

    g = fixtures.graph(spark, sf_dir, "activity")
    lines = []
    for n in (4, 12):
        begun = time.time()
        found = sampling.sampled_count(g, Pattern.of(n + 1, [(i, i + 1, 50) for i in range(n)]), 50, seed=1)
        lines.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert found.first()[0] > 0 and time.time() - begun < 60
    assert lines[1] <= lines[0] + 5


def test_walks_within_a_bound_keep_their_sums(spark, sf_dir):
    from graphlift.operators import cycles

    g = fixtures.graph(spark, sf_dir, "activity")
    total = lambda df: {r["k"]: r["w"] for r in df.groupBy(F.length("path").alias("k")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()}
    whole, bounded = total(cycles.walk_counts(g, 3)), total(cycles.walk_counts(g, 3, most_walks=2000))
    assert all(bounded[k] == pytest.approx(whole[k], rel=0.25) for k in whole)
    assert cycles.walk_counts(g, 3, most_walks=2000).where("length(path) = 3").count() < 2600
