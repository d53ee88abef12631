import time
from collections import Counter

from graphlift import fixtures
from graphlift.model import Pattern
from graphlift.operators import exact


def test_pairs_that_come_once_pass_no_exchange(spark):
    """200 vertices have one middle: their 40,000 pairs are not summed again, so no exchange holds them."""
    g = fixtures.small(spark, 201, [(v, 201) for v in range(1, 201)])
    frame = exact.grouped_counts(g, Pattern.of(3, [(0, 1), (2, 1)]), (0, 2))
    pairs = 200 * 200
    written = lambda plan: [int(n.metrics().apply("shuffleRecordsWritten").value()) for n in nodes(plan) if n.metrics().contains("shuffleRecordsWritten")]

    def nodes(plan):
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan, *(x for p in inner for x in nodes(p))]

    assert len(frame.collect()) == pairs
    rows = written(frame._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < pairs


def test_pairs_over_several_middles_are_summed(spark):
    """Ends with one middle and with several on either side, against plain sums."""
    left = [(1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (4, 13)]
    right = [(21, 11), (21, 12), (22, 12), (23, 12), (23, 13), (24, 11)]
    g = fixtures.small(spark, 30, left + right)
    p = Pattern.of(3, [(0, 1), (2, 1)])
    everything = Counter((a, c) for a, m in left + right for c, n in left + right if m == n)
    found = {(r.q0, r.q2): r.weight for r in exact.grouped_counts(g, p, (0, 2)).collect()}
    assert found == everything and max(found.values()) > 1
    assert exact.grouped_counts(g, p, (0, 2)).count() == len(everything)


def test_a_job_that_begins_late_is_stopped_too(spark):
    def job():
        time.sleep(1)  # planning may take longer than the time allowed
        return spark.range(10**11).selectExpr("sum(id % 7)").first()[0]

    begun = time.time()
    assert exact.within(spark, 1e-3, job, "late") == "late"
    assert time.time() - begun < 15
