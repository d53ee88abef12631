"""Registered queries of sources, sinks, plans, samples and guards, with the SQL that checks them. Text inputs are made of the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog, fixtures
from .catalog import ACTIVITY, COMMERCE, _EDGE_DEG, _hashed, _label, _log, _query, _rounded, _sql
from .model import Pattern, PropertyGraph, random_graph
from .operators import estimate, exact, harness, metrics, sampling, stats, summary, update
from .operators.store import new_path
from .plans.order import min_width_order, path_signs, shortest_sign, spanning_tree
from .sources import results, text
from .streaming.update import SummaryStream


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(df: DataFrame) -> DataFrame:
    """Label sets as text."""
    return df.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), " "))


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


# --- text graphs -------------------------------------------------------------------------------


def _lines(spark, sf_dir: str, *kinds: F.Column) -> str:
    """A folder of text lines, one of each kind for each customer, between lines that mean nothing."""
    path = new_path(spark)
    rows = _table(spark, sf_dir, "customer").select(F.explode(F.array(*kinds)).alias("value"))
    noise = spark.createDataFrame([("t # 1",), ("",), ("# v 1 2",)], "value string")
    rows.unionByName(noise).write.text(path)
    return path


def _gcare(spark, sf_dir: str) -> PropertyGraph:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    v = F.concat_ws(" ", F.lit("v"), key, nation, key % 7 + 100, F.lit(-1))
    e = F.concat_ws("  ", F.lit("e"), key, nation + 1_000_000_000, key % 3)
    again = F.concat_ws(" ", F.lit("e"), key, nation + 1_000_000_000, key % 2 + 50)
    return text.read_graph(spark, _lines(spark, sf_dir, v, e, again))


@_query("source_graph_text_vertices", "SELECT id, string_agg(label::VARCHAR, ' ' ORDER BY label) AS labels FROM (SELECT c_custkey::BIGINT AS id, c_nationkey::INT AS label FROM customer UNION SELECT c_custkey, c_custkey % 7 + 100 FROM customer) t GROUP BY id UNION ALL SELECT DISTINCT c_nationkey::BIGINT + 1000000000, '' FROM customer")
def source_vertices(spark, sf_dir):
    return _shown(_gcare(spark, sf_dir).vertices)


@_query("source_graph_text_edges", "SELECT c_custkey::BIGINT AS src, c_nationkey::BIGINT + 1000000000 AS dst, (c_custkey % 3)::VARCHAR || ' ' || (c_custkey % 2 + 50)::VARCHAR AS labels FROM customer")
def source_edges(spark, sf_dir):
    return _shown(_gcare(spark, sf_dir).edges)


def _matching(spark, sf_dir: str) -> str:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return _lines(spark, sf_dir, F.concat_ws(" ", F.lit("v"), key, key % 5, F.lit(1)), F.concat_ws(" ", F.lit("e"), key, nation + 1_000_000_000))


_BOTH = "SELECT c_custkey::BIGINT AS src, c_nationkey::BIGINT + 1000000000 AS dst FROM customer UNION SELECT c_nationkey + 1000000000, c_custkey FROM customer"


@_query("source_matching_vertices", "SELECT c_custkey::BIGINT AS id, (c_custkey % 5)::VARCHAR AS labels FROM customer UNION ALL SELECT DISTINCT c_nationkey::BIGINT + 1000000000, '' FROM customer")
def source_matching_vertices(spark, sf_dir):
    return _shown(text.read_graph(spark, _matching(spark, sf_dir), text.MATCHING).vertices)


@_query("source_matching_edges", f"SELECT src, dst, '0' AS labels FROM ({_BOTH}) t")
def source_matching_edges(spark, sf_dir):
    return _shown(text.read_graph(spark, _matching(spark, sf_dir), text.MATCHING).edges)


@_query("sink_graph_text", _sql("SELECT 'v ' || id || ' ' || string_agg(label::VARCHAR, ' ' ORDER BY label) AS value FROM v GROUP BY id UNION ALL SELECT 'e ' || src || ' ' || dst || ' ' || label FROM e", ACTIVITY))
def sink_graph_text(spark, sf_dir):
    path = new_path(spark)
    text.write_graph(fixtures.graph(spark, sf_dir, "activity"), path)
    return spark.read.text(path)


@_query("sink_converted_text", f"SELECT 'v ' || c_custkey || ' ' || c_custkey % 5 AS value FROM customer UNION ALL SELECT DISTINCT 'v ' || (c_nationkey + 1000000000) FROM customer UNION ALL SELECT 'e ' || src || ' ' || dst || ' 0' FROM ({_BOTH}) t")
def sink_converted(spark, sf_dir):
    path = new_path(spark)
    text.convert_graph(spark, _matching(spark, sf_dir), path)
    return spark.read.text(path)


@_query("source_datasets", "SELECT 'aids' AS name, n_nationkey::BIGINT AS src, n_regionkey::BIGINT + 100 AS dst, n_nationkey % 4 AS label FROM nation UNION ALL SELECT 'yeast', n_nationkey, n_regionkey + 100, 0 FROM nation UNION ALL SELECT 'yeast', n_regionkey + 100, n_nationkey, 0 FROM nation")
def source_datasets(spark, sf_dir):
    """Two named datasets; the files are small, as there are 25 nations."""
    folder, rows = new_path(spark), _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    text.write_text(spark, f"{folder}/aids.txt", "".join(f"e {r['n_nationkey']} {r['n_regionkey'] + 100} {r['n_nationkey'] % 4}\n" for r in rows))
    text.write_text(spark, f"{folder}/yeast.graph", "".join(f"e {r['n_nationkey']} {r['n_regionkey'] + 100}\n" for r in rows))
    parts = [text.read_dataset(spark, n, folder).edges.select(F.lit(n).alias("name"), "src", "dst", F.explode("labels").alias("label")) for n in ("aids", "yeast")]
    return parts[0].unionByName(parts[1])


FAMILIES = ("chain", "star", "tree", "cycle", "flower")


def _query_files(spark, sf_dir: str) -> tuple[str, str]:
    """A query file for each nation in a folder of its region's family, and counts for those of even number."""
    queries, truths = new_path(spark), new_path(spark)
    for r in _table(spark, sf_dir, "nation").collect():
        n, k = r["n_nationkey"], r["n_regionkey"]
        any_label = -1 if n % 3 == 0 else n
        text.write_text(spark, f"{queries}/{FAMILIES[k]}/q_{n}.txt", f"t # {n}\nv 5 {k} -1\nv 9 {any_label} {2_000_000_000 + n}\ne 5 9 {n % 2 - 1}\n")
        if n % 2 == 0:
            text.write_text(spark, f"{truths}/q_{n}.txt", f"counted 3\n{n * 100 + 7} 0.25\n\n")
    return queries, truths


_QUERY_SET = "SELECT 'q_' || n_nationkey AS name, ['Chain', 'Star', 'Tree', 'Cycle', 'Flower'][n_regionkey + 1] AS type, n_regionkey::INT AS first_label, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END::INT AS second_label, 2000000000 + n_nationkey::BIGINT AS data_id, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 0 END::INT AS edge_label, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100 + 7 END::BIGINT AS truth FROM nation"


def _query_set(spark, sf_dir: str, required: bool) -> DataFrame:
    rows = []
    for q in text.read_query_set(spark, *_query_files(spark, sf_dir), required=required):
        p = q["pattern"]
        ((edge),) = p.edges
        rows.append((q["name"], q["type"], p.vertices[edge.src].label, p.vertices[edge.dst].label, min(p.ids_of(edge.dst)), edge.label, q["truth"]))
    return spark.createDataFrame(rows, "name string, type string, first_label int, second_label int, data_id bigint, edge_label int, truth bigint")


_query("source_query_set", _QUERY_SET)(lambda spark, sf_dir: _query_set(spark, sf_dir, False))
_query("source_query_set_required", f"SELECT * FROM ({_QUERY_SET}) t WHERE truth IS NOT NULL")(lambda spark, sf_dir: _query_set(spark, sf_dir, True))


@_query("source_true_counts", "SELECT 'q_' || n_nationkey AS name, (n_nationkey * 100 + 7)::BIGINT AS truth FROM nation WHERE n_nationkey % 2 = 0")
def source_true_counts(spark, sf_dir):
    _, truths = _query_files(spark, sf_dir)
    return spark.createDataFrame([(f"q_{n}", text.read_true_count(spark, f"{truths}/q_{n}.txt")) for n in range(0, 25, 2)], "name string, truth bigint")


# --- result files ------------------------------------------------------------------------------


@_query("source_csv_normalised", "SELECT o_orderkey::BIGINT AS order_key, o_totalprice AS total_price, o_orderstatus AS status FROM orders")
def source_csv(spark, sf_dir):
    path = new_path(spark)
    results.write_csv(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total-Price"), F.col("o_orderstatus").alias("Status ")), path)
    return results.normalised(results.read_csv(spark, path, "`Order Key` bigint, `Total-Price` double, `Status ` string"))


def _competitors(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    query = F.concat(F.lit("/queries/"), F.element_at(F.array(*map(F.lit, FAMILIES)), (key % 5 + 1).cast("int")), F.lit("_"), key, F.lit(".txt"))
    return _table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), key % 3).alias("Estimator"), F.col("o_orderstatus").alias("Dataset"), query.alias("Query"), F.col("o_totalprice").alias("Value"), (key % 100 / 8.0).alias("Runtime"))


_COMPETITORS = "SELECT 'm' || o_orderkey % 3 AS \"Estimator\", o_orderstatus AS \"Dataset\", '/queries/' || ['chain', 'star', 'tree', 'cycle', 'flower'][o_orderkey % 5 + 1] || '_' || o_orderkey || '.txt' AS \"Query\", o_totalprice AS \"Value\", (o_orderkey % 100) / 8.0::DOUBLE AS \"Runtime\" FROM orders"


@_query("source_competitors", f"SELECT *, upper(regexp_extract(\"Query\", '/([a-z])[a-z]*_', 1)) || regexp_extract(\"Query\", '/[a-z]([a-z]*)_', 1) AS \"QueryType\" FROM ({_COMPETITORS}) t")
def source_competitors(spark, sf_dir):
    path = new_path(spark)
    _competitors(spark, sf_dir).write.parquet(path)
    return results.read_competitors(spark, path)


@_query("source_competitor_logs", "SELECT ['sketch', 'walk'][n_regionkey % 2 + 1] AS \"Estimator\", ['east', 'west'][n_regionkey // 2 % 2 + 1] AS \"Dataset\", '/q/nation_' || n_nationkey || '.txt' AS \"Query\", CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_nationkey * 1.5 END::DOUBLE AS \"Value\", n_nationkey / 4.0::DOUBLE AS \"Runtime\" FROM nation WHERE n_regionkey < 4")
def source_logs(spark, sf_dir):
    folder = new_path(spark)
    rows = _table(spark, sf_dir, "nation").where("n_regionkey < 4").orderBy("n_nationkey").collect()
    for k in range(4):
        own = [r["n_nationkey"] for r in rows if r["n_regionkey"] == k]
        text.write_text(spark, f"{folder}/{('sketch', 'walk')[k % 2]}_{('east', 'west')[k // 2 % 2]}", "\n".join(f"/q/nation_{n}.txt\n{'timeout' if n % 6 == 0 else n * 1.5}  {n / 4.0}\n" for n in own))
    return results.parse_logs(spark, folder)


@_query("result_append", f"SELECT * FROM ({_COMPETITORS}) t WHERE \"Estimator\" <> 'm2' UNION ALL SELECT 'new', \"Dataset\", \"Query\", \"Value\" * 2, CASE WHEN \"Runtime\" < 6 THEN \"Runtime\" END FROM ({_COMPETITORS}) t WHERE \"Estimator\" = 'm2' AND \"Runtime\" > 1")
def result_append(spark, sf_dir):
    every = _competitors(spark, sf_dir)
    old, more = every.where("Estimator <> 'm2'"), every.where("Estimator = 'm2'")
    raw = more.select("Dataset", "Query", F.when(F.col("Runtime") > 1, (F.col("Value") * 2).cast("string")).otherwise("failed").alias("Value"))
    return results.append_runtimes(old, raw, more.where("Runtime < 6"), "new")


@_query("result_combine", f"SELECT \"Estimator\", \"Dataset\", \"Query\", CASE WHEN \"Estimator\" = 'm1' THEN -\"Value\" ELSE \"Value\" END AS \"Value\", \"Runtime\" FROM ({_COMPETITORS}) t WHERE \"Estimator\" IN ('m0', 'm1')")
def result_combine(spark, sf_dir):
    every = _competitors(spark, sf_dir)
    return results.combine(every, every.where("Estimator = 'm1'").withColumn("Value", -F.col("Value")), ["m1", "m2"])


@_query("sink_true_counts", "SELECT 'q' || o_orderkey AS query, (o_orderkey % 9 - 1)::BIGINT AS truth FROM orders WHERE o_orderkey % 9 > 1")
def sink_true_counts(spark, sf_dir):
    path = new_path(spark)
    results.write_true_counts(_table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("query"), (F.col("o_orderkey") % 9 - 1).alias("truth")), path)
    return results.read_csv(spark, path, "query string, truth bigint")


@_query("sink_degree_ranges", _sql("SELECT cell, (max(deg) - min(deg))::BIGINT AS spread FROM deg JOIN cells USING (id) GROUP BY 1", ACTIVITY, _hashed(8)))
def sink_degree_ranges(spark, sf_dir):
    path = new_path(spark)
    results.write_degree_ranges(stats.degree_ranges(*catalog._celled(spark, sf_dir, 8, "activity")), path)
    return results.read_csv(spark, path, "cell int, spread bigint")


@_query("truth_check", "SELECT o_orderkey::BIGINT AS query, CASE WHEN o_orderkey % 4 <> 1 THEN o_custkey END::BIGINT AS stored, CASE WHEN o_orderkey % 4 <> 2 THEN o_custkey + (o_orderkey % 4 = 3)::INT END::BIGINT AS recounted, o_orderkey % 4 = 0 AS same FROM orders")
def truth_check(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_custkey").alias("truth"))
    again = o.where("query % 4 <> 2").withColumn("truth", F.col("truth") + (F.col("query") % 4 == 3).cast("int"))
    return metrics.verified(o.where("query % 4 <> 1"), again)


@_query("sink_summary", _sql("SELECT edge_label, vlabel, c1, c2, round(avg_in, 6) + 0.0 AS avg_in, round(max_out, 6) + 0.0 AS max_out FROM edge_deg", ACTIVITY, _hashed(4), *_EDGE_DEG))
def sink_summary(spark, sf_dir):
    path = new_path(spark)
    catalog._summary(spark, sf_dir, "activity").save(path)
    return _rounded(summary.CellSummary.load(spark, path).edge_deg.select("edge_label", "vlabel", "c1", "c2", "avg_in", "max_out"))


_MEMBERS = "SELECT count(*) * 12 AS b FROM cells"


@_query(
    "sink_build_report",
    _sql(
        "SELECT 'activity' AS \"Dataset\", 'H4' AS \"Partitioner\", 4::BIGINT AS \"NumColors\", phase AS \"BuildPhase\", (SELECT b FROM size)::DOUBLE AS \"MemoryFootprint\" FROM (VALUES ('partition'), ('cycles'), ('cardinalities'), ('edge_stats'), ('totals')) t(phase)",
        ACTIVITY, _hashed(4), *_EDGE_DEG,
        # values of 4 bytes for labels and cells, of 8 for ids, counts and each of the ten degree statistics
        f"size AS (SELECT (SELECT count(*) * 16 FROM card) + (SELECT count(*) * 96 FROM edge_deg) + ({_MEMBERS}) AS b)",
    ),
)
def sink_build_report(spark, sf_dir):
    path, params = new_path(spark), summary.SummaryParams((("hash", 4),), "corr", 0)
    built = summary.summarize(fixtures.graph(spark, sf_dir, "activity"), params)
    results.write_csv(harness.reports(spark, [summary.build_report(built, "activity", params)]), path)
    return results.read_csv(spark, path, results.BUILDS).where("BuildTime >= 0").drop("BuildTime")


_ID_SQL = "coalesce(sum(s.cnt * a.avg_out * least(1, f.found::DOUBLE / t.cnt)), 0)"
_ID_FROM = "FROM card s JOIN edge_deg a ON a.c1 = s.cell AND a.edge_label = 10 AND a.vlabel = 3 JOIN card t ON t.cell = a.c2 AND t.label = 3 JOIN (SELECT cell, count(*) AS found FROM cells WHERE id IN (3000000005, 3000000006) GROUP BY 1) f ON f.cell = a.c2 WHERE s.label = 6"
_PATH_SQL = "coalesce(sum(s.cnt * a.avg_out * b.avg_in), 0)"


@_query(
    "sink_estimates",
    _sql(
        f"SELECT 'path' AS \"QueryPath\", 'Chain' AS \"QueryType\", 12.0::DOUBLE AS \"TrueCard\", 2.0::DOUBLE AS \"QuerySize\", false AS \"Failure\", 1::BIGINT AS \"PathWidth\", {_log(_PATH_SQL)} {catalog._PATH_FROM} UNION ALL SELECT 'ids', 'Star', NULL, 1.0, false, 1, {_log(f'greatest(1, {_ID_SQL})')} {_ID_FROM}",
        COMMERCE, _hashed(4), *_EDGE_DEG,
    ),
)
def sink_estimates(spark, sf_dir):
    queries = [{"name": "path", "type": "Chain", "pattern": catalog._PATH, "truth": 12}, {"name": "ids", "type": "Star", "pattern": catalog._ID_PATH, "truth": None}]
    setting = harness.Experiment("commerce", summary.SummaryParams((("hash", 4),), "avg", 0), cap=None, replications=1, timeout=None)
    path = new_path(spark)
    results.write_csv(harness.estimates(spark, catalog._summary(spark, sf_dir, "commerce", 4, 0), queries, setting), path)
    found = results.read_csv(spark, path, results.ESTIMATES).where("EstimationTime >= 0")
    return found.select("QueryPath", "QueryType", "TrueCard", "QuerySize", "Failure", "PathWidth", F.round(F.log10(F.col("Estimate") + 1), 6).alias("log_estimate"))


# --- metrics -----------------------------------------------------------------------------------

_OTHERS = "SELECT o_orderstatus AS dataset, o_orderkey AS query, o_totalprice / 2 AS value, (o_orderkey % 13)::DOUBLE AS runtime FROM orders WHERE o_orderkey % 3 <> 0"


def _others(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("query"), (F.col("o_totalprice") / 2).alias("value"), (F.col("o_orderkey") % 13).cast("double").alias("runtime"))


@_query("metric_median_seconds", "SELECT o_orderstatus AS dataset, (o_orderkey % 10)::BIGINT AS query, median(o_totalprice) AS seconds FROM orders GROUP BY 1, 2")
def metric_median_seconds(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dataset"), (F.col("o_orderkey") % 10).alias("query"), F.col("o_totalprice").alias("seconds"))
    return metrics.median_seconds(o, ["dataset", "query"])


@_query("metric_with_competitors", f"WITH {catalog._JUDGED}, x AS ({_OTHERS}) SELECT j.query::BIGINT AS query, coalesce(x.value, 1) AS other_value, x.runtime AS other_seconds, x.value IS NULL AS other_missing FROM judged j LEFT JOIN x USING (dataset, query)")
def metric_with_competitors(spark, sf_dir):
    return metrics.with_competitors(catalog._judged(spark, sf_dir), _others(spark, sf_dir)).select("query", "other_value", "other_seconds", "other_missing")


@_query("metric_missing_from", "SELECT o_orderkey::BIGINT AS query FROM orders WHERE o_orderkey % 3 = 0")
def metric_missing_from(spark, sf_dir):
    return metrics.missing_from(catalog._judged(spark, sf_dir), _others(spark, sf_dir)).select("query")


@_query("summary_footprint", _sql("SELECT 'cell_card' AS name, (SELECT count(*) * 16 FROM card)::BIGINT AS bytes UNION ALL SELECT 'edge_deg', (SELECT count(*) * 96 FROM edge_deg) UNION ALL SELECT 'cell_member', (SELECT count(*) * 12 FROM cells) UNION ALL SELECT 'cycle_prob', (SELECT coalesce(sum(16 + length(path)), 0)::BIGINT FROM cycle_prob) UNION ALL SELECT 'cycle_len_prob', (SELECT count(*) * 12 FROM cycle_len_prob)", ACTIVITY, _hashed(4), *_EDGE_DEG, *catalog._WALKS))
def summary_footprint(spark, sf_dir):
    return spark.createDataFrame(list(catalog._summary(spark, sf_dir, "activity").footprint_bytes().items()), "name string, bytes bigint")


# --- graphs ------------------------------------------------------------------------------------


@_query("graph_empty", "SELECT n_nationkey::BIGINT AS id, '' AS labels, 0::BIGINT AS n_edges FROM nation")
def graph_empty(spark, sf_dir):
    g = PropertyGraph.empty(spark, _table(spark, sf_dir, "nation").count())
    return _shown(g.vertices).withColumn("n_edges", F.lit(g.edges.count()).cast("bigint"))


@_query("graph_vertices_added", _sql("SELECT id, string_agg(label::VARCHAR, ' ' ORDER BY label) AS labels FROM (SELECT id, label FROM v UNION SELECT id + 500, 9 FROM v WHERE label = 7 UNION SELECT id, 6 FROM v WHERE label = 7) t GROUP BY id", ACTIVITY))
def graph_vertices_added(spark, sf_dir):
    g = fixtures.graph(spark, sf_dir, "activity")
    users = g.vertices.where(F.array_contains("labels", 7))
    more = users.select((F.col("id") + 500).alias("id"), F.array(F.lit(9), F.lit(-1)).alias("labels")).unionByName(users.select("id", F.array(F.lit(6)).alias("labels")))
    return _shown(g.add_vertices(more).vertices)


def _draw(*columns: str, seed: int = 0) -> str:
    """model.drawn() in SQL."""
    h = str(seed)
    for c in columns:
        a = f"((({h}) * 31 + ({c}) % 2147483629) % 2147483647)"
        b = f"(({a} * 48271 + 12345) % 2147483647)"
        h = f"(({b} * {b} + {a}) % 2147483647)"
    return f"({h})"


def _random(salt: int, limit: int) -> str:
    return f"({_draw('id', str(salt), seed=7)} % {limit})"


_RANDOM = f"WITH r AS (SELECT range::BIGINT AS id FROM range(2000)), ed AS (SELECT {_random(1, 2000)} AS src, {_random(2, 2000)} AS dst, {_random(3, 50)} AS label FROM r)"


@_query("graph_random_edges", f"{_RANDOM} SELECT src::BIGINT AS src, dst::BIGINT AS dst, string_agg(DISTINCT label::VARCHAR, ' ' ORDER BY label::VARCHAR) AS labels FROM ed GROUP BY 1, 2")
def graph_random_edges(spark, sf_dir):
    g = random_graph(spark, 4000, seed=7)
    return g.edges.select("src", "dst", F.array_join(F.array_sort(F.col("labels").cast("array<string>")), " ").alias("labels"))


@_query("graph_random_vertices", f"{_RANDOM} SELECT id, string_agg(DISTINCT label::VARCHAR, ' ' ORDER BY label::VARCHAR) AS labels FROM (SELECT id, {_draw('id', 'i + 10', seed=7)} % 50 AS label FROM (SELECT id, unnest(range(1, 2 + {_random(0, 5)})) AS i FROM r) t) u GROUP BY id")
def graph_random_vertices(spark, sf_dir):
    g = random_graph(spark, 4000, seed=7)
    return g.vertices.select("id", F.array_join(F.array_sort(F.col("labels").cast("array<string>")), " ").alias("labels"))


@_query("update_hold_out", _sql(f"SELECT {_draw('src', 'dst', seed=5)} < 0.25 * 2147483647 AS held_out, src, dst FROM p", ACTIVITY))
def update_hold_out(spark, sf_dir):
    kept, rest = update.hold_out(fixtures.graph(spark, sf_dir, "activity"), 0.25, 5)
    return kept.select(F.lit(False).alias("held_out"), "src", "dst").unionByName(rest.select(F.lit(True).alias("held_out"), "src", "dst"))


@_query("pattern_edge_labels", _values([(0, 1, 5), (1, 2, None), (2, 0, 8), (2, 3, 4)], "src, dst, label"))
def pattern_edge_labels(spark, sf_dir):
    p = Pattern.of(3, [(0, 1, 4), (1, 2, 3), (2, 0)]).set_edge_label(0, 1, [5]).set_edge_label(1, 2, None).add_edge(2, 0, 8)
    p = p.add_vertex(2, [4, 5]).add_edge(2, 3, 4)
    return spark.createDataFrame([(e.src, e.dst, e.label) for e in p.edges], "src int, dst int, label int")


# --- plans -------------------------------------------------------------------------------------

_CLIQUE4 = Pattern.of(4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])

#: Orders worked out by hand: of those of the least width the one of the lowest numbers (the tree is the path 3 2 1 0 4 5, where 2 may come before 3).
_ORDERS = [("exact_star3", "0 1 2 3"), ("exact_tree", "2 3 1 0 4 5"), ("exact_cycle4", "0 1 2 3"), ("exact_triangle", "0 1 2"), ("exact_path3_backward", "0 1 2 3")]


@_query("plan_orders", _values(_ORDERS, "pattern, vertices"))
def plan_orders(spark, sf_dir):
    return spark.createDataFrame([(n, " ".join(map(str, min_width_order(catalog._EXACT[n][0])))) for n, _ in _ORDERS], "pattern string, vertices string")


@_query("plan_spanning_trees", _values([("cycle4", 0, 1), ("cycle4", 0, 3), ("cycle4", 1, 2), ("tree", 0, 1), ("tree", 0, 4), ("tree", 1, 2), ("tree", 4, 5), ("tree", 2, 3)], "pattern, parent, child"))
def plan_spanning_trees(spark, sf_dir):
    rows = [(n, a, b) for n in ("cycle4", "tree") for a, b in spanning_tree(catalog._EXACT[f"exact_{n}"][0])]
    return spark.createDataFrame(rows, "pattern string, parent int, child int")


#: From 0 to 2: over 1 (FF), over 3 and 4 (FBF), over 3, 4 and 5 (FBFB); at most 3 edges, so the last one is left out.
_TWO_WAYS = [(0, 1), (1, 2), (0, 3), (4, 3), (4, 2), (4, 5), (2, 5)]


@_query("plan_paths", _values([("all", "FBF"), ("all", "FF"), ("shortest", "FF"), ("long", "FBF"), ("long", "FBFB"), ("long", "FF")], "kind, signs"))
def plan_paths(spark, sf_dir):
    rows = [("all", s) for s in path_signs(_TWO_WAYS, 0, 2, 3)] + [("shortest", s) for s in shortest_sign(_TWO_WAYS, 0, 2, 3)] + [("long", s) for s in path_signs(_TWO_WAYS, 0, 2, 4)]
    return spark.createDataFrame(rows, "kind string, signs string")


# --- samples -----------------------------------------------------------------------------------

_MATCHES = f"m AS (SELECT o_orderkey AS q0, o_custkey AS q1, (o_orderkey % 8)::DOUBLE AS weight, ({_draw('o_orderkey', 'o_custkey', seed=3)} + 1) / 2147483648.0::DOUBLE AS u FROM orders), live AS (SELECT * FROM m WHERE weight > 0)"


def _sample_query(strategy: str, order: str, by: str) -> None:
    sql = f"WITH {_MATCHES}, kept AS (SELECT * FROM live ORDER BY {order}, q0, q1 LIMIT 100) SELECT q0::BIGINT AS q0, q1::BIGINT AS q1, round({by}, 6) AS weight FROM kept"

    @_query(f"sample_{strategy}", sql)
    def sample(spark, sf_dir):
        rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q0"), F.col("o_custkey").alias("q1"), (F.col("o_orderkey") % 8).cast("double").alias("weight"))
        return _rounded(sampling.sample_paths(rows, 100, strategy, seed=3))


_sample_query("uniform", "u", "weight * (SELECT count(*) FROM live) / 100")
_sample_query("weighted", "-ln(u) / weight", "(SELECT sum(weight) FROM live) / 100")
_sample_query("redistributive", "-ln(u) / weight", "weight * (SELECT sum(weight) FROM live) / (SELECT sum(weight) FROM kept)")


@_query("sample_matches", f"WITH {_MATCHES}, kept AS (SELECT * FROM live ORDER BY u, q0, q1 LIMIT 90) SELECT q0::BIGINT AS q0, q1::BIGINT AS q1, ceil(weight * (SELECT count(*) FROM live) / 90)::BIGINT AS weight FROM kept")
def sample_matches(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q0"), F.col("o_custkey").alias("q1"), (F.col("o_orderkey") % 8).cast("bigint").alias("weight"))
    return sampling.sample_matches(rows, 90, seed=3)


def _capped(k: int, rows: str, names: tuple[str, str]) -> list[str]:
    """Step k of a sampled count: 2000 of the rows (names, weight), the weight of the rest shared out."""
    a, b = names
    return [
        f"r{k} AS MATERIALIZED ({rows})",
        f"s{k} AS (SELECT {a}, {b}, CASE WHEN n > 2000 THEN ceil(weight * (n / 2000.0::DOUBLE))::BIGINT ELSE weight END AS weight FROM (SELECT *, (SELECT count(*) FROM r{k}) AS n FROM r{k} ORDER BY {_draw(a, b, seed=1 + k)}, {a}, {b} LIMIT 2000) t)",
    ]


_SAMPLED = [
    *_capped(1, f"SELECT dst AS q0, src AS q1, 1::BIGINT AS weight FROM {_label(20, 'a')}", ("q0", "q1")),
    *_capped(2, f"SELECT s.q1, a.dst AS q2, s.weight FROM (SELECT q1, sum(weight)::BIGINT AS weight FROM s1 GROUP BY 1) s JOIN {_label(20, 'a')} ON a.src = s.q1", ("q1", "q2")),
    *_capped(3, f"SELECT s.q2, a.src AS q3, s.weight FROM (SELECT q2, sum(weight)::BIGINT AS weight FROM s2 GROUP BY 1) s JOIN {_label(20, 'a')} ON a.dst = s.q2", ("q2", "q3")),
]


@_query("exact_sampled", _sql("SELECT sum(weight)::BIGINT AS cnt FROM s3", COMMERCE, *_SAMPLED))
def exact_sampled(spark, sf_dir):
    return sampling.sampled_count(fixtures.graph(spark, sf_dir), catalog._EXACT["exact_path3_backward"][0], 2000, seed=1)


@_query("exact_uncapped_sample", catalog.ORACLES["exact_path3_backward"])
def exact_uncapped_sample(spark, sf_dir):
    """A cap above the number of partial matches leaves the exact count."""
    return sampling.sampled_count(fixtures.graph(spark, sf_dir), catalog._EXACT["exact_path3_backward"][0], 10**9, seed=1)


# --- estimates and guards ----------------------------------------------------------------------


@_query("estimate_guards", _values([("count, no time", "-1"), ("avg, no time", "0.0"), ("max, no time", "inf"), ("max, too many partials", "inf"), ("avg, too many partials", "0.0")], "guard, value"))
def estimate_guards(spark, sf_dir):
    """What comes of counts and estimates that run out of time or rows."""
    s, g = catalog._summary(spark, sf_dir, "activity"), fixtures.graph(spark, sf_dir)
    rows = [("count, no time", str(exact.exact_count(g, catalog._EXACT["exact_cycle4"][0], timeout=1e-3)))]
    for kind in ("avg", "max"):
        rows.append((f"{kind}, no time", str(estimate.estimate(s, catalog._TRIANGLE, kind, timeout=1e-3))))
        rows.append((f"{kind}, too many partials", str(estimate.estimate(s, catalog._TRIANGLE, kind, guard=True, most_partials=2))))
    return spark.createDataFrame(rows, "guard string, value string")


_BOUNDED = ("exact_path2", "exact_star3", "exact_tree", "exact_triangle", "exact_cycle4", "exact_id_filter", "exact_vertex_label")


@_query("estimate_bounds", _values([(n, True) for n in _BOUNDED], "pattern, holds"))
def estimate_bounds(spark, sf_dir):
    """min <= exact <= max for each pattern; cycles closed by the independent formula."""
    g, s = fixtures.graph(spark, sf_dir), catalog._summary(spark, sf_dir, "commerce", 4, 0)
    rows = []
    for n in _BOUNDED:
        p = catalog._EXACT[n][0]
        low, high = (estimate.estimate(s, p, k, stored_cycles=False) for k in ("min", "max"))
        rows.append((n, low - 1e-6 <= exact.exact_count(g, p) <= high + 1e-6))
    return spark.createDataFrame(rows, "pattern string, holds boolean")


@_query("update_stream_restarted", catalog.ORACLES["update_edges"])
def update_stream_restarted(spark, sf_dir):
    """New edges come as a stream; what is read is the state that another object finds after a restart."""
    folder, path = new_path(spark), new_path(spark)
    new = catalog._new_edges(spark, sf_dir)
    new.write.parquet(folder)  # all files come as one batch
    source = lambda: spark.readStream.schema(new.schema).parquet(folder)
    first = SummaryStream(catalog._summary(spark, sf_dir, "activity"), path)
    first.edges(source(), checkpointLocation=f"{path}-stream").awaitTermination()
    again = SummaryStream(catalog._summary(spark, sf_dir, "activity"), path)
    again.edges(source(), checkpointLocation=f"{path}-stream").awaitTermination()
    return _rounded(again.summary.edge_deg.where("avg_out > 0").select("edge_label", "vlabel", "c1", "c2", "avg_out"))


_CLOSED = """FROM card s JOIN grown a ON a.c1 = s.cell AND a.edge_label = 50 AND a.vlabel = 7 JOIN edge_deg_in b ON b.c1 = s.cell AND b.edge_label = 50 AND b.vlabel = 7
  JOIN grown k ON k.c1 = a.c2 AND k.c2 = b.c2 AND k.edge_label = 50 AND k.vlabel = 7 JOIN card t ON t.cell = b.c2 AND t.label = 7 WHERE s.label = 7 AND a.avg_out > 0 AND b.avg_in > 0 AND k.avg_out > 0"""
_GROWN_IN = [
    "mi AS (SELECT edge_label, c.label AS vlabel, ct AS c1, cs AS c2, m * c.cnt::DOUBLE / w.cnt AS more FROM fl JOIN card c ON c.cell = cs JOIN whole w ON w.cell = cs)",
    """edge_deg_in AS (SELECT edge_label, vlabel, c1, c2, CASE WHEN coalesce(more, 0) > 0 THEN least(coalesce(avg_in, 0) * n.cnt + more, n.cnt::DOUBLE * c.cnt) / n.cnt ELSE coalesce(avg_in, 0) END AS avg_in
  FROM edge_deg FULL JOIN mi USING (edge_label, vlabel, c1, c2) JOIN whole n ON n.cell = c1 JOIN card c ON c.cell = c2 AND c.label = vlabel)""",
]


@_query("estimate_closed_after_update", _sql(f"SELECT {_log('coalesce(sum(s.cnt * a.avg_out * b.avg_in * (1 - (1 - least(1, k.avg_out / t.cnt)) * (1 - (SELECT count(*) FROM nw)::DOUBLE / ((SELECT count(*) FROM ids)::DOUBLE * (SELECT count(*) FROM ids))))), 0)')} {_CLOSED}", ACTIVITY, _hashed(4), *_EDGE_DEG, *catalog._GROWN, *_GROWN_IN))
def estimate_closed_after_update(spark, sf_dir):
    """A closing edge after an update: the added edges raise the chance that it exists."""
    grown = update.add_edges(catalog._summary(spark, sf_dir, "activity"), catalog._new_edges(spark, sf_dir))
    return catalog._rounded_estimate(estimate.estimate_frame(grown, catalog._TRIANGLE, "avg", stored_cycles=False))
