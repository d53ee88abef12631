"""Graphs made from the sample tables, and small graphs with known counts."""

from __future__ import annotations

from functools import reduce
from itertools import permutations, product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import EDGE_SCHEMA, VERTEX_SCHEMA, Pattern, PropertyGraph
from .operators.store import stored_rows

KIND = 1_000_000_000
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(1, 7)
USER, EVENT_TYPE = 7, 8
EVENT_TYPE_BASE = 8 * KIND
_cache: dict[tuple, PropertyGraph] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _id(kind: int, key: str) -> F.Column:
    return F.col(key).cast("bigint") + kind * KIND


def _rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Alphabetical rank of each value of a column; null where the column is null. One task orders the different values."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(values.select(column, F.dense_rank().over(Window.orderBy(column)).alias(name)), column, "left")


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of(*commerce_rows(spark, sf_dir))


def commerce_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers, suppliers, parts and orders. Vertex id: kind * 10**9 + key.

    Edge labels: 10 order->customer, 11 customer->nation, 12 supplier->nation, 13 nation->region, 20 order->part
    (21, 22, 23 besides, for return flag A, N, R), 30 order->supplier, 31 part->supplier. Vertex labels: the kind; customers
    100 + rank of the segment, parts 200 + rank of the type, orders 300 + digit of the priority and 311, 312, 313 for status F, O, P.
    """
    read = lambda t: _read(spark, sf_dir, t)
    customer, orders, part, lines = _rank(read("customer"), "c_mktsegment", "rank"), read("orders"), _rank(read("part"), "p_type", "rank"), read("lineitem")
    supplier, nation, region = read("supplier"), read("nation"), read("region")
    labels = lambda *cols: F.array(*[c if isinstance(c, F.Column) else F.lit(c) for c in cols]).cast("array<int>").alias("labels")
    status = F.lit(310) + F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 3)
    vertices = [
        region.select(_id(REGION, "r_regionkey").alias("id"), labels(REGION)),
        nation.select(_id(NATION, "n_nationkey").alias("id"), labels(NATION)),
        customer.select(_id(CUSTOMER, "c_custkey").alias("id"), labels(CUSTOMER, F.col("rank") + 100)),
        supplier.select(_id(SUPPLIER, "s_suppkey").alias("id"), labels(SUPPLIER)),
        part.select(_id(PART, "p_partkey").alias("id"), labels(PART, F.col("rank") + 200)),
        orders.select(_id(ORDER, "o_orderkey").alias("id"), labels(ORDER, F.substring("o_orderpriority", 1, 1).cast("int") + 300, status)),
    ]
    edge = lambda rows, a, b, *ls: rows.select(a.alias("src"), b.alias("dst"), labels(*ls))
    flag = F.lit(20) + F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3)
    edges = [
        edge(orders, _id(ORDER, "o_orderkey"), _id(CUSTOMER, "o_custkey"), 10),
        edge(customer, _id(CUSTOMER, "c_custkey"), _id(NATION, "c_nationkey"), 11),
        edge(supplier, _id(SUPPLIER, "s_suppkey"), _id(NATION, "s_nationkey"), 12),
        edge(nation, _id(NATION, "n_nationkey"), _id(REGION, "n_regionkey"), 13),
        edge(lines, _id(ORDER, "l_orderkey"), _id(PART, "l_partkey"), F.lit(20), flag),
        edge(lines, _id(ORDER, "l_orderkey"), _id(SUPPLIER, "l_suppkey"), 30),
        edge(lines, _id(PART, "l_partkey"), _id(SUPPLIER, "l_suppkey"), 31),
    ]
    return reduce(DataFrame.unionByName, vertices), reduce(DataFrame.unionByName, edges)


def followed(events: DataFrame) -> DataFrame:
    """(src, dst): each event's user and that of the next event by (ts, event_id). Events are ordered day by day; the days' first events join the days."""
    day = events.select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    within = day.withColumn("dst", F.lead("user_id").over(order))
    firsts = day.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    nexts = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("next_first"))  # a row for each day
    return within.join(nexts, "day").select(F.col("user_id").alias("src"), F.coalesce("dst", "next_first").alias("dst")).where(F.col("dst").isNotNull())


def activity(spark: SparkSession, sf_dir: str, until: float = 1.0) -> PropertyGraph:
    return PropertyGraph.of(*activity_rows(spark, sf_dir, until))


def activity_rows(spark: SparkSession, sf_dir: str, until: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Users and event types; edges 40 user->type, 50 user->user of the next event. `until` takes the first share of the time."""
    events = _read(spark, sf_dir, "events")
    if until < 1:
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        low, high = events.agg(F.min(micros), F.max(micros)).first()
        events = events.where(micros <= int(low + (high - low) * until))
    labels = lambda x: F.array(F.lit(x)).cast("array<int>").alias("labels")
    ranked = _rank(events, "event_type", "rank").where(F.col("rank").isNotNull())
    type_id = F.col("rank").cast("bigint") + EVENT_TYPE_BASE
    vertices = events.select(F.col("user_id").alias("id"), labels(USER)).unionByName(ranked.select(type_id.alias("id"), labels(EVENT_TYPE)))
    edges = ranked.select(F.col("user_id").alias("src"), type_id.alias("dst"), labels(40)).unionByName(followed(events).select("src", "dst", labels(50)))
    return vertices, edges


#: Makers of the rows of graphs, and the labels of their vertices (None: many) and edges.
GRAPHS = {"commerce": (commerce_rows, None, (10, 11, 12, 13, 20, 21, 22, 23, 30, 31)), "activity": (activity_rows, (USER, EVENT_TYPE), (40, 50))}


def graph(spark: SparkSession, sf_dir: str, name: str = "commerce") -> PropertyGraph:
    """The stored graph of a folder of tables; made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cache:
        rows, *labels = GRAPHS[name]
        _cache[key] = stored_rows(*rows(spark, sf_dir), *labels)
    return _cache[key]


def small(spark: SparkSession, n: int, pairs, labels: dict[int, list[int]] | None = None, edge_label: int | None = None, both: bool = False) -> PropertyGraph:
    """n vertices 1..n and edges given as pairs."""
    labels = labels or {}
    pairs = [*pairs, *((b, a) for a, b in pairs)] if both else list(pairs)
    v = spark.createDataFrame([(i, labels.get(i, [])) for i in range(1, n + 1)], VERTEX_SCHEMA)
    e = spark.createDataFrame([(a, b, [] if edge_label is None else [edge_label]) for a, b in pairs], EDGE_SCHEMA)
    return PropertyGraph.of(v, e)


EDGE = Pattern.of(2, [(0, 1)])
PATH2 = Pattern.of(3, [(0, 1), (1, 2)])
TRIANGLE = Pattern.of(3, [(0, 1), (1, 2), (2, 0)])


def golden(spark: SparkSession) -> dict[str, tuple[PropertyGraph, Pattern, int]]:
    """Graphs with counts that follow from their shape."""
    ring = lambda n: [(i, i % n + 1) for i in range(1, n + 1)]
    part = lambda v: (v - 1) // 3
    turan = [(a, b) for a, b in permutations(range(1, 13), 2) if part(a) != part(b)]
    tree = [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)]
    one = Pattern.of(2, [(0, 1, 1)])
    return {
        "one_edge": (small(spark, 2, [(1, 2)]), EDGE, 1),
        "one_edge_l1": (small(spark, 2, [(1, 2)], edge_label=1), Pattern.of(3, [(0, 1, 1), (1, 2, 1)]), 0),
        "cycle1000_l1": (small(spark, 1000, ring(1000), edge_label=1), one, 1000),
        "turan_12_4": (small(spark, 12, turan), PATH2, 972),
        "cycle1000_und": (small(spark, 1000, ring(1000), both=True), PATH2, 4000),
        "cycle1000_dir": (small(spark, 1000, ring(1000)), EDGE, 1000),
        "dm4": (small(spark, 4, [(1, 2), (2, 3), (3, 1), (1, 4), (2, 4)], both=True), PATH2, 26),
        "bintree_und": (small(spark, 7, tree, both=True), PATH2, 26),
        "bintree_dir": (small(spark, 7, tree, edge_label=1), PATH2, 4),
        "star4": (small(spark, 4, [(1, 2), (1, 3), (1, 4)], both=True), PATH2, 12),
        "two_comp": (small(spark, 4, [(1, 2), (3, 4)], edge_label=1), EDGE, 2),
        "tri_und": (small(spark, 3, ring(3), both=True), TRIANGLE, 6),
        "cycle4_und": (small(spark, 4, ring(4), both=True), TRIANGLE, 0),
        "clique10_loops": (small(spark, 10, product(range(1, 11), repeat=2)), TRIANGLE, 1000),
        "two_vertices": (small(spark, 2, [], {1: [1], 2: [1]}), Pattern.of(1, []), 2),
        "asym_star": (small(spark, 6, [(1, 2), (1, 3), (1, 4), (1, 5), (5, 6)], both=True), PATH2, 24),
        "barbell": (small(spark, 7, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 7), (5, 6), (6, 7)], both=True), PATH2, 38),
    }
