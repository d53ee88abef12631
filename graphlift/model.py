"""Data graphs as two DataFrames, query graphs as small driver-side patterns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written in files and summary tables where any label or id will do; None in patterns.
WILDCARD = -1

VERTEX_SCHEMA = "id bigint, labels array<int>"
EDGE_SCHEMA = "src bigint, dst bigint, labels array<int>"


def _label(value: int | None) -> int | None:
    return None if value is None or value == WILDCARD else int(value)


@dataclass(frozen=True)
class PatternVertex:
    label: int | None = None
    ids: frozenset[int] | None = None


@dataclass(frozen=True)
class PatternEdge:
    src: int
    dst: int
    label: int | None = None


@dataclass(frozen=True)
class Pattern:
    """A directed query graph; vertices are numbered from 0, every vertex and edge has one label or any.

    A pattern never changes: each method gives a new one.
    """

    vertices: tuple[PatternVertex, ...] = ()
    edges: tuple[PatternEdge, ...] = ()

    @classmethod
    def of(cls, n: int, edges: Iterable[tuple], labels: dict[int, int | None] | None = None, ids: dict[int, Iterable[int]] | None = None) -> Pattern:
        """n vertices and edges (src, dst[, label])."""
        out = cls(tuple(PatternVertex() for _ in range(n)))
        for e in edges:
            out = out.add_edge(*e)
        for v, label in (labels or {}).items():
            out = out.set_vertex_label(v, label)
        for v, allowed in (ids or {}).items():
            out = out.set_ids(v, allowed)
        return out

    def _with_vertex(self, v: int, **changes) -> Pattern:
        self._check(v)
        return replace(self, vertices=tuple(replace(x, **changes) if i == v else x for i, x in enumerate(self.vertices)))

    def _check(self, v: int) -> None:
        if not 0 <= v < len(self.vertices):
            raise ValueError(f"no vertex {v}")

    def add_vertex(self, label: int | None = None, ids: Iterable[int] | None = None) -> Pattern:
        return replace(self, vertices=(*self.vertices, PatternVertex())).set_vertex_label(len(self.vertices), label).set_ids(len(self.vertices), ids)

    def add_edge(self, src: int, dst: int, label: int | None = None) -> Pattern:
        """An edge that is there already gets the label; two unequal labels on one edge are refused."""
        self._check(src)
        self._check(dst)
        label = _label(label)
        for e in self.edges:
            if (e.src, e.dst) == (src, dst):
                if e.label is not None and label is not None and e.label != label:
                    raise ValueError(f"edge {src}->{dst} has label {e.label}; a pattern's edge has one label")
                return self.set_edge_label(src, dst, label if label is not None else e.label)
        return replace(self, edges=(*self.edges, PatternEdge(src, dst, label)))

    def set_vertex_label(self, v: int, label: int | None) -> Pattern:
        return self._with_vertex(v, label=_label(label))

    def set_edge_label(self, src: int, dst: int, labels: int | Iterable[int] | None) -> Pattern:
        if labels is not None and not isinstance(labels, int):
            labels = list(labels)
            if len(labels) > 1:
                raise ValueError("a pattern's edge has one label")
            labels = labels[0] if labels else None
        if not any((e.src, e.dst) == (src, dst) for e in self.edges):
            raise ValueError(f"no edge {src}->{dst}")
        return replace(self, edges=tuple(replace(e, label=_label(labels)) if (e.src, e.dst) == (src, dst) else e for e in self.edges))

    def set_ids(self, v: int, ids: Iterable[int] | int | None) -> Pattern:
        """Allowed data ids; None, or the wildcard anywhere among them: any."""
        ids = None if ids is None else frozenset([ids] if isinstance(ids, int) else map(int, ids))
        return self._with_vertex(v, ids=None if ids is None or WILDCARD in ids else ids)

    def ids_of(self, v: int) -> frozenset[int] | None:
        return self.vertices[v].ids

    def edge(self, src: int, dst: int) -> PatternEdge | None:
        return next((e for e in self.edges if (e.src, e.dst) == (src, dst)), None)

    def neighbours(self, v: int) -> set[int]:
        """Other vertices that share an edge with v, in either direction."""
        return {e.dst for e in self.edges if e.src == v and e.dst != v} | {e.src for e in self.edges if e.dst == v and e.src != v}

    def components(self) -> list[list[int]]:
        left, out = set(range(len(self.vertices))), []
        while left:
            found, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v not in found:
                    found.add(v)
                    todo.extend(self.neighbours(v) - found)
            out.append(sorted(found))
            left -= found
        return out

    def restricted_to(self, keep: list[int]) -> tuple[Pattern, dict[int, int]]:
        """The pattern on some of its vertices, and the new number of each."""
        number = {v: i for i, v in enumerate(keep)}
        return Pattern(tuple(self.vertices[v] for v in keep), tuple(PatternEdge(number[e.src], number[e.dst], e.label) for e in self.edges if e.src in number and e.dst in number)), number


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(id, labels) and edges(src, dst, labels), unique by id and by (src, dst). Labels are sets without the wildcard."""

    vertices: DataFrame
    edges: DataFrame
    #: (src, dst, label), stored in a folder for each label, where the graph was stored: a slice reads its own files.
    by_label: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, n: int) -> PropertyGraph:
        """n vertices 0..n-1 without labels, no edges."""
        vertices = spark.range(n).select("id", F.array().cast("array<int>").alias("labels"))
        return cls(vertices, spark.createDataFrame([], EDGE_SCHEMA))

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From rows (id, labels) and (src, dst, labels) that may repeat: label sets are merged, endpoints without a row become vertices without labels."""
        merged = merge_labels(edges.select("src", "dst", "labels"), ["src", "dst"])
        ends = merged.select(F.col("src").alias("id")).unionByName(merged.select(F.col("dst").alias("id")))
        bare = ends.select("id", F.array().cast("array<int>").alias("labels"))
        return cls(merge_labels(vertices.select("id", "labels").unionByName(bare), ["id"]), merged)

    @classmethod
    def from_edges(cls, edges: DataFrame) -> PropertyGraph:
        return cls.of(edges.select(F.col("src").alias("id"), F.array().cast("array<int>").alias("labels")), edges)

    def add_vertices(self, more: DataFrame) -> PropertyGraph:
        return PropertyGraph(merge_labels(self.vertices.unionByName(more.select("id", "labels")), ["id"]), self.edges)

    def add_edges(self, more: DataFrame) -> PropertyGraph:
        """A pair that is there already gets the new labels besides its own."""
        return PropertyGraph.of(self.vertices, self.edges.unionByName(more.select("src", "dst", "labels")))

    def with_vertex_labels(self, labels: DataFrame) -> PropertyGraph:
        """Replaces the labels of the ids in labels(id, labels)."""
        new = labels.select("id", F.col("labels").alias("_new"))
        return PropertyGraph(self.vertices.join(new, "id", "left").select("id", F.coalesce(clean("_new"), "labels").alias("labels")), self.edges)

    def symmetric(self) -> PropertyGraph:
        """Every edge in both directions."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "labels")
        return PropertyGraph(self.vertices, merge_labels(self.edges.unionByName(back), ["src", "dst"]))

    def degrees(self) -> DataFrame:
        """(id, d_in, d_out) of every vertex."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        none = self.vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i"))
        return ends.unionByName(none).groupBy("id").agg(F.sum("i").alias("d_in"), F.sum("o").alias("d_out"))

    def totals(self) -> tuple[int, int]:
        """(vertices, edges)."""
        return self.vertices.count(), self.edges.count()


def drawn(*columns, seed: int = 0) -> F.Column:
    """A hash of integer columns below 2**31 - 1, in plain integer arithmetic that any SQL engine can repeat: squares modulo a prime."""
    h = F.lit(seed).cast("bigint")
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        a = F.pmod(h * 31 + F.pmod(c.cast("bigint"), F.lit(2_147_483_629)), F.lit(2_147_483_647))
        b = F.pmod(a * 48_271 + 12_345, F.lit(2_147_483_647))
        h = F.pmod(b * b + a, F.lit(2_147_483_647))
    return h


def clean(labels) -> F.Column:
    """A label set: each once, ascending, without the wildcard."""
    col = F.col(labels) if isinstance(labels, str) else labels
    return F.array_sort(F.array_distinct(F.filter(col, lambda x: x != WILDCARD)))


def merge_labels(rows: DataFrame, key: list[str], known: Iterable[int] | None = None) -> DataFrame:
    """One row for each key with all its labels. Where all labels are known, 63 at most, they are summed as bits of a number, in rows of one width; others are an error."""
    if known is None:
        return rows.groupBy(*key).agg(F.collect_set("labels").alias("_sets")).select(*key, clean(F.flatten("_sets")).alias("labels"))
    known = sorted({*known} - {WILDCARD})
    if len(known) > 63:
        raise ValueError("more than 63 labels")
    label, bit = F.col("_label"), F.when(F.col("_label").isNull() | (F.col("_label") == WILDCARD), F.lit(0).cast("bigint"))
    for k, x in enumerate(known):
        bit = bit.when(label == x, F.lit(1 << k).cast("bigint"))
    bit = bit.otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("bigint"))
    bits, one = F.col("_bits"), lambda x: F.array(F.lit(x)).cast("array<int>")
    labels = F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.lit(x)) for k, x in enumerate(known)])).cast("array<int>")
    for k, x in enumerate(known):
        labels = F.when(bits == F.lit(1 << k).cast("bigint"), one(x)).otherwise(labels)
    return rows.select(*key, F.explode_outer("labels").alias("_label")).groupBy(*key).agg(F.bit_or(bit).alias("_bits")).select(*key, labels.alias("labels"))


def random_graph(spark: SparkSession, size: int, n_labels: int = 50, most_labels: int = 5, seed: int = 0) -> PropertyGraph:
    """size / 2 vertices and as many edges; a vertex has 1 to most_labels labels below n_labels, an edge one."""
    n = size // 2
    draw = lambda salt, limit: F.pmod(drawn("id", F.lit(salt), seed=seed), F.lit(limit)).cast("int")
    labels = F.transform(F.sequence(F.lit(1), 1 + draw(0, most_labels)), lambda i: F.pmod(drawn("id", i + 10, seed=seed), F.lit(n_labels)).cast("int"))
    vertices = spark.range(n).select("id", labels.alias("labels"))
    edges = spark.range(n).select(draw(1, n).cast("bigint").alias("src"), draw(2, n).cast("bigint").alias("dst"), F.array(draw(3, n_labels)).alias("labels"))
    return PropertyGraph.of(vertices, edges)
