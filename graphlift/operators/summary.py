"""The cell summary of a data graph: small tables, stored as Parquet."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .partition import SHORT, Stage, cell_graph
from .cycles import cycle_probabilities
from .stats import cell_card, edge_deg
from .store import written


@dataclass(frozen=True)
class SummaryParams:
    """How to build a summary. kind: min, avg, max or corr (which degree statistics an estimate will use)."""

    stages: tuple[tuple[str, int], ...] = (("quasi_stable", 64),)
    kind: str = "avg"
    max_cycle: int = 4
    most_starts: int | None = None
    seed: int = 0
    most_walks: int | None = None

    def name(self) -> str:
        """A file name that tells the parameters."""
        return "_".join([self.kind, "".join(f"{SHORT[m]}{k}" for m, k in self.stages), f"c{self.max_cycle}", str(self.most_starts or "all")])


@dataclass(frozen=True)
class CellSummary:
    """cell_card(cell, label, cnt), edge_deg, cell_member(id, cell), cycle_prob, cycle_len_prob; totals of the graph.

    cell_full(cell) lists cells that count as holding any id (as a saturated filter would).
    """

    cell_card: DataFrame
    edge_deg: DataFrame
    cell_member: DataFrame
    cycle_prob: DataFrame
    cycle_len_prob: DataFrame
    n_vertices: int
    n_edges: int
    max_cycle: int
    added_edges: int = 0
    full_cells: tuple[int, ...] = ()
    timings: dict[str, float] = field(default_factory=dict, compare=False)

    TABLES = ("cell_card", "edge_deg", "cell_member", "cycle_prob", "cycle_len_prob")

    @property
    def n_cells(self) -> int:
        return self.cell_member.agg(F.countDistinct("cell")).first()[0]

    def save(self, path: str) -> None:
        for t in self.TABLES:
            out = getattr(self, t)
            # estimates look up one edge label at a time
            (out.repartition("edge_label").sortWithinPartitions("edge_label", "vlabel", "c1") if t == "edge_deg" else out).write.mode("overwrite").parquet(f"{path}/{t}")
        spark = self.cell_card.sparkSession
        meta = [(self.n_vertices, self.n_edges, self.max_cycle, self.added_edges, list(self.full_cells))]
        spark.createDataFrame(meta, "n_vertices bigint, n_edges bigint, max_cycle int, added_edges bigint, full_cells array<int>").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellSummary:
        meta = spark.read.schema("n_vertices bigint, n_edges bigint, max_cycle int, added_edges bigint, full_cells array<int>").json(f"{path}/meta").first()
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in cls.TABLES), meta["n_vertices"], meta["n_edges"], meta["max_cycle"], meta["added_edges"], tuple(meta["full_cells"]))

    def footprint(self) -> dict[str, int]:
        """Rows of each table."""
        return {t: getattr(self, t).count() for t in self.TABLES}

    def footprint_bytes(self) -> dict[str, int]:
        """Bytes of each table's values: 8 for a number of 64 bits, 4 for one of 32, a text's own."""
        out = {}
        for t in self.TABLES:
            df = getattr(self, t)
            fixed = sum({"bigint": 8, "double": 8, "int": 4}.get(kind, 0) for _, kind in df.dtypes)
            texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
            row = df.agg(F.count("*"), *texts).first()
            out[t] = row[0] * fixed + sum(x or 0 for x in row[1:])
        return out


def summarize(graph: PropertyGraph, params: SummaryParams | None = None, cells: DataFrame | None = None) -> CellSummary:
    """Builds the summary, phase by phase; `cells` replaces the partition. Each table is stored once built, and timed."""
    params = params or SummaryParams()
    timings: dict[str, float] = {}

    def timed(phase: str, make):
        begun = time.time()
        out = make()
        timings[phase] = time.time() - begun
        return out

    cells = timed("partition", lambda: written(cells.select("id", F.col("cell").cast("int").alias("cell"))) if cells is not None else cell_graph(graph, [Stage(*s) for s in params.stages]))
    paths, lengths = timed("cycles", lambda: tuple(map(written, cycle_probabilities(graph, cells, params.max_cycle, most_starts=params.most_starts, seed=params.seed, most_walks=params.most_walks))))
    card = timed("cardinalities", lambda: written(cell_card(graph, cells)))
    degrees = timed("edge_stats", lambda: written(edge_deg(graph, cells, corr=params.kind == "corr")))
    n, m = timed("totals", graph.totals)
    return CellSummary(card, degrees, cells, paths, lengths, n, m, params.max_cycle, timings=timings)


def with_cycles(summary: CellSummary, graph: PropertyGraph, params: SummaryParams) -> CellSummary:
    """A summary of the same graph, built for shorter cycles or none, with the cycle statistics of these parameters."""
    begun = time.time()
    paths, lengths = map(written, cycle_probabilities(graph, summary.cell_member, params.max_cycle, most_starts=params.most_starts, seed=params.seed, most_walks=params.most_walks))
    return replace(summary, cycle_prob=paths, cycle_len_prob=lengths, max_cycle=params.max_cycle, timings=summary.timings | {"cycles": time.time() - begun})


def build_report(summary: CellSummary, dataset: str, params: SummaryParams) -> DataFrame:
    """Rows (Dataset, Partitioner, NumColors, BuildPhase, BuildTime, MemoryFootprint) of a build, for a CSV sink."""
    spark = summary.cell_card.sparkSession
    size = sum(summary.footprint_bytes().values())
    name = "".join(f"{SHORT[m]}{k}" for m, k in params.stages)
    return spark.createDataFrame([(dataset, name, summary.n_cells, phase, float(t), float(size)) for phase, t in summary.timings.items()], "Dataset string, Partitioner string, NumColors bigint, BuildPhase string, BuildTime double, MemoryFootprint double")


