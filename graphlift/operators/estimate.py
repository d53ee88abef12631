"""Estimates and bounds: the exact plan over the summary, cells for vertices and degrees for edges.

A partial estimate has a cell for each live pattern vertex and a weight (and variance). Binding a vertex joins the
statistics of its edge and label on the parent's cell; a closing edge multiplies the weight by the chance that it is there;
vertices without open edges are summed out.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.degree import KINDS, Kind
from ..model import WILDCARD, Pattern, PatternEdge
from ..plans.order import path_signs, shortest_sign
from ..plans.steps import steps
from .exact import WEIGHT, within
from .sampling import limited, sample_paths
from .summary import CellSummary

#: More partial estimates than this after a step give the kind's default.
MOST_PARTIALS = 1_000_000


def _c(v: int) -> str:
    return f"c{v}"


def _label(label: int | None) -> int:
    return WILDCARD if label is None else label


def _cards(summary: CellSummary, label: int | None) -> DataFrame:
    return summary.cell_card.where(F.col("label") == _label(label)).select("cell", "cnt")


def _with_ids(summary: CellSummary, ids: frozenset[int]) -> DataFrame:
    """(cell, found): cells that hold some of the ids, and how many. Full cells count as holding all of them."""
    found = summary.cell_member.where(F.col("id").isin(*sorted(ids))) if ids else summary.cell_member.where(F.lit(False))
    found = found.groupBy("cell").agg(F.count("*").alias("found"))
    if summary.full_cells:
        full = summary.cell_member.sparkSession.createDataFrame([(c, len(ids)) for c in summary.full_cells], "cell int, found bigint")
        found = found.unionByName(full).groupBy("cell").agg(F.max("found").alias("found"))
    return found


def _seed(summary: CellSummary, pattern: Pattern, v: int, kind: Kind) -> DataFrame:
    vertex = pattern.vertices[v]
    rows = _cards(summary, vertex.label)
    count = F.col("cnt").cast("double")
    if vertex.ids is not None:
        rows = rows.join(_with_ids(summary, vertex.ids), "cell")
        # averages: the ids are what is left of the cell; an upper bound can't have more than either; no lower bound on a label
        count = F.when(F.col("found") >= F.col("cnt"), count).otherwise(F.lit(0.0)) if kind.name == "min" else F.least(count, F.col("found").cast("double"))
    state = kind.seed(count)
    return rows.select(F.col("cell").alias(_c(v)), *[x.alias(n) for n, x in state.items()])


def _extended(summary: CellSummary, pattern: Pattern, rows: DataFrame, parent: int, v: int, edge: PatternEdge, forward: bool, kind: Kind) -> DataFrame:
    roles = kind.columns(forward)
    vertex = pattern.vertices[v]
    slice_ = summary.edge_deg.where((F.col("edge_label") == _label(edge.label)) & (F.col("vlabel") == _label(vertex.label)))
    slice_ = slice_.select(F.col("c1").alias(_c(parent)), F.col("c2").alias(_c(v)), *[F.col(c).alias(f"_{r}") for r, c in roles.items()]).where(F.col("_deg") > 0)
    joined = rows.join(slice_, _c(parent))
    state = kind.extend({n: F.col(n) for n in kind.state} | {r: F.col(f"_{r}") for r in roles})
    joined = joined.withColumns(state).drop(*[f"_{r}" for r in roles])
    if vertex.ids is not None:
        share = _cards(summary, vertex.label).join(_with_ids(summary, vertex.ids), "cell")
        share = share.select(F.col("cell").alias(_c(v)), F.least(F.lit(1.0), F.col("found") / F.col("cnt")).alias("_share"))
        joined = _scaled(joined.join(share, _c(v)), kind, F.col("_share")).drop("_share")
    return joined


def _scaled(rows: DataFrame, kind: Kind, by: Column) -> DataFrame:
    return rows.withColumns(kind.scale({n: F.col(n) for n in kind.state}, by))


def _closed(summary: CellSummary, pattern: Pattern, rows: DataFrame, e: PatternEdge, done: list[PatternEdge], kind: Kind, stored: bool, shortest: bool) -> DataFrame:
    """Scales by the chance that the closing edge exists between the two cells."""
    label = _label(pattern.vertices[e.dst].label)
    roles = kind.columns(True)
    slice_ = summary.edge_deg.where((F.col("edge_label") == _label(e.label)) & (F.col("vlabel") == label))
    deg = {"min": "min_out", "max": "max_out"}.get(kind.name, roles["deg"])
    a, b = F.col("c1"), F.col("c2")
    slice_ = slice_.select(a.alias("_a"), b.alias("_b"), F.col(deg).alias("_deg"))
    on = (rows[_c(e.src)] == slice_["_a"]) & (rows[_c(e.dst)] == slice_["_b"])
    joined = rows.join(slice_, on)  # no such edges between the cells: no matches
    known = [(x.src, x.dst) for x in done if x != e]
    signs = [] if e.src == e.dst else (shortest_sign if shortest else path_signs)(known, e.src, e.dst, max(1, summary.max_cycle - 1))
    absent: Column
    if stored and signs and summary.max_cycle >= 2:
        absent = F.lit(1.0)
        default = min(1.0, 5.0 * summary.n_edges / max(1, summary.n_vertices) ** 2)
        for k, (sign, times) in enumerate(sorted(Counter(signs).items())):
            own = summary.cycle_prob.where(F.col("path") == sign)
            pair = own.where(F.col("c1") != WILDCARD).select(F.col("c1").alias("_pa"), F.col("c2").alias("_pb"), F.col("prob").alias(f"_p{k}"))
            joined = joined.join(pair, (joined[_c(e.src)] == pair["_pa"]) & (joined[_c(e.dst)] == pair["_pb"]), "left").drop("_pa", "_pb")
            # one row at most: a scalar for the whole table
            anywhere = own.where(F.col("c1") == WILDCARD).agg(F.max("prob").alias(f"_q{k}"))
            length = summary.cycle_len_prob.where(F.col("len") == len(sign)).agg(F.max("prob").alias(f"_l{k}"))
            joined = joined.crossJoin(F.broadcast(anywhere)).crossJoin(F.broadcast(length))
            p = F.coalesce(F.col(f"_p{k}"), F.col(f"_q{k}"), F.col(f"_l{k}"), F.lit(default))
            absent = absent * F.pow(1 - p, F.lit(times))
    else:
        cards = _cards(summary, pattern.vertices[e.dst].label).select(F.col("cell").alias("_card_cell"), "cnt")
        joined = joined.join(cards, joined[_c(e.dst)] == cards["_card_cell"]).drop("_card_cell")
        absent = 1 - F.least(F.lit(1.0), F.col("_deg") / F.col("cnt"))
    # edges that were added since the build aren't in the statistics
    if summary.added_edges:
        absent = absent * (1 - summary.added_edges / max(1, summary.n_vertices) ** 2)
    joined = _scaled(joined, kind, 1 - absent)
    return joined.select(*rows.columns)


def _summed(rows: DataFrame, live: tuple[int, ...], kind: Kind) -> DataFrame:
    return rows.groupBy(*[_c(v) for v in live]).agg(*[F.sum(n).alias(n) for n in kind.state])


def partial_estimates(summary: CellSummary, pattern: Pattern, kind: Kind, stored_cycles: bool = True, shortest_only: bool = False, partial_sums: bool = True, cap: int | None = None, strategy: str = "redistributive", seed: int = 0, check=None, most_exact: int = 8) -> DataFrame:
    plan = steps(pattern, (), most_exact)
    rows, done = None, []
    for k, step in enumerate(plan):
        v = step.vertex
        if step.parent is None:
            rows = _seed(summary, pattern, v, kind)
        else:
            rows = _extended(summary, pattern, rows, step.parent, v, step.edge, step.forward, kind)
            done.append(step.edge)
        for e in step.closing:
            done.append(e)
            rows = _closed(summary, pattern, rows, e, done, kind, stored_cycles, shortest_only)
        if partial_sums and len(step.live) < len([c for c in rows.columns if c not in kind.state]) and k < len(plan) - 1:
            rows = _summed(rows, step.live, kind)
        if limited(cap) and k:
            rows = sample_paths(rows, cap, strategy, seed + k, kind.state)
        if check is not None:
            rows = check(rows)
    return rows


def estimate_frame(summary: CellSummary, pattern: Pattern, kind: str | Kind = "avg", **options) -> DataFrame:
    """One row, `estimate` (and `var` for correlated ones): the sum of all weights; components multiply."""
    kind = KINDS[kind] if isinstance(kind, str) else kind
    out = None
    for component in pattern.components():
        part, _ = pattern.restricted_to(component)
        rows = partial_estimates(summary, part, kind, **options)
        one = rows.agg(F.coalesce(F.sum(WEIGHT), F.lit(0.0)).alias("estimate"), *([F.coalesce(F.sum("var"), F.lit(0.0)).alias("var")] if kind.name == "corr" else []))
        if out is None:
            out = one
        else:
            out = out.crossJoin(F.broadcast(one.select(F.col("estimate").alias("_e")))).withColumn("estimate", F.col("estimate") * F.col("_e")).drop("_e")
    return out


class _TooMany(Exception):
    pass


def estimate(summary: CellSummary, pattern: Pattern, kind: str = "avg", timeout: float | None = None, most_partials: int = MOST_PARTIALS, guard: bool = False, **options) -> float:
    """The estimate as a number, or the kind's default if it takes longer than `timeout` seconds or, with `guard`, more than most_partials rows after a step."""
    k = KINDS[kind]

    def check(rows: DataFrame) -> DataFrame:
        if rows.limit(most_partials + 1).count() > most_partials:
            raise _TooMany
        return rows

    def job() -> float:
        try:
            return float(estimate_frame(summary, pattern, k, check=check if guard else None, **options).first()["estimate"])
        except _TooMany:
            return k.default

    return within(summary.cell_card.sparkSession, timeout, job, k.default)


def estimate_all(summary: CellSummary, patterns: dict[str, Pattern], kind: str = "avg", **options) -> DataFrame:
    """(pattern, estimate) of a query set, in one job."""
    out = None
    for name, p in patterns.items():
        row = estimate_frame(summary, p, kind, **options).select(F.lit(name).alias("pattern"), "estimate")
        out = row if out is None else out.unionByName(row)
    return out
