"""The plan that exact counting and estimation share: which vertex is bound when, from where, and what can be summed out."""

from __future__ import annotations

from dataclasses import dataclass

from ..model import Pattern, PatternEdge
from .order import min_width_order


@dataclass(frozen=True)
class Step:
    """Bind `vertex` from `parent` over `edge` (None for the first), then check `closing` edges, then keep `live` vertices."""

    vertex: int
    parent: int | None
    edge: PatternEdge | None
    forward: bool
    closing: tuple[PatternEdge, ...]
    live: tuple[int, ...]


def steps(pattern: Pattern, keep: tuple[int, ...] = (), max_exact: int = 8) -> list[Step]:
    """Steps of a connected pattern. A bound vertex stays live while an edge of it is open or it is in `keep`."""
    order = min_width_order(pattern, max_exact)
    out, bound, used = [], [], set()
    for v in order:
        parent, edge, forward = None, None, True
        for u in bound:  # the earliest bound neighbour
            edge = pattern.edge(u, v) or pattern.edge(v, u)
            if edge:
                parent, forward = u, edge.src == u
                break
        if edge:
            used.add(edge)
        bound.append(v)
        closing = tuple(e for e in pattern.edges if e not in used and e.src in bound and e.dst in bound)
        used.update(closing)
        open_ = {x for e in pattern.edges if e not in used for x in (e.src, e.dst)}
        out.append(Step(v, parent, edge, forward, closing, tuple(u for u in bound if u in open_ or u in keep)))
    return out
