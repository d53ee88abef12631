"""Degree statistics of cell pairs and how an estimate grows by them, as column expressions.

Each kind tells which columns of the `edge_deg` table it needs and how a weight (and, for correlated
estimates, its variance) is extended over an edge, summed and scaled. All stay inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str

    @property
    def state(self) -> tuple[str, ...]:
        """Columns that a partial estimate carries."""
        return ("weight", "var") if self.name == "corr" else ("weight",)

    def columns(self, forward: bool) -> dict[str, str]:
        """Role to column of edge_deg, for an edge that is walked along (forward) or against its direction."""
        side = "out" if forward else "in"
        if self.name == "corr":
            return {"deg": f"avg_{side}", "spread": f"var_{side}", "rho": f"corr_{side}"}
        return {"deg": f"{self.name}_{side}"}

    def seed(self, count: Column) -> dict[str, Column]:
        out = {"weight": count.cast("double")}
        return out | {"var": F.lit(0.0)} if self.name == "corr" else out

    def extend(self, s: dict[str, Column]) -> dict[str, Column]:
        """s has weight (and var) and the roles of columns()."""
        w, a = s["weight"], s["deg"]
        if self.name != "corr":
            return {"weight": w * a}
        v, s2, rho = s["var"], s["spread"], s["rho"]
        cross = F.sqrt(v) * F.sqrt(s2) * rho
        mean = w * a + cross
        second = (v + w * w) * (s2 + a * a) + 4 * w * a * cross + 2 * rho * rho * v * s2
        return {"weight": mean, "var": F.greatest(F.lit(0.0), second - mean * mean)}

    def scale(self, state: dict[str, Column], by: Column) -> dict[str, Column]:
        """Lower bounds can't rely on a factor below 1, upper bounds only on one above."""
        w = state["weight"]
        if self.name == "min":
            return {"weight": F.when(by >= 1, w).otherwise(F.lit(0.0))}
        if self.name == "max":
            return {"weight": F.when(by >= 1, w * by).otherwise(w)}
        if self.name == "avg":
            return {"weight": w * by}
        return {"weight": w * by, "var": state["var"] * by * by}

    @property
    def default(self) -> float:
        """What an estimate is when it can't be made in time or room."""
        return float("inf") if self.name == "max" else 0.0


MIN, AVG, MAX, CORR = Kind("min"), Kind("avg"), Kind("max"), Kind("corr")
KINDS = {k.name: k for k in (MIN, AVG, MAX, CORR)}
