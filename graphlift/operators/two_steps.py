"""Pairs of vertices two edges apart, without a table of all paths of two edges.

Vertices get one of b colours by a hash. The pairs from a start to an end are found by the task of their two colours, to which go the edges
that leave such a start and those that reach such an end: an edge goes to 2 b tasks, and paths are made and told apart within a task, some millions at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import drawn

#: Edges that a task holds, about; it takes some 100 bytes for each.
TASK_EDGES = 2_000_000


def two_steps(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(src, dst), each once: there is a path of two edges from src to dst but no edge. edges(src, dst) has each edge once; it is read three times."""
    b = max(1, math.ceil(2 * edges.count() / task_edges))
    colour = lambda end: F.pmod(drawn(end, seed=2), F.lit(b)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    leave = edges.select("src", "dst", F.lit(True).alias("first"), (colour("src") * b).alias("_i"), every.alias("_j"))
    reach = edges.select("src", "dst", F.lit(False).alias("first"), colour("dst").alias("_j"), every.alias("_i")).select("src", "dst", "first", (F.col("_i") * b).alias("_i"), "_j")
    rows = leave.unionByName(reach).select((F.col("_i") + F.col("_j")).alias("task"), "src", "dst", "first")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_finder(), "src bigint, dst bigint")


def _finder(chunk: int = 1 << 22, most_rows: int = 1 << 18):
    # a closure, so that executors need no more than numpy and pyarrow
    def find(batches):
        import numpy as np
        import pyarrow as pa

        def task(rows):
            first = rows["first"].to_numpy()
            src, dst = rows["src"].to_numpy(), rows["dst"].to_numpy()
            a, m = src[first], dst[first]
            order = np.argsort(a, kind="stable")
            a, m = a[order], m[order]
            order = np.argsort(src[~first], kind="stable")
            middle, ends = src[~first][order], dst[~first][order]
            names, ends = np.unique(ends, return_inverse=True)
            d = len(names)
            if not len(a) or not d:
                return
            starts, begin, row = np.unique(a, return_index=True, return_inverse=True)
            low = np.searchsorted(middle, m)
            paths = np.searchsorted(middle, m, "right") - low
            upto = np.concatenate([[0], np.cumsum(paths)])
            begin = np.append(begin, len(a))
            # the edges that are there already
            at = np.minimum(np.searchsorted(names, m), d - 1)
            there = names[at] == m

            def codes(e0, e1, r0):
                """row and end of each path over the edges e0 to e1"""
                e = np.repeat(np.arange(e0, e1), paths[e0:e1])
                return (row[e] - r0) * d + ends[np.arange(len(e)) + upto[e0] - upto[e] + low[e]]

            r0 = 0
            while r0 < len(starts):
                r1 = max(r0 + 1, int(np.searchsorted(upto[begin], upto[begin[r0]] + chunk, "right")) - 1)
                e0, e1 = begin[r0], begin[r1]
                old = np.flatnonzero(there[e0:e1]) + e0
                old = (row[old] - r0) * d + at[old]
                if r1 == r0 + 1 or (r1 - r0) * d <= 16 * (upto[e1] - upto[e0]):
                    marks = np.zeros((r1 - r0) * d, bool)
                    while e0 < e1:  # one start may have more paths than a chunk
                        stop = min(e1, max(e0 + 1, int(np.searchsorted(upto, upto[e0] + chunk, "right")) - 1))
                        marks[codes(e0, stop, r0)] = True
                        e0 = stop
                    marks[old] = False
                    found = np.flatnonzero(marks)
                else:
                    found = np.setdiff1d(codes(e0, e1, r0), old)
                for k in range(0, len(found), most_rows):
                    x = found[k : k + most_rows]
                    yield pa.RecordBatch.from_arrays([pa.array(starts[r0 + x // d]), pa.array(names[x % d])], ["src", "dst"])
                r0 = r1

        kept, now = [], None
        for batch in batches:
            task_of = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task_of)) + 1).tolist(), len(task_of)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if kept and task_of[x] != now:
                    yield from task(pa.Table.from_batches(kept))
                    kept = []
                now = task_of[x]
                kept.append(batch.slice(x, y - x))
        if kept:
            yield from task(pa.Table.from_batches(kept))

    return find
