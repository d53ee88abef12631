"""Triangles by classes: counted from their edges, no table of all paths of two edges is made.

Vertices get one of b colours by a hash. A triangle is counted by the task of its three colours, to which go all edges between these: an edge
goes to b tasks, and a task holds about 6 / b^2 of the edges, whatever the degrees. Edges travel as compressed blocks of two colours. Within a task the
ends of an edge are ordered by degree, so that an edge is followed by sqrt(2 edges) others at most and hubs never multiply rows; a path u, v, w in
this order is closed by a look-up in a table of the edges of some u, which stays in a processor's cache.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import drawn

#: Edges that a task holds, about; it takes some 100 bytes for each.
TASK_EDGES = 1_000_000

CLASS = "cu int, cv int, cw int, uv int, uw int, vw int, n bigint"


def triangle_classes(pairs: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(cu, cv, cw, uv, uw, vw, n): numbers of triangles u, v, w by the cells of their vertices and the directions of their edges (bit 1: from the
    first vertex to the second, 2: back). pairs(lo, hi, dirs, c_lo, c_hi) has each linked pair of different vertices once, lo before hi in one order of all vertices."""
    b = max(1, math.ceil(math.sqrt(6 * pairs.count() / task_edges)))
    p, q = (F.pmod(drawn(end, seed=1), F.lit(b)).cast("int") for end in ("lo", "hi"))
    coloured = pairs.select("lo", "hi", F.col("dirs").cast("tinyint").alias("dirs"), "c_lo", "c_hi", F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    blocks = coloured.mapInArrow(_packer(), "p int, q int, edges binary").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    three = F.array_sort(F.array("p", "q", "r"))
    rows = blocks.select("edges", (F.col("p") == F.col("q")).alias("same"), three[0].alias("i"), three[1].alias("j"), three[2].alias("k"))
    # blocks are small for what they take to count, so AQE is not to join tasks by their bytes
    rows = rows.repartition(b * (b + 1) * (b + 2) // 6, "i", "j", "k")
    found = rows.groupBy("i", "j", "k").applyInArrow(_counter(), CLASS)
    return found.groupBy("cu", "cv", "cw", "uv", "uw", "vw").agg(F.sum("n").alias("n"))


def _packer(most_rows: int = 1 << 20):
    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def packed(held):
            table = pa.Table.from_batches(held)
            p, q = table["p"].to_numpy(), table["q"].to_numpy()
            order = np.lexsort((table["lo"].to_numpy(), q, p))
            table = table.take(order)
            p, q = p[order], q[order]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            edges = table.drop_columns(["p", "q"]).combine_chunks()
            blocks = []
            for at, to in zip(first, [*first[1:], len(p)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, edges.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(edges.slice(at, to - at))
                blocks.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(p[first], pa.int32()), pa.array(q[first], pa.int32()), pa.array(blocks, pa.binary())], ["p", "q", "edges"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most_rows:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return pack


def _counter(chunk: int = 1 << 18, most_sums: int = 1 << 22, most_marks: int = 1 << 22):
    # a closure, so that executors need no more than numpy and pyarrow
    def count(key, table):
        import numpy as np
        import pyarrow as pa

        names = ["cu", "cv", "cw", "uv", "uw", "vw"]
        shape = pa.schema([(c, pa.int32()) for c in names] + [("n", pa.int64())])
        one_colour = key[0].as_py() == key[2].as_py()
        blocks = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["edges"]]
        same = np.repeat(table["same"].to_numpy(), [t.num_rows for t in blocks])
        table = pa.concat_tables(blocks)
        del blocks
        column = lambda c: table[c].to_numpy()
        ids, ends = np.unique(np.concatenate([column("lo"), column("hi")]), return_inverse=True)
        n, m = len(ids), table.num_rows
        cells, of_end = np.unique(np.concatenate([column("c_lo"), column("c_hi")]), return_inverse=True)
        cell = np.empty(n, np.int64)
        cell[ends] = of_end
        k = len(cells)
        order = np.argsort(ends[:m] * n + ends[m:])
        a, b = ends[:m][order], ends[m:][order].astype(np.int32)
        dirs, same = column("dirs").astype(np.uint8)[order], same[order]
        del table, ids, ends, of_end, order
        begin = np.searchsorted(a, np.arange(n + 1))
        follow = np.diff(begin)[b]  # edges that follow an edge
        upto = np.concatenate([[0], np.cumsum(follow)])
        # vertices with edges in blocks: one row of marks for each, a column for each end of their edges
        heads = np.flatnonzero(np.diff(begin))
        column_of = np.zeros(n, np.int32)  # 0 for the ends of no edge of the block
        sums = np.zeros(27 * k**3, np.int64) if 27 * k**3 <= most_sums else None
        out, h = [], 0
        while h < len(heads):
            low = begin[heads[h]]
            rows = np.arange(1, len(heads) - h + 1) if len(heads) - h < 4096 else np.arange(1, 4097)
            fits = rows * (begin[heads[h : h + len(rows)] + 1] - low + 1) <= most_marks
            take = max(1, int(np.searchsorted(~fits, True)))
            high = begin[heads[h + take - 1] + 1]
            far = np.unique(b[low:high])
            width = len(far) + 1
            column_of[far] = np.arange(1, width)
            row = (np.searchsorted(heads[h : h + take], a[low:high]) * width).astype(np.int64)
            marks = np.zeros(take * width, np.uint8)
            marks[row + column_of[b[low:high]]] = dirs[low:high]
            h += take
            start = low
            while start < high:
                stop = min(high, max(start + 1, int(np.searchsorted(upto, upto[start] + chunk, "right")) - 1))
                each = follow[start:stop]
                second = np.arange(upto[stop] - upto[start]) + np.repeat(begin[b[start:stop]] - (upto[start:stop] - upto[start]), each)
                mark = marks[np.repeat(row[start - low : stop - low], each) + column_of[b[second]]]
                hit = np.flatnonzero(mark)
                first = np.searchsorted(upto[start : stop + 1] - upto[start], hit, "right") - 1 + start
                second, mark = second[hit], mark[hit]
                start = stop
                if not one_colour:  # triangles of one colour belong to the task of that colour
                    other = np.flatnonzero(~(same[first] & same[second]))
                    first, second, mark = first[other], second[other], mark[other]
                parts = [cell[a[first]], cell[b[first]], cell[b[second]], dirs[first], mark, dirs[second]]
                if sums is not None:
                    code = (parts[0] * k + parts[1]) * k + parts[2]
                    for x in parts[3:]:
                        code = code * 3 + (x - 1)
                    sums += np.bincount(code, minlength=len(sums))
                elif len(first):
                    out.append(pa.table(dict(zip(names, parts))).group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "n"]))
                    if sum(t.num_rows for t in out) > most_sums:
                        out = [pa.concat_tables(out).group_by(names).aggregate([("n", "sum")]).rename_columns([*names, "n"])]
            column_of[far] = 0
        if sums is not None:
            code = np.flatnonzero(sums)
            parts = []
            rest = code
            for _ in range(3):
                parts.insert(0, rest % 3 + 1)
                rest = rest // 3
            parts = [rest // (k * k), rest // k % k, rest % k, *parts]
            out = [pa.table(dict(zip(names, parts)) | {"n": sums[code]})]
        if not out:
            return shape.empty_table()
        whole = pa.concat_tables(out)
        for i, c in enumerate(names[:3]):
            whole = whole.set_column(i, c, pa.array(cells[whole[c].to_numpy()]))
        return whole.select([*names, "n"]).cast(shape)

    return count
