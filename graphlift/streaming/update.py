"""Summary maintenance from streams: each micro-batch is one update."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.summary import CellSummary
from ..operators.update import add_edges, add_vertices


_LAST = "kind string, number bigint"


class SummaryStream:
    """Keeps a summary up to date from streams of vertices and edges.

    With a `path`, each batch stores the summary together with the numbers of the last batches applied, as state-0, state-1, ...; a new object on the same path
    goes on from the last whole state, so with Spark's own checkpoint a restart loses no batch and a batch that Spark sends again counts once.
    """

    def __init__(self, summary: CellSummary, path: str | None = None):
        self.summary, self.path = summary, path
        self._last: dict[str, int] = {}
        self._state = -1
        self._lock = threading.Lock()  # streams of vertices and of edges may run at the same time
        if path:
            spark = summary.cell_card.sparkSession
            self._state = max(_states(spark, path), default=-1)
            if self._state >= 0:
                at = f"{path}/state-{self._state}"
                self.summary = CellSummary.load(spark, at)
                self._last = {r["kind"]: r["number"] for r in spark.read.schema(_LAST).json(f"{at}/last").collect()}

    def _apply(self, kind: str, change: Callable[[CellSummary, DataFrame], CellSummary]):
        def batch(df: DataFrame, number: int) -> None:
            with self._lock:
                if number <= self._last.get(kind, -1):
                    return
                summary, last = change(self.summary, df), self._last | {kind: number}
                if self.path:
                    spark = summary.cell_card.sparkSession
                    at = f"{self.path}/state-{self._state + 1}"
                    summary.save(at)
                    # written last: a state without it isn't whole
                    spark.createDataFrame(list(last.items()), _LAST).coalesce(1).write.mode("overwrite").json(f"{at}/last")
                    self._state += 1
                    summary = CellSummary.load(spark, at)
                self.summary, self._last = summary, last

        return batch

    def vertices(self, stream: DataFrame, **options):
        """Starts the query for stream(id, labels)."""
        return self._start(stream, "vertices", add_vertices, options)

    def edges(self, stream: DataFrame, **options):
        """Starts the query for stream(src, dst, labels)."""
        return self._start(stream, "edges", add_edges, options)

    def _start(self, stream: DataFrame, kind: str, change, options: dict):
        writer = stream.writeStream.foreachBatch(self._apply(kind, change)).trigger(availableNow=options.pop("available_now", True))
        for k, v in options.items():
            writer = writer.option(k, v)
        return writer.start()


def _states(spark, path: str) -> list[int]:
    """Numbers of the whole states under a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/last/_SUCCESS"))
    return [int(n[6:]) for n in names if n.startswith("state-") and n[6:].isdigit() and whole(n)]
