"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, VERTEX_SCHEMA, PropertyGraph, merge_labels


def new_path(spark) -> str:
    """A fresh path in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # only in tests
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


#: Stored tables: numbers in sorted rows as differences, under zstd, a quarter of Spark's default.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2", **{f"parquet.enable.dictionary#{c}": "false" for c in ("id", "src", "dst")}}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark):
    """Jobs inside leave no shuffle files when they end: for what is written and read again, whose exchanges nobody reads later."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under spark.checkpoint.dir and reads it again: later jobs don't repeat its work, and no lost executor can take it away."""
    path = new_path(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**COMPACT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of so many vertices at most goes whole to each executor, some 50 to 100 bytes for each; edges that join it aren't exchanged then.
MOST_SENT = 500_000


def sent_whole(vertices: DataFrame) -> DataFrame:
    """A table of a row for each vertex, stored, to be joined with edges: marked for broadcast if it has MOST_SENT rows at most."""
    return F.broadcast(vertices) if vertices.count() <= MOST_SENT else vertices


def stored(graph: PropertyGraph, path: str | None = None) -> PropertyGraph:
    """The graph as Parquet: vertices, edges, and the edges once more in a folder for each label, so that a labelled edge of a pattern reads its slice alone."""
    path = path or new_path(graph.edges.sparkSession)
    return _stored(lambda edges: graph.vertices, graph.edges, path)


def stored_rows(vertices: DataFrame, edges: DataFrame, vertex_labels=None, edge_labels=None, path: str | None = None) -> PropertyGraph:
    """stored(PropertyGraph.of(vertices, edges)), but edges are merged once: their ends are read from what was written. *_labels: all labels there are, if they are few."""

    def merged(written_edges: DataFrame) -> DataFrame:
        ends = written_edges.select(F.col("src").alias("id")).unionByName(written_edges.select(F.col("dst").alias("id"))).distinct()
        return merge_labels(vertices.select("id", "labels").unionByName(ends.select("id", F.array().cast("array<int>").alias("labels"))), ["id"], vertex_labels)

    return _stored(merged, merge_labels(edges.select("src", "dst", "labels"), ["src", "dst"], edge_labels), path or new_path(edges.sparkSession))


def _stored(vertices, edges: DataFrame, path: str) -> PropertyGraph:
    """Rows are sorted within their files, and each table's exchange is dropped once it is written: at no time are there two."""
    spark = edges.sparkSession

    def write(df: DataFrame, name: str, *order: str, by: tuple[str, ...] = ()) -> None:
        with shuffles_dropped(spark):
            df.sortWithinPartitions(*by, *order).write.mode("overwrite").options(**COMPACT).partitionBy(*by).parquet(f"{path}/{name}")

    write(edges, "edges", "src", "dst")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")
    write(vertices(edges), "vertices", "id")
    write(edges.select("src", "dst", F.explode("labels").alias("label")), "by_label", "src", "dst", by=("label",))
    return opened(spark, path)


def opened(spark, path: str) -> PropertyGraph:
    """A graph that stored() wrote."""
    schema = "src bigint, dst bigint, label int"
    return PropertyGraph(spark.read.schema(VERTEX_SCHEMA).parquet(f"{path}/vertices"), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"), spark.read.schema(schema).parquet(f"{path}/by_label"))
