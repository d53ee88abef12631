"""Text formats of graphs and queries.

G-CARE dialect: `t # id` (ignored), `v id label*`, `e src dst label`. Subgraph-matching dialect: `v id label degree`, `e src
dst`; its data edges count both ways with label 0. A label of -1 is the wildcard: no label.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Pattern, PropertyGraph

GCARE, MATCHING = "gcare", "matching"


def _fields(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_graph(spark: SparkSession, path, dialect: str = GCARE) -> PropertyGraph:
    """A data graph; lines that are neither v nor e are passed over, file ids are kept. One scan for vertices, one for edges."""
    rows = _fields(spark, path)
    number = lambda i, kind: F.col("f")[i].cast(kind)
    labels = F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))) if dialect == GCARE else F.slice("f", 3, 1)
    vertices = rows.where(F.col("f")[0] == "v").select(number(1, "bigint").alias("id"), labels.cast("array<int>").alias("labels"))
    edges = rows.where(F.col("f")[0] == "e").select(number(1, "bigint").alias("src"), number(2, "bigint").alias("dst"), (F.array(number(3, "int")) if dialect == GCARE else F.array(F.lit(0))).alias("labels"))
    graph = PropertyGraph.of(vertices, edges)
    return graph if dialect == GCARE else graph.symmetric()


def parse_pattern(lines: Iterable[str], dialect: str = GCARE) -> Pattern:
    """A query graph: `v id label dataid`, `e src dst label`; in the other dialect `v id label degree`, `e src dst` one way with label 0."""
    out, number = Pattern(), {}
    edges = []
    for line in lines:
        f = line.split()
        if not f:
            continue
        if f[0] == "v":
            number[int(f[1])] = len(number)
            label = int(f[2]) if len(f) > 2 else None
            data = int(f[3]) if dialect == GCARE and len(f) > 3 else None
            out = out.add_vertex(label, None if data is None else [data])
        elif f[0] == "e":
            edges.append((int(f[1]), int(f[2]), (int(f[3]) if len(f) > 3 else None) if dialect == GCARE else 0))
    for src, dst, label in edges:
        out = out.add_edge(number[src], number[dst], label)
    return out


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file anywhere that Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_pattern(spark: SparkSession, path: str, dialect: str = GCARE) -> Pattern:
    return parse_pattern(_text(spark, path).splitlines(), dialect)


def parse_true_count(text: str) -> int:
    """The first number of the last line."""
    return int([line for line in text.splitlines() if line.strip()][-1].split()[0])


def read_true_count(spark: SparkSession, path: str) -> int:
    return parse_true_count(_text(spark, path))


def read_query_set(spark: SparkSession, queries: str, truths: str | None = None, dialect: str = GCARE, required: bool = False) -> list[dict]:
    """name, type, pattern and truth of each file under `queries`; truths are files of the same names. With
    `required`, queries without one are left out. Query files are small: their texts come to the driver."""
    from ..operators.metrics import query_type

    def texts(path: str) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        return files.withColumn("name", F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)?$", 1))

    rows = texts(queries)
    if truths:
        rows = rows.join(texts(truths).select("name", F.col("text").alias("truth")), "name", "inner" if required else "left")
    else:
        rows = rows.withColumn("truth", F.lit(None).cast("string"))
    return [{"name": r["name"], "type": query_type(r["path"]), "pattern": parse_pattern(r["text"].splitlines(), dialect), "truth": parse_true_count(r["truth"]) if r["truth"] else None} for r in rows.orderBy("name").collect()]


def write_graph(graph: PropertyGraph, path: str) -> None:
    """G-CARE text: a line for each vertex, and for each label of each edge."""
    v = graph.vertices.select(F.concat_ws(" ", F.lit("v"), F.col("id").cast("string"), F.array_join(F.col("labels").cast("array<string>"), " ")).alias("value")).select(F.rtrim("value").alias("value"))
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(-1)))
    e = graph.edges.select("src", "dst", F.explode(labels).alias("label")).select(F.concat_ws(" ", F.lit("e"), "src", "dst", "label").alias("value"))
    v.unionByName(e).write.mode("overwrite").text(path)


def write_pattern(pattern: Pattern) -> str:
    """G-CARE text of a query graph."""
    show = lambda x: str(-1 if x is None else x)
    v = [f"v {i} {show(x.label)} {show(min(x.ids) if x.ids else None)}" for i, x in enumerate(pattern.vertices)]
    e = [f"e {x.src} {x.dst} {show(x.label)}" for x in pattern.edges]
    return "\n".join(["t # 0", *v, *e]) + "\n"


def convert_graph(spark: SparkSession, source: str, target: str) -> None:
    """Subgraph-matching text to G-CARE text."""
    write_graph(read_graph(spark, source, MATCHING), target)


#: Datasets by name: dialect of their files. Paths are the caller's.
DATASETS = {
    "aids": GCARE, "human": GCARE, "lubm80": GCARE, "yago": GCARE,
    "yeast": MATCHING, "hprd": MATCHING, "wordnet": MATCHING, "dblp": MATCHING, "youtube": MATCHING, "patents": MATCHING, "eu2005": MATCHING,
}


def read_dataset(spark: SparkSession, name: str, folder: str) -> PropertyGraph:
    """A named dataset from `folder`/`name`.txt or .graph, by its dialect."""
    dialect = DATASETS[name]
    return read_graph(spark, f"{folder}/{name}.{'txt' if dialect == GCARE else 'graph'}", dialect)
