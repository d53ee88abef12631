"""Spark helpers of the operators: reading, held-out rows, checkpoints in the shared folder, compressed chunks of texts."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20


#: Arrow batches hold so many bytes at most, unless the session says otherwise; Spark's own limit is 64 MB.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. Long texts make batches of the default size large on both sides of the pipe, so they are cut by bytes."""
    if spark.conf.get(BATCH) == "67108864b":
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """The name, with as many signs more as it takes that df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(columns: list[str], added: list[str]) -> list[str]:
    """The columns but those that have the name of an added one: an operator's own column takes the place of such a column, as in withColumn()."""
    names = {c.lower() for c in added}
    return [c for c in columns if c.lower() not in names]


def fold(column: str, n: int):
    """crc32 of a column as text, modulo n; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); a local one of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """Writes df to the shared folder as Parquet, in so many files at most, and reads it again: later jobs neither repeat its work nor need
    the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(batches):
    """Passes on an iterator's batches; at its end this worker, which Spark keeps for later tasks, gives unused memory back to the system."""
    yield from batches
    release()


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(function):
    """A function of one group whose memory goes back to the system after each group; for groups of some MB."""

    def run(table):
        try:
            return function(table)
        finally:
            release()

    return run


def tidy_pair(function):
    """As tidy(), for cogrouped tables."""

    def run(left, right):
        try:
            return function(left, right)
        finally:
            release()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(), whose workers give their memory back at each task's end."""
    return df.mapInArrow(lambda batches: freed(function(batches)), schema)


def strings(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunk_count(docs: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    """So many chunks that each has about chunk_bytes of text. One scan of lengths."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


def chunked(docs: DataFrame, n_chunks: int, keep: list[str], column: str = "text") -> DataFrame:
    """(chunk int, block binary): the rows dealt evenly over n_chunks by a hash of the row, each block a compressed list of rows.

    A row goes by its key and text, so one hot source or null key spreads over all chunks, and a
    rerun deals in the same way. Compression before the exchange keeps it under half of the text.
    """
    key = F.pmod(F.xxhash64(*keep, column), F.lit(n_chunks)).cast("int")
    rows = docs.select(key.alias("chunk"), *keep, F.col(column).alias("_text"))

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        size = 0

        def flush():
            out = [(c, squeeze.compress(pickle.dumps(list(zip(*rows, strict=True)), 4))) for c, rows in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["chunk", "block"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in keep]
            for c, text, *rest in zip(batch.column("chunk").to_pylist(), strings(batch.column("_text")), *cols, strict=True):
                held.setdefault(c, []).append((text, *rest))
                size += len(text)
            if size > 64 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    return map_arrow(rows, pack, "chunk int, block binary")


def unpack_rows(blocks: list[bytes]) -> list[list]:
    """Columns (texts, then the kept ones) of all rows of the blocks."""
    import zstandard

    out: list[list] = []
    for b in blocks:
        cols = pickle.loads(zstandard.decompress(b))
        if not out:
            out = [[] for _ in cols]
        for have, more in zip(out, cols, strict=True):
            have.extend(more)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    """Made on the driver: executors can't parse DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_fields(df: DataFrame, ddl: str):
    """df's schema and more fields; df keeps its own (StructType.add changes the schema that it is called on)."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def as_table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
