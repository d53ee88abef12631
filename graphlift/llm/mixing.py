"""Mixes sources to target weights.

Each source's tokens are laid out one after the other, documents in a fixed order, and cut into blocks of a fixed
length. Targets share the whole by weight, up to `max_repeat` times a source's own size. Each output shard
draws its sources' slots from a multinomial of its own, by (seed, shard) in any executor; running sums over the shards, scaled to the targets, make
totals the targets', so a shard's size differs from `shard_slots` by its draw's share of that correction. The k-th slot of a source takes block perm(k mod n) of its n blocks, where
perm is a keyed permutation of its own for each source and each pass over it (a Feistel network that walks until it is in range): no
table of permutations is kept, and no block is used again before all others of the source were. Slots and blocks are then joined by (source, index).

Only sources come to the driver, a row each, and are broadcast; more than `most_sources` are an error.

Null texts have size 0. Sources are ordered by code point, a null source last and of its own. Repeated rows count
as often as they stand there; documents of size 0 are in no block. Texts of any length are laid out whole, over as many blocks as it
takes. An empty table gives no rows. Other columns stay out of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

BLOCK = 64
#: Rows of a source are put in order within buckets of about so many, so no source is sorted by one task; so many buckets are summed at once.
BUCKET_ROWS = 4_000
UPPER = 1_000
#: Shards whose draws are put in order at once.
SHARDS = 4_096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _keys(seed: int, source: np.ndarray, epoch: np.ndarray, rounds: int = 6) -> list[np.ndarray]:
    from .vector import mix

    base = mix((source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (epoch.astype(np.uint64) << np.uint64(32)) ^ np.uint64(seed & 0xFFFFFFFF))
    return [mix(base + np.uint64(0xD1B54A32D192ED03 * (r + 1) & (1 << 64) - 1)) for r in range(rounds)]


def permuted(index: np.ndarray, n: np.ndarray, source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at `index`; every argument an array, element by element."""
    from .vector import mix

    n = n.astype(np.int64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(seed, source, epoch)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for k in keys:
            left, right = right, left ^ (mix(right + k[todo]) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo].astype(np.int64) >= n[todo]]  # a cycle leads back into the range
    return out.astype(np.int64)


def water_filled(sizes: list[int], weights: list[float], max_repeat: float = 3.0) -> list[float]:
    """Shares of the whole by weight; none above max_repeat times its size, the excess shared again by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > max_repeat * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            return out
        for i in over:
            out[i] = max_repeat * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def drawn(shards: DataFrame, slots: list[int], shard_slots: int, seed: int) -> DataFrame:
    """(shard, number, n) for the numbers in `shards`: each shard's own multinomial draw. A source also gets one in
    one shard, picked by a hash, so that the scaled sums have somewhere to put a source that no shard drew."""
    total = sum(slots)
    schema = frames.arrow_schema("shard bigint, number int, n bigint")

    def draw(batches):
        import pyarrow as pa

        from .vector import mix as _mixed

        share = np.array(slots, np.float64) / max(1, total)
        several = -(-total // shard_slots)
        home = (_mixed(np.arange(len(slots), dtype=np.uint64) + np.uint64(seed)) % np.uint64(max(1, several))).astype(np.int64)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng((seed, shard)).multinomial(min(shard_slots, total - shard * shard_slots), share) + (home == shard)
                counts[share == 0] = 0
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=schema)

    return frames.map_arrow(shards, draw, "shard bigint, number int, n bigint")


@dataclass
class Plan:
    """sources: order, name, size, weight, target and slots of each; small, as there are few sources."""

    sources: list[dict]
    shard_slots: int

    @property
    def shards(self) -> int:
        return -(-sum(s["slots"] for s in self.sources) // self.shard_slots)


def plan(sizes: list[tuple], weights, block: int, max_repeat: float, shard_slots: int) -> Plan:
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    w = weights([r[0] for r in rows])
    targets = water_filled([r[1] for r in rows], w, max_repeat)
    sources = [{"number": i, "source": r[0], "source_size": r[1], "blocks": -(-r[1] // block), "weight": float(w[i]), "target": targets[i], "slots": min(round(targets[i] * -(-r[1] // block) / r[1]), int(max_repeat) * -(-r[1] // block)) if r[1] else 0} for i, r in enumerate(rows)]
    return Plan(sources, shard_slots)


def cycling(sources: list) -> list[float]:
    """Weights 1, 2, 3, 1, 2, 3, ... in the sources' order."""
    return [float(1 + i % 3) for i in range(len(sources))]


def running(rows: DataFrame, group: str, bucket: str, within: list[str], value: str, before: str, total: str) -> DataFrame:
    """Adds the sums of `value` over the rows of the same group that come before, by bucket and then `within`, and over all of them.

    Buckets are summed first, UPPER of them at a time, so a group of any share of the rows is summed by many tasks.
    """
    of = Window.partitionBy(group)
    past = lambda w, by: w.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_upper", F.floor(F.col(bucket) / UPPER))
    uppers = sums.groupBy(F.col(group).alias("_g"), F.col("_upper").alias("_u")).agg(F.sum("_sum").alias("_whole"))
    uppers = uppers.select("_g", "_u", F.coalesce(F.sum("_whole").over(past(Window.partitionBy("_g"), ["_u"])), F.lit(0)).alias("_above"), F.sum("_whole").over(Window.partitionBy("_g")).alias(total))
    sums = sums.join(uppers, sums[group].eqNullSafe(uppers["_g"]) & (sums["_upper"] == uppers["_u"]))
    below = F.coalesce(F.sum("_sum").over(past(Window.partitionBy(group, "_upper"), [bucket])), F.lit(0))
    sums = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), (F.col("_above") + below).alias("_before"), total)
    rows = rows.join(sums, rows[group].eqNullSafe(sums["_g"]) & (rows[bucket] == sums["_b"]))
    own = F.coalesce(F.sum(value).over(past(Window.partitionBy(group, bucket), within)), F.lit(0))
    return rows.withColumn(before, F.col("_before") + own).drop("_g", "_b", "_before")


def laid_out(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds `size`, `source_size` and `start`, the first token's place among its source's. Order: a hash bucket, the key, the text's hash."""
    rows = docs.withColumn("size", size).withColumn("_digest", F.xxhash64(F.col(key), F.col(text)))
    rows = frames.written(rows.drop(text) if text != source else rows)
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod("_digest", F.lit(n)))
    return running(rows, source, "_bucket", [key, "_digest"], "size", "start", "source_size").drop("_bucket", "_digest")


def slots(spark, made: Plan, seed: int) -> DataFrame:
    """One row for each slot of the mix: shard, number (of the source), k (of its slots), block (its index)."""
    numbers = [s["slots"] for s in made.sources]
    draws = drawn(spark.range(made.shards).toDF("shard"), numbers, made.shard_slots, seed).withColumn("_bucket", F.floor(F.col("shard") / SHARDS))
    sums = running(draws, "number", "_bucket", ["shard"], "n", "_past", "_all")
    # a row for each source, their number checked
    table = F.broadcast(spark.createDataFrame([(s["number"], s["slots"], s["blocks"]) for s in made.sources], "number int, slots bigint, blocks bigint"))
    scaled = lambda x: F.expr(f"cast(({x}) as decimal(38,0)) * slots div _all")
    runs = sums.join(table, "number").select("shard", "number", "blocks", scaled("_past").alias("first"), scaled("_past + n").alias("next")).where(F.col("next") > F.col("first"))
    each = runs.select("shard", "number", "blocks", F.explode(F.sequence(F.col("first"), F.col("next") - 1)).alias("k"))

    @F.pandas_udf("bigint")
    def block(k: pd.Series, blocks: pd.Series, number: pd.Series) -> pd.Series:
        n = blocks.to_numpy()
        return pd.Series(permuted(k.to_numpy() % n, n, number.to_numpy(), k.to_numpy() // n, seed))

    return each.repartition(F.col("shard")).withColumn("block", block("k", "blocks", "number"))


def mix(docs: DataFrame, weights=cycling, max_repeat: float = 3.0, block: int = BLOCK, shard_slots: int = 1 << 14, seed: int = 20_011, most_sources: int = 100_000, source: str = "source", key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Plan]:
    """(documents with size, source_size, target and taken; the mix's slots; the plan).

    `taken` is how many words of the document the mix holds, repeats counted.
    """
    spark = docs.sparkSession
    names = list(dict.fromkeys([key, source, *keep]))
    rows = frames.written(laid_out(docs.select(*names, *([text] if text not in names else [])), word_count(text), source, key, text))
    sizes = [(r[0], r[1] or 0) for r in rows.groupBy(source).agg(F.sum("size")).limit(most_sources + 1).collect()]
    if len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    made = plan(sizes, weights, block, max_repeat, shard_slots)
    table = spark.createDataFrame([(s["number"], s["source"], s["target"]) for s in made.sources], "number int, _s string, target double")
    table = F.broadcast(table)  # a row for each source, their number checked
    rows = rows.join(table, rows[source].cast("string").eqNullSafe(table["_s"])).drop("_s")
    every = slots(spark, made, seed)
    uses = every.groupBy("number", "block").agg(F.count("*").alias("uses"))
    full = rows.where(F.col("size") > 0)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = full.select("number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = parts.join(uses, ["number", "block"]).groupBy("number", "start").agg(F.sum(F.col("uses") * inside).alias("_taken"))
    taken = taken.select(F.col("number").alias("_n"), F.col("start").alias("_at"), "_taken")
    found = rows.join(taken, (rows["number"] == taken["_n"]) & (rows["start"] == taken["_at"]) & (rows["size"] > 0), "left")
    return found.withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("bigint")).drop("_n", "_at", "_taken"), every, made


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    found, _, _ = mix(frames.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
