"""N-gram Jaccard join by chosen paths.

Each text becomes a set of word shingles; texts with equal sets become one node. In each of several runs a
node follows a path: it goes to the bucket of its smallest token under a hash of the path's own, and a bucket that is still too
large is split again, on one or two more sampled tokens. Two sets of similarity s share a sampled token
with probability s, so true pairs mostly stay together and others part. Small buckets are compared by brute
force on 64-value signatures; runs repeat until a pair at the threshold is missed with a probability
under 1 - recall, even if all its buckets are split to the deepest level. Buckets that stay too large are compared block by block, all blocks with all, so nothing is dropped.

Pairs so found only have to hold together what belongs together: the connected parts are then verified with
exact sets, all pairs within a part, which gives exact links and classes. Pairs aren't written
out: a bucket emits a spanning forest, a block its members' link counts. Blocks are cut by rows and by tokens, so that two of them fit in a task's memory
whatever their sets' sizes; a single set must fit.

Words and shingles are 64-bit hashes, sets are named by 128 bits; two different shingles of a part share a hash with a chance of one in 2^64 a pair.

Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased. A text of fewer words than a shingle has
one shingle of all its words. Texts without a word (null, empty) are linked to nothing and are each
a class of their own. Repeated rows are copies of each other. Texts are taken whole, of any length. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, vector
from .components import components

U64 = np.uint64
SIGNATURE = 64
_MUL = vector.mix(np.arange(1, SIGNATURE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_XOR = vector.mix(np.arange(101, SIGNATURE + 101, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Bits of the fixed-size map of nodes that need their exact sets: 4 MB, whatever the input.
MAP_BITS = 1 << 25
#: Columns of the bit rows that are compared at once.
TILE = 1 << 17
_MAP_PART = 1 << 15


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    out: list[np.ndarray] = []
    for a, b in vector.groups(texts):
        split = vector.Words(texts[a:b])
        h = split.hashes()
        n = max(0, len(h) - words + 1)
        turn = [vector.mix(np.array([7 * i + 3], U64))[0] | U64(1) for i in range(words)]
        whole = np.zeros(n, U64)
        for i in range(words):
            whole += h[i : i + n] * turn[i]
        whole = vector.mix(whole)
        first = split.first.tolist()
        for i, j in zip(first[:-1], first[1:], strict=True):
            if j - i >= words:
                out.append(np.unique(whole[i : j - words + 1]))
            elif j > i:
                few = h[i:j] * np.array(turn[: j - i], U64)
                out.append(vector.mix(np.array([few.sum() ^ U64(j - i)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set; empty for the empty set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest hashes of each set under 64 hash functions; zeros for an empty set."""
    out = np.zeros((len(sets), SIGNATURE), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + len(sets[full[to]]) <= 200_000):
            size += len(sets[full[to]])
            to += 1
        part = [sets[i] for i in full[at:to]]
        flat = np.concatenate(part)
        first = np.concatenate(([0], np.cumsum([len(s) for s in part])[:-1]))
        for j in range(SIGNATURE):
            out[full[at:to], j] = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], first) >> U64(32)
        at = to
    return out


def runs_for(recall: float, threshold: float, depth: int = 2) -> int:
    """Runs after which a pair at the threshold, split `depth` times, is missed with probability 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _profiles(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, node (128-bit name of the set), size, signature for every row."""
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, node binary, size int, signature array<int>"
    schema = frames.arrow_schema(ddl)

    def profile(batches):
        for batch in batches:
            texts = frames.strings(batch.column(1))
            sets = shingle_sets(texts, words)
            sign = signatures(sets).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SIGNATURE, pa.int32()), pa.array(sign.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), lists.cast(schema.field(3).type)], schema=schema)

    return frames.map_arrow(docs.select(key, text), profile, ddl)


def _leaves(nodes: DataFrame, runs: int, levels: int, limit: int) -> DataFrame:
    """(path, node): members of the buckets to be compared, two at least in each; large ones that can't be split further come as pairs of blocks."""
    starts = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.element_at("signature", r % SIGNATURE + 1)).alias("path")) for r in range(runs)])
    rows = nodes.select("node", F.explode(starts).alias("p")).select("node", "p.run", "p.path")
    out = []
    for level in range(levels):
        # dealt again: then both sides of the join are plain shuffles, of which AQE can split a hot path's
        sizes = rows.groupBy("path").agg(F.count("*").alias("members")).where(F.col("members") > 1).repartition("path")
        rows = frames.written(rows.join(sizes, "path"))
        out.append(rows.where(F.col("members") <= limit).select("path", "node"))
        rows = rows.where(F.col("members") > limit)
        if level == levels - 1 or rows.limit(1).count() == 0:
            break
        signed = rows.join(nodes.select("node", "signature"), "node")
        # a hash function of the path's own: with one for all paths of a level, runs would fail together
        value = lambda branch: F.element_at("signature", F.pmod(F.xxhash64("path", F.lit("token"), F.lit(branch)), F.lit(SIGNATURE)).cast("int") + 1)
        # one sampled token and, for one path in four, another: 1 / 0.8 of them on the average
        second = F.pmod(F.col("path"), F.lit(4)) == 0
        steps = F.array(F.xxhash64("path", F.lit(0), value(0)), F.when(second, F.xxhash64("path", F.lit(1), value(1))))
        rows = signed.select("node", "run", F.explode(steps).alias("path")).where(F.col("path").isNotNull())
    else:
        return out[0]
    blocks = F.ceil(F.col("members") / limit).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    rest = rows.select("path", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rest = rest.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "node")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0].unionByName(rest)


def _forest(names: list[bytes], sign: np.ndarray, sizes: np.ndarray, threshold: float, least: int) -> list[tuple[bytes, bytes]]:
    """Edges that span the likely pairs: each found node is compared with those that aren't found yet."""
    order = np.argsort(np.array(names, object))
    sign, sizes = sign[order], sizes[order]
    left = np.arange(len(names))
    edges = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            p = stack.pop()
            near = np.flatnonzero((np.minimum(sizes[left], sizes[p]) >= threshold * np.maximum(sizes[left], sizes[p]) - 1e-9))
            hit = near[(sign[left[near]] == sign[p]).sum(axis=1) >= least]
            if len(hit):
                found = left[hit]
                stack.extend(found.tolist())
                edges.extend((names[order[q]], names[order[p]]) for q in found.tolist())
                left = np.delete(left, hit)
    return edges


def _candidates(nodes: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    sigma = math.sqrt(threshold * (1 - threshold) / SIGNATURE)
    least = max(1, math.floor(SIGNATURE * (threshold - 5 * sigma)))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        sign = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(names), SIGNATURE)
        edges = _forest(names, sign, table.column("size").to_numpy(), threshold, least)
        return pa.table([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], schema=schema)

    rows = leaves.join(nodes.select("node", "size", "signature"), "node")
    return rows.select("path", "node", "size", "signature").groupBy("path").applyInArrow(compare, "a binary, b binary")


def _bitmap(members: DataFrame) -> np.ndarray:
    """MAP_BITS bits with those of the members' hashes set. A full map lets every node through, and the result is the same."""
    place = F.pmod(F.xxhash64("node"), F.lit(MAP_BITS))
    parts = members.select(F.floor(place / _MAP_PART).alias("part"), (place % _MAP_PART).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    # 4 MB at any size, by one job: an iterator runs a job for each partition
    for r in parts.collect():
        out[r["part"] * (_MAP_PART // 8) : (r["part"] + 1) * (_MAP_PART // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sets(docs: DataFrame, profiles: DataFrame, members: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(node, tokens): the packed exact set of each member, and of few others."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(members).tobytes())  # 4 MB at any size
    schema = pa.schema([("node", pa.binary()), ("place", pa.int64()), ("tokens", pa.binary())])

    def sets(batches):
        seen: set[bytes] = set()
        for batch in batches:
            found = shingle_sets(frames.strings(batch.column(0)), words)
            rows = []
            for s in found:
                k = set_key(s)
                if k and k not in seen and _may_hold(bits.value, k):
                    seen.add(k)
                    rows.append((k, vector.pack_keys(s)))
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([0] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    every = frames.map_arrow(docs.select(text), sets, "node binary, place bigint, tokens binary")
    return every.groupBy("node").agg(F.first("tokens").alias("tokens"))


def _may_hold(bits: bytes, node: bytes) -> bool:
    place = _xxhash64(node) % MAP_BITS
    return bool(bits[place >> 3] >> (place & 7) & 1)


def _xxhash64(data: bytes) -> int:
    """Spark's xxhash64() of one binary value."""
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=42)


def _verify(members: DataFrame, sets: DataFrame, threshold: float, block: int, block_tokens: int) -> DataFrame:
    """(node, links, other): exact links of each member with the rest of its part, counted with copies, and an edge of the forest of true pairs."""
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("tokens_all")).repartition("root")
    rows = members.join(sizes, "root")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("tokens_all") / block_tokens)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("verify")), blocks).cast("int")
    rows = rows.withColumn("own", own).join(sets, "node")
    rows = rows.select("node", "copies", "tokens", "root", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "copies", "own", "tokens")
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def verify(table: pa.Table) -> pa.Table:
        names = table.column("node").to_pylist()
        copies, own = table.column("copies").to_numpy(), table.column("own").to_numpy()
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets_ = [vector.unpack_keys(b) for b in table.column("tokens").to_pylist()]
        links, parent = links_of(sets_, copies, own if cross else None, threshold)
        return pa.table([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array([names[p] for p in parent], pa.binary())], schema=schema)

    return rows.groupBy("root", "i", "j").applyInArrow(verify, "node binary, links bigint, other binary")


def links_of(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[int]]:
    """All pairs by exact intersections on bit rows; with `own`, pairs across the two blocks alone. Returns
    each set's linked copies and its parent in a forest of linked sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    row = np.repeat(np.arange(m), sizes)
    keep = shared[place]
    links = np.zeros(m, np.int64)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # in tiles of columns, so that memory goes with the rows alone
    both = np.zeros((m, m), np.int32)
    order = np.argsort(column[keep], kind="stable")
    row_of, column_of = row[keep][order], column[keep][order]
    for low in range(0, int(shared.sum()), TILE):
        a, b = np.searchsorted(column_of, [low, low + TILE])
        width = min(TILE, int(shared.sum()) - low) // 64 + 1
        bits = np.zeros((m, width), U64)
        at = column_of[a:b] - low
        # a set has each token once, so adding bits sets them
        np.add.at(bits.ravel(), row_of[a:b] * width + at // 64, U64(1) << (at % 64).astype(U64))
        for i in range(m - 1):
            rest = slice(i + 1, m) if own is None else np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
            both[i, rest] += np.bitwise_count(bits[rest] & bits[i]).sum(axis=1, dtype=np.int32)
    for i in range(m - 1):
        rest = np.arange(i + 1, m)
        ok = np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9
        if own is not None:
            ok &= own[rest] != own[i]
        rest = rest[ok]
        if not len(rest):
            continue
        common = both[i, rest].astype(np.int64)
        # common / (a + b - common) >= t, as integers would compare
        hit = rest[common >= threshold * (sizes[rest] + sizes[i] - common) - 1e-9]
        if len(hit):
            links[i] += copies[hit].sum()
            links[hit] += copies[i]
            r = root(i)
            for j in hit.tolist():
                q = root(j)
                if q != r:
                    parent[max(q, r)] = min(q, r)
                    r = min(q, r)
    return links, [root(i) for i in range(m)]


def join(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, limit: int = 4096, levels: int = 4, block: int = 1024, block_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, class_id (the least key of its connected class), n_links (other rows at
    `threshold` or more), n_copies (rows with the same shingles, itself among them), n_shingles."""
    profiles = frames.written(_profiles(docs, key, text, words))
    nodes = frames.written(profiles.where(F.col("size") > 0).groupBy("node").agg(F.first("size").alias("size"), F.first("signature").alias("signature"), F.count("*").alias("copies"), F.min(key).alias("least")))
    leaves = _leaves(nodes, runs_for(recall, threshold, levels), levels, limit)
    parts = components(_candidates(nodes, leaves, threshold))
    members = frames.written(parts.join(nodes.select("node", "copies", "size"), "node"))
    verified = frames.written(_verify(members, _sets(docs, profiles, members, key, text, words), threshold, block, block_tokens))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "copies", "least").join(links, "node", "left").join(classes, "node", "left")
    known = known.select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    first = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(first, "root").select(F.col("node").alias("_node"), "class_id", "copies", "links")
    rows = profiles.select(key, "node", "size")
    found = rows.join(known, rows["node"] == known["_node"], "left")
    alone = F.col("size") == 0
    return found.select(
        key,
        F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("bigint").alias("n_copies"),
        F.col("size").cast("bigint").alias("n_shingles"),
    )


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(frames.read(spark, sf_dir, "documents"))


#: All pairs that share a shingle, compared exactly; classes by following links.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0
), s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM g GROUP BY 1
), c AS (SELECT name, count(*) AS copies FROM s GROUP BY 1
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT p.a, p.b FROM pairs p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE p.n >= 0.8 * (x.n + y.n - p.n) - 1e-9
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS class_id, (SELECT count(*) FROM e WHERE e.a = w.doc_id)::BIGINT AS n_links,
  coalesce(c.copies, 1)::BIGINT AS n_copies, coalesce(s.n, 0)::BIGINT AS n_shingles
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (name)
"""
