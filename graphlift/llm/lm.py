"""Language-model scores by a weighted backoff automaton.

The smoothed model of order k (3 by default): P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) for a word alone; for a context h of
1 to k - 1 words with absolute discount D, over the n-grams h w seen min_count times or more in training,

    P(w | h) = (c(h w) - D) / c(h) + r(h) P(w | h')   for such an n-gram, r(h) P(w | h') for any other,
    r(h) = 1 - sum over them of (c(h w) - D) / c(h),

where h' is h without its first word, so each state's probabilities sum to 1. As an automaton: a state for each word seen
in training and each kept n-gram of up to k - 1 words (a text's start counts as a word of contexts), an arc for each
kept n-gram with log10 P(w | h), a failure arc from h to h' with log10 r(h), at the root an arc with log10 P(w) for any token.
A text is walked from left to right: the state before a token is the longest kept suffix read so far; the walk
takes the token's arc, or failure arcs down to the first state that has one, and adds the weights.

On the cluster: texts are dealt into chunks, and one exchange of them serves all rounds. In each round chunks send the hashes of
their distinct n-grams, with counts, to range buckets of the hash space; the buckets add up and answer each chunk about its own, as bits and
counts in the order asked. An n-gram is asked for only if both shorter ones that it is made of were kept (else it can't be). Then chunks
send what each kept n-gram adds to its context, one chunk for each n-gram, to the bucket that knows the context.
All counts cover every training text. Messages are as many as chunks times buckets, but no more than
chunks times their distinct n-grams; larger chunks make fewer and longer ones (16 MB of text have 1.7 million).

N-grams are named by 64-bit hashes: of n distinct ones about n^2 / 2^65 pairs share a name and are counted as one.

Tokens: runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased, then one end. Null texts count
as empty (the end alone); a null key is a training row. Repeated rows count and are scored each. Texts are taken whole; a
text longer than chunk_bytes makes its chunk as much longer. Other columns are ignored, whatever their names. An empty table gives no rows.
No training rows at all: N = V = 0 and every score is the base score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, vector

U64 = np.uint64
START, END = U64(0x5354415254000001), U64(0x454E440000000003)
#: Rows between chunks and buckets; level is the n-grams' n, or 0 for the totals N and V.
_MESSAGE = "to int, sender int, level int, n int, a binary, b binary, c binary"
_SCHEMA = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("level", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _longer(prefix: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Names of n-grams from those of their prefixes and their last tokens."""
    return vector.mix((prefix * U64(0x9DDFEA08EB382D69)) ^ token)


def _first_of_runs(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


class Level:
    """The distinct n-grams of a chunk for one n: sorted names, training counts, a place of each; once answered, which are kept."""

    def __init__(self, names: np.ndarray, at: np.ndarray, learn: np.ndarray):
        order = np.argsort(names)
        ordered = names[order]
        new = _first_of_runs(ordered)
        first = np.flatnonzero(new)
        self.names, self.at, self.place = ordered[first], at, at[order[first]]
        self.number = np.empty(len(names), np.int32)
        self.number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.train = np.bincount(self.number, learn[at], len(first)).astype(np.uint32)
        self.node = np.full(len(learn), -1, np.int32)
        self.kept = self.own = self.counts = np.zeros(0, np.int64)

    def answered(self, kept: np.ndarray, counts: np.ndarray, own: np.ndarray) -> None:
        """kept: which names are; counts of the kept ones over all training texts; own: which of these this chunk reports to their contexts."""
        index = np.where(kept, np.cumsum(kept, dtype=np.int32) - np.int32(1), np.int32(-1))
        self.node[self.at] = index[self.number]
        self.kept, self.counts, self.own = np.flatnonzero(kept), counts, np.flatnonzero(own)


class Chunk:
    """Texts as tokens [START, words..., END] end to end, and their n-grams level by level."""

    def __init__(self, texts: list[bytes], train: list[bool]):
        parts, counts = [], []
        for a, b in vector.groups(texts):
            words = vector.Words(texts[a:b])
            parts.append(words.hashes())
            counts.append(words.counts())
        self.sizes = (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + 2
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.tokens = np.empty(int(first[-1]), U64)
        inner = np.ones(len(self.tokens), bool)
        inner[first[:-1]] = inner[first[1:] - 1] = False
        if parts:
            self.tokens[inner] = np.concatenate(parts)
        self.tokens[first[:-1]], self.tokens[first[1:] - 1] = START, END
        self.offset = (np.arange(len(self.tokens)) - np.repeat(first[:-1], self.sizes)).astype(np.int32)
        self.learn = np.repeat(np.array(train, bool), self.sizes)
        self.names = self.tokens.copy()
        self.levels = {1: Level(self.tokens, np.arange(len(self.tokens), dtype=np.int32), self.learn)}
        self.levels[1].node = self.levels[1].number

    def grow(self, n: int) -> Level:
        """The n-grams that may be kept: both (n - 1)-grams in them are, and they lie within a text. `names` holds those of the longest n-gram that ends at a place."""
        held = self.levels[n - 1].node >= 0
        at = np.flatnonzero(held[1:] & held[:-1] & (self.offset[1:] >= n - 1)).astype(np.int32) + np.int32(1)
        fresh = _longer(self.names[at - 1], self.tokens[at])
        self.names[at] = fresh
        self.levels[n] = Level(fresh, at, self.learn)
        return self.levels[n]

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each kept n-gram as a context: counts and number of the kept n-grams after it that this chunk reports."""
        down, up = self.levels[n], self.levels[n + 1]
        context = down.node[up.place[up.kept[up.own]] - 1]
        m = len(down.names) if n == 1 else len(down.kept)
        return np.bincount(context, up.counts[up.own], m).astype(np.int64), np.bincount(context, minlength=m).astype(np.int64)

    def take(self, table: pa.Table, n: int) -> None:
        """Level n as the buckets answered it; they answer in the order of names."""
        own = table.filter(pc.equal(table.column("level"), n)).sort_by("sender")
        level = self.levels[n]
        counts = np.concatenate([vector.unpack_array(x, np.uint32).astype(np.int64) for x in own.column("a").to_pylist()] or [np.zeros(0, np.int64)])
        if n == 1:
            level.counts = counts
            return
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=m).astype(bool) for x, m in zip(own.column("b").to_pylist(), own.column("n").to_pylist(), strict=True)]
        kept = np.concatenate(bits or [np.zeros(0, bool)])
        mine = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(k.sum())).astype(bool) for x, k in zip(own.column("c").to_pylist(), bits, strict=True)]
        level.answered(kept, counts, np.concatenate(mine or [np.zeros(0, bool)]))


class Automaton:
    """Weights of arcs and failure arcs for a chunk's n-grams: log10, by level."""

    def __init__(self, chunk: Chunk, sums: dict[int, tuple[np.ndarray, np.ndarray]], total: int, distinct: int, discount: float):
        self.chunk = chunk
        self.order = len(sums) + 1
        counts = chunk.levels[1].counts
        self.root = np.log10(counts + 0.5) - np.log10(total + 0.5 * (distinct + 1))
        # a context without kept n-grams fails at no cost
        rest = {n: 1 - (s - discount * k) / np.maximum(chunk.levels[n].counts, 1) for n, (s, k) in sums.items()}
        self.fail = {n: np.log10(r) for n, r in rest.items()}
        self.arc: dict[int, np.ndarray] = {}
        for n in range(2, self.order + 1):
            level, down = chunk.levels[n], chunk.levels[n - 1]
            place = level.place[level.kept]
            context, shorter = down.node[place - 1], down.node[place]
            below = self.root[shorter] if n == 2 else self.arc[n - 1][shorter]
            self.arc[n] = np.log10((level.counts - discount) / down.counts[context] + rest[n - 1][context] * 10**below)

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base score, score, known tokens) of each text. Every place starts from its state, the longest kept suffix before
        it, and falls through failure arcs until it finds an arc for its token."""
        chunk = self.chunk
        left = scored = np.flatnonzero(chunk.offset > 0)
        weight = np.zeros(len(chunk.tokens))
        word = chunk.levels[1].node
        for n in range(self.order, 1, -1):
            state = chunk.levels[n - 1].node[left - 1]
            here = state >= 0 if n > 2 else chunk.levels[1].counts[state] > 0
            at, state = left[here], state[here]
            arc = chunk.levels[n].node[at]
            found = arc >= 0
            weight[at[found]] += self.arc[n][arc[found]]
            weight[at[~found]] += self.fail[n - 1][state[~found]]
            here[here] = found
            left = left[~here]
        weight[left] += self.root[word[left]]
        first = np.concatenate(([0], np.cumsum(chunk.sizes - 1)))
        known = (chunk.levels[1].counts > 0).astype(np.int64)
        word = word[scored]
        return vector.row_sums(self.root[word], first), vector.row_sums(weight[scored], first), vector.row_sums(known[word], first)


def _cuts(names: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted names for n equal ranges of the hash space."""
    limits = np.array([-(-(b << 64) // n) for b in range(1, n)], U64)
    at = np.concatenate(([0], np.searchsorted(names, limits), [len(names)]))
    return [(b, int(at[b]), int(at[b + 1])) for b in range(n) if at[b + 1] > at[b]]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _rebuilt(left: pa.Table, answers: pa.Table | None, levels: int) -> tuple[Chunk, list]:
    """A chunk with its answered levels, and the keys of its rows."""
    texts, keys, train = frames.unpack_rows(left.column("block").to_pylist())
    chunk = Chunk(texts, train)
    del texts
    for n in range(1, levels + 1) if answers is not None else ():
        if n > 1:
            chunk.grow(n)
        chunk.take(answers, n)
    return chunk, [keys, train]


def _asks(chunk: Chunk, sender: int, levels: list[int], buckets: int) -> pa.Table:
    rows = []
    for n in levels:
        level = chunk.levels[1] if n == 1 else chunk.grow(n)
        rows.extend((b, sender, n, j - i, vector.pack_keys(level.names[i:j]), vector.pack_array(level.train[i:j]), b"") for b, i, j in _cuts(level.names, buckets))
    return _table(rows)


def _gathered(table: pa.Table, n: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of level n, by sender: senders, what each sent (names and counts); the distinct names and their whole counts."""
    table = table.filter(pc.equal(table.column("level"), n)).sort_by("sender")
    sent = [vector.unpack_keys(x) for x in table.column("a").to_pylist()]
    counts = [vector.unpack_array(x, np.uint32).astype(np.int64) for x in table.column("b").to_pylist()]
    every, part = np.concatenate(sent or [np.zeros(0, U64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(_first_of_runs(every))
    return table.column("sender").to_pylist(), sent, counts, every[first], np.add.reduceat(part[order], first) if len(first) else first


def _levels_in(table: pa.Table) -> list[int]:
    return sorted(set(table.column("level").to_pylist()))


def _answer(min_count: int):
    def answer(table: pa.Table) -> pa.Table:
        bucket, rows = table.column("to")[0].as_py(), []
        for n in _levels_in(table):
            senders, sent, counts, names, total = _gathered(table, n)
            kept, owned = total >= min_count, np.zeros(len(names), bool)
            for chunk, own, train in zip(senders, sent, counts, strict=True):
                at = np.searchsorted(names, own)
                if n == 1:
                    rows.append((chunk, bucket, n, len(own), vector.pack_array(total[at].astype(np.uint32)), b"", b""))
                    continue
                mine = kept[at]
                first = mine & (train > 0) & ~owned[at]  # the first chunk that learned it reports it
                owned[at[first]] = True
                rows.append((chunk, bucket, n, len(own), vector.pack_array(total[at[mine]].astype(np.uint32)), np.packbits(mine).tobytes(), np.packbits(first[mine]).tobytes()))
        return _table(rows)

    return answer


def _share(table: pa.Table) -> pa.Table:
    """A bucket's part of N and V."""
    _, _, _, names, total = _gathered(table, 1)
    total = total[names != START]
    return pa.table([pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], ["total", "distinct"])


def _summed(min_count: int):
    """What all chunks report about the contexts that a bucket knows (left: what they asked, right: what they report)."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        bucket = right.column("to")[0].as_py() if right.num_rows else None
        for n in _levels_in(right):
            senders, sent, _, names, total = _gathered(left, n)
            kept = np.ones(len(names), bool) if n == 1 else total >= min_count
            place = {}
            for chunk, own in zip(senders, sent, strict=True):
                at = np.searchsorted(names, own)
                place[chunk] = at[kept[at]]
            both = np.zeros((2, len(names)), np.int64)
            reports = right.filter(pc.equal(right.column("level"), n))
            for chunk, blob in zip(reports.column("sender").to_pylist(), reports.column("a").to_pylist(), strict=True):
                both[:, place[chunk]] += vector.unpack_array(blob, np.int64).reshape(2, -1)
            rows.extend((chunk, bucket, -n, len(at), vector.pack_array(both[:, at].ravel()), b"", b"") for chunk, at in place.items() if len(at))
        return _table(rows)

    return add


def score(docs: DataFrame, train, order: int = 3, min_count: int = 2, discount: float = 0.75, key: str = "doc_id", text: str = "text", chunk_bytes: int = frames.CHUNK_BYTES) -> DataFrame:
    """Scores every text under the automaton learned from the rows where `train` holds (a Column; null: no).

    Returns key, train, n_tokens, n_known, train_tokens, vocabulary, base_score, score. min_count
    prunes rare n-grams of two words and more, at every size alike; the root has all words.
    """
    n = frames.chunk_count(docs, text, chunk_bytes)
    # one number for all that is dealt by chunk: then neither the texts nor an answer is sent twice
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(text).alias("_body"))
    chunks = frames.chunked(rows, n, ["_key", "_train"], "_body").repartition(parts, "chunk").groupBy("chunk")

    def ask(left: pa.Table, answers: pa.Table | None, known: int, levels: list[int]) -> pa.Table:
        if not left.num_rows:
            return _table([])
        chunk, _ = _rebuilt(left, answers, known)
        return _asks(chunk, left.column("chunk")[0].as_py(), levels, n)

    def report(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        chunk, _ = _rebuilt(left, answers, order)
        sender, out = left.column("chunk")[0].as_py(), []
        for k in range(1, order):
            both, level = np.stack(chunk.sums(k)), chunk.levels[k]
            names = level.names if k == 1 else level.names[level.kept]
            out.extend((b, sender, k, j - i, vector.pack_array(both[:, i:j].ravel()), b"", b"") for b, i, j in _cuts(names, n))
        return _table(out)

    # round k asks about n-grams of k + 1 words; the first one about words, too
    first = chunks.applyInArrow(frames.tidy(lambda left: ask(left, None, 0, [1, 2][:order])), _MESSAGE)
    asked = [first]
    # dealt by chunk at once, so that each answer is made and sent once for all rounds that need it
    every = first.groupBy("to").applyInArrow(frames.tidy(_answer(min_count)), _MESSAGE).repartition(parts, "to")
    for k in range(3, order + 1):
        asked.append(chunks.cogroup(every.groupBy("to")).applyInArrow(frames.tidy_pair(lambda left, right, k=k: ask(left, right, k - 1, [k])), _MESSAGE))
        every = every.unionByName(asked[-1].groupBy("to").applyInArrow(frames.tidy(_answer(min_count)), _MESSAGE).repartition(parts, "to"))
    totals = first.groupBy("to").applyInArrow(_share, "total bigint, distinct bigint").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    numbers = F.concat_ws(",", F.coalesce("total", F.lit(0)), F.coalesce("distinct", F.lit(0))).cast("binary")
    # N and V for every chunk, a row each
    totals = totals.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to"), F.lit(0).alias("sender"), F.lit(0).alias("level"), F.lit(1).alias("n"), numbers.alias("a"), F.lit(b"").alias("b"), F.lit(b"").alias("c")).repartition(parts, "to")
    final = every.unionByName(totals)
    if order > 1:
        reports = chunks.cogroup(every.groupBy("to")).applyInArrow(frames.tidy_pair(report), _MESSAGE)
        for j, asks in enumerate(asked[: max(1, order - 2)]):
            levels = [1, 2] if j == 0 else [j + 2]
            final = final.unionByName(asks.groupBy("to").cogroup(reports.where(F.col("level").isin([k for k in levels if k < order])).groupBy("to")).applyInArrow(frames.tidy_pair(_summed(min_count)), _MESSAGE).repartition(parts, "to"))
    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, vocabulary bigint, base_score double, score double"
    out_schema = frames.arrow_schema(ddl)

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        chunk, (keys, learn) = _rebuilt(left, right, order)
        of = {k: right.filter(pc.equal(right.column("level"), -k)).sort_by("sender").column("a").to_pylist() for k in range(1, order)}
        sums = {k: np.concatenate([vector.unpack_array(x, np.int64).reshape(2, -1) for x in blobs] or [np.zeros((2, 0), np.int64)], axis=1) for k, blobs in of.items()}
        total, distinct = map(int, right.filter(pc.equal(right.column("level"), 0)).column("a")[0].as_py().split(b","))
        base, scores, known = Automaton(chunk, {k: (s[0], s[1]) for k, s in sums.items()}, total, distinct, discount).traverse()
        m = len(keys)
        return frames.as_table({key: keys, "train": learn, "n_tokens": chunk.sizes - 1, "n_known": known, "train_tokens": np.full(m, total), "vocabulary": np.full(m, distinct), "base_score": base, "score": scores}, out_schema)

    return chunks.cogroup(final.groupBy("to")).applyInArrow(frames.tidy_pair(traverse), ddl)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores to six places after the point, so that any order of addition gives the same."""
    docs = frames.read(spark, sf_dir, "documents")
    scored = score(docs, F.coalesce(frames.fold("doc_id", 5), F.lit(0)) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), "vocabulary")


#: Counts of words, pairs and triples by grouping, each token's probability by the formula from the shortest context up. The
#: training rows are found by CRC-32 in plain arithmetic, a byte and seven zeros for each character of the key.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_reduce(flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')]), lambda s, b: xor(xor(s, b) >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295) AS crc,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents
), f AS (SELECT doc_id, xor(crc, 4294967295) % 5 = 1 AS held_out, w FROM d
), t AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(range(len(w))) AS i FROM f
), s AS (SELECT *, lag(w, 1, ' ') OVER o AS v, CASE WHEN i = 0 THEN NULL ELSE lag(w, 2, ' ') OVER o END AS u FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), l AS (SELECT * FROM s WHERE NOT held_out
), c1 AS (SELECT w, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT ' ', count(*) FROM f WHERE NOT held_out
), k AS (SELECT (SELECT count(*) FROM l) AS n, (SELECT count(DISTINCT w) FROM l) AS v
), c2 AS (SELECT v, w, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 2
), c3 AS (SELECT u, v, w, count(*) AS n FROM l WHERE u IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2
), r1 AS (SELECT c1.w AS v, c1.n, 1 - coalesce(sum(c2.n - 0.75::DOUBLE), 0) / c1.n AS r FROM c1 LEFT JOIN c2 ON c2.v = c1.w WHERE c1.n > 0 GROUP BY 1, 2
), r2 AS (SELECT c2.v AS u, c2.w AS v, c2.n, 1 - coalesce(sum(c3.n - 0.75::DOUBLE), 0) / c2.n AS r FROM c2 LEFT JOIN c3 ON c3.u = c2.v AND c3.v = c2.w GROUP BY 1, 2, 3
), p AS (
  SELECT s.doc_id, s.held_out, c1.n IS NOT NULL AS known, (coalesce(c1.n, 0) + 0.5::DOUBLE) / (k.n + 0.5::DOUBLE * (k.v + 1)) AS p1, r1.n AS n1, r1.r AS r1, c2.n AS m2, r2.n AS n2, r2.r AS r2, c3.n AS m3
  FROM s CROSS JOIN k LEFT JOIN c1 ON c1.w = s.w LEFT JOIN r1 ON r1.v = s.v LEFT JOIN c2 ON c2.v = s.v AND c2.w = s.w LEFT JOIN r2 ON r2.u = s.u AND r2.v = s.v LEFT JOIN c3 ON c3.u = s.u AND c3.v = s.v AND c3.w = s.w
), q AS (SELECT *, CASE WHEN n1 IS NULL THEN p1 ELSE coalesce((m2 - 0.75::DOUBLE) / n1, 0) + r1 * p1 END AS p2 FROM p
)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE known)::BIGINT AS n_known, (SELECT n FROM k)::BIGINT AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10(CASE WHEN n2 IS NULL THEN p2 ELSE coalesce((m3 - 0.75::DOUBLE) / n2, 0) + r2 * p2 END)), 6) AS score, (SELECT v FROM k)::BIGINT AS vocabulary
FROM q GROUP BY 1, 2
"""
