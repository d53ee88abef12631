"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A section ends at an empty line, a paragraph at a line's end, a piece at a sentence's end or after a word that
the text itself marks (so a piece that isn't touched by an edit stays as it is). Runs without blanks, as in scripts that have none, are cut
at characters that the ones before them mark, and no piece is longer than 240 bytes. A piece's digest is
of its characters, with what separates it from the next one; a node's digest is of its children's. Equal
roots mean equal texts; unequal branches lead to the edits.

A fingerprint is written as `root:tree`: the root's digest, then sections by `/`, paragraphs by `.` and each
piece as 6 hexadecimal digits of its digest and one sign for its weight. The likeness of two
fingerprints is the weight of the pieces that both have, twice, over the weight of all pieces: 1 for equal roots, 0
if nothing is shared.

Digests are 128 bits wide down to the paragraphs: unequal texts share a root by chance alone. The written 24 bits of a piece serve likeness only.

Null texts count as empty; two empty texts are alike (1). Repeated rows stay, ordered by key and then text.
Other columns are ignored, whatever their names. Texts are taken whole. An empty table gives no rows. Rows of one key, or without one, are
read by one task, one after the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, vector

_WEIGHTS = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_WIDTH = 7
#: A blank ends a piece if the two bytes before it are marked: a sentence's end, or one pair in six.
_RUN, _LONGEST = 24, 240
_MARKED = np.array([[b in b".!?" or (a * 131 + b * 31) // 2 % 6 == 0 for b in range(256)] for a in range(256)])


def _cut_runs(data: np.ndarray, apart: np.ndarray, piece: np.ndarray) -> None:
    """Marks pieces within long runs without a blank: at a character whose four bytes before say so, and where a piece grows too long."""
    n = len(data)
    place = np.arange(n)
    if n > _RUN:
        since = place - np.maximum.accumulate(np.where(apart, place, np.where(piece[:n], place - 1, -1)))
        at = np.flatnonzero((since > _RUN) & ((data & 0xC0) != 0x80))
        at = at[at >= 4]
        b = [data[at - k].astype(np.uint32) for k in (1, 2, 3, 4)]
        mark = (b[0] * 0x9E3779B1 + b[1] * 0x85EBCA77 + b[2] * 0xC2B2AE3D + b[3] * 0x27D4EB2F) >> np.uint32(26)
        piece[at[(mark < 2) & ((b[0] != b[1]) | (b[1] != b[2]))]] = True
    starts = np.flatnonzero(piece[:n])
    size = np.append(starts[1:], n) - starts
    for s, m in zip(starts[size > _LONGEST].tolist(), size[size > _LONGEST].tolist(), strict=True):
        cuts = np.arange(s + _LONGEST - 3, s + m, _LONGEST - 3)
        for _ in range(3):  # back to the first byte of a character
            cuts = np.where((data[cuts] & 0xC0) == 0x80, cuts - 1, cuts)
        piece[cuts] = True


class Forest:
    """Merkle trees of many texts (UTF-8), as arrays: pieces, paragraphs, sections and roots."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate(([0], np.cumsum(sizes)))
        blank = (data == 0x20) | (data == 0x09)
        line = data == 0x0A
        n = len(data)
        starts_text = np.zeros(n + 1, bool)
        starts_text[first] = True
        paragraph = starts_text.copy()  # a paragraph starts here
        paragraph[1:][line] = True
        piece = paragraph.copy()
        at = np.flatnonzero(~blank[3:] & blank[2:-1]) + 3 if n > 3 else np.zeros(0, np.int64)
        piece[at[_MARKED[data[at - 3], data[at - 2]]]] = True
        _cut_runs(data, blank | line, piece)
        self.starts = np.flatnonzero(piece[:n])
        self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        self.digests = vector.slice_hashes(data, self.starts, self.ends)
        # a second, independent digest makes nodes 128 bits wide
        twin = vector.slice_hashes(data, self.starts, self.ends, 1)
        self.bytes = self.ends - self.starts
        # paragraphs as runs of pieces; a line without text ends its section
        p_first = np.flatnonzero(paragraph[self.starts])
        p_starts = self.starts[p_first]
        p_last = np.append(p_first[1:], len(self.starts))
        paragraphs = [vector.slice_hashes(d, p_first, p_last, k) for k, d in enumerate((self.digests, twin))]
        text_bytes = np.concatenate(([0], np.cumsum(~blank & ~line & (data != 0x0D))))
        p_ends = np.append(p_starts[1:], n)[: len(p_starts)]
        empty = text_bytes[p_ends] == text_bytes[p_starts]
        section = np.ones(len(p_first), bool)
        section[1:] = empty[:-1] | starts_text[p_starts[1:]]
        s_first = np.flatnonzero(section)
        s_last = np.append(s_first[1:], len(p_first))
        sections = np.stack([vector.slice_hashes(d, s_first, s_last, k) for k, d in enumerate(paragraphs)], axis=1)
        of_text = np.searchsorted(p_starts[s_first], first)
        self.roots = [hashlib.blake2b(b"%d:" % m + sections[i:j].tobytes(), digest_size=16).hexdigest() for m, i, j in zip(sizes.tolist(), of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]
        self.first = np.searchsorted(self.starts, first)
        # written form: short digest and weight of each piece, a sign before each paragraph or section but a text's first
        short = self.digests & np.uint64(0xFFFFFF)
        weight = np.minimum(self.bytes // 4, len(_WEIGHTS) - 1)
        self.keys = (short << np.uint64(6)) | weight.astype(np.uint64)
        mark = np.zeros(len(self.starts), np.uint8)
        mark[p_first] = ord(".")
        mark[p_first[s_first]] = ord("/")
        mark[starts_text[self.starts]] = 0
        place = _WIDTH * np.arange(len(self.starts)) + np.cumsum(mark != 0)
        out = np.empty(_WIDTH * len(self.starts) + int((mark != 0).sum()), np.uint8)
        out[place[mark != 0] - 1] = mark[mark != 0]
        for k in range(6):
            out[place + k] = _HEX[((short >> np.uint64(20 - 4 * k)) & np.uint64(15)).astype(np.int64)]
        out[place + 6] = np.frombuffer(_WEIGHTS, np.uint8)[weight]
        self._tree = out.tobytes()
        # where a text's part begins: before it stand as many signs as there are marks of earlier pieces
        marks = np.concatenate(([0], np.cumsum(mark != 0)))
        self._from = _WIDTH * self.first + marks[self.first]

    def fingerprints(self) -> list[str]:
        tree = self._tree.decode("ascii")
        at = self._from.tolist()
        return [f"{r}:{tree[i:j]}" for r, i, j in zip(self.roots, at[:-1], at[1:], strict=True)]

    def piece_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `which`, piece key) of the texts that `which` names."""
        n = (self.first[1:] - self.first[:-1])[which]
        return np.repeat(np.arange(len(which)), n), self.keys[vector.ragged(self.first[:-1][which], n)]


def _weights(keys: np.ndarray) -> np.ndarray:
    return 2 + 4 * (keys & np.uint64(63)).astype(np.int64)


def likenesses(a: Forest, which_a: np.ndarray, b: Forest, which_b: np.ndarray) -> np.ndarray:
    """Likeness of text which_a[i] of a and which_b[i] of b, for each i."""
    n = len(which_a)
    counted, total = [], np.zeros(n)
    for forest, which in ((a, which_a), (b, which_b)):
        row, key = forest.piece_keys(which)
        total += np.bincount(row, _weights(key), n)
        # row and 30-bit key in one number
        counted.append(np.unique((row.astype(np.uint64) << np.uint64(30)) | key, return_counts=True))
    (x, m), (y, k) = counted
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.bincount((shared >> np.uint64(30)).astype(np.int64), np.minimum(m[i], k[j]) * _weights(shared), n)
    out = np.minimum(2 * both / np.maximum(total, 1), 1 - 1e-9)  # unequal roots are never wholly alike
    equal = np.fromiter((a.roots[p] == b.roots[q] for p, q in zip(which_a.tolist(), which_b.tolist(), strict=True)), bool, n)
    out[equal] = 1.0
    return out


def fingerprint(text: str) -> str:
    return Forest([text.encode("utf-8", "surrogatepass")]).fingerprints()[0]


def likeness(a: str, b: str) -> float:
    """From two written fingerprints alone; the same value as likenesses() gives."""
    from collections import Counter

    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    trees = [f.partition(":")[2].replace("/", "").replace(".", "") for f in (a, b)]
    x, y = (Counter(t[i : i + _WIDTH] for i in range(0, len(t), _WIDTH)) for t in trees)
    weigh = lambda c: sum(n * (2 + 4 * _WEIGHTS.index(k[6].encode())) for k, n in c.items())
    both = weigh(x) + weigh(y)
    return min(2 * weigh(x & y) / both, 1 - 1e-9) if both else 0.0


def edits(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Where fingerprint b differs from a: (kind, section, paragraph) runs of a and of b that don't match, going down
    unequal branches alone. Rows are (insert | delete | replace, from, to in a's paragraphs, from, to in b's)."""
    import difflib

    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    x, y = ([(i, p) for i, s in enumerate(f.partition(":")[2].split("/")) for p in s.split(".")] for f in (a, b))
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[len(x) - 1 - end][1] == y[len(y) - 1 - end][1]:
        end += 1
    match = difflib.SequenceMatcher(None, [p for _, p in x[start : len(x) - end]], [p for _, p in y[start : len(y) - end]], autojunk=False)
    return [(kind, start + i, start + j, start + k, start + m) for kind, i, j, k, m in match.get_opcodes() if kind != "equal"]


def first_edit(a: str, b: str) -> int | None:
    """Number of the first paragraph that differs; null for equal texts."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return None
    x, y = (f.partition(":")[2].replace("/", "./").split(".") for f in (a, b))
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column."""

    def add(batches):
        for batch in batches:
            texts = frames.strings(batch.column(batch.num_columns - 1))
            prints = [f for i, j in vector.groups(texts) for f in Forest(texts[i:j]).fingerprints()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.string())], [*batch.schema.names[:-1], name])

    kept = frames.without(docs.columns, [name])
    return frames.map_arrow(docs.select(*kept, F.col(text).alias(frames.fresh("_text", docs))), add, frames.with_fields(docs.select(*kept), f"`{name}` string"))


def edited(text: str, other: str) -> str:
    """The last half of the characters (rounded down) replaced by the first as many, or all, of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _ranges(docs: DataFrame, key: str, n: int) -> tuple[list[int], dict[int, int]]:
    """Limits of n ranges of keys, and for each range with rows the largest key below it, which follows in falling order.

    Two scans of the key column; n numbers come to the driver, as many as there are partitions.
    """
    limits = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else []
    limits = sorted(set(limits or []))
    tops = {r["b"]: r["top"] for r in docs.where(F.col(key).isNotNull()).groupBy(_range_of(key, limits).alias("b")).agg(F.max(key).alias("top")).collect()}
    return limits, tops


def _range_of(key: str, limits: list[int]):
    """Number of limits up to the key; rows without a key come last in falling order, in range 0."""
    if not limits:
        return F.lit(0)
    steps = np.array(limits)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.where(keys.isna(), 0, np.searchsorted(steps, keys.fillna(steps[0]).to_numpy(), "right")))

    return place(F.col(key))


def neighbours(docs: DataFrame, per_batch, schema: str, key: str = "doc_id", text: str = "text", partition_bytes: int = 24 << 20) -> DataFrame:
    """Runs per_batch(keys, texts, next texts) for rows and those after them, in falling order of keys (after the last: the first).

    Rows go to ranges of keys, sorted within; the largest key below each range is dealt to that range
    too, so one exchange of the texts is enough and no range waits for another.
    """
    n = frames.chunk_count(docs, text, partition_bytes)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    limits, tops = _ranges(rows, "_key", n)
    order = sorted(tops, reverse=True)
    has_null = rows.where(F.col("_key").isNull()).limit(1).count() > 0
    if has_null and 0 not in tops:
        order.append(0)
    # the range that needs a row of another, and that row's key (None: a row without key)
    needs = {b: tops.get(order[(i + 1) % len(order)]) for i, b in enumerate(order)}
    guests: dict[int, list[int]] = {}
    for b, top in needs.items():
        guests.setdefault(top, []).append(b)
    own = rows.withColumn("_range", _range_of("_key", limits)).withColumn("_guest", F.lit(False))
    frames_ = [own]
    known = [(int(k), int(b)) for k, bs in guests.items() if k is not None for b in bs]
    if known:
        spark = docs.sparkSession
        asked = F.broadcast(spark.createDataFrame(known, "_k bigint, _to int"))  # a row for each partition
        frames_.append(rows.join(asked, rows["_key"] == asked["_k"]).select("_key", "_text", F.col("_to").alias("_range"), F.lit(True).alias("_guest")))
    if None in guests:
        for b in guests[None]:
            frames_.append(rows.where(F.col("_key").isNull()).select("_key", "_text", F.lit(b).alias("_range"), F.lit(True).alias("_guest")))
    every = frames_[0]
    for f in frames_[1:]:
        every = every.unionByName(f)
    dealt = every.repartition(max(1, len(order)), "_range").sortWithinPartitions("_range", "_guest", F.desc_nulls_last("_key"), "_text")
    out_schema = frames.arrow_schema(schema)

    def run(batches):
        held = None  # (range, key, text) that waits for the row after it
        done = -1
        rows: list[tuple] = []
        size = 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(per_batch(*map(list, zip(*rows, strict=True))), out_schema, strict=True)], schema=out_schema)
            rows.clear()
            return out

        for batch in batches:
            for k, t, r, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None:
                    if held[0] == r:
                        rows.append((held[1], held[2], t))
                        size += len(held[2])
                    held = None
                if guest:
                    done = r  # only the first guest follows; the rest repeat its key
                elif done != r:
                    held = (r, k, t)
                if size > 1 << 20:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return frames.map_arrow(dealt, run, schema)


def compare(keys: list, texts: list[str], after: list[str]) -> tuple:
    """The columns of op3: each text against its edited form and the next text."""
    changed = [edited(t, o) for t, o in zip(texts, after, strict=True)]
    changed_bytes = [t.encode() for t in changed]
    # the next text is the next row's, but for the last of a batch
    plain = texts + [o for i, o in enumerate(after) if i + 1 == len(texts) or o is not texts[i + 1]]
    extra = iter(range(len(texts), len(plain)))
    follows = np.array([next(extra) if i + 1 == len(texts) or o is not texts[i + 1] else i + 1 for i, o in enumerate(after)], np.int64)
    own, other = Forest([t.encode() for t in plain]), Forest(changed_bytes)
    every = np.arange(len(texts))
    prints, changed_prints = own.fingerprints(), other.fingerprints()
    return (
        keys, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed_bytes], prints[: len(texts)], changed_prints,
        likenesses(own, every, other, every), likenesses(own, every, own, follows), [first_edit(a, b) for a, b in zip(prints, changed_prints, strict=False)],
    )


def op3_merkle(spark, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    return neighbours(docs, compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit bigint")
