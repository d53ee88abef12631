"""Vectorised text primitives shared by the operators: token boundaries, 64-bit token hashes, ragged arrays.

Everything works on whole texts laid end to end in one byte array, so the cost for a word is a few
array operations and no Python object.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Words of the contracts that split at ASCII white space: every byte but 0x20 and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z alone; the other bytes of UTF-8 stay.
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))

#: Slices over so many bytes are hashed one by one.
_LONG = 256
_PART = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3, in place: every bit of the input moves every bit of the result."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each values[start:end].

    Eight bytes a round go through a finaliser that is one-to-one, with the length in the first state: slices of one length
    up to 8 bytes never share a hash, others do by chance alone, one pair in 2^64. Long slices, few for their size, are hashed by XXH3.
    """
    import xxhash

    width = values.dtype.itemsize
    raw = np.zeros(values.nbytes + 8, np.uint8)
    raw[: values.nbytes] = np.ascontiguousarray(values).view(np.uint8)
    eight = np.ndarray((values.nbytes + 1,), "<u8", raw.data, strides=(1,))
    at, size = starts * width, (ends - starts) * width
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(2 * seed + 1))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]].data, seed=seed)
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at, size, state = at[left], size[left], out[left]
    while len(left):
        block = eight[at]
        last = size < 8
        block[last] &= _PART[size[last]]
        state = mix(state ^ block)
        out[left] = state
        more = np.flatnonzero(size > 8)
        left, at, size, state = left[more], at[more] + 8, size[more] - 8, state[more] * U64(0x9DDFEA08EB382D69)
    return out


def distinct(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct slice, number of the distinct slice at each place). Equal hashes are told apart by the values themselves."""
    hashes = slice_hashes(values, starts, ends)
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = order[new]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    size, like = ends - starts, first[inverse]
    if np.array_equal(size, size[like]) and np.array_equal(values[ragged(starts, size)], values[ragged(starts[like], size)]):
        return first, inverse
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(values[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(number, return_index=True)[1], number


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted(table, keys) for large tables: sorted keys walk through the table instead of jumping about in it."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


class Words:
    """Words of many texts: starts, ends in `data`, the row of each word, and rows' first words (`first`, one more than rows)."""

    def __init__(self, texts: list[bytes], word: np.ndarray = NON_SPACE, lower: bytes | None = LOWER):
        data = b" " + b" ".join(texts) + b" "
        self.data = data.translate(lower) if lower else data
        self.bytes = np.frombuffer(self.data, np.uint8)
        inside = word[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))[: len(texts) + 1]
        self.first = np.searchsorted(self.starts, self.text_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.bytes, self.starts, self.ends)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i; empty rows give 0. Added row by row, so rows don't disturb each other."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def groups(texts: list, limit: int = 1_000_000):
    """Runs (from, to) of texts of about `limit` units together; a longer text is a run by itself."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences, split into byte planes, so that zstd removes the empty high planes."""
    import zstandard

    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def pack_array(values: np.ndarray) -> bytes:
    """An array of a narrow type, in byte planes under zstd; unpack_array needs the same type."""
    import zstandard

    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_array(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()
