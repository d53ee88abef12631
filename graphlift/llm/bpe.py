"""BPE encoding and decoding through a table of distinct words.

1. Texts are dealt into chunks of about 12 MB and split into the tokenizer's words (pre-tokens).
2. Each chunk sends its distinct words, grouped by a hash, to the word buckets; a bucket encodes
   each distinct word of the corpus once and sends every chunk the ids of its words.
3. A chunk joins the ids back by position among its sorted words and decodes through the id-to-piece table (as many rows as the vocabulary has).

Only compressed texts, distinct words and their ids are exchanged, never one row for each place of a word.

Null texts count as empty; an empty text has no ids. Repeated rows stay repeated. Columns besides
the key and the text are ignored. A text of any length is handled whole, in one piece.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, vector

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
#: Stands between texts; never part of one, as UTF-8 can't hold it.
_BORDER = 0x110000
_cache: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    if "classes" not in _cache:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
        kind = np.full(0x110001, _OTHER, np.uint8)
        for what, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            for m in regex.finditer(pattern + "+", every):
                kind[m.start() : m.end()] = what
        kind[_BORDER] = _END
        _cache["classes"] = kind
    return _cache["classes"]


class Splitter:
    """Splits texts as PATTERN does, many texts at once; strings in `special` are words of their own."""

    def __init__(self, special: list[str] = ()):
        import regex

        self.special = [s for s in special if s]
        guard = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        full = PATTERN
        if guard:
            full = f"{guard}|'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?(?:(?!{guard})[^\\s\\p{{L}}\\p{{N}}])+|\\s+(?!(?!{guard})\\S)|\\s+"
        self.regex = regex.compile(full)

    def slow(self, text: str) -> list[str]:
        return self.regex.findall(text)

    def spans(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined text, its code points, starts, ends, words of each text); no text holds a special string."""
        code = np.frombuffer("\x00".join(texts).encode("utf-32-le") + b"\x00\x00\x00\x00", np.uint32).copy()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        borders = np.cumsum(lengths + 1) - 1
        code[borders] = _BORDER
        kind = _classes()[code]
        n = len(code)
        cut = np.zeros(n + 1, bool)  # a word starts here
        cut[0] = True
        cut[1:n] = kind[1:] != kind[:-1]
        cut[borders] = cut[borders + 1] = True
        # The last space before other text leaves its run: a blank joins what follows, another space stands alone.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
        cut[last] = True
        blank = last[code[last] == 0x20]
        cut[blank + 1] = False
        # Contractions: a lone apostrophe that starts a word takes s, t, m, d, re, ve or ll from the letters after it.
        quote = np.flatnonzero((code == 0x27) & cut[:n])
        if len(quote):
            follow = lambda k: code[np.minimum(quote + k, n - 1)]
            a, b = follow(1), follow(2)
            one = np.isin(a, np.array([ord(c) for c in "stmd"], np.uint32))
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            cut[quote[one | two] + 1] = False
            cut[quote[one] + 2] = True
            cut[quote[two] + 3] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        keep = kind[starts] != _END
        starts, ends = starts[keep], ends[keep]
        per = np.diff(np.searchsorted(starts, np.concatenate(([0], borders + 1))))
        return "\x00".join(texts), code, starts, ends, per

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, index of the word at each place, words of each text)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        index: dict[str, int] = {}
        at: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for a, b in vector.groups(plain):
            joined, code, starts, ends, per = self.spans(plain[a:b])
            first, inverse = vector.distinct(code, starts, ends)
            own = [index.setdefault(joined[s:e], len(index)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            at.append(np.array(own, np.int64)[inverse])
            counts.append(per)
        per = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        if odd:
            rows = np.split(flat, np.cumsum(per)[:-1])
            for i in odd:
                ids = []
                for w in self.slow(texts[i]):
                    ids.append(index.setdefault(w, len(index)))
                rows[i] = np.array(ids, np.int64)
            flat = np.concatenate(rows)
            per = np.fromiter(map(len, rows), np.int64, len(rows))
        return list(index), flat, per


class Coder:
    """The tokenizer of a file's content: encodes words, knows its special strings and the piece of each id."""

    def __init__(self, content: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splitter = Splitter([t["content"] for t in json.loads(content).get("added_tokens", [])])

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 20_000):
            out.extend(e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False))
        return out

    def pieces(self) -> list[bytes]:
        """The id-to-piece table: bytes of each id."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        return out


def coder(content: str) -> Coder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if _cache.get("content") != content:
        _cache.update(content=content, coder=Coder(content))
        _cache.pop("pieces", None)
    return _cache["coder"]


def pieces(content: str) -> list[bytes]:
    coder(content)
    if "pieces" not in _cache:
        _cache["pieces"] = _cache["coder"].pieces()
    return _cache["pieces"]


def _bucketed(words: list[str], n: int) -> dict[int, list[int]]:
    """Indices of the words of each bucket, sorted by the words themselves: a chunk's rows reach its two readers in different orders where they
    come from several executors, so the order of first places can't name a word."""
    out: dict[int, list[int]] = {}
    for i in sorted(range(len(words)), key=words.__getitem__):
        out.setdefault(zlib.crc32(words[i].encode()) % n, []).append(i)
    return out


def _texts(blobs: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in blobs]


def encode(docs: DataFrame, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text", outputs: str = "digest", chunk_bytes: int = 12 << 20) -> DataFrame:
    """Encodes and decodes docs.text. outputs "digest": key, n_tokens, ids_sha256, decoded_sha256; "ids": key, ids array<int>, decoded string.

    The tokenizer's file is read once on the driver and sent with the code (some MB, fixed by the
    vocabulary). Special strings in a text become their ids, as the library does by default.
    """
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    n = frames.chunk_count(docs, text, chunk_bytes)
    chunks = frames.chunked(docs, n, [key], text)
    words_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])

    def split(table: pa.Table) -> pa.Table:
        import zstandard

        texts, _ = frames.unpack_rows(table.column("block").to_pylist())
        words, _, _ = coder(content.value).splitter.words(_texts(texts))
        chunk = table.column("chunk")[0].as_py()
        rows = [(b, chunk, zstandard.compress(pickle.dumps([words[i] for i in at], 4), 3)) for b, at in _bucketed(words, n).items()]
        return frames.as_table(dict(zip(words_schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(words_schema.names, []), words_schema)

    def encode_bucket(table: pa.Table) -> pa.Table:
        import zstandard

        asked = [pickle.loads(zstandard.decompress(b)) for b in table.column("blob").to_pylist()]
        distinct = list(dict.fromkeys(w for ws in asked for w in ws))
        ids = dict(zip(distinct, (",".join(map(str, x)) for x in coder(content.value).encode(distinct)), strict=True))
        blobs = [zstandard.compress(";".join([ids[w] for w in ws]).encode(), 3) for ws in asked]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(blobs, pa.binary())], schema=words_schema)

    key_type = docs.schema[key].dataType
    digest = outputs == "digest"
    schema = f"`{key}` {key_type.simpleString()}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    out_schema = frames.arrow_schema(schema)

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        texts, keys = frames.unpack_rows(left.column("block").to_pylist())
        words, flat, per = coder(content.value).splitter.words(_texts(texts))
        del texts
        ids_of: list[str] = [""] * len(words)
        buckets = _bucketed(words, n)
        for b, blob in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True):
            for i, ids in zip(buckets[b], zstandard.decompress(blob).decode().split(";"), strict=True):
                ids_of[i] = ids
        piece = {str(i): p for i, p in enumerate(pieces(content.value))}
        decoded_of = [b"".join([piece[i] for i in ids.split(",")]) for ids in ids_of]
        lengths = np.fromiter((x.count(",") + 1 for x in ids_of), np.int64, len(ids_of))
        rows: dict[str, list] = {f: [] for f in out_schema.names}
        at = 0
        for k, m in zip(keys, per.tolist(), strict=True):
            place = flat[at : at + m]
            at += m
            places = place.tolist()
            ids = ",".join([ids_of[i] for i in places])
            whole = b"".join([decoded_of[i] for i in places]).decode("utf-8", "replace")
            rows[key].append(k)
            if digest:
                rows["n_tokens"].append(int(lengths[place].sum()) if m else 0)
                rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(whole.encode()).hexdigest())
            else:
                rows["ids"].append(list(map(int, ids.split(","))) if m else [])
                rows["decoded"].append(whole)
        return frames.as_table(rows, out_schema)

    asked = chunks.groupBy("chunk").applyInArrow(frames.tidy(split), "bucket int, chunk int, blob binary")
    answered = asked.groupBy("bucket").applyInArrow(frames.tidy(encode_bucket), "bucket int, chunk int, blob binary")
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(frames.tidy_pair(join_back), schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(frames.read(spark, sf_dir, "documents"))
