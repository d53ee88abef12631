import random

import regex
from tokenizers import Tokenizer

from graphlift.llm import bpe

from .conftest import sha


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_splitter_equals_the_pattern():
    pattern, splitter = regex.compile(bpe.PATTERN), bpe.Splitter(["<|endoftext|>"])
    rng = random.Random(3)
    signs = "ab sdtrevlm''  \n\t\r1²,.<|>é中　\u0085  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["", " ", "a ", "  a", "'s", " 's", "''s", "it's", "we'll'll", "<|endoftext|>", "a <|endoftext|> 's"]
    distinct, flat, per = splitter.words(texts)
    at = 0
    for t, n in zip(texts, per.tolist(), strict=True):
        found = [distinct[i] for i in flat[at : at + n]]
        at += n
        assert found == splitter.slow(t)
        if "<|endoftext|>" not in t:
            assert found == pattern.findall(t)
    assert len(set(distinct)) == len(distinct)


def test_query_equals_the_library(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = bpe.op4_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(tokenizer, texts[r["doc_id"]])


def test_awkward_texts_in_small_chunks(awkward_docs, awkward):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = bpe.encode(awkward_docs, chunk_bytes=5_000).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(((d, *expected(tokenizer, t)) for d, t, *_ in awkward), key=key)


def test_ids_and_decoded_texts_come_back(awkward_docs, awkward):
    rows = bpe.encode(awkward_docs, outputs="ids").collect()
    assert sorted(r["decoded"] for r in rows) == sorted(t or "" for _, t, *_ in awkward)
    assert all((len(r["ids"]) > 0) == bool(r["decoded"]) for r in rows)


def test_clashing_columns_and_empty_tables(clashing_docs, empty_docs, awkward):
    assert bpe.encode(clashing_docs).count() == len(awkward)
    assert bpe.encode(empty_docs).count() == 0


def test_words_with_equal_hashes_are_told_apart(monkeypatch, thue_morse):
    """Long words that a polynomial hash confuses, and a hash that gives all words one value."""
    import numpy as np

    from graphlift.llm import vector

    texts = [" ".join(thue_morse), "a b a c", *thue_morse]
    splitter = bpe.Splitter()
    for hashes in (vector.slice_hashes, lambda values, starts, ends, seed=0: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(vector, "slice_hashes", hashes)
        distinct, flat, per = splitter.words(texts)
        found, at = [], 0
        for n in per.tolist():
            found.append([distinct[i] for i in flat[at : at + n]])
            at += n
        assert found == [splitter.slow(t) for t in texts]
        assert len(set(distinct)) == len(distinct)


def test_long_words_equal_the_library(spark, thue_morse):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    docs = spark.createDataFrame(list(enumerate(thue_morse)), "doc_id bigint, text string")
    for r in bpe.encode(docs).collect():
        assert tuple(r)[1:] == expected(tokenizer, thue_morse[r["doc_id"]])


def test_rows_in_another_order_for_each_reader(spark):
    """Blocks of several executors arrive in any order: here a chunk's two readers get its rows shuffled apart."""
    import pyarrow as pa

    def shuffled(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    texts = {i: f"{'word' * (i % 9)} {i * 7919} <|endoftext|> {'other' * (i % 7)}{i}" for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(bpe.default_path())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = bpe.encode(docs.mapInArrow(shuffled, docs.schema), chunk_bytes=5_000).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r)[1:] == expected(tokenizer, texts[r["doc_id"]])


def test_messages_do_not_depend_on_the_order_of_texts():
    given = ["one two", "three " * 400_000, "four " * 400_000, "<|endoftext|> five", "six <|endoftext|>", "seven one", ""]
    splitter = bpe.Splitter(["<|endoftext|>"])
    messages = []
    for some in (given, given[::-1]):
        words, _, _ = splitter.words(some)
        messages.append({b: [words[i] for i in at] for b, at in bpe._bucketed(words, 3).items()})
    assert messages[0] == messages[1]
