import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlift.llm import lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def model(seqs, learned, order=3, discount=0.75, least=2):
    """(counts of n-grams, P(w | context), N) with dictionaries."""
    c = Counter()
    for s, yes in zip(seqs, learned, strict=True):
        if yes:
            c.update(tuple(s[i : i + n]) for n in range(1, order + 1) for i in range(len(s) - n + 1))
    words = {k: m for k, m in c.items() if len(k) == 1 and k != ("<s>",)}
    n, v = sum(words.values()), len(words)
    kept = {k: m for k, m in c.items() if len(k) > 1 and m >= least}
    mass = Counter()
    for k, m in kept.items():
        mass[k[:-1]] += m - discount

    def p(w, context):
        if not context:
            return (words.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))
        below = p(w, context[1:])
        if c[context] == 0 or (len(context) > 1 and context not in kept):
            return below
        return max(kept.get((*context, w), 0) - discount, 0) / c[context] + (1 - mass[context] / c[context]) * below

    return words, p, n


def brute(rows, learned, order=3):
    """rows: (id, text, learned from?). Each text walked token by token."""
    seqs = [tokens(t) for _, t in rows]
    words, p, n = model(seqs, learned, order)
    out = []
    for s in seqs:
        total = sum(math.log10(p(s[i], tuple(s[max(0, i - order + 1) : i]))) for i in range(1, len(s)))
        out.append((len(s) - 1, sum((w,) in words for w in s[1:]), n, sum(math.log10(p(w, ())) for w in s[1:]), total))
    return out


def same(found, expected, apart=1e-9):
    assert found[:3] == expected[:3]
    assert found[3:] == pytest.approx(expected[3:], rel=1e-9, abs=apart)


def test_query_equals_brute_force_and_beats_the_base(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in lm.op7_lm_score(spark, sf_dir).collect()}
    learned = [zlib.crc32(str(d).encode()) % 5 != 1 for d in texts]
    for (d, t), e, yes in zip(texts.items(), brute(list(texts.items()), learned), learned, strict=True):
        r = rows[d]
        assert r["held_out"] == (not yes)
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), e, 1e-6)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_texts_in_small_chunks(awkward_docs, awkward):
    learn = [d is None or d % 2 == 0 for d, *_ in awkward]
    found = lm.score(awkward_docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)), chunk_bytes=4_000).collect()
    expected = brute([(d, t) for d, t, *_ in awkward], learn)
    order = lambda x: (x[0] is None, x[0] or 0)
    pairs = zip(sorted([(r["doc_id"], r) for r in found], key=order), sorted(zip([d for d, *_ in awkward], expected, strict=True), key=order), strict=True)
    for (d, r), (d2, e) in pairs:
        assert d == d2
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), e)


def test_states_sum_to_one():
    seqs = [tokens("a b a c a b b a d a b")] * 3
    words, p, _ = model(seqs, [True] * 3)
    for context in [(), ("<s>",), ("a",), ("b", "a"), ("<s>", "a"), ("d",), ("never",)]:
        # one unknown word stands for all
        assert sum(p(w, context) for (w,) in words) + p("unknown", context) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, order):
    texts = ["a b a c a b b a d a b", "a b a c x", "b b b b b b", "a b a c a b y", "", "z"] * 2
    rows = list(enumerate(texts))
    learned = [i % 5 != 0 for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") % 5 != 0, order=order, chunk_bytes=40).collect()}
    for (i, _), e in zip(rows, brute(rows, learned, order), strict=True):
        r = found[i]
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), e)


def test_long_words_that_differ_in_every_letter_are_told_apart(spark, thue_morse):
    rows = [(i, f"{w} end") for i, w in enumerate(thue_morse)] * 2
    found = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 2 == 0).collect()
    learned = [i % 2 == 0 for i, _ in rows]
    by_id = {i: e for (i, _), e in zip(rows, brute(rows, learned), strict=True)}
    for r in found:
        same((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), by_id[r["doc_id"]])


def test_nothing_to_learn_from_and_empty_tables(awkward_docs, empty_docs, clashing_docs, awkward):
    rows = lm.score(awkward_docs, F.lit(False)).collect()
    assert all(r["score"] == pytest.approx(r["base_score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    assert lm.score(empty_docs, F.lit(True)).count() == 0
    assert lm.score(clashing_docs, F.lit(True)).count() == len(awkward)


def test_keys_are_packed_without_loss():
    from graphlift.llm import vector

    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (vector.unpack_keys(vector.pack_keys(keys)) == keys).all()
    assert len(vector.unpack_keys(vector.pack_keys(keys[:0]))) == 0
    values = np.arange(7, dtype=np.uint32) * 70_000
    assert (vector.unpack_array(vector.pack_array(values), np.uint32) == values).all()
