import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlift.llm import langid, licenses, toxicity


def reference_profile(texts, size):
    """Ranks of n-grams by plain dictionaries; an n-gram is written as a string with _ for a border."""
    import unicodedata
    from collections import Counter

    count = Counter()
    for t in texts:
        signs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower())
        for w in signs.split():
            p = f"_{w}_"
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    if p[i : i + n] != "_":
                        count[p[i : i + n]] += 1
    number = lambda g: sum((0 if c == "_" else ord(c)) << s for c, s in zip(g, (42, 21, 0), strict=False)) + sum(((1 << 21) - 1) << s for s in (42, 21, 0)[len(g) :])
    return [number(g) for g in sorted(count, key=lambda g: (-count[g], number(g)))][:size]


@pytest.mark.parametrize("text", ["Hello, world! hello", "é", "The cat's 12 mats — the END", "", "中文 中文 a", "1 2 3"])
def test_profiles_of_a_text_equal_plain_counting(text):
    grams = langid.Grams([text, "between", text])
    for i in (0, 2):
        assert langid.ranked(*grams.of(i), 50).tolist() == reference_profile([text], 50)
    assert all(a.tolist() == b.tolist() for a, b in zip(grams.counted(), grams.counted(most=1), strict=True))


def test_distance_is_out_of_place():
    p = langid.Profiles({"x": [1, 2, 3], "y": [3, 9]}, 5)
    best = np.array([3, 1, 7])
    assert p.distances(best).tolist() == [2 + 1 + 5, 0 + 5 + 5]


def test_language_accuracy_on_held_out_rows(spark, sf_dir, docs):
    rows = langid.op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_texts(awkward_docs, clashing_docs, empty_docs, awkward):
    profiles = langid.learn(awkward_docs, F.lit(True))
    found_rows = langid.predict(awkward_docs, profiles).collect()
    found = {(r["doc_id"], r["text"]): r for r in found_rows}
    for d in (1, 2, 3, 10):
        (r,) = [x for (i, _), x in found.items() if i == d]
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert all(r["lang_pred"] in profiles.languages for (d, _), r in found.items() if d not in (1, 2, 3, 10))
    clash = langid.predict(clashing_docs, profiles)
    assert sorted(r["score"] for r in clash.select("score").collect()) == sorted(r["score"] for r in found_rows) and clash.columns.count("score") == 1
    nothing = langid.learn(empty_docs, F.lit(True))
    assert nothing.languages == []
    assert {r["lang_pred"] for r in langid.predict(awkward_docs, nothing).collect()} == {"und"}


def plain_prediction(profiles, text, size):
    """(language, score) by the definition: ranks in lists, one n-gram after the other."""
    best = reference_profile([text], size)
    if not best:
        return "und", 0.0
    apart = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(best)) for k, p in profiles.items()}
    lang = min(sorted(apart), key=apart.get)
    return lang, 1 - apart[lang] / (len(best) * size)


def test_learning_and_prediction_equal_plain_counting(spark):
    rng = np.random.default_rng(2)
    vocabulary = {"a": ["eins", "zwei", "drei", "über"], "b": ["one", "two", "three", "o'clock"], "c": ["un", "deux", "trois", "œuf"]}
    rows = [(i, k, " ".join(rng.choice(vocabulary[k], rng.integers(1, 30)))) for i, k in enumerate("abcabcabcab" * 3)]
    rows += [(100, "a", None), (101, "b", "1 2 3"), (102, None, "EINS two"), (103, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    size = 25
    learned = langid.learn(docs, F.col("doc_id") % 4 != 2, size=size)
    profiles = {k: reference_profile([t or "" for i, x, t in rows if x == k and i % 4 != 2], size) for k in "abc"}
    for r in langid.predict(docs, learned).collect():
        lang, score = plain_prediction(profiles, r["text"] or "", size)
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=1e-12))


def test_too_many_languages_are_refused(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "cast(id AS string) AS lang", "'a b' AS text")
    assert len(langid.learn(docs, F.lit(True)).languages) == 40
    with pytest.raises(ValueError, match="languages"):
        langid.learn(docs, F.lit(True), most_languages=39)


def test_the_sample_is_bounded_and_repeatable(docs):
    a, b = (langid.learn(docs, F.lit(True), sample_per_language=15) for _ in range(2))
    assert a.grams.tolist() == b.grams.tolist() and a.languages == ["de", "en", "es", "fr"]


def brute_noisy_or(model, text):
    import re

    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    none = 1.0
    for sentence in re.split(rb"[.!?\n]", text.lower() if text.isascii() else text):
        ws = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
        if ws:
            signs = toxicity.Bags([b" ".join(ws)]).signs
            z = model.bias + sum(weight.get(int(h), 0.0) for part in signs for h in part)
            none *= 1 - 1 / (1 + np.exp(-z))
    return 1 - none


def training(n=400, seed=1):
    rng = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(rng.integers(1, 9))]
        if bad:
            k = rng.integers(0, len(sentences))
            sentences[k] += " " + rng.choice(["idiot", "scum"])
        texts.append((". ".join(sentences) + ".").encode())
        labels.append(int(bad))
    return texts, np.array(labels)


def test_sentences_are_learned_from_document_labels():
    texts, labels = training()
    model = toxicity.fit(texts, labels)
    again, truth = training(seed=2)
    scores, worst = model.score(again)
    assert ((scores >= 0.3) == truth).mean() > 0.98
    for t, y, (_, p, start, end), s in zip(again, truth, worst, scores, strict=True):
        assert s == pytest.approx(brute_noisy_or(model, t), abs=1e-9)
        if y:
            assert (b"idiot" in t[start:end] or b"scum" in t[start:end]) and p > 0.3


def test_scores_of_awkward_texts(spark, awkward_docs, clashing_docs, empty_docs, awkward):
    texts, labels = training()
    model = toxicity.fit(texts, labels)
    rows = toxicity.score(awkward_docs, model).collect()
    assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 and r["worst_sentence"] == -1 for r in rows if r["doc_id"] in (1, 2, 3))
    clash = toxicity.score(clashing_docs, model)
    assert sorted(r["score"] for r in clash.select("score").collect()) == sorted(r["score"] for r in rows) and clash.columns.count("score") == 1
    marks = spark.createDataFrame([(2, None), (5, 1), (5, 0), (8, 0)], "doc_id bigint, toxic int")
    assert toxicity.learn(awkward_docs, marks, F.lit(True)).bias < 0
    none = toxicity.learn(empty_docs, marks, F.lit(True))
    assert len(none.words) == 0 and toxicity.score(empty_docs, none).count() == 0


def test_toxicity_on_held_out_rows(spark, sf_dir):
    """Recall and false alarms on rows that weren't learned from, whole and by language."""
    large = sf_dir.replace(sf_dir.rsplit("/", 1)[1], "sf0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic IS NOT NULL")
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "lang")
    rows = toxicity.op10_toxicity(spark, large).where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    share = lambda rows: np.mean([r["predicted"] for r in rows])
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) > 100 and share(toxic) > 0.8 and share(clean) < 0.02
    for lang in ("de", "en", "es", "fr"):
        assert share([r for r in toxic if r["lang"] == lang]) > 0.6
        assert share([r for r in clean if r["lang"] == lang]) < 0.05


def test_stems_are_of_whole_characters():
    bags = toxicity.Bags(["éééé ééééé ééééxy abcd".encode()])
    four, five = bags.signs[1], bags.signs[2]
    assert (four != 0).tolist() == [False, True, True, False] and four[1] == four[2]
    assert (five != 0).tolist() == [False, False, True, False]


def test_words_are_chosen_by_their_likelihood_ratio():
    ratio = toxicity._g2(np.array([10.0, 10.0, 100.0, 1.0]), np.array([10.0, 1.0, 10.0, 1.0]), 1000.0, 100.0)
    assert ratio[0] == pytest.approx(2 * (10 * np.log(10) + 90 * np.log(90 / 99) + 900 * np.log(900 / (990 * 0.9))), rel=1e-6)
    assert ratio[1] == pytest.approx(0, abs=1e-9) and ratio[2] == pytest.approx(0, abs=1e-9) and 0 < ratio[3] < 20


def test_expressions():
    e = licenses.Expression.of("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)")
    assert e.postfix == ("MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or")
    assert e.licences() == ["MIT", "Apache-2.0", "GPL-2.0-only"]
    assert licenses.parse("a and b or c and d") == ["a", "b", "and", "c", "d", "and", "or"]
    strict = lambda name, exception: name == "MIT"
    assert e.allowed(strict) and not licenses.Expression.of("MIT AND GPL-3.0").allowed(strict)
    assert licenses.Expression.of("GPL-2.0 WITH Classpath-exception-2.0").allowed(licenses.permissive)
    assert not licenses.Expression.of("GPL-2.0").allowed(licenses.permissive)
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT Apache-2.0", "()", "MIT (BSD)"):
        with pytest.raises(licenses.ExpressionError):
            licenses.parse(bad)
    assert licenses.leading("MIT. Copyright me") == "MIT"
    assert licenses.leading("(MIT OR Apache-2.0) */") == "(MIT OR Apache-2.0)"
    assert licenses.leading("GPL-2.0 and the rest of this") == "GPL-2.0"
    assert licenses.leading("***") == licenses.leading("is required") == licenses.leading("(MIT or") == licenses.leading("") == ""
    assert licenses.leading("MIT OR\nApache-2.0") == "MIT" and licenses.leading("((MIT) and Zlib) with me") == "((MIT) and Zlib)"
    assert licenses.leading("GPL-2.0-only WITH Classpath-exception-2.0, or else") == "GPL-2.0-only WITH Classpath-exception-2.0"
    assert licenses.leading("LicenseRef-Own-1 or Python-2.0)") == "LicenseRef-Own-1 or Python-2.0"


def test_long_expressions_take_time_in_proportion():
    import time

    long = b"SPDX-License-Identifier: " + b" or ".join([b"MIT"] * 100_000) + b" and the rest"
    deep = b"SPDX-License-Identifier: " + b"(" * 50_000 + b"MIT" + b") and Zlib" * 50_000
    automaton = licenses._automaton(licenses.BASE, licenses.NOTICES)
    begun = time.process_time()
    scans = [licenses.scan(t, automaton) for t in (long, deep, b"SPDX-License-Identifier: " * 20_000)]
    assert time.process_time() - begun < 5
    assert [s.labels for s in scans] == [["mit"], ["mit", "zlib"], []]


def split_expression(text):
    """The licences of the longest expression that a text begins with, by trying all of its beginnings with a recursive parser."""
    import re

    tokens = re.match(r"(?:[ \t]*(?:\(|\)|[A-Za-z0-9.+:-]+))*", text)[0]
    tokens = re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", tokens)

    def value(ts, rank=1):
        """(licences, rest) of the first expression of operators of this rank and above, or None."""
        if rank == 4:
            if ts and ts[0] == "(":
                inner = value(ts[1:])
                return (inner[0], inner[1][1:]) if inner and inner[1][:1] == [")"] else None
            word = ts[0].rstrip(".:") if ts else ""
            return ([word], ts[1:]) if word and word.lower() not in ("and", "or", "with") and licenses.identifies(word) else None
        left = value(ts, rank + 1)
        while left and left[1] and left[1][0].lower() == {1: "or", 2: "and", 3: "with"}[rank]:
            right = value(left[1][1:], rank + 1)
            if not right:
                return left
            left = (left[0] if rank == 3 else left[0] + right[0], right[1])
        return left

    for n in range(len(tokens), 0, -1):
        if any(t.rstrip(".:") != t for t in tokens[: n - 1]):
            continue
        found = value(tokens[:n])
        if found and not found[1]:
            return found[0]
    return []


def brute_labels(text):
    """All labels: phrases by comparing words at every place, expressions by the recursive parser."""
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {**licenses.NOTICES, **licenses.BASE}
    n = [(label, sum(w[i : i + len(p.split())] == p.split() for i in range(len(w)))) for p, label in phrases.items()]
    labels, count = {label for label, k in n if k}, sum(k for _, k in n)
    tags = [split_expression((text or "")[m.end() :]) for m in re.finditer(r"(?i)spdx[-\s]license[-\s]identifier\s*:?", text or "")]
    tags = [t for t in tags if t]
    return ",".join(sorted(labels | {licenses.family(x) for t in tags for x in t})), 1 - 0.5 ** (count + 2 * len(tags))


def test_expressions_equal_the_recursive_parser():
    rng = np.random.default_rng(4)
    parts = ["MIT", "(", ")", "or", "AND", "with", "GPL-2.0+", "the", "Zlib.", "LLVM-exception", "BSD-3-Clause", ", "]
    for _ in range(3000):
        text = " ".join(rng.choice(parts, rng.integers(0, 9)))
        found = licenses.leading(text)
        assert (licenses.Expression.of(found).licences() if found else []) == list(dict.fromkeys(split_expression(text))), text


def brute_scan(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_scan_equals_brute_force(spark, sf_dir, texts):
    for r in licenses.op8_license_scan(spark, sf_dir).collect():
        assert tuple(r)[1:6] == brute_scan(texts[r["doc_id"]])
        assert (r["labels"], r["score"]) == brute_labels(texts[r["doc_id"]])


def test_scan_of_awkward_texts(spark, awkward_docs, clashing_docs, empty_docs, awkward):
    tricky = ["MIT-License mit license license", "CC\nBY, cc by cc by-sa", "the gnu General, Public: LICENSE x", "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND LGPL-2.1+)\nrest", "mit licensed", "émit license", "Apache License", "spdx license identifier"]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in licenses.scan_licences(df).collect()}
    for i, t in enumerate(tricky):
        assert tuple(rows[i])[1:6] == brute_scan(t)
        assert (rows[i]["labels"], rows[i]["score"]) == brute_labels(t)
    assert rows[3]["labels"] == "apache,lgpl,mit" and rows[3]["expressions"] == ["MIT OR (Apache-2.0 AND LGPL-2.1+)"] and rows[3]["allowed"] is True
    assert rows[4]["labels"] == rows[5]["labels"] == rows[7]["labels"] == ""
    found = licenses.scan_licences(awkward_docs).collect()
    assert len(found) == len(awkward) and all(r["n_words"] == 0 and r["first_word"] is None and r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert licenses.scan_licences(clashing_docs).count() == len(awkward) and licenses.scan_licences(empty_docs).count() == 0
