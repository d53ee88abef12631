import hashlib
import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; an input may have them too.
CLASHES = ["chunk", "block", "node", "size", "score", "_text", "_row", "_lang", "_score", "number", "taken", "target", "bucket", "word"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty and long texts, repeats, control signs and other scripts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    long = words(rng, 30_000, vocabulary)
    copy = words(rng, 60, vocabulary)
    near = copy.split()
    near[30] = "CHANGED"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, long, "en", "b", len(long)),
        (5, copy, "de", "b", len(copy)),
        (6, copy, "de", None, len(copy)),
        (7, " ".join(near), "de", "b", None),
        (8, "one", "fr", "c", 3),
        (9, "Two words.\n\nAnd a section.\nA\u0000 null   <|endoftext|> ’s it's 123 ½", None, "c", 9),
        (9, "Two words.\n\nAnd a section.\nA\u0000 null   <|endoftext|> ’s it's 123 ½", None, "c", 9),
        (None, "no id at all, but words", "en", "c", 9),
        (10, "1234 5678 !!! ???", "en", "c", 17),
        (-4, copy + " and a little more", "de", "é", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    return spark.createDataFrame(awkward, DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(awkward_docs):
    from pyspark.sql import functions as F

    return awkward_docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def thue_morse():
    """Pairs of words that any polynomial hash modulo 2^64 takes for the same: the sequence and its complement."""
    out = []
    for n in (1024, 2048, 65_536):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        out += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    return out
