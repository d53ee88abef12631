"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (n = 1 to 3, a word's border counts as a
sign) over the training texts, in order. A text's most frequent n-grams are compared to each profile by the
out-of-place distance: the sum of the differences of ranks, with `size` for an n-gram that the profile
lacks. The nearest language wins; equal distances go to the first by code point.

Null texts and texts without a letter are `und` with score 0, as is every text where there was nothing to
learn from (an empty table, no labelled rows). Repeated rows stay; other columns are ignored, and one that has the name of an added column
is replaced. Texts are taken whole, of any length.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames, vector

UNKNOWN = "und"
#: Characters that are taken apart at once.
_SPAN = 400_000
_cache: dict = {}


def _letters() -> np.ndarray:
    """Code point to itself where it is a letter, to 0 where not."""
    if "letters" not in _cache:
        table = np.zeros(0x110000, np.int64)
        letters = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
        table[letters] = letters
        _cache["letters"] = table
    return _cache["letters"]


class Grams:
    """n-grams of texts as numbers: three signs of 21 bits; a border is 0, and unused signs are all ones."""

    _NONE = (1 << 21) - 1

    def __init__(self, texts: list[str]):
        joined = " ".join(t.lower() for t in texts)
        code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)] if joined else np.zeros(0, np.int64)
        lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        # One border before and after each word, one at least at each end of a text.
        code = np.concatenate(([0], code, [0]))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        at = np.cumsum(keep)
        self.code = code = code[keep]
        self.first = at[starts] - 1  # place of the border before each text
        self.last = np.concatenate((self.first[1:], [len(code) - 1])) if len(texts) else self.first
        # the signs at hand in their order, the unused one last: n-grams are numbers to a small base, sorted as those of 21 bits
        self.signs = np.append(np.unique(code), self._NONE)
        place = np.zeros(0x110000, np.int64)
        place[self.signs[:-1]] = np.arange(len(self.signs) - 1)
        self.base = len(self.signs)
        self.code = place[code]

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of text i, ascending, and their counts."""
        row, gram, n = self.counted()
        return gram[row == i], n[row == i]

    def counted(self, group: np.ndarray | None = None, most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, count), ascending, of all texts; with `group`, a number for each text, texts of one number count together."""
        row = np.repeat(np.arange(len(self.first)), self.last - self.first)  # of each place but the last border
        row = row if group is None else group[row]
        code, base = self.code, self.base
        none, cube = base - 1, base**3
        letter, middle = code[:-1] != 0, code[1:-1] != 0
        gram = np.concatenate((((code[:-1] * base + none) * base + none)[letter], (code[:-1] * base + code[1:]) * base + none, ((code[:-2] * base + code[1:-1]) * base + code[2:])[middle]))
        rows = np.concatenate((row[letter], row, row[:-1][middle]))
        known = None
        if (len(self.first) + 1) * cube >= most:  # very many different signs: the n-grams at hand are numbered instead
            known, gram = np.unique(gram, return_inverse=True)
            cube = len(known)
        every = rows * cube + gram
        every.sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(new)
        gram, signs = every[at] % cube, self.signs
        gram = gram if known is None else known[gram]
        return every[at] // cube, (signs[gram // (base * base)] << 42) | (signs[gram // base % base] << 21) | signs[gram % base], np.diff(np.append(at, len(every)))


def best_of_rows(row: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank) of the `size` most frequent n-grams of each text, ties by the n-gram's number; rows ascend by text and n-gram."""
    most = int(n.max(initial=0))
    order = np.argsort(row * (most + 1) + (most - n), kind="stable")
    row, gram = row[order], gram[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = rank < size
    return row[keep], gram[keep], rank[keep]


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first; ties by the n-gram's number."""
    return best_of_rows(np.zeros(len(grams), np.int64), grams, counts, size)[1]


class Profiles:
    """Ranks of every profile's n-grams: one row for each n-gram, one column for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), size, np.int64)  # the last row: in no profile
        self.listed = self.ranks < 0
        for k, name in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(profiles[name], np.int64))
            self.ranks[at, k] = np.arange(len(at))
            self.listed[at, k] = True

    def distances(self, best: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, best), len(self.grams) - 1)
        at[self.grams[at] != best] = len(self.grams)
        apart = np.abs(self.ranks[at] - np.arange(len(best))[:, None])
        return np.where(self.listed[at], apart, self.size).sum(axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each; the score is 1 less the distance as a part of the largest possible one."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        whole = [t or "" for t in texts]
        for a, b in vector.groups(whole, _SPAN) if self.languages else ():
            row, gram, rank = best_of_rows(*Grams(whole[a:b]).counted(), self.size)
            if not len(row):
                continue
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at[self.grams[at] != gram] = len(self.grams)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            count = np.diff(np.append(first, len(row)))
            apart = np.stack([np.add.reduceat(np.where(self.listed[at, k], np.abs(self.ranks[at, k] - rank), self.size), first) for k in range(len(self.languages))], axis=1)
            best = apart.argmin(axis=1)
            score = 1 - apart[np.arange(len(best)), best] / (count * self.size)
            for i, k, x in zip((row[first] + a).tolist(), best.tolist(), score.tolist(), strict=True):
                names[i], scores[i] = self.languages[k], x
        return names, scores


def learn(docs: DataFrame, train: Column, size: int = 400, sample_per_language: int = 4000, most_languages: int = 10_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from the rows where `train` holds and the language isn't null.

    The classifier is fitted on about sample_per_language rows of each language (all, where there
    are fewer), chosen by a hash of the key. More than most_languages values of the language column are an error: that column holds no languages. Counts are summed by Spark; only the profiles, `size` n-grams for
    each language, come to the driver.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, lang, text)
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages in column {lang}")
    if not counts:
        return Profiles({}, size)
    steps = 1 << 24
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("language sample")), F.lit(steps))
    # a row for each language, their number checked above
    share = docs.sparkSession.createDataFrame([(k, min(steps, -(-steps * sample_per_language // n))) for k, n in counts.items()], "_name string, _share bigint")
    rows = rows.join(F.broadcast(share), F.col(lang) == F.col("_name")).where(draw < F.col("_share")) if any(n > sample_per_language for n in counts.values()) else rows

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            texts, langs = batch.column(text).to_pylist(), batch.column(lang).to_pylist()
            for a, b in vector.groups(texts, _SPAN):
                names = sorted(set(langs[a:b]))
                group = np.array([names.index(x) for x in langs[a:b]])
                for k, g, n in zip(*(x.tolist() for x in Grams(texts[a:b]).counted(group)), strict=True):
                    own = total.setdefault(names[k], {})
                    own[g] = own.get(g, 0) + n
        for name, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    summed = frames.map_arrow(rows.select(text, lang), count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = summed.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {name: [] for name in counts}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles[r["lang"]].append(r["gram"])
    return Profiles({k: p for k, p in profiles.items() if p}, size)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the predicted language and its score to the kept columns (all, by default). Reads nothing but the text."""
    kept = frames.without(docs.columns if keep is None else keep, [lang_name, score_name])
    hidden = frames.fresh("_text", docs)
    rows = docs.select(*kept, F.col(text).alias(hidden))
    schema = frames.with_fields(rows.drop(hidden), f"`{lang_name}` string, `{score_name}` double")

    def label(batches):
        for batch in batches:
            names, scores = profiles.predict(batch.column(hidden).to_pylist())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], lang_name, score_name])

    return frames.map_arrow(rows, label, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    held_out = F.coalesce(frames.fold("doc_id", 4), F.lit(0)) == 2
    profiles = learn(docs, ~held_out)
    found = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
