"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence (up to . ! ? or a line's end) has z = b + sum of its words' weights and p = 1 / (1 + exp(-z)).
The document's probability is the noisy-or 1 - prod(1 - p). Weights and b are fitted to document
labels by gradient descent through the noisy-or, so that the sentences' own scores locate the offence.

A word counts as itself and by its first 4 and 5 characters, so that forms of one stem are learned together.

Words: runs of a-z, 0-9 and non-ASCII bytes, A-Z lower-cased. Null or empty texts have no sentence
and score 0. Repeated rows stay; other columns are ignored, and one that has the name of an added column is replaced. Texts are taken whole,
of any length. An empty table gives no rows, and no rows of both labels a model that scores nearly 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, vector

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Longer words also count by beginnings of so many characters.
STEMS = (4, 5)
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True


class Bags:
    """Word hashes of texts with the sentence of each word and the text of each sentence. A sentence has a word at least."""

    def __init__(self, texts: list[bytes]):
        words = vector.Words(texts, WORD)
        size = words.ends - words.starts
        # signs of each word: itself and its stems; 0 stands for none
        self.signs = [words.hashes()]
        # first byte of each character, and of which number a word's first one is
        opens = (words.bytes & 0xC0) != 0x80
        places = np.flatnonzero(opens)
        number = (np.cumsum(opens) - 1)[words.starts]
        for k in STEMS:
            end = places[np.minimum(number + k, len(places) - 1)] if len(places) else words.ends
            longer = (number + k < len(places)) & (end < words.ends)
            stem = np.zeros(len(size), np.uint64)
            stem[longer] = vector.slice_hashes(words.bytes, words.starts[longer], end[longer]) ^ np.uint64(0xA5A5A5A500000000 + k)
            self.signs.append(stem)
        self.starts, self.ends = words.starts, words.ends
        self.text_at = words.text_at
        stops = np.concatenate(([0], np.cumsum(_STOP[words.bytes])))[words.starts]
        rows = words.rows()
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (stops[1:] != stops[:-1])
        self.first_word = np.append(np.flatnonzero(new), len(rows))
        self.text_of = rows[self.first_word[:-1]]
        self.first_sentence = np.searchsorted(self.text_of, np.arange(len(texts) + 1))

    def flat(self, of_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signs, and what belongs to the sentence of each."""
        of_word = np.repeat(of_sentence, np.diff(self.first_word))
        kept = [h != 0 for h in self.signs]
        return np.concatenate([h[k] for h, k in zip(self.signs, kept, strict=True)]), np.concatenate([of_word[k] for k in kept])


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0

    def __post_init__(self):
        self._bits = max(1, 2 * int(np.ceil(np.log2(len(self.words) + 2))))
        self._bits = min(self._bits, 22)
        self._place = np.full(1 << self._bits, -1, np.int32)
        # the few words that share a slot are looked up one by one, so that nothing is lost
        slot = (self.words >> np.uint64(64 - self._bits)).astype(np.int64)
        _, first, n = np.unique(slot, return_index=True, return_counts=True)
        alone = first[n == 1]
        self._place[slot[alone]] = alone
        self._place[np.unique(slot[~np.isin(np.arange(len(slot)), alone)])] = -2

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each word; 0 for words that weren't learned."""
        at = self._place[(hashes >> np.uint64(64 - self._bits)).astype(np.int64)]
        out = np.zeros(len(hashes))
        hit = np.flatnonzero(at >= 0)
        hit = hit[self.words[at[hit]] == hashes[hit]]
        out[hit] = self.weights[at[hit]]
        shared = np.flatnonzero(at == -2)
        if len(shared):
            near = np.minimum(np.searchsorted(self.words, hashes[shared]), len(self.words) - 1)
            same = self.words[near] == hashes[shared]
            out[shared[same]] = self.weights[near[same]]
        return out

    def sentences(self, bags: Bags) -> np.ndarray:
        """log odds of each sentence."""
        return self.bias + vector.row_sums(sum(self.of(h) for h in bags.signs), bags.first_word)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[dict]]:
        """Noisy-or of each text; its worst sentence: index, score, first and last byte (-1 and 0 where it has none)."""
        scores, worst = np.zeros(len(texts)), []
        for a, b in vector.groups(texts):
            bags = Bags(texts[a:b])
            z = self.sentences(bags)
            none = vector.row_sums(-np.logaddexp(0, z), bags.first_sentence)
            scores[a:b] = -np.expm1(none)
            for i in range(b - a):
                s, e = bags.first_sentence[i], bags.first_sentence[i + 1]
                if s == e:
                    worst.append((-1, 0.0, 0, 0))
                    continue
                k = int(s + z[s:e].argmax())
                base = bags.text_at[i]
                worst.append((k - int(s), float(_logistic(z[k])), int(bags.starts[bags.first_word[k]] - base), int(bags.ends[bags.first_word[k + 1] - 1] - base)))
        return scores, worst


def _logistic(z):
    return np.exp(-np.logaddexp(0, -z))


def word_counts(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signs of words, in how many texts each is, and in how many labelled 1."""
    bags = Bags(texts)
    every, of = bags.flat(bags.text_of)
    words, inverse = np.unique(every, return_inverse=True)
    text = of
    pairs = np.unique(inverse * np.int64(len(texts)) + text)
    there, of = pairs // len(texts), pairs % len(texts)
    return words, np.bincount(there, minlength=len(words)), np.bincount(there, labels[of], len(words)).astype(np.int64)


@dataclass
class Sparse:
    """Texts as their numbers of sentences and the learned words of those that have some: sentence `s` has word `f`, text by text."""

    labels: np.ndarray
    n_sentences: np.ndarray
    text_of: np.ndarray  # of each sentence with learned words
    sentence: np.ndarray  # of each learned word
    feature: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], labels: np.ndarray, words: np.ndarray) -> Sparse:
        bags = Bags(texts)
        signs, of = bags.flat(np.arange(len(bags.text_of)))
        at = np.minimum(np.searchsorted(words, signs), max(len(words) - 1, 0))
        hit = words[at] == signs if len(words) else np.zeros(len(signs), bool)
        order = np.argsort(of[hit], kind="stable")
        held, sentence = np.unique(of[hit][order], return_inverse=True)
        return cls(labels, np.diff(bags.first_sentence), bags.text_of[held], sentence, at[hit][order])

    def rows(self) -> list[tuple]:
        """(label, sentences, sentence of each word, word) for each text; sentences count from 0 in each."""
        n = len(self.labels)
        first = np.searchsorted(self.text_of, np.arange(n + 1))
        at = np.searchsorted(self.sentence, first)
        return [(int(self.labels[i]), int(self.n_sentences[i]), (self.sentence[at[i] : at[i + 1]] - first[i]).tolist(), self.feature[at[i] : at[i + 1]].tolist()) for i in range(n)]

    @classmethod
    def from_table(cls, table: pa.Table) -> Sparse:
        """From columns y, n, sentence and feature, as rows() has them."""
        table = table.combine_chunks()
        y, n = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "n"))
        lists = [table.column(c).combine_chunks() for c in ("sentence", "feature")]
        sizes = pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        own, feature = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        text = np.repeat(np.arange(len(y)), sizes)
        # a text's sentences are numbered from 0 without a gap
        new = np.ones(len(own), bool)
        new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
        return cls(y, n, text[new], np.cumsum(new) - 1, feature)


def descend(data: Sparse, words: np.ndarray, rounds: int = 300, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Gradient descent (Adam, whole batch) on the noisy-or likelihood. Sentences without a learned word all have z = b."""
    y = data.labels.astype(float)
    if not len(words) or not len(y) or y.min() == y.max():
        return Model()  # else the bias alone would take long texts for toxic
    n, m = len(words), len(data.text_of)
    bare = data.n_sentences - np.bincount(data.text_of, minlength=len(y))
    theta = np.zeros(n + 1)
    theta[-1] = -6.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        b = theta[-1]
        z = b + np.bincount(data.sentence, theta[data.feature], m)
        none = np.exp(-bare * np.logaddexp(0, b) - np.bincount(data.text_of, np.logaddexp(0, z), len(y)))
        none = np.minimum(none, 1 - 1e-12)
        factor = np.where(y == 1, -none / (1 - none), 1.0) / len(y)
        slope = factor[data.text_of] * _logistic(z)
        grad = np.append(np.bincount(data.feature, slope[data.sentence], n), slope.sum() + (factor * bare).sum() * _logistic(b))
        grad[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= rate * (0.05 + 0.95 * (1 - step / rounds)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


#: A word gets a weight if it is in texts labelled 1 more often than in others, by a log-likelihood ratio of MIN_G2 or more (20: 8 in a
#: million words by chance); else the many words that occur by chance in a few toxic texts would be learned by heart.
MIN_G2 = 20.0
#: ... and the label is MIN_LIFT times as frequent among its texts as among all: frequent words that long texts have more of pass any test of
#: significance once there are rows enough, and only raise false alarms.
MIN_LIFT = 2.0


def _g2(n_word, n_both, n_all, n_one, log=np.log, largest=np.maximum):
    """Signed log-likelihood ratio of the table of word and label, above 0 if the word goes with label 1; works on arrays and on columns."""
    part = lambda x: x * log(largest(x, x * 0 + 1))
    cells = part(n_both) + part(n_word - n_both) + part(n_one - n_both) + part(n_all - n_word - n_one + n_both)
    sums = part(n_word) + part(n_all - n_word) + part(n_one) + part(n_all - n_one)
    apart = n_both * n_all - n_word * n_one
    return 2 * (cells - sums + part(n_all)) * apart / largest(largest(apart, -apart), apart * 0 + 1)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Fits on texts in memory. Repeated texts count once."""
    if not len(texts) or labels.min() == labels.max():
        return Model()
    last = {(t, int(y)): i for i, (t, y) in enumerate(zip(texts, labels, strict=True))}
    texts, labels = [texts[i] for i in last.values()], labels[list(last.values())]
    words, n_word, n_both = word_counts(texts, labels)
    keep = (_g2(n_word.astype(float), n_both.astype(float), np.float64(len(texts)), np.float64(labels.sum())) >= MIN_G2) & (n_both * len(texts) >= MIN_LIFT * n_word * labels.sum())
    return descend(Sparse.of(texts, labels, words[keep]), words[keep])


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample_docs: int = 16_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on the labelled rows where `train` holds: about sample_docs of them, chosen by a hash of the key (all, where there are fewer).

    The sample is the one bound: words are counted and chosen by Spark over all of it, and the chosen words of the sampled texts
    come to the driver, some numbers for each text. A key with several labels counts as labelled 1 if one of them is; null labels don't count.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    rows = docs.where(train & F.col(text).isNotNull()).select(key, F.col(text).alias("_text"))
    n = rows.select(key).join(marks, key, "left_semi").count()
    steps = 1 << 24
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("label sample")), F.lit(steps)) < int(steps * min(1.0, sample_docs / max(n, 1)))
    picked = rows.where(draw).join(marks, key)
    # repeated texts count once
    picked = frames.written(picked.groupBy(F.xxhash64("_text"), "_label").agg(F.first("_text").alias("_text")).select("_text", "_label", F.xxhash64("_text").alias("_digest")))
    totals = picked.agg(F.count("*"), F.sum("_label")).first()
    n_all, n_one = totals[0] or 0, totals[1] or 0
    if not 0 < n_one < n_all:
        return Model()

    def count(batches):
        for batch in batches:
            texts, y = frames.strings(batch.column(0)), batch.column(1).to_numpy()
            for a, b in vector.groups(texts):
                words, n_word, n_both = word_counts(texts[a:b], y[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n_word), pa.array(n_both)], ["word", "n", "pos"])

    counted = frames.map_arrow(picked, count, "word bigint, n bigint, pos bigint").groupBy("word").agg(F.sum("n").cast("double").alias("n"), F.sum("pos").cast("double").alias("pos"))
    ratio = _g2(F.col("n"), F.col("pos"), F.lit(float(n_all)), F.lit(float(n_one)), F.log, F.greatest)
    words = np.sort(counted.where((ratio >= MIN_G2) & (F.col("pos") * n_all >= F.col("n") * (MIN_LIFT * n_one))).select("word").toArrow().column(0).to_numpy().view(np.uint64))

    def reduce(batches):
        for batch in batches:
            texts, y = frames.strings(batch.column(0)), batch.column(1).to_numpy()
            for a, b in vector.groups(texts):
                cols = list(zip(*Sparse.of(texts[a:b], y[a:b], words).rows(), strict=True))
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column(2).slice(a, b - a)], ["y", "n", "sentence", "feature", "digest"])

    table = frames.map_arrow(picked, reduce, "y int, n int, sentence array<int>, feature array<int>, digest bigint").toArrow()
    # the fit doesn't hang on the order of arrival
    return descend(Sparse.from_table(table.sort_by([("digest", "ascending"), ("y", "ascending")])), words)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, score_name: str = "score", located: bool = True) -> DataFrame:
    """Adds the score and, if `located`, the worst sentence (its index, score, first and last byte) to the kept columns (all, by default)."""
    added = [score_name, *(["worst_sentence", "worst_score", "worst_from", "worst_to"] if located else [])]
    kept = frames.without(docs.columns if keep is None else keep, added)
    hidden = frames.fresh("_text", docs)
    rows = docs.select(*kept, F.col(text).alias(hidden))
    schema = frames.with_fields(rows.drop(hidden), f"`{score_name}` double" + (", worst_sentence int, worst_score double, worst_from bigint, worst_to bigint" if located else ""))

    def apply(batches):
        for batch in batches:
            scores, worst = model.score(frames.strings(batch.column(hidden)))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            index, own, start, end = zip(*worst, strict=True) if worst else ((), (), (), ())
            found = [pa.array(index, pa.int32()), pa.array(own, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores), *(found if located else [])], schema.names)

    return frames.map_arrow(rows, apply, schema)


THRESHOLD = 0.3


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    held_out = F.coalesce(frames.fold("doc_id", 4), F.lit(0)) == 2
    model = learn(docs, frames.read(spark, sf_dir, "labels"), ~held_out)
    found = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "worst_score", "worst_from", "worst_to")
