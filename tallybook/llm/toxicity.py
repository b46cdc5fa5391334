"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is toxic if at least one of its sentences is:
sentence probabilities are combined by noisy-or, and the sentence model is trained on
the likelihood of the document labels. The sentences that score highest then show where.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

# Labelled documents that are learned from at most; chosen by a hash of the id.
MAX_TRAIN = 20_000
# The sentence model knows every feature whose presence goes with the label this clearly: the log of how much likelier
# the counts of both kinds of documents are than without a link. By chance alone about one feature in ten thousand gets there.
CLEAR = 7.0
# A word has itself and its first letters, as many as these, as features.
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each stretch between sentence ends that has a word."""
    for m in SENTENCE.finditer(text):
        found = TOKEN.findall(m[0].lower())
        if found:
            yield m.start(), m.end(), found


def features(word: str) -> list[str]:
    """The word, and a mark and its first letters for each length that it exceeds."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class Lookup(dict):
    """Word to what is known of its features; forgets all words when it has grown large."""

    def __init__(self, known: dict, most: int = 200_000):
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, word: str) -> tuple:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = tuple((f, self.known[f]) for f in features(word) if f in self.known)
        return found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            words = set(TOKEN.findall((text.as_py() or "").lower()))
            counts[int(label > 0)].update({f for w in words for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())], names=["word", "pos", "neg"])


def _bags(vocabulary: dict[str, int]):
    """(doc_id, label, plain sentences, known words of each other sentence one after the other with its length)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_of = Lookup(vocabulary)
        for batch in batches:
            plain, words, lengths = [], [], []
            for text in batch.column("text"):
                none, flat, sizes = 0, [], []
                for _, _, found in sentences(text.as_py() or ""):
                    known = sorted({k for w in found for _, k in known_of[w]})
                    if known:
                        flat += known
                        sizes.append(len(known))
                    else:
                        none += 1
                plain.append(none)
                words.append(flat)
                lengths.append(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(plain, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], names=["doc_id", "label", "plain", "words", "lengths"])

    return bags


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def sentence(self, known: set[tuple[str, float]]) -> float:
        """Probability of a sentence with these features and weights."""
        z = self.bias + sum(x for _, x in known)
        return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))


def fit(y: np.ndarray, plain: np.ndarray, doc: np.ndarray, lengths: np.ndarray, words: np.ndarray, n_words: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights of at least 0 by Adam on the noisy-or likelihood of the labels ``y``.

    ``doc`` and ``lengths`` are of the sentences with a known word; ``plain`` counts the others of each document,
    which all have the bias alone.
    """
    n = np.maximum(np.bincount(doc, minlength=len(y)) + plain, 1)
    base = (y.sum() + 1) / (len(y) + 2)
    p0 = base / n.mean()
    theta = np.zeros(n_words + 1)
    theta[-1] = np.log(p0 / (1 - p0))
    of = np.repeat(np.arange(len(lengths)), lengths)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(of, theta[words], len(lengths)) + theta[-1]
        keep = np.bincount(doc, -np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, theta[-1])  # log of no toxic sentence
        p = np.clip(-np.expm1(keep), 1e-9, 1)
        pull = np.where(y > 0, -(1 - p) / p, 1.0) / len(y)
        slope = pull[doc] / (1 + np.exp(-z))
        g = np.zeros_like(theta)
        g[:-1] = np.bincount(words, slope[of], n_words) + ridge * theta[:-1]
        g[-1] = slope.sum() + (pull * plain).sum() / (1 + np.exp(-theta[-1]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # a sentence is toxic for what it holds, never for what it lacks
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from about ``max_train`` labelled documents at most that are not held out."""
    chosen = common.bounded_sample(common.one_label(labels, "toxic").where(~common.held_out(3, 1)), "doc_id", max_train)
    # bounded by max_train rows of two numbers
    rows = common.stored(common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")
    n_pos, n_neg = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n_pos or not n_neg:
        share = ((n_pos or 0) + 1) / ((n_pos or 0) + (n_neg or 0) + 2)
        return Model(float(np.log(share / (1 - share))) - 3, {})
    counts = rows.mapInArrow(_word_counts, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # the likelihood ratio of "label and feature are independent"; a Wald score would rank clean cuts low
    term = lambda seen, of, share: F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)
    total = n_pos + n_neg
    seen, share = F.col("pos") + F.col("neg"), (F.col("pos") + F.col("neg")) / float(total)
    clear = term(F.col("pos"), F.lit(float(n_pos)), share) + term(F.col("neg"), F.lit(float(n_neg)), share)
    clear += term(n_pos - F.col("pos"), F.lit(float(n_pos)), 1 - share) + term(n_neg - F.col("neg"), F.lit(float(n_neg)), 1 - share)
    # a few toxic documents cannot be that clear: then what all of a quarter of them would reach is enough
    alone = (int(n_pos) / 4) * math.log(total / n_pos)
    # few words pass, as all come from max_train texts
    names = [r.word for r in counts.where((clear >= min(CLEAR, alone)) & (F.col("pos") * n_neg > F.col("neg") * n_pos)).orderBy("word").collect()]
    bags = rows.mapInArrow(_bags({w: k for k, w in enumerate(names)}), "doc_id long, label int, plain long, words array<int>, lengths array<int>").toPandas().sort_values("doc_id")
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *bags[c]]).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), [len(x) for x in bags["lengths"]])
    bias, weights = fit((bags["label"].to_numpy() > 0).astype(float), bags["plain"].to_numpy(dtype=float), doc, flat("lengths"), flat("words"), len(names))
    return Model(bias, dict(zip(names, weights.tolist())))


def detect(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_sentences, offending.

    ``score`` is the noisy-or of the sentences; a null text, or one without a word, has none and scores 0.
    ``offending`` lists the sentences with probability 0.5 or more as (start, end, score) in characters. Labels
    are learned from ids whose crc32 leaves a remainder other than 1 by 3; of repeated labels the largest
    counts, and labels of unknown documents are ignored. A row without an id is held out and scored. Repeated
    rows get equal results. Without labels of both kinds the score comes from the share of label 1 alone.
    Ties do not arise: each row is judged alone. A very long text is read whole, sentence by sentence. Extra columns
    are not read. Empty tables give empty results.
    """
    model = train(docs, labels, max_train)
    # a word that changes nothing is not looked up
    known = {w: x for w, x in model.weights.items() if abs(x) > 1e-3}
    plain = np.log1p(-model.sentence(set()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_of = Lookup(known)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                clean, n, found = 0.0, 0, []
                for start, end, words in sentences(text.as_py() or ""):
                    n += 1
                    here = {x for w in words for x in known_of[w]}
                    if not here:
                        clean += plain
                        continue
                    p = model.sentence(here)
                    clean += np.log1p(-min(p, 1 - 1e-12))
                    if p >= 0.5:
                        found.append({"start": start, "end": end, "score": float(p)})
                out.append((float(np.clip(-np.expm1(clean), 0, 1)), n, found))
            score, n, found = zip(*out) if out else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "score", "n_sentences", "offending"])

    found = common.id_and_text(docs).mapInArrow(judge, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
    return found.select("doc_id", common.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")
