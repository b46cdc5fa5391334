"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language has
several centroids, found by spherical clustering of its training vectors; the nearest
by cosine gives the language, and a text further from it than its own training
vectors are is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

DIMENSIONS = 4096
CENTROIDS = 3
# Training texts of all languages together at most, dealt evenly. With more than a quarter as many languages, those with
# the most texts are learned, so that each has about 4.
MAX_TRAIN = 6_000
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams; None without a letter. A long text is worked on in slices."""
    total, seen = np.zeros(DIMENSIONS), False
    for k in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[k : k + (1 << 20) + 2].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        seen = seen or bool(letter.any())
        c = np.where(letter, points, 32).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        for n, grams in ((0, c), (1, two), (2, three)):
            keep = letter[: len(grams)] | (letter[1 : len(grams) + 1] if n else False)
            spread = (grams[keep] + np.uint32(n)) * np.uint32(0xC2B2AE3D)
            total += np.bincount(spread >> np.uint32(20), minlength=DIMENSIONS)
    return total if seen else None


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, at, n = [], [], []
        for own, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts = gram_counts(text.as_py() or "")
            if counts is not None:
                used = np.flatnonzero(counts)
                lang.append(own)
                at.append(used)
                n.append(counts[used])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["lang", "at", "n"])


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)  # of each centroid
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMENSIONS))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS)))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))  # cosine below which a text is rejected

    def vector(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / max(np.sqrt(x @ x), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors: the one nearest the mean, then the furthest ones, then Lloyd steps."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(near)))
    centres = x[chosen].copy()
    for _ in range(10):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centres[c] = mean / max(np.sqrt(mean @ mean), 1e-12)
    return centres


def train(docs: DataFrame, max_train: int = MAX_TRAIN, k: int = CENTROIDS) -> Model:
    """Learn from texts with a language that are not held out: a share of each language, by a hash of the id.

    Languages without a text that has a letter are not learned; of more than ``max_train / 4`` languages those with
    the most texts are, ties by name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(~common.held_out(5, 0)).where("lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = {r.lang: r.n for r in counts.limit(max(1, max_train // 4)).collect()}
    if not sizes:
        return Model()
    each = max_train // len(sizes)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sizes.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language; texts stay where they are unless there are very many
    got = rows.join(common.small(shares), "lang").where(chance < F.col("share")).select("lang", "text", "doc_id").mapInArrow(_sparse, "lang string, at array<int>, n array<float>").toArrow()
    if not len(got):
        return Model()
    own = np.array(got.column("lang").to_pylist(), dtype=object)
    at, n = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.column(x).chunks]) for x in ("at", "n"))
    bounds = np.append(0, np.cumsum(np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in got.column("at").chunks])))
    idf = np.log((1 + len(got)) / (1 + np.bincount(at, minlength=DIMENSIONS))) + 1
    del got

    def vectors(lang: str) -> np.ndarray:
        """Unit vectors of one language's texts; the order in which tasks hand over their rows must not matter."""
        parts = [slice(bounds[k], bounds[k + 1]) for k in np.flatnonzero(own == lang)]
        parts.sort(key=lambda p: (at[p].tobytes(), n[p].tobytes()))
        x = np.zeros((len(parts), DIMENSIONS), dtype=np.float32)
        for row, p in enumerate(parts):
            x[row, at[p]] = np.log1p(n[p].astype(np.float64))
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
        return x

    langs, centres, least = [], [], []
    for lang in sorted(set(own)):
        x = vectors(lang)
        found = _clusters(x, k)
        near = x @ found.T
        nearest = near.argmax(axis=1)
        for c in range(len(found)):
            langs.append(lang)
            centres.append(found[c])
            inside = near[nearest == c, c]
            least.append(float(np.quantile(inside, 0.01)) * 0.8 if len(inside) else 0.0)
    return Model(langs, idf, np.array(centres, dtype=np.float64), np.array(least))


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    ``lang_pred`` is the language of the nearest centroid, ``score`` the cosine; ``rejected`` says that it lies
    below what 99 % of the centroid's training texts reach, less a fifth. A null text, or one without a letter,
    and any text if nothing was learned, is ``und`` with score 0, rejected. A row without an id is held out.
    Repeated rows get equal results; a null lang is not learned from. Centroids at equal distance: the language first by
    name. A very long text is read whole, in slices. Extra columns are not read. Empty tables give empty results.
    """
    model = train(docs, max_train)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                counts = gram_counts(text.as_py() or "") if model.langs else None
                if counts is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                near = model.centroids @ model.vector(counts)
                best = int(near.argmax())
                out.append((model.langs[best], float(np.clip(near[best], 0, 1)), bool(near[best] < model.least[best])))
            lang, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    found = common.id_and_text(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", common.held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")
