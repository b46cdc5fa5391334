"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature and, after
that, tables for the pairs of features that explain most of what is left. A score
is a sum of table entries found by the bins of the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm import common

FEATURES = """
log_bytes log_words word_length upper_share bang_share symbol_share bar_share digit_share
line_share wide_share stop_share distinct_share stutter_share repeat_share
""".split()
SYMBOLS = b"#*$%&|<>"
# Labelled rows that the model is fitted on at most; chosen by a hash of the id.
MAX_TRAIN = 20_000


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(members)] = 1
    return table


CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "bang": _class(b"!"),
    "symbol": _class(SYMBOLS),
    "bar": _class(b"|"),
    "digit": _class(bytes(range(48, 58))),
    "line": _class(b"\n"),
    "wide": _class(bytes(range(0xC0, 0x100))),
    "stop": _class(b".,;:?"),
}


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each document."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document; all 0 for an empty one."""
    n = len(offsets) - 1
    count = {}
    for name, table in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[data])])
        count[name] = sums[offsets[1:]] - sums[offsets[:-1]]
    hashes, doc, length = common.words(data, offsets, fold=False)
    n_words = np.bincount(doc, minlength=n)
    size, per_word = np.maximum(np.diff(offsets), 1), np.maximum(n_words, 1)
    same = doc[1:] == doc[:-1]
    stutter = np.bincount(doc[1:][same & (hashes[1:] == hashes[:-1])], minlength=n)
    three = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
    c = common.seeds(3, 5)
    grams = common.mix(hashes[:-2] * c[0] + hashes[1:-1] * c[1] + hashes[2:] * c[2])[three] if len(doc) > 2 else np.zeros(0, np.uint64)
    of = doc[:-2][three] if len(doc) > 2 else np.zeros(0, np.int64)
    n_grams = np.bincount(of, minlength=n)
    columns = [
        np.log1p(np.diff(offsets)), np.log1p(n_words), np.bincount(doc, weights=length, minlength=n) / per_word,
        count["upper"] / size, count["bang"] / per_word, count["symbol"] / per_word, count["bar"] / per_word, count["digit"] / size,
        count["line"] / per_word, count["wide"] / size, count["stop"] / per_word,
        _distinct(doc, hashes, n) / per_word, stutter / per_word, 1 - _distinct(of, grams, n) / np.maximum(n_grams, 1),
    ]
    columns[-1][n_grams == 0] = 0
    return np.column_stack(columns)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in common.text_blocks(batch.column("text")):
            x = features(data, offsets)
            flat = pa.array(x.reshape(-1), pa.float64())
            bounds = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(bounds, flat)], names=["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""
    return common.in_python(common.id_and_text(docs), _featured, "doc_id long, x array<double>")


@dataclass
class Model:
    """Cuts and tables of each feature, and of each pair (i, j, cuts of i, cuts of j, table)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf value of every bin, of a tree that splits the best leaf until there are ``leaves``."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    worth = lambda s, t: s * s / (t + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left, right = H[at] - H[a], H[b] - H[at]
            gain = worth(G[at] - G[a], left) + worth(G[b] - G[at], right) - worth(G[b] - G[a], H[b] - H[a])
            gain[(left < least) | (right < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, bins: int = 32, pair_bins: int = 8, n_pairs: int = 5, rate: float = 0.2) -> Model:
    """Boost the features in turn, then the strongest pairs in turn, on the logistic loss."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))), [], [], [])
    k = x.shape[1]
    cuts = [_cuts(x[:, f], bins) for f in range(k)]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(tables[f])), np.bincount(at[f], h, len(tables[f])), 4, 1.0, 0.5)
            tables[f] += step
            total += step[at[f]]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(k)]
    cell = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    grid = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    g, h = slopes()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            flat, n = cell[i] * grid(i, j)[1] + cell[j], grid(i, j)[0] * grid(i, j)[1]
            gains.append((float((np.bincount(flat, g, n) ** 2 / (np.bincount(flat, h, n) + 5)).sum()), i, j, flat, n))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]
    boosted = [np.zeros(t[4]) for t in chosen]
    for _ in range(rounds // 3):
        for table, (_, i, j, flat, n) in zip(boosted, chosen):
            g, h = slopes()
            G, H = np.bincount(flat, g, n).reshape(grid(i, j)), np.bincount(flat, h, n).reshape(grid(i, j))
            rows = _tree(G.sum(1), H.sum(1), 2, 5.0, 2.0)
            step = np.zeros(grid(i, j))
            for value in np.unique(rows):  # a second level below the split on the first feature
                part = rows == value
                step[part] = _tree(G[part].sum(0), H[part].sum(0), 2, 5.0, 2.0)
            step = rate * step.reshape(-1)
            table += step
            total += step[flat]
    pairs = [(i, j, coarse[i], coarse[j], table.reshape(grid(i, j))) for table, (_, i, j, _, _) in zip(boosted, chosen)]
    return Model(bias, cuts, tables, pairs)


def train(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN) -> Model:
    """Fit on documents that are not held out, about ``max_train`` at most."""
    chosen = common.bounded_sample(common.one_label(labels, label).where(~common.held_out(5, 0)), "doc_id", max_train)
    # bounded by max_train rows of two numbers
    rows = feature_table(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(chosen, "doc_id")
    got = rows.select("x", "label", "doc_id").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, (got["label"].to_numpy(dtype=float) > 0).astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column, the score found by its features, called by common.unused(); all rows and columns pass through."""
    schema = T.StructType([*docs.schema.fields, T.StructField(common.unused(docs, "score"), T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            found = [model.score(features(data, offsets)) for _, _, data, offsets in common.text_blocks(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], names=schema.names)

    return common.in_python(docs, score, schema)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learned from ids whose crc32 leaves a remainder other than 0 by 5. A null or empty text has
    all features 0 and gets the score learned for that; a row without an id is held out and scored. Repeated
    rows each get the same score. Without labels of both kinds every score is the smoothed share of label 1
    (0.5 without any). Of repeated labels the largest counts. Ties do not arise: each row is judged alone. A very
    long text is read whole. Extra columns are not read. Empty tables give empty results.
    """
    result = scored(common.id_and_text(docs), train(docs, labels, "quality", max_train))
    return result.select("doc_id", common.held_out(5, 0).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that classify() predicts 1 for, in one pass and with the columns as they are, whatever they are called."""
    rows = scored(docs, train(docs, labels, "quality", max_train))
    return rows.where(F.col(rows.columns[-1]) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
