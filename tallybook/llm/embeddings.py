"""Exact cosine join of embeddings within a label, by metric partitioning.

On unit vectors a cosine bound is a bound on the Euclidean distance. Every vector
lives in the cell of its nearest pivot. By the triangle inequality a neighbour can
live in another cell only if the vector lies within the distance of the plane
between the two pivots; then it also visits that cell. A class starts as one cell;
cells above a size are split again, level by level, as long as a sample of the cell
shows that less work is left. Cells are joined on their own, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

COSINE = 0.93
CELL = 500  # vectors of a cell that is not split further
SAMPLE = 1_000  # vectors of a cell from which its pivots are found; no result depends on them
PIVOTS = 32  # pivots of a cell at most, before those that share too many vectors are merged
WORTH = 0.8  # a cell is split if less than this part of its comparisons is left
LEVELS = 40  # one bit of a number each; cells still large after them are joined in blocks like all others
CHUNK = 10_000  # vectors of a cell that one task places
BLOCK = 4_096  # vectors of a block at most; a task compares two blocks
VALUES = 1 << 21  # numbers of a block at most, for long vectors
STEP = 512  # vectors of a block that are compared at once
CLASS = ["label", "dim"]
KEY = [*CLASS, "cell"]
ENTRY = "label string, dim int, cell string, visits long, rep long, copies long, embedding array<double>"


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


def _near(x: np.ndarray, centre: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and which other pivots' cells may hold a vector within ``reach``."""
    square = _squares(x, centre)
    home = square.argmin(axis=1)
    rows = np.arange(len(x))
    apart = np.sqrt(_squares(centre, centre))[home]
    near = square - square[rows, home][:, None] <= 2 * apart * reach
    near[rows, home] = False
    return home, near


def _centres(x: np.ndarray, reach: float) -> np.ndarray | None:
    """Pivots for a cell with these vectors, or None if a split would not pay.

    Means of half of the vectors are merged, those first that share most vectors, as long as the other half shows
    fewer comparisons. So tight clusters get cells of their own and what has no structure stays together.
    """
    learn, judge = x[::2], x[1::2]
    if len(judge) < 2:
        return None
    random = np.random.default_rng(0)
    centre = learn[:1]
    far = _squares(learn, centre)[:, 0]
    while len(centre) < PIVOTS and far.max() > 1e-6:
        centre = np.vstack([centre, learn[random.choice(len(learn), p=far / far.sum())]])
        far = np.minimum(far, _squares(learn, centre[-1:])[:, 0])
    for _ in range(8):
        home = _squares(learn, centre).argmin(axis=1)
        centre = np.stack([learn[home == k].mean(axis=0) for k in np.unique(home)])
    weight = 1.0 + np.bincount(_squares(learn, centre).argmin(axis=1), minlength=len(centre))
    best, least = None, WORTH * len(judge) ** 2
    while len(centre) > 1:
        home, near = _near(judge, centre, reach)
        visits = near & (np.arange(len(centre))[None, :] > home[:, None])
        work = float(((np.bincount(home, minlength=len(centre)) + visits.sum(axis=0)) ** 2).sum())
        between = np.sqrt(_squares(centre, centre)) + 9 * np.eye(len(centre))
        if work < least and between.min() > 1e-3:
            best, least = centre, work
        shared = np.eye(len(centre))[home].T @ near
        shared = np.triu(shared + shared.T, 1)  # the closer of equals first
        if not shared.any():
            break
        a, b = np.unravel_index(int((shared - np.minimum(between, 8) / 10).argmax()), shared.shape)
        both = weight[a] + weight[b]
        centre = centre.copy()
        centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / both
        weight[a] = both
        centre, weight = np.delete(centre, b, axis=0), np.delete(weight, b)
    return best


def _pivots(reach: float):
    def pivots(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _centres(_unit(pdf.sort_values("rep")["embedding"].tolist()), reach)
        centre = [] if found is None else found.tolist()
        first = pdf.iloc[0]
        return pd.DataFrame({"label": first["label"], "dim": first["dim"], "cell": first["cell"], "n": first["n"], "number": range(len(centre)), "centre": pd.Series(centre, dtype=object)})

    return pivots


def _placed(reach: float, level: int):
    """Rows of a vector for the cell that it lives in and for those it visits, which have higher numbers."""

    def place(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["label", "dim", "cell", "visits", "rep", "copies", "embedding"]]
        if not len(rows) or not len(pivots):
            return rows.iloc[:0]
        centre = np.stack(pivots.sort_values("number")["centre"].tolist())
        home, near = _near(_unit(rows["embedding"].tolist()), centre, reach + 1e-9)
        at, to = np.nonzero(near & (np.arange(len(centre))[None, :] > home[:, None]))
        name = rows["cell"].iloc[0]
        away = rows.iloc[at]
        away = away.assign(cell=[f"{name}.{k}" for k in to], visits=away["visits"] | (1 << level))
        return pd.concat([rows.assign(cell=[f"{name}.{k}" for k in home]), away])

    return place


def _joined(cosine: float):
    """Links and the least id reachable of each vector of two blocks; two vectors that came to a cell as visitors meet elsewhere."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
        a, b = pdf[pdf["block"] == one], pdf[pdf["block"] == two]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        x, y = _unit(a["embedding"].tolist()), _unit(b["embedding"].tolist())
        away_a, away_b = a["visits"].to_numpy(), b["visits"].to_numpy()
        ids_a, ids_b = a["rep"].to_numpy(), b["rep"].to_numpy()
        steps = [slice(k, k + STEP) for k in range(0, len(a), STEP)]
        linked = np.empty((len(a), len(b)), dtype=bool)
        for k in steps:
            linked[k] = x[k] @ y.T >= cosine
            if away_a[k].any():
                linked[k] &= (away_a[k, None] & away_b[None, :]) == 0
        if one == two:
            np.fill_diagonal(linked, False)
        copies_a, copies_b = a["copies"].to_numpy(dtype=float), b["copies"].to_numpy(dtype=float)
        links = np.concatenate([linked[k] @ copies_b for k in steps]).astype(np.int64)
        linked_back = sum(copies_a[k] @ linked[k] for k in steps).astype(np.int64)
        root_a, root_b = ids_a.copy(), ids_b.copy()
        far = np.iinfo(np.int64).max
        while True:  # the least id reachable within this pair of blocks
            low_a = np.minimum(root_a, np.concatenate([np.where(linked[k], root_b[None, :], far).min(axis=1) for k in steps]))
            low_b = root_b
            for k in steps:
                low_b = np.minimum(low_b, np.where(linked[k], low_a[k, None], far).min(axis=0))
            if one == two:
                low_a = low_b = np.minimum(low_a, low_b)
            if (low_a == root_a).all() and (low_b == root_b).all():
                break
            root_a, root_b = low_a, low_b
        found = [pd.DataFrame({"rep": ids_a, "links": links, "root": root_a})]
        if one != two:
            found.append(pd.DataFrame({"rep": ids_b, "links": linked_back, "root": root_b}))
        found = pd.concat(found)
        return found[found["links"] > 0]

    return join


def cells(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Nodes (label, dim, rep, copies, embedding) with (cell, visits), once for each cell they live in or visit.

    Bit k of ``visits`` says that the node came to this cell's part of level k as a visitor. Two nodes within the
    bound share exactly one cell in which they have no bit in common. Pivots stay in tables: a task that places
    vectors gets those of its one cell.
    """
    reach = math.sqrt(2 - 2 * cosine)
    entries = nodes.select(*CLASS, F.lit("").alias("cell"), F.lit(0).cast("long").alias("visits"), "rep", "copies", "embedding")
    done = []
    for level in range(LEVELS):
        large = common.small(common.stored(entries.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > CELL), "embeddings-large"))
        chance = F.pmod(F.xxhash64("rep", F.lit(29 + level)), F.lit(1 << 30)) / float(1 << 30)
        sample = entries.join(large, KEY).where(chance * F.col("n") < SAMPLE)
        found = sample.select(*KEY, "n", "rep", "embedding").groupBy(*KEY).applyInPandas(_pivots(reach), "label string, dim int, cell string, n long, number int, centre array<double>")
        found = common.stored(found, "embeddings-pivots")
        if found.isEmpty():
            break
        split = common.small(found.groupBy(*KEY).agg(F.ceil(F.max("n") / CHUNK).cast("int").alias("chunks")))
        done.append(entries.join(split, KEY, "left_anti"))
        dealt = entries.join(split, KEY).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
        centres = found.join(split, KEY).select(*KEY, "number", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        together = dealt.groupBy(*KEY, "chunk").cogroup(centres.groupBy(*KEY, "chunk"))
        entries = common.stored(together.applyInPandas(_placed(reach, level), ENTRY), "embeddings-cells")
    for part in done:
        entries = entries.unionByName(part)
    return entries


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors of equal label and length are compared. Equal vectors of a label are one node and linked with
    each other. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing. A row without an id takes no part: no component, and kept. Repeated rows are
    copies of each other. A cosine of exactly the threshold links. Texts are not read, nor are extra columns. Empty
    tables give empty results.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = common.stored(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("embedding", F.when(F.col("good"), F.col("embedding"))), "embeddings")
    same = ["label", "embedding"]
    nodes = rows.where("good").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))
    nodes = common.stored(nodes, "embeddings-nodes")
    placed = cells(nodes, cosine)
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(64), F.floor(F.lit(VALUES) / F.col("dim"))))
    counts = placed.groupBy(*KEY).agg(F.count("*").alias("n")).select(*KEY, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    counts = common.small(common.stored(counts, "embeddings-blocks"))
    dealt = placed.join(counts, KEY).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    found = dealt.select(*KEY, "one", "two", "block", "rep", "copies", "visits", "embedding").groupBy(*KEY, "one", "two").applyInPandas(_joined(cosine), "rep long, links long, root long")
    found = common.stored(found, "embeddings-links")
    direct = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = common.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "embeddings-components")
    known = nodes.join(direct, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(known, same, "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
