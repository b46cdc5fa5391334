"""Near duplicates on word shingles: banded MinHash candidates, odd sketches, exact confirmation.

One pass over the texts gives each document its MinHash samples, kept only as band
hashes and as an odd sketch: the samples are folded into a bitmap in which a bit is
set if an odd number of them fell on it. The XOR of two sketches shows how many
samples differ, which is precise for high similarities and throws out weak
candidates before any shingle set is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

SHINGLE = 5
# 26 bands of 5 samples: a pair at similarity 0.85 shares no band with probability 2e-7.
BANDS, ROWS = 26, 5
SKETCH_WORDS = 16  # of 64 bits
SAMPLES = 2 * BANDS * ROWS  # the bands use the first half, the sketch all
# Of the samples of a pair at 0.85, 39 +- 5.8 differ; more than 75 do with probability 1e-7. Sketches that show
# more than that, and 12 bits for their own error, are dropped.
MOST_DIFFERENT = 75
SKETCH_ERROR = 12
PARTS = 32  # of the range of shingle hashes, in which shingles known from other documents are counted


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every 5-word shingle, or of the whole sequence of a shorter text."""
    hashes, doc, _ = common.words(data, offsets, fold=True)
    c = common.seeds(SHINGLE, 11)
    n = len(hashes) - SHINGLE + 1
    full_doc, full = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        whole = doc[SHINGLE - 1 :] == doc[:n]
        full = sum(hashes[k : k + n] * c[k] for k in range(SHINGLE))[whole]
        full_doc = doc[:n][whole]
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    short = (n_words > 0) & (n_words < SHINGLE)
    part = short[doc]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    total = np.zeros(len(n_words), np.uint64)
    np.add.at(total, doc[part], hashes[part] * c[place[part]])
    few = np.flatnonzero(short)
    all_doc = np.concatenate([full_doc, few])
    all_hash = common.mix(np.concatenate([full, total[few] + n_words[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)]))
    order = np.argsort(all_doc, kind="stable")
    return all_doc[order], all_hash[order]


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    doc, hashes = shingles(data, offsets)
    bound = common.per_document(doc, len(offsets) - 1)
    return [np.unique(hashes[bound[k] : bound[k + 1]]) for k in range(len(offsets) - 1)]


MULTIPLY, ADD = common.seeds(SAMPLES, 101), common.seeds(SAMPLES, 202)
FOLD = common.seeds(ROWS, 303)


def samples(values: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, worked on in slices so that a long text needs little memory."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 1024):
        part = values[k : k + 1024]
        np.minimum(low, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    return common.mix((low[: BANDS * ROWS].reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    bits = SKETCH_WORDS * 64
    places = common.mix(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    odd = (np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in common.text_blocks(batch.column("text")):
            rows = []
            for values in _sets(data, offsets):
                if len(values):
                    low = samples(values)
                    key = int((common.mix(values + np.uint64(7)).sum(dtype=np.uint64)).view(np.int64)), int(np.bitwise_xor.reduce(common.mix(values)).view(np.int64))
                    rows.append((len(values), *key, bands_of(low), odd_sketch(low)))
                else:
                    rows.append((0, None, None, None, None))
            n, k1, k2, bands, sketch = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n", "k1", "k2", "bands", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, bands, sketch) of every row; k1 and k2 are equal for equal shingle sets."""
    return common.in_python(common.id_and_text(docs), _signed, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in common.text_blocks(batch.column("text")):
            sets = [x.view(np.int64) for x in _sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "grams"])


def _promising(threshold: int) -> Column:
    """Size ratio that the threshold allows, and sketches that show few enough differing samples."""
    differ = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    bits = SKETCH_WORDS * 64
    # expected odd bits after 2 * MOST_DIFFERENT toggles
    most = bits / 2 * (1 - (1 - 2 / bits) ** (2 * MOST_DIFFERENT))
    return (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (differ <= int(np.ceil(most)) + SKETCH_ERROR)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, grams) of the documents in ``wanted``; texts are read again, and shuffled only if those are many."""
    texts = common.id_and_text(docs).join(common.small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    return common.stored(common.in_python(texts, _full_sets, "doc_id long, grams array<long>").dropDuplicates(["doc_id"]), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("i"), (F.size("ga") + F.size("gb")).alias("t"))
    return both.where(100 * F.col("i") >= threshold * (F.col("t") - F.col("i"))).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one node. Each bucket of a band hands its members to one leader,
    another one in each band, so that a bucket of any size gives as many candidates as it has members.
    Buckets whose members are then still in several components do so twice more, with leaders from outside
    the first one's component. What is outside of it after that is compared with the others of the bucket that
    belong elsewhere, in the first bucket that both share, if the shingles that occur in any second document,
    counted by parts of the hash range, could make them similar enough. A null or blank text has no shingles and is linked with nothing. A row
    without an id is linked with nothing, has no component and is kept. Repeated rows get equal results.
    Empty tables give empty results.
    """
    sig = common.stored(signatures(docs), "minhash-signatures")
    same = ["k1", "k2", "n"]
    nodes = common.stored(sig.where("doc_id is not null and n > 0").groupBy(*same).agg(F.min("doc_id").alias("node")), "minhash-nodes")
    slim = sig.where("doc_id is not null").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    slim = common.stored(slim.dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch", "bands"), "minhash-reps")
    keys = common.stored(sig.select("doc_id", *same), "minhash-keys")
    common.drop(sig)
    members = slim.select("doc_id", F.posexplode("bands").alias("band", "bucket"))

    # the leader of a bucket has the smallest hash of id and band
    ticket = F.struct(F.xxhash64("doc_id", "band").alias("h"), "doc_id")
    buckets = members.groupBy("bucket").agg(F.min(ticket)["doc_id"].alias("leader"), F.count("*").alias("m")).where("m > 1")
    # tables of their own, here and below, so that the joins shuffle apart from the sums and Spark can split a large bucket
    buckets = common.stored(buckets, "minhash-buckets")
    shared = common.stored(members.join(buckets.select("bucket", "leader"), "bucket").select("bucket", "band", "doc_id", "leader"), "minhash-members")
    stars = shared.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    a = slim.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = slim.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    stars = common.stored(stars.join(a, "a").join(b, "b").where(_promising(threshold)).select("a", "b"), "minhash-stars")
    sets = _sets_of(docs, _ends(stars))
    links = common.stored(_confirmed(stars, sets, threshold), "minhash-links")
    common.drop(sets, stars)
    groups = common.stored(common.components(links, "minhash-stars"), "minhash-groups")
    common.drop(links)

    root = groups.select(F.col("node").alias("doc_id"), "root")
    placed = shared.join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    mixed = common.stored(mixed, "minhash-mixed-buckets")
    placed = common.stored(placed.join(mixed, "bucket", "left_semi").select("bucket", "band", "doc_id", "leader"), "minhash-mixed")
    sets = _sets_of(docs, placed)
    grams = sets.select("doc_id", F.explode("grams").alias("gram"))
    twice = grams.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("part")
    parts = grams.join(twice, "gram", "left_semi").groupBy("doc_id", part).agg(F.count("*").cast("int").alias("m"))
    counts = F.map_from_entries(F.collect_list(F.struct("part", "m")))
    known = parts.groupBy("doc_id").agg(F.sum("m").alias("known"), counts.alias("of"))
    known = known.select("doc_id", "known", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.col("of")[k], F.lit(0))).alias("parts"))
    facts = slim.join(known, "doc_id").select("doc_id", "n", "sketch", "bands", "known", "parts").where(100 * F.col("known") >= threshold * F.col("n"))
    placed = common.stored(placed.join(facts, "doc_id"), "minhash-placed")
    # two documents share at most the smaller count of known shingles in each part of the hash range
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, m: t + m)
    enough = _promising(threshold) & (100 * most >= threshold * (F.col("na") + F.col("nb") - most))

    def rooted(groups: DataFrame) -> DataFrame:
        root = groups.select(F.col("node").alias("doc_id"), "root")
        led = groups.select(F.col("node").alias("leader"), F.col("root").alias("led"))
        now = placed.join(root, "doc_id", "left").join(led, "leader", "left").withColumn("root", F.coalesce("root", "doc_id"))
        return now.withColumn("stray", F.col("root") != F.coalesce("led", "leader"))

    def side(rows: DataFrame, end: str) -> DataFrame:
        return rows.select("bucket", "band", "stray", "root", *[F.col(c).alias(c[0] + end) for c in ("n", "sketch", "bands", "parts")], F.col("doc_id").alias(end)).alias(end)

    elsewhere = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") != F.col("b.root")) & enough
    for turn in range(2):
        # another leader from outside the first one's component: again as many candidates as members
        now = rooted(groups)
        heads = now.where("stray").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id", "band", F.lit(turn)).alias("h"), "doc_id", "band", "stray", "root", "n", "sketch", "bands", "parts")).alias("x"))
        heads = common.stored(heads, "minhash-heads")
        stars = side(heads.select("bucket", "x.*"), "a").join(side(now, "b"), elsewhere).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _confirmed(stars, sets, threshold).unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, groups = groups, common.stored(common.components(more, "minhash-stars"), "minhash-groups")
        common.drop(before, heads)
    now = common.stored(rooted(groups), "minhash-rooted")
    first = F.array_position(F.zip_with("ba", "bb", lambda p, q: p == q), True) == F.col("a.band") + 1
    once = ~F.col("b.stray") | (F.col("a") < F.col("b"))
    across = side(now.where("stray"), "a").join(side(now, "b"), elsewhere & once & first)
    more = common.stored(_confirmed(across.select("a", "b"), sets, threshold), "minhash-more")
    links = more.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
    final = common.stored(common.components(links, "minhash-components"), "minhash-final")
    common.drop(sets, more, groups, buckets, shared, mixed, slim, placed, now)

    roots = nodes.join(final, "node", "left").select(*same, F.coalesce("root", "node").alias("root"))
    out = keys.join(roots, same, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
