"""Document fingerprints that feel edits: a randomised embedding of edit distance into Hamming distance.

A pointer walks over the characters of a text. At every step the character under it is written down, and a
coin, shared by all texts and chosen by step and character, tells whether the pointer moves on. Texts that
differ by few edits fall into step again, so the strings written down differ in few places.

A fingerprint keeps one bit of the character at sampled steps. The steps sampled for a walk of up to 2 ** k
steps are nested in those for shorter ones, so that fingerprints of texts of any lengths can be held against
each other. Bands of the bits propose near copies, which the whole fingerprints confirm: every two that share
a band are compared or already known to be joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm import common, tries
from tallybook.llm.suffix import cumulated

# Coins repeat after so many steps; characters fall into so many classes of coins.
PERIOD = 1 << 12
CLASSES = 1 << 6
# Sampled steps of a long walk, about; walks of up to so many steps are kept whole.
SAMPLES = 512
# Walks that are worth a vectorised step together; fewer go one by one.
TOGETHER = 64
# Characters and texts that are walked over in one go; a longer text is a go of its own.
LOT_CHARS, LOT_TEXTS = 1 << 23, 8_000
BANDS, BAND_BITS = 32, 40
NEAR = 0.9
ROUNDS = 3
# Fingerprints on each side of one comparison of all with all; a band with more is dealt to several tasks.
CELL = 2_048


@cache
def _coins() -> tuple[np.ndarray, list[int]]:
    """Steps that the pointer stays at a character of a class from a step on, at class * PERIOD + step."""
    heads = (common.mix(common.seeds(CLASSES * PERIOD, 101)) >> np.uint64(63)).astype(bool).reshape(CLASSES, PERIOD)
    twice = np.concatenate([heads, heads], axis=1)
    following = np.where(twice, np.arange(2 * PERIOD), 4 * PERIOD)
    following = np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    stay = (following - np.arange(PERIOD) + 1).astype(np.int32).ravel()
    return stay, stay.tolist()


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class times PERIOD, and the bit written down, of every code point."""
    mixed = common.mix(np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    return ((mixed >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int32) * PERIOD, (mixed & np.uint64(1)).astype(np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(points: np.ndarray, offsets: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The step at which the pointer leaves each character; ``begun`` is the first step of each text.

    All texts are walked over at once, character by character; the last few long ones one by one.
    """
    stay, listed = _coins()
    rows = _characters()[0][points]
    out = np.empty(len(points), np.int32)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    at, step, lengths = offsets[:-1][order], begun[order].astype(np.int32), lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    apart = int(np.searchsorted(-alive, -TOGETHER, "right"))
    for i in range(apart):
        m = alive[i]
        place = at[:m] + i
        now = step[:m]
        now += stay[rows[place] + (now & (PERIOD - 1))]
        out[place] = now
    for k in range(alive[apart] if apart < len(alive) else 0):
        a, b, now, left = at[k] + apart, at[k] + lengths[k], int(step[k]), []
        for row in rows[a:b].tolist():
            now += listed[row + (now & (PERIOD - 1))]
            left.append(now)
        out[a:b] = left
    return out


# ---- fingerprints -------------------------------------------------------------------------------------------


def _level(steps: int) -> int:
    return max(SAMPLES.bit_length() - 1, (steps - 1).bit_length() if steps else 0)


@cache
def sampled(level: int) -> np.ndarray:
    """Sampled steps of a walk of at most 2 ** level steps: half of the level's below, and as many in its upper half."""
    if 1 << level <= SAMPLES:
        return np.arange(1 << level)
    below, half = sampled(level - 1), 1 << (level - 1)
    kept = below[(common.mix(below.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)) & np.uint64(1)) == 0]
    new = common.mix(common.seeds(SAMPLES // 2, 1000 + level)) % np.uint64(half)
    return np.concatenate([kept, half + np.unique(new.astype(np.int64))])


@cache
def _still(level: int, upper: int) -> np.ndarray:
    """Which sampled steps of a level are sampled at an upper one too."""
    return np.isin(sampled(level), sampled(upper), assume_unique=True)


def bits_of(points: np.ndarray, left: np.ndarray) -> tuple[int, np.ndarray]:
    """(steps of the walk, one bit of the character at each sampled step)."""
    steps = int(left[-1]) if len(left) else 0
    wanted = sampled(_level(steps))
    wanted = wanted[: int(np.searchsorted(wanted, steps))]
    return steps, _characters()[1][points[np.searchsorted(left, wanted, "right")]]


def written(print_: tuple[int, np.ndarray]) -> str:
    """A fingerprint as text: the steps of the walk and the bits, both hexadecimal."""
    return f"{print_[0]:x}-{np.packbits(print_[1]).tobytes().hex()}"


def read(text: str) -> tuple[int, np.ndarray]:
    steps, bits = text.split("-")
    wanted = sampled(_level(int(steps, 16)))
    return int(steps, 16), np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=int(np.searchsorted(wanted, int(steps, 16))))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of steps at which both walks write down the same character, 0 to 1; chance agreement counts as none.

    Steps that only the longer walk takes are unlike. Two empty texts are alike, an empty one is unlike any other.
    """
    upper = max(_level(a[0]), _level(b[0]))
    x, y = (p[1] if _level(p[0]) == upper else p[1][_still(_level(p[0]), upper)[: len(p[1])]] for p in (a, b))
    both, most = min(len(x), len(y)), max(len(x), len(y))
    if not most:
        return float(a[0] == b[0])
    return max(0.0, (both - 2 * int((x[:both] != y[:both]).sum())) / most)


# ---- each document against the next -------------------------------------------------------------------------


def _dealt(firsts: np.ndarray):
    """Rows by range of ids, texts compressed; the first document of a range also goes ahead to the end of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for i, text, h in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string()).cast(pa.large_binary()), batch.column("hash").to_pylist()):
                packed = packer.compress(text.as_py() or b"")
                if i is None:
                    rows.append((h % max(1, len(firsts)), None, False, h, packed))
                    continue
                key = int(np.searchsorted(firsts, i, "right")) - 1
                rows.append((key, i, False, h, packed))
                if firsts[key] == i:
                    rows.append(((key - 1) % len(firsts), i, True, h, packed))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "doc_id", "ahead", "hash", "packed"])

    return run


class _Lot:
    """Texts walked over in one go, each with the place of its next document."""

    def __init__(self, texts: list[str]):
        self.texts, self.following, self.ids = texts, [None] * len(texts), [None] * len(texts)
        self.chars = sum(map(len, texts))

    def add(self, text: str, doc_id: int | None) -> int:
        self.texts.append(text)
        self.ids.append(doc_id)
        self.following.append(None)
        self.chars += len(text)
        return len(self.texts) - 1

    def rows(self, wanted: list[int]) -> list[tuple]:
        """Result rows of the documents at the ``wanted`` places; a following place of -1 is an empty text."""
        points = [code_points(x) for x in self.texts]
        sizes = np.array([len(x) for x in points])
        offsets = np.append(0, np.cumsum(sizes))
        left = walk(np.concatenate(points), offsets, np.zeros(len(points), np.int32))
        lefts = [left[offsets[k] : offsets[k + 1]] for k in range(len(points))]
        prints: dict[int, tuple[int, np.ndarray]] = {}
        empty = code_points("")
        keeps = [len(points[k]) - len(points[k]) // 2 for k in wanted]
        tails = [(points[self.following[k]] if self.following[k] >= 0 else empty)[: len(points[k]) // 2] for k in wanted]
        bounds = np.append(0, np.cumsum([len(x) for x in tails])).astype(np.int64)
        begun = np.array([lefts[k][keep - 1] if keep else 0 for k, keep in zip(wanted, keeps)], dtype=np.int32)
        ends = walk(np.concatenate([empty, *tails]), bounds, begun) if wanted else left

        def own(k: int) -> tuple[int, np.ndarray]:
            if k not in prints:
                prints[k] = bits_of(points[k], lefts[k])
            return prints[k]

        out = []
        for place, (k, keep, tail) in enumerate(zip(wanted, keeps, tails)):
            after = self.following[k]
            edited = bits_of(np.concatenate([points[k][:keep], tail]), np.concatenate([lefts[k][:keep], ends[bounds[place] : bounds[place + 1]]]))
            text = self.texts[k][:keep] + (self.texts[after][: len(tail)] if after >= 0 else "")
            sha = hashlib.sha256(text.encode(errors="surrogatepass")).hexdigest()
            near_next = likeness(own(k), own(after)) if after >= 0 else 0.0
            out.append((self.ids[k], len(points[k]), sha, written(own(k)), written(edited), likeness(own(k), edited), near_next))
        return out


PRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in the order of ids; those of the latest id wait for the first row of the next one."""
    unpacker = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    lot, ready, waiting, last = _Lot([]), [], [], None

    def done() -> pa.RecordBatch:
        rows = lot.rows(ready)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for key, i, ahead, _, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if ahead and last == (key, i, True):
                continue
            text = unpacker.decompress(packed).decode(errors="surrogatepass")
            place = lot.add(text, i)
            if i is None:
                lot.following[place] = -1
                ready.append(place)
            elif last != (key, i, ahead):
                # the first row of an id, or of the range after: what waits has met its next document
                for k in waiting:
                    lot.following[k] = place
                ready += waiting
                waiting = []
            if i is not None and not ahead:
                waiting.append(place)
            last = (key, i, ahead) if i is not None else last
            if lot.chars >= LOT_CHARS or len(lot.texts) >= LOT_TEXTS:
                if ready:
                    yield done()
                kept = [(lot.texts[k], lot.ids[k]) for k in waiting]
                lot, ready = _Lot([]), []
                waiting = [lot.add(*x) for x in kept]
    if ready:
        yield done()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document, that of the next larger id; the last document is followed by the first, and a
    single one by itself. Lengths are code points; a null text is empty. Of rows that share an id each is
    edited, and the one with the least xxhash64 of its text is the next document of others. A row without an id
    has no next document: its tail is dropped and near_next is 0. Equal texts have equal fingerprints. A very
    long text is walked over by itself, in memory that grows with its length. Other columns are not read. An
    empty table gives no rows.

    Each text is moved once, compressed, to the task of its range of ids; ranges hold about equal bytes.
    """
    label = "edits"
    rows = common.id_and_text(docs)
    rows = rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    sizes = rows.where("doc_id is not null").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"))
    placed = cumulated(sizes, ["doc_id"], {"size": F.col("size")}, label)
    total = placed.agg(F.coalesce(F.sum("n_size"), F.lit(0))).first()[0]
    ranges = tries.planned_ranges(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = placed.groupBy(F.floor(F.col("size") * ranges / max(1, total)).alias("range")).agg(F.min("doc_id").alias("first")).collect()
    common.drop(placed)
    firsts = np.array(sorted(r["first"] for r in firsts), dtype=np.int64)
    dealt = rows.mapInArrow(_dealt(firsts), "key int, doc_id long, ahead boolean, hash long, packed binary")
    return dealt.repartition("key").sortWithinPartitions("key", "ahead", "doc_id", "hash").mapInArrow(_printed, PRINTED)


# ---- near copies --------------------------------------------------------------------------------------------


@cache
def _band_steps(level: int) -> np.ndarray:
    """Places of each band's bits among the steps sampled one level up, which walks of both levels have; all in the lower half of the level."""
    steps = sampled(max(level + 1, SAMPLES.bit_length() - 1))
    inside = int(np.searchsorted(steps, 1 << (level - 1))) if level else 0
    if not inside:
        return np.zeros((0, BAND_BITS), np.int64)
    drawn = common.mix(common.seeds(BANDS * BAND_BITS, 5000 + level)) % np.uint64(inside)
    return drawn.astype(np.int64).reshape(BANDS, BAND_BITS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, band): a walk gives the bands of its level, and one just above the level below the bands of that too."""
    weights = np.uint64(1) << np.arange(BAND_BITS, dtype=np.uint64)
    for batch in batches:
        reps, bands = [], []
        for rep, text in zip(batch.column("rep").to_pylist(), batch.column("fingerprint").to_pylist()):
            steps, bits = read(text)
            own = (steps - 1).bit_length() if steps else 0
            for level in {own, max(0, int(steps * 0.9) - 1).bit_length()}:
                upper = max(level + 1, SAMPLES.bit_length() - 1)
                held = bits if _level(steps) == upper else bits[_still(_level(steps), upper)[: len(bits)]]
                at = _band_steps(level)
                if len(at):
                    keys = common.mix((held[at] * weights).sum(axis=1, dtype=np.uint64) + common.seeds(BANDS, 9000 + level))
                    reps += [rep] * BANDS
                    bands += keys.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(bands, pa.int64())], names=["rep", "band"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [likeness(read(a), read(b)) for a, b in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("leader"), pa.array(near, pa.float64())], names=["rep", "leader", "near"])


def _alike(own: list[tuple[int, np.ndarray]], other: list[tuple[int, np.ndarray]], near: float) -> np.ndarray:
    """Whether likeness() is ``near`` or more, for each of the first fingerprints with each of the second."""

    def signs(prints: list[tuple[int, np.ndarray]], upper: int) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = np.zeros((len(prints), len(sampled(upper))), np.float32), np.zeros(len(prints), np.int64)
        for k, (steps, bits) in enumerate(prints):
            bits = bits if _level(steps) == upper else bits[_still(_level(steps), upper)[: len(bits)]]
            out[k, : len(bits)], sizes[k] = 1 - 2 * bits.astype(np.float32), len(bits)
        return out, sizes

    alike = np.zeros((len(own), len(other)), dtype=bool)
    rows, columns = (np.array([_level(p[0]) for p in prints], dtype=np.int64) for prints in (own, other))
    for x in np.unique(rows):
        for y in np.unique(columns):
            i, j = np.flatnonzero(rows == x), np.flatnonzero(columns == y)
            (a, m), (b, n) = signs([own[k] for k in i], max(x, y)), signs([other[k] for k in j], max(x, y))
            # steps that only one walk takes are 0 in the other; sums of so few ones are exact
            alike[np.ix_(i, j)] = (a @ b.T).astype(np.float64) / np.maximum(np.maximum.outer(m, n), 1) >= near
    return alike


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """So many of the links of a square as join the same members."""
    new, links = np.ones(len(linked), dtype=bool), []
    for k in range(len(linked)):
        reached = [k] if new[k] else []
        new[k] = False
        while reached:
            i = reached.pop()
            for j in np.flatnonzero(linked[i] & new).tolist():
                new[j] = False
                links.append((i, j))
                reached.append(j)
    return links


def _compared(near: float):
    """(a, b): joined roots of cells (band, i, j); rows come sorted by cell and side, those of the last cell of a batch wait for the next."""

    def links(cell: pa.Table) -> list[tuple[int, int]]:
        prints, root, n = [read(x) for x in cell.column("fingerprint").to_pylist()], cell.column("root").to_pylist(), cell.num_rows
        cut = int(np.searchsorted(cell.column("side").to_numpy(), 1))
        if cut in (0, n):
            linked = _alike(prints, prints, near)
        else:
            linked = np.zeros((n, n), dtype=bool)
            linked[:cut, cut:] = _alike(prints[:cut], prints[cut:], near)
            linked[cut:, :cut] = linked[:cut, cut:].T
        return [(root[x], root[y]) for x, y in _forest(linked) if root[x] != root[y]]

    def found(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        pairs = [x for a, b in zip(starts, np.append(starts[1:], rows.num_rows)) for x in links(rows.slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.column_stack([rows.column(c).to_numpy() for c in ("band", "i", "j")])
            starts = np.append(0, 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)))
            if len(starts) > 1:
                yield found(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield found(held, np.zeros(1, np.int64))

    return run


def _cells(members: DataFrame, label: str) -> DataFrame:
    """(band, i, j, side, rep, root): every two members (rep, band, root) of a band that differ in root meet in a cell.

    The members of a band that no cell holds are dealt to parts, those of a root that fills a cell to parts of their
    own, and each two parts are a cell, unless all their members have one root.
    """
    bands = members.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "n")
    bands = common.small(common.stored(bands, label))
    one = members.join(bands.where(F.col("n") <= CELL), "band").select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "rep", "root")
    many = common.stored(members.join(bands.where(F.col("n") > CELL), "band"), label)
    alone = common.stored(many.groupBy("band", "root").agg(F.count("*").alias("own")).where(F.col("own") >= CELL), label)
    others = bands.where(F.col("n") > CELL).join(alone.groupBy("band").agg(F.sum("own").alias("apart")), "band", "left").select("band", (F.col("n") - F.coalesce("apart", F.lit(0))).alias("others"))
    dealt = many.drop("n").join(common.small(alone), ["band", "root"], "left").join(common.small(common.stored(others, label)), "band")
    size = F.ceil(F.coalesce("own", "others") / CELL)
    part = F.struct(F.when(F.col("own").isNotNull(), F.col("root")).alias("of"), F.pmod(F.xxhash64("rep", F.lit(3)), size).alias("slot"))
    dealt = common.stored(dealt.select("band", "rep", "root", part.alias("part")), label)
    parts = dealt.select("band", "part").distinct().select("band", "part", F.row_number().over(W.partitionBy("band").orderBy("part")).alias("k"))
    parts = common.stored(parts, label)
    two = parts.select("band", F.col("k").alias("i"), F.col("part.of").alias("x")).join(parts.select("band", F.col("k").alias("j"), F.col("part.of").alias("y")), "band")
    two = two.where("i <= j and not coalesce(x = y, false)").select("band", "i", "j")
    sides = two.select("*", F.col("i").alias("k"), F.lit(0).alias("side")).unionByName(two.where("i < j").select("*", F.col("j").alias("k"), F.lit(1).alias("side")))
    placed = dealt.join(parts, ["band", "part"]).join(sides, ["band", "k"])
    return one.unionByName(placed.select("band", "i", "j", "side", "rep", "root"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their rep; ``roots`` (node, root) holds joined ones only, others are roots themselves."""
    found = rows.join(roots, F.col("rep") == F.col("node"), "left")
    return found.select(*rows.columns, F.coalesce("root", "rep").alias("root"))


def near_copies(prints: DataFrame, rounds: int = ROUNDS, near: float = NEAR) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with component_id, the smallest id that near copies lead to.

    Documents of equal fingerprints are one. In each band the smallest id leads; every member is held against
    its leader by the whole fingerprints, and members unlike it choose another leader in the next round. After
    ``rounds`` rounds, which settle large groups of copies with one comparison a member, every two members of a band that are
    not joined yet are compared, so the rounds do not change the result. Likenesses of ``near`` or more join components. A pair
    whose bits agree at 97 % of the steps shares a band with a probability of 0.99999, one at 95 % (likeness 0.9) of
    0.98. A row without an id has no component.
    """
    label = "edits-near"
    reps = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    # an id that is repeated with another text stands for the texts of all its rows
    reps = common.stored(reps, label)
    banded = common.stored(reps.mapInArrow(_banded, "rep long, band long").distinct(), label)
    # bands with the same members, as a count and two hashes show, are one
    same = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    bands = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("leader"), *same).where("n > 1")
    bands = common.stored(bands.groupBy("n", "leader", "h1", "h2").agg(F.min("band").alias("band")).select("band"), label)
    members = common.stored(banded.join(bands, "band"), label)
    common.drop(banded, bands)
    own, other = reps.withColumnRenamed("fingerprint", "own"), reps.select(F.col("rep").alias("leader"), F.col("fingerprint").alias("other"))
    left, links = members, None
    for _ in range(rounds):
        leaders = left.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = common.stored(left.join(leaders, "band").where("rep <> leader"), label)
        tried = met.select("rep", "leader").distinct().join(own, "rep").join(other, "leader").mapInArrow(_verified, "rep long, leader long, near double")
        found = common.stored(tried.where(F.col("near") >= near).select("rep", "leader").distinct(), label)
        links = found if links is None else links.unionByName(found)
        # strangers of their leader go on without it and those that it has won
        before, left = left, common.stored(met.join(found, ["rep", "leader"], "left_anti").select("rep", "band"), label)
        common.drop(met, *[before] * (before is not members))
    common.drop(left)
    roots = common.components(links.select(F.col("rep").alias("a"), F.col("leader").alias("b")), label)
    roots = common.small(common.stored(roots, label))
    reps = common.stored(_rooted(reps, roots), label)
    # what is left: members of a band that no leader has joined
    placed = common.stored(_rooted(members, roots), label)
    common.drop(members)
    cells = _cells(placed, label).join(reps.select("rep", "fingerprint"), "rep")
    cells = cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side").select("band", "i", "j", "side", "root", "fingerprint")
    joined = common.components(cells.mapInArrow(_compared(near), "a long, b long"), label)
    common.drop(placed)
    joined = joined.withColumnRenamed("root", "joined")
    classes = reps.join(joined, F.col("root") == F.col("node"), "left").select("fingerprint", F.coalesce("joined", "root").alias("component_id"))
    found = prints.join(classes, "fingerprint", "left")
    return found.select(*prints.columns, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
