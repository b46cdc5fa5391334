"""Repeated byte strings by a distributed difference-cover suffix sort.

Strings of 400 bytes (or another window) are looked for. Texts become sequences of
symbols: of every 161 consecutive 240-byte strings the one with the least hash is
marked, so that any 400-byte string holds a mark and equal strings are marked alike. A symbol is a mark's hash and the distance to the next
mark. Marks that occur once end a sequence, because nothing repeats across them.

The suffixes of all sequences are ordered by the difference cover modulo 3: triples
at places 1 and 2 are sorted and named, the names are sorted by recursion, and the
suffixes at place 0 are merged in. Adjacent suffixes share the longest prefixes; a
shared prefix of a window settles whole runs. Only windows at the ends of runs, whose
first and last bytes lie outside the marks, are compared by a hash of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm import common

WINDOW = 400


@dataclass(frozen=True)
class Sizes:
    """Bytes of the strings looked for, of the strings that marks are chosen among, and how many of these a window starts with."""

    window: int = WINDOW

    @property
    def span(self) -> int:
        return 2 * self.window // 5 + 1

    @property
    def gram(self) -> int:
        return self.window - self.span + 1


# Places of a mark whose surroundings one task compares; the windows of a mark with more are dealt out one by one.
HOT_MARK = 1_000
# Window starts that one vectorised step marks, in some hundred bytes of memory each; a longer text takes several steps.
STEP = 1 << 17


def rolling(data: np.ndarray, size: int, start: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes, by doubling."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = common.seeds(2 * size.bit_length(), start)
    current, have, done, out = common.seeds(256, start + 1)[data], 1, 0, None
    for k in range(size.bit_length()):
        if size & have:
            if out is None:
                out = current
            else:
                m = len(data) - done - have + 1
                out = out[:m] * factor[2 * k] + current[done : done + m]
            done += have
        if 2 * have <= size:
            m = len(data) - 2 * have + 1
            current = current[:m] * factor[2 * k + 1] + current[have : have + m]
        have *= 2
    return common.mix(out[:n])


def _marks(data: np.ndarray, offsets: np.ndarray, size: Sizes = Sizes()) -> list[np.ndarray]:
    """Marks of texts that stand one after the other: place, hash, first and last window start they are the mark of."""
    n = len(data) - size.window + 1
    if n <= 0:
        return [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    hashes = rolling(data, size.gram, 40)
    low_bits = np.uint64((1 << len(data).bit_length()) - 1)
    least = (hashes & ~low_bits) | (low_bits - np.arange(len(hashes), dtype=np.uint64))  # of equal hashes the last
    width = 1
    while 2 * width <= size.span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[size.span - width : size.span - width + n])
    ends = np.zeros(len(data) + 1, dtype=np.int64)
    a, b = offsets[:-1], offsets[1:] - size.window + 1
    ok = b > a
    np.add.at(ends, a[ok], 1)
    np.add.at(ends, b[ok], -1)
    starts = np.flatnonzero(np.cumsum(ends)[:n] > 0)
    places = (low_bits - (least[starts] & low_bits)).astype(np.int64)
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] != places[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(places))[: len(at)] - 1
    return [places[at], hashes[places[at]], starts[at], starts[last]]


def _period(gram: bytes, span: int) -> int:
    """A period below ``span`` of a string, as the nearest return of the 16 bytes in its middle shows it; else 0."""
    at = gram.rfind(gram[span : span + 16], 0, span + 15)
    p = span - at
    return p if at >= 0 and gram[p:] == gram[:-p] else 0


def _returns(data: np.ndarray, places: np.ndarray, size: Sizes) -> np.ndarray:
    """Which marks have 16 bytes in their middle that also stand up to a span before."""
    found = np.zeros(len(places), dtype=bool)
    for k in range(0, len(places), 4096):
        part = places[k : k + 4096]
        some = rolling(data[part[0] : part[-1] + size.gram], 16, 70)
        middle = part - part[0] + size.span
        for back in range(1, size.span + 1):
            found[k : k + 4096] |= some[middle - back] == some[middle]
    return found


def _stretches(text: bytes, marks: list[tuple[int, int, int, int]], size: Sizes) -> tuple[list, list]:
    """For marks (place, period, lo, hi) of one text: runs sure to repeat by their period, and windows to compare.

    In a stretch of period p and at least a window and 2 p bytes every window repeats p bytes before or after. Windows of these marks that are not
    inside such a stretch are compared by their bytes, and so is one period of windows inside, each rotation of the phrase once: a shorter
    stretch elsewhere may have its only equals there.
    """
    runs, asked, a, b, period = [], [], 0, 0, 0
    for place, p, lo, hi in marks:
        if p != period or place + size.gram > b:
            period, a, b = p, place, place + size.gram
            while a > 0 and text[a - 1] == text[a - 1 + p]:
                a -= 1
            while b < len(text) and text[b] == text[b - p]:
                b += 1
            if b - a >= size.window + 2 * p:
                runs.append({"a": a, "b": b})
                asked.append({"lo": a, "hi": a + p - 1})
        if b - a >= size.window + 2 * p:
            asked += [{"lo": x, "hi": y} for x, y in ((lo, min(hi, a - 1)), (max(lo, b - size.window + 1), hi)) if x <= y]
        else:
            asked.append({"lo": lo, "hi": hi})
    return runs, asked


def _marked(batches: Iterator[pa.RecordBatch], size: Sizes = Sizes()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in common.text_blocks(batch.column("text"), STEP):
            if len(data) <= 2 * STEP:
                places, hashes, lo, hi = _marks(data, offsets, size)
            else:  # one long text, marked in steps of window starts
                parts = []
                for s in range(0, len(data), STEP):
                    part = data[s : s + STEP + size.window - 1]
                    p, h, x, y = _marks(part, np.array([0, len(part)]), size)
                    parts.append((s + p, h, s + x, s + y))
                places, hashes, lo, hi = (np.concatenate(c) for c in zip(*parts))
                places, at = np.unique(places, return_index=True)
                hashes, lo, hi = hashes[at], lo[at], np.append(hi[at[1:] - 1], hi[-1:])
            doc = np.searchsorted(offsets, places, "right") - 1
            bounds = pa.array(common.per_document(doc, b - a), pa.int32())
            base = offsets[doc]
            periods, runs, asked = {}, [[] for _ in range(b - a)], [[] for _ in range(b - a)]
            for k in np.flatnonzero(_returns(data, places, size)):
                if p := _period(data[places[k] : places[k] + size.gram].tobytes(), size.span):
                    periods.setdefault(int(doc[k]), []).append((int(places[k]), p, int(lo[k]), int(hi[k])))
                    hashes[k] = 0
            for d, found in periods.items():
                own = int(offsets[d])
                runs[d], asked[d] = _stretches(data[own : int(offsets[d + 1])].tobytes(), [(x - own, p, y - own, z - own) for x, p, y, z in found], size)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (places - base, hashes.view(np.int64), lo - base, hi - base)]
            kinds = [pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())])) for x, y in (("a", "b"), ("lo", "hi"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *lists, pa.array(runs, kinds[0]), pa.array(asked, kinds[1])], names=["doc_id", "pos", "mark", "lo", "hi", "runs", "asked"])


# ---- difference-cover suffix sort on (d, r, k, c): text, run, place in the run, symbol > 0 ------------------


def cumulated(rows: DataFrame, keys: list[str], counts: dict[str, Column], label: str) -> DataFrame:
    """Each distinct key with its counts ``n_x`` and, as ``x``, how many rows have a smaller key.

    Keys are dealt by range and written, so that the ranges stay fixed; the offsets
    of the ranges are sums over as many rows as there are ranges.
    """
    grouped = rows.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(f"n_{x}") for x, c in counts.items()])
    fixed = common.stored(grouped.repartitionByRange(*keys).withColumn("p", F.spark_partition_id()), label)
    ranges = fixed.groupBy("p").agg(*[F.sum(f"n_{x}").alias(f"t_{x}") for x in counts])
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("p", *[F.coalesce(F.sum(f"t_{x}").over(before), F.lit(0)).alias(f"o_{x}") for x in counts])
    inside = W.partitionBy("p").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    summed = fixed.select("*", *[F.coalesce(F.sum(f"n_{x}").over(inside), F.lit(0)).alias(x) for x in counts])
    placed = summed.join(ranges, "p").select(*keys, *[f"n_{x}" for x in counts], *[(F.col(x) + F.col(f"o_{x}")).alias(x) for x in counts])
    placed = common.stored(placed, label)
    common.drop(fixed)
    return placed


def suffix_ranks(text: DataFrame, symbols: int, label: str) -> DataFrame:
    """(d, r, k, rank): 1 + the number of smaller suffixes, compared over at least ``symbols`` symbols.

    Suffixes that agree so far share a rank. An ended sequence is smaller than one that goes on.
    """
    along = W.partitionBy("d", "r").orderBy("k")
    ahead = lambda c, n: F.coalesce(F.lead(c, n).over(along), F.lit(0))
    triples = common.stored(text.select("*", ahead("c", 1).alias("c1"), ahead("c", 2).alias("c2")), label)
    cover = triples.where("k % 3 <> 0")
    names = cumulated(cover, ["c", "c1", "c2"], {"name": F.lit(1)}, label)
    repeated = names.where("n_name > 1").limit(1).count() > 0
    named = cover.join(names.select("c", "c1", "c2", (F.col("name") + 1).alias("name")), ["c", "c1", "c2"])
    if repeated and symbols > 3:
        shorter = named.select("d", (F.col("r") * 2 + (F.col("k") % 3 == 2).cast("long")).alias("r"), F.floor(F.col("k") / 3).alias("k"), F.col("name").alias("c"))
        ranks = suffix_ranks(shorter, -(-symbols // 3) + 1, label)
        ranked = ranks.select("d", F.floor(F.col("r") / 2).alias("r"), (3 * F.col("k") + 1 + F.pmod("r", F.lit(2))).alias("k"), F.col("rank").alias("q"))
    else:
        ranked = named.select("d", "r", "k", F.col("name").alias("q"))
    rows = triples.join(ranked, ["d", "r", "k"], "left")
    rows = common.stored(rows.select("d", "r", "k", "c", "c1", "q", ahead("q", 1).alias("q1"), ahead("q", 2).alias("q2")), label)
    place = F.col("k") % 3
    one = cumulated(rows.where(place != 2), ["c", "q1"], {"zero": place == 0, "one": place == 1}, label)
    two = cumulated(rows.where(place != 1), ["c", "c1", "q2"], {"zero": place == 0, "two": place == 2}, label)
    merged = rows.join(one.select("c", "q1", F.col("zero").alias("z1"), "one"), ["c", "q1"], "left").join(two.select("c", "c1", "q2", F.col("zero").alias("z2"), "two"), ["c", "c1", "q2"], "left")
    rank = F.when(place == 0, F.col("z1") + F.col("one") + F.col("two") + 1).when(place == 1, F.col("q") + F.col("z1")).otherwise(F.col("q") + F.col("z2"))
    ranks = common.stored(merged.select("d", "r", "k", rank.alias("rank")), label)
    common.drop(triples, names, rows, one, two)
    return ranks


# ---- repeated strings ---------------------------------------------------------------------------------------


def _window_hashes(batches: Iterator[pa.RecordBatch], size: Sizes) -> Iterator[pa.RecordBatch]:
    for batch in common.lots(batches):
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
            data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
            for lo, hi in _merged([(s["lo"], s["hi"] + 1) for s in spans]):
                for a in range(lo, hi, STEP):
                    part = data[a : min(hi, a + STEP) + size.window - 1]
                    one, two = rolling(part, size.window, 50).view(np.int64), rolling(part, size.window, 60).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), doc)), pa.array(np.arange(a, a + len(one))), pa.array(one), pa.array(two)], names=["d", "s", "h1", "h2"])


def _surroundings(batches: Iterator[pa.RecordBatch], size: Sizes) -> Iterator[pa.RecordBatch]:
    """(mark, d, pos, lo, hi, left, right): the bytes before a mark, backwards, and after it that its windows hold."""
    for batch in common.lots(batches):
        rows = []
        for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places").to_pylist()):
            data = text.as_py().encode()
            for x in places:
                pos, lo, hi = x["pos"], x["lo"], x["hi"]
                rows.append((x["mark"], doc, pos, lo, hi, data[lo:pos][::-1], data[pos + size.gram : hi + size.window]))
        if rows:
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["mark", "d", "pos", "lo", "hi", "left", "right"])


def _prefix_hashes(column: pa.Array, span: int) -> np.ndarray:
    """Hashes of the first 0 to span - 1 bytes of each value."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"\0", dtype=np.uint8)
    out = np.ones((len(column), span), dtype=np.uint64)
    for k in range(1, span):
        byte = data[np.minimum(offsets[:-1] + k - 1, len(data) - 1)]
        out[:, k] = (out[:, k - 1] + common.BYTE_VALUE[byte]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _equal_windows(rows: pa.Table, size: Sizes) -> pa.RecordBatch:
    """(d, s) of windows that another place of the same mark has at the same distance."""
    mark, d, pos, lo, hi = (rows.column(c).to_numpy() for c in ("mark", "d", "pos", "lo", "hi"))
    left, right = (_prefix_hashes(rows.column(c).combine_chunks(), size.span) for c in ("left", "right"))
    back = np.arange(size.span)
    own, o = np.nonzero((back[None, :] <= (pos - lo)[:, None]) & (back[None, :] >= (pos - hi)[:, None]))
    c = common.seeds(4, 80)
    key = common.mix(left[own, o] * c[0] + right[own, size.span - 1 - o] * c[1] + o.astype(np.uint64) * c[2] + mark[own].view(np.uint64) * c[3])
    order = np.argsort(key, kind="stable")
    own, o, key = own[order], o[order], key[order]
    same = (key[1:] == key[:-1]) & (o[1:] == o[:-1]) & (mark[own[1:]] == mark[own[:-1]])
    twin = np.zeros(len(key), dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    return pa.RecordBatch.from_arrays([pa.array(d[own[twin]]), pa.array((pos[own] - o)[twin])], names=["d", "s"])


def _twins(batches: Iterator[pa.RecordBatch], size: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by mark; those of the last mark of a batch wait for the next batch."""
    held = None
    for batch in common.lots(batches):
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        marks = rows.column("mark").to_numpy()
        cut = int(np.searchsorted(marks, marks[-1]))
        if cut:
            yield _equal_windows(rows.slice(0, cut), size)
        held = rows.slice(cut)
    if held is not None:
        yield _equal_windows(held, size)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that each handed over has many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 20_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hashed(batches: Iterator[pa.RecordBatch], size: Sizes) -> Iterator[pa.RecordBatch]:
    yield from _packed(_window_hashes(batches, size))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch], size: Sizes) -> Iterator[pa.RecordBatch]:
    for batch in common.lots(batches):
        rows = []
        for text, runs, starts in zip(batch.column("text"), batch.column("runs").to_pylist(), batch.column("starts").to_pylist()):
            data = text.as_py().encode()
            spans = _merged([(r["a"], r["b"]) for r in runs or []] + [(s, s + size.window) for s in starts or []])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            rows.append(([{"start": a, "end": b} for a, b in spans], len(data) - len(left), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
        spans, removed, sha, left = zip(*rows)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=["doc_id", "spans", "n_removed", "sha", "left_text"])


SAMPLE = "doc_id long, pos array<long>, mark array<long>, lo array<long>, hi array<long>, runs array<struct<a:long,b:long>>, asked array<struct<lo:long,hi:long>>"


def _symbols(reps: DataFrame, label: str) -> DataFrame:
    """(d, i, pos, mark, lo, hi) of marks that occur at least twice; a missing i ends a sequence."""
    shifted = reps.select(
        F.col("doc_id").alias("d"),
        F.posexplode(F.transform("pos", lambda p, i: F.struct(p.alias("pos"), F.get("mark", i).alias("mark"), F.get("lo", i).alias("lo"), F.get("hi", i).alias("hi")))).alias("i", "x"),
    ).select("d", "i", "x.*")
    # a mark of 0 lies in a periodic stretch, which is settled apart
    shifted = shifted.where("mark <> 0")
    # a table of its own, so that the join shuffles apart from the sums and Spark can split a mark with very many places
    twice = common.stored(shifted.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), label)
    return common.stored(shifted.join(twice, "mark", "left_semi"), label)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, sha, n_bytes, whole, spans, n_removed, kept_sha, left_text), one row per row of ``docs``.

    ``spans`` are the maximal byte runs covered by a string of ``window`` bytes that also starts elsewhere, in the same
    text or another. ``whole`` marks texts of ``window`` bytes or more of which there are copies: nothing is left of
    them. ``spans`` and what follows are null where nothing is removed or the text is ``whole``. ``left_text``
    drops the halves of characters that a cut leaves. A null text is empty. A row without an id takes no part
    and loses nothing. Repeated rows are copies of each other. Empty tables give empty results.
    """
    label, size = "suffix", Sizes(window)
    rows = common.id_and_text(docs)
    binary = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    base = common.stored(rows.select("doc_id", F.octet_length(binary).cast("long").alias("n_bytes"), F.sha2(binary, 256).alias("sha")), label)
    copies = base.where("doc_id is not null").groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n"))
    copies = common.stored(copies.where(F.col("n") >= size.window), label)
    sampled = common.stored(common.in_python(rows.where("doc_id is not null"), lambda batches: _marked(batches, size), SAMPLE).where(F.size("pos") > 0), label)
    reps = sampled.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = common.stored(reps, label)
    common.drop(sampled)

    kept = _symbols(reps, label)
    by_doc = W.partitionBy("d").orderBy("i")
    gap = F.when(F.lead("i").over(by_doc) == F.col("i") + 1, F.lead("pos").over(by_doc) - F.col("pos")).otherwise(0)
    runs = kept.select("*", gap.alias("gap"), (F.col("i") - F.row_number().over(by_doc)).cast("long").alias("r"))
    # what follows a mark far enough to settle every window that starts up to two spans later
    follow = W.partitionBy("d", "r").orderBy("pos").rangeBetween(0, 5 * (size.span - 1) + 2)
    inside = W.partitionBy("d", "r").orderBy("i")
    ahead = F.transform(F.collect_list(F.struct("pos", "mark")).over(follow), lambda x: F.struct((x["pos"] - F.col("pos")).alias("at"), x["mark"].alias("mark")))
    runs = runs.select("d", "r", (F.row_number().over(inside) - 1).cast("long").alias("k"), "pos", "mark", "gap", "lo", "hi", ahead.alias("ahead"))
    runs = common.stored(runs, label)
    symbols = runs.agg(F.max(F.size("ahead"))).first()[0]
    names = cumulated(runs, ["mark", "gap"], {"c": F.lit(1)}, label).select("mark", "gap", (F.col("c") + 1).alias("c"))
    text = runs.select("d", "r", "k", "mark", "gap").join(names, ["mark", "gap"]).select("d", "r", "k", "c")
    ranks = suffix_ranks(text, symbols or 1, label)

    # adjacent suffixes: one row per rank, numbered without gaps, met by the next number
    suffixes = common.stored(runs.join(ranks, ["d", "r", "k"]), label)
    prefixes = common.stored(suffixes.groupBy("rank").agg(F.count("*").alias("m"), F.max_by("ahead", F.size("ahead")).alias("prefix")), label)
    order = common.stored(prefixes.join(cumulated(prefixes.select("rank"), ["rank"], {"g": F.lit(1)}, label).select("rank", "g"), "rank"), label)
    after = order.select((F.col("g") - 1).alias("g"), F.col("prefix").alias("other"))
    first_off = F.array_position(F.zip_with("prefix", "other", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(first_off == 0, F.size("prefix")).otherwise(first_off - 1).cast("int")
    met = common.stored(order.join(after, "g").select("g", shared.alias("shared")), label)
    up, down = met.select("g", F.col("shared").alias("s1")), met.select((F.col("g") + 1).alias("g"), F.col("shared").alias("s2"))
    best = order.select("rank", "m", "g").join(up, "g", "left").join(down, "g", "left")
    best = best.select("rank", "m", F.greatest(F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))).alias("s"))
    matched = F.when(F.col("m") > 1, F.size("ahead")).otherwise(F.least("s", F.size("ahead")))
    found = suffixes.join(best, "rank").withColumn("f", matched)
    # [pos, pos + reach) also stands elsewhere; windows lo..hi have this mark, and those between open_lo and open_hi are in no such run
    reach = F.when(F.col("f") > 0, F.get("ahead", F.col("f") - 1)["at"] + size.gram).otherwise(0)
    found = found.select("d", "pos", "mark", "lo", "hi", reach.alias("reach"))
    along = W.partitionBy("d").orderBy("pos")
    near = F.collect_list(F.struct("pos", (F.col("pos") + F.col("reach") - size.window).alias("to"))).over(along.rangeBetween(-size.span + 1, 0))
    far = F.max(F.col("pos") + F.col("reach") - size.window).over(along.rangeBetween(W.unboundedPreceding, -size.span))
    found = found.select("*", near.alias("near"), far.alias("far"))
    to = F.greatest(F.coalesce("far", F.lit(-1)), F.coalesce(F.array_max(F.transform(F.filter("near", lambda x: x["pos"] <= F.col("lo")), lambda x: x["to"])), F.lit(-1)))
    since = F.array_min(F.transform(F.filter("near", lambda x: (x["pos"] > F.col("lo")) & (x["to"] >= F.col("hi"))), lambda x: x["pos"]))
    found = found.select("d", "pos", "mark", "lo", "hi", "reach", F.greatest("lo", to + 1).alias("open_lo"), F.least("hi", F.coalesce(since - 1, F.col("hi"))).alias("open_hi"))
    found = common.stored(found, label)

    # windows at the ends of runs, and those of the same mark and distance that they may equal
    open_ = found.where("open_lo <= open_hi").groupBy("mark").agg(F.min(F.col("pos") - F.col("open_hi")).alias("near"), F.max(F.col("pos") - F.col("open_lo")).alias("far"))
    open_ = common.stored(open_, label)  # as in _symbols
    asked = found.where("lo <= hi").join(open_, "mark").select("d", "mark", "pos", F.greatest("lo", F.col("pos") - F.col("far")).alias("lo"), F.least("hi", F.col("pos") - F.col("near")).alias("hi")).where("lo <= hi")
    asked = common.stored(asked, label)
    hot = common.small(common.stored(asked.groupBy("mark").agg(F.count("*").alias("m")).where(F.col("m") > HOT_MARK).select("mark"), label))
    places = asked.join(hot, "mark", "left_anti").groupBy("d").agg(F.collect_list(F.struct("mark", "pos", "lo", "hi")).alias("places"))
    places = common.stored(places, label)
    periodic = reps.select(F.col("doc_id").alias("d"), F.explode("asked").alias("x")).select("d", "x.*")
    spans = asked.join(hot, "mark", "left_semi").select("d", "lo", "hi").unionByName(periodic)
    spans = common.stored(spans.groupBy("d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), label)
    periodic = reps.select(F.col("doc_id").alias("d"), F.explode("runs").alias("x")).select("d", "x.*")
    settled = found.where(F.col("reach") >= size.window).select("d", F.col("pos").alias("a"), (F.col("pos") + F.col("reach")).alias("b")).unionByName(periodic)
    settled = settled.groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    settled = common.stored(settled, label)
    common.drop(reps, kept, runs, suffixes, prefixes, order, met, ranks, found)
    wanted = common.stored(places.select("d").unionByName(spans.select("d")).unionByName(settled.select("d")).distinct().withColumnRenamed("d", "doc_id"), label)
    held = common.stored(rows.join(common.small(wanted), "doc_id", "left_semi"), label)
    texts = held.dropDuplicates(["doc_id"])
    around = common.in_python(texts.join(places.withColumnRenamed("d", "doc_id"), "doc_id"), lambda batches: _surroundings(batches, size), "mark long, d long, pos long, lo long, hi long, left binary, right binary")
    twins = common.in_python(around.repartition("mark").sortWithinPartitions("mark"), lambda batches: _twins(batches, size), "d long, s long")
    windows = common.in_python(texts.join(spans.withColumnRenamed("d", "doc_id"), "doc_id"), lambda batches: _hashed(batches, size), "d long, s long, h1 long, h2 long")
    windows = common.stored(windows, label)
    equal = common.stored(windows.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2"), label)
    starts = windows.join(equal, ["h1", "h2"], "left_semi").select("d", "s").unionByName(twins)
    starts = common.stored(starts.groupBy("d").agg(F.collect_list("s").alias("starts")), label)
    both = settled.join(starts, "d", "full").withColumnRenamed("d", "doc_id")
    cut = common.in_python(texts.join(both, "doc_id"), lambda batches: _cut(batches, size), "doc_id long, spans array<struct<start:long,end:long>>, n_removed long, sha string, left_text string")
    cut = common.stored(cut, label)
    common.drop(windows, equal, open_, asked, places, spans, starts, settled, held, wanted)

    many = base.join(copies.where("copies > 1").select("sha", "copies"), "sha", "left")
    whole = F.col("doc_id").isNotNull() & F.col("copies").isNotNull() & (F.col("n_bytes") >= size.window)
    many = many.select("doc_id", "sha", "n_bytes", whole.alias("whole"))
    cut = cut.select("doc_id", "spans", "n_removed", F.col("sha").alias("kept_sha"), "left_text", F.lit(False).alias("whole"))
    return many.join(cut, ["doc_id", "whole"], "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see repeats()."""
    found = repeats(docs)
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated strings of ``window`` bytes cut out of ``text`` and ``n_chars``, if there, counted again.

    All rows and columns stay, whatever the others are called; see repeats().
    """
    found = repeats(docs, window).where(F.col("whole") | (F.col("n_removed") > 0))
    found = found.select(F.col("doc_id").alias("id"), F.when(F.col("whole"), "").otherwise(F.col("left_text")).alias("left")).dropDuplicates(["id"])
    rows = docs.select(common.packed(docs)).join(found, F.col("row.doc_id") == F.col("id"), "left")
    cut = F.col("left").isNotNull()
    new = {"text": F.when(cut, F.col("left")), "n_chars": F.when(cut, F.length("left").cast("long"))}
    return rows.select(*[F.coalesce(new[c], F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
