"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import common, embeddings, language, minhash, mixing, packing, quality, rules, shards, suffix, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, k1 string, shard int, label string"
SYLLABLES = "ba ko ri tu mel san dor vik pa lo ne".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + ("." if r.random() < 0.1 else "") for _ in range(n))


def documents() -> list[tuple]:
    """Edge cases beside plain prose; the columns after n_chars clash with names that operators use inside."""
    texts = [None, "", " \t\n", "one", "one two three four", "ONE two three Four", "é" * 600, "x " * 900]
    base = prose(1, 260)
    words = base.split()
    near = list(words)
    near[100] = "changed"
    texts += [base, base, base.upper(), " ".join(near), base + " " + prose(2, 10), prose(3, 120) + " " + base[200:700] + " " + prose(4, 120)]
    texts += [prose(5, 150) + "\n" + "Home | About | Contact | Help", prose(6, 3000), "tie tie tie", "tie tie tie", "ab" * 500]
    texts += [base[:400], base[50:449], prose(7, 60) + base[100:501], prose(8, 30) + base[101:501]]
    texts += [prose(k, 40 + 7 * k) for k in range(10, 40)]
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", "", None][k % 4], len(t or ""), k, "x", 7, "y") for k, t in enumerate(texts)]
    return rows + [(None, base, "en", "a", 1, 1, "x", 7, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(60)] + [(3, 1, 1), (3, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def gram_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def check_minhash(got, rows, threshold=85):
    sets = {i: gram_set(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    root = components(sets, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_minhash(docs):
    check_minhash(minhash.near_duplicates(docs).collect(), [(r[0], r[1]) for r in documents()])


def test_minhash_hot_group(spark):
    """Near copies around one text, some of them linked only through others."""
    words, r = prose(50, 300).split(), random.Random(3)
    rows = []
    for k in range(120):
        w = list(words)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((k, " ".join(w)))
    check_minhash(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_odd_sketch_estimates():
    """XOR counts of sketches follow the number of samples that differ."""
    r = np.random.default_rng(1)
    for share in (1.0, 0.95, 0.85):
        both = r.integers(0, 2**63, 1000).astype(np.uint64)
        n = int(2000 * share / (1 + share)) if share < 1 else 1000
        a = both
        b = np.concatenate([both[:n], r.integers(0, 2**63, 1000 - n).astype(np.uint64)])
        x, y = minhash.samples(a), minhash.samples(b)
        differ = np.unpackbits((minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).view(np.uint8)).sum()
        bits = minhash.SKETCH_WORDS * 64
        estimate = -bits / 4 * np.log(1 - 2 * differ / bits)
        assert abs(estimate - (x != y).sum()) <= 12


def brute_repeats(rows, n=400):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + n] for b in data.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in data.items():
        mark = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest())
    return out


def test_suffix(docs):
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None]
    want = brute_repeats(rows)
    for r in suffix.digest(docs).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffix_overlaps_and_copies(spark):
    """Runs of 400 to 700 bytes at many offsets, periodic text, and matches chained over three texts."""
    r = random.Random(9)
    pool = prose(60, 900)
    rows = []
    for k in range(40):
        parts = [prose(1000 + k, r.randint(0, 30))]
        for _ in range(r.randint(1, 3)):
            a = r.randrange(len(pool) - 800)
            parts += [pool[a : a + r.randint(380, 700)], prose(2000 + 10 * k + len(parts), r.randint(1, 30))]
        rows.append((k, "".join(parts)))
    rows += [(100, "a" * 1500), (101, "ab" * 420 + "c"), (102, rows[0][1]), (103, "a" * 399), (104, "é" * 250)]
    want = brute_repeats(rows)
    for x in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id], x.doc_id


def test_suffix_short_stretches_against_long_ones(spark):
    """A short periodic stretch whose only equals lie inside a long one, in any rotation, within one text too."""
    line = "".join(random.Random(11).choices("abcdefghijklmnopqrstuvwxyz ", k=99)) + "\n"
    wide = "".join(random.Random(12).choices("abcdefghijklmnopqrstuvwxyz ", k=129))
    rows = [(1, (line * 5)[:450]), (2, line * 10), (3, "-" * 400), (4, "-" * 1500), (5, prose(80, 20) + (line * 6)[37:440] + prose(81, 20))]
    rows += [(6, "=" * 401 + prose(82, 90) + "=" * 900), (7, (wide * 5)[60:500]), (8, prose(83, 9) + wide * 6), (9, (line * 5)[:399]), (10, "+" * 401)]
    want = brute_repeats(rows)
    assert all(want[k][1] for k in (1, 3, 5, 7)) and not want[9][1]
    for x in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id], x.doc_id


def test_suffix_ranks(spark):
    """The difference cover orders the suffixes of several sequences like a plain sort."""
    r = random.Random(5)
    strings = {(d, 0): [r.randint(1, 2) for _ in range(r.randint(1, 40))] for d in range(12)}
    rows = [(d, q, k, c) for (d, q), s in strings.items() for k, c in enumerate(s)]
    got = suffix.suffix_ranks(spark.createDataFrame(rows, "d long, r long, k long, c long"), 200, "test").collect()
    text = {(d, q, k): tuple(s[k:]) for (d, q), s in strings.items() for k in range(len(s))}
    order = sorted(text.values())
    for x in got:
        assert x["rank"] == 1 + order.index(text[x["d"], x["r"], x["k"]])


def test_long_text_in_steps(monkeypatch):
    """Marks do not depend on the steps in which a long text is worked on."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([prose(70, 4000)])], names=["doc_id", "text"])
    whole = list(suffix._marked(iter([batch])))[0].to_pydict()
    monkeypatch.setattr(suffix, "STEP", 1500)
    assert list(suffix._marked(iter([batch])))[0].to_pydict() == whole


def test_steps_on_texts_take_little_memory():
    """Steps hold many times the text they work on, so that they take small blocks, whatever a batch holds."""
    import pyarrow as pa

    texts = [prose(k, 300) for k in range(40)] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 3 << 20
    places = [[{"mark": 1, "pos": 240 * k, "lo": 240 * k, "hi": 240 * k + 90} for k in range(3)] for _ in texts]
    around = batch.append_column("places", pa.array(places))
    size = suffix.Sizes(240)
    for run in (lambda: suffix._marked(iter([batch]), size), lambda: quality._featured(iter([batch])), lambda: suffix._surroundings(iter([around]), size)):
        tracemalloc.start()
        rows = sum(x.num_rows for x in run())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= len(texts) and peak < 30 << 20


@pytest.mark.parametrize("name", "quality minhash suffix".split())
def test_texts_reach_python_in_small_batches(name, spark, nothing):
    """By default Spark hands over 10,000 rows at once, here 48 MB; a limit that the session names stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    call = {"quality": lambda: quality.feature_table(nothing), "minhash": lambda: minhash.signatures(nothing), "suffix": lambda: suffix.digest(nothing)}[name]
    texts = spark.range(1200).selectExpr("id", "repeat('some words ', 4000) as text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    spark.conf.unset(limit)
    try:
        call()
        got = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 1200 and max(r.size for r in got) < 2 * common.BATCH_BYTES
        spark.conf.set(limit, "1000000")
        call()
        assert spark.conf.get(limit) == "1000000"
    finally:
        spark.conf.unset(limit)


def test_cleaned_keeps_columns(docs):
    out = suffix.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = brute_repeats([(r[0], r[1]) for r in documents() if r[0] is not None])
    for r in out.where("doc_id is not null and text is not null").collect():
        if "é" not in r.text:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(dict(sizes))
    assert abs(float(sum(want.values())) - sum(sizes.values())) < 1e-6
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 0.05 * float(want[s]) + 20
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def plain_targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Shares by weight in the order of code points, null last; stopped sources drop out until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped = set()
    while True:
        rest = Fraction(sum(sizes.values()) - sum(ceiling * sizes[s] for s in stopped))
        among = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and weight[s] * rest > ceiling * sizes[s] * among}
        if not over:
            return {s: ceiling * sizes[s] if s in stopped else weight[s] * rest / among for s in names}
        stopped |= over


def spark_targets(spark, sizes):
    rows = [("n" if s is None else "s" + s, n) for s, n in sizes.items()]
    found = mixing.goals(spark.createDataFrame(rows, "_key string, tokens long")).collect()
    return {None if r._key == "n" else r._key[1:]: r.target for r in found}


def test_targets_reshare(spark):
    # a stops at 30; b and c share the rest 2 to 1; a null source is last and has weight 5 and no words
    assert spark_targets(spark, {"a": 10, "b": 1000, "c": 1000, None: 0}) == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(660.0), None: 0.0}
    assert spark_targets(spark, {"a": 0, "": 0}) == {"a": 0.0, "": 0.0}


def test_targets_and_rates_of_many_sources(spark):
    r = random.Random(6)
    sizes = {f"{r.choice(['site', 'é', 'Z', '😀', '｡'])}{k}": int(r.paretovariate(0.7)) - r.choice([0, 1]) for k in range(30_000)} | {None: 77}
    want = plain_targets(sizes)
    assert spark_targets(spark, sizes) == {s: float(x) for s, x in want.items()}
    # more sources than any list in the driver was meant for
    many = spark.range(200_000).selectExpr("concat('s', id) as _key", "1 + id % 1000 as tokens")
    off = F.abs(F.col("rate") * F.col("source_size") - F.col("target")) > 1e-6 * F.col("target")
    plan = mixing.balance(mixing.goals(many)).agg(F.count("*"), F.sum("target"), F.sum("source_size"), F.sum(off.cast("int"))).first()
    assert plan[0] == 200_000 and plan[1] == pytest.approx(plan[2]) and plan[3] == 0


def test_packing(docs):
    rows = packing.pack(docs, buckets=4, budget=500).collect()
    size = Counter(len(WORD.findall(r[1] or "")) for r in documents())
    assert Counter(r.n_tokens for r in rows) == size
    packed = [r for r in rows if r.n_tokens]
    assert all(r.batch is None for r in rows if not r.n_tokens)
    seen = Counter(r.batch for r in packed)
    assert sorted(seen) == list(range(len(seen))) and len({(r.batch, r.place) for r in packed}) == len(packed)
    for r in packed:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        assert seen[r.batch] * r.bucket_length <= 500 or (seen[r.batch] == 1 and r.oversize)


def test_packing_bounds_are_optimal():
    from itertools import combinations

    r = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 60), 8)))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        waste = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts))
        least = min(waste([*inner, lengths[-1]]) for k in range(3) for inner in combinations(lengths[:-1], k))
        assert waste(packing.bounds(lengths, counts, 3)) == least


def test_packing_bounds_of_many_lengths():
    """The search by levels finds what a plain dynamic programme finds."""
    r = np.random.default_rng(6)
    for m, buckets in ((1, 3), (2, 2), (3, 5), (40, 4), (300, 16)):
        lengths, counts = np.sort(r.choice(np.arange(1, 2000), m, replace=False)), r.integers(1, 50, m)
        n, t = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
        least = [0] + [int(lengths[j - 1] * n[j] - t[j]) for j in range(1, m + 1)]
        for _ in range(buckets - 1):
            least = [0] + [min(int(least[i] + lengths[j - 1] * (n[j] - n[i]) - (t[j] - t[i])) for i in range(j)) for j in range(1, m + 1)]
        tops = packing.bounds(lengths, counts, buckets)
        assert len(tops) <= buckets and tops[-1] == lengths[-1]
        assert int((counts * (tops[np.searchsorted(tops, lengths)] - lengths)).sum()) == least[m]


def test_packing_with_a_very_long_text(spark):
    """One long text changes the buckets of no other; it is alone and not padded, also if there is nothing else."""
    r = random.Random(4)
    sizes = [r.randint(1, 400) for _ in range(500)]
    rows = [(k, "x " * n) for k, n in enumerate(sizes)]
    pack = lambda rows: {x.doc_id: x for x in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain, more, alone = pack(rows), pack([*rows, (1000, "x " * 100_000)]), pack([(1000, "x " * 100_000)])
    lengths, counts = np.unique(sizes, return_counts=True)
    tops = packing.bounds(lengths, counts, packing.BUCKETS)
    for k, n in enumerate(sizes):
        assert more[k] == plain[k] and plain[k].bucket_length == tops[np.searchsorted(tops, n)]
    for x, bucket in ((more[1000], len(tops)), (alone[1000], 0)):
        assert (x.n_tokens, x.bucket, x.bucket_length, x.place, x.padding, x.oversize) == (100_000, bucket, 100_000, 0, 0, True)
    assert max(x.batch for x in plain.values()) < more[1000].batch


def test_shards(docs):
    rows = shards.shard(docs, 5).collect()
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), documents()):
        data = (d[1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(5):
        own = [r for r in rows if r.shard == k]
        assert abs(sum(r["size"] for r in own) - total / 5) <= most
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_codes_of_many_values(spark):
    """Codes follow the order of the values whatever their number; null is last."""
    for n in (3, 9_000):
        rows = [(f"v{k:05d}",) for k in range(n)] + [("v00001",), (None,)]
        got = shards._codes(spark.createDataFrame(rows, "source string"), "source").collect()
        assert sorted((r.source or "~", r.source_code) for r in got) == sorted((v[0] or "~", int(v[0][1:]) * 4096 // (n + 1) if v[0] else 4095) for v in rows)


def test_shards_of_one_hot_text(spark):
    rows = [(k, "same text", "en", "s") for k in range(4000)] + [(k, prose(k, 5), "en", "s") for k in range(4000, 4500)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.02 * sum(sums) / 8 + 200


def test_equal_texts_share_a_shard(spark):
    """Copies of unlike source and lang lie together, unless they hold more than fits; shards are even all the same."""
    r = random.Random(8)
    texts = [prose(k, r.randint(5, 60)) for k in range(1500)]
    source, lang = ["a", "b", "c", None], ["en", "de", None]
    rows = [(k, texts[k % 1500], r.choice(source), r.choice(lang)) for k in range(3000)] + [(k, "hot text " * 20, r.choice(source), r.choice(lang)) for k in range(3000, 4500)]
    rows += [(5000, None, "a", "en"), (5001, "", "b", None)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 8).collect()
    of, sums = {}, Counter()
    for x in got:
        of.setdefault((x.text_crc32, x["size"]), set()).add(x.shard)
        sums[x.shard] += x["size"]
    split = [k for k, v in of.items() if len(v) > 1]
    hot = "hot text " * 20
    assert split == [(zlib.crc32(hot.encode()), len(hot) + 16)]
    even = sum(sums.values()) / 8
    assert len(sums) == 8 and all(abs(x - even) <= 0.03 * even for x in sums.values())


def test_shards_equal_plain_medians(spark):
    """Against a k-d tree in plain Python that sorts the rows of each node."""
    r = random.Random(9)
    rows = [(k, prose(k, r.randint(1, 200)), r.choice("abc"), r.choice(["en", "de"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {x.doc_id: x.shard for x in shards.shard(df, 6).collect()}
    hashes = {x.doc_id: (x.t, x.i) for x in df.select("doc_id", F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(1 << 24)).alias("t"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)).alias("i")).collect()}
    ranks = [{v: k * 4096 // n for k, v in enumerate(sorted({x[c] for x in rows}))} for c, n in ((2, 3), (3, 2))]
    items = []
    for k, text, source, lang in rows:
        size = len(text.encode()) + 16
        codes = ranks[0][source], ranks[1][lang], min(int(np.log2(size) * 128), 4095)
        items.append((k, size, [(c, *hashes[k]) for c in codes]))
    total = sum(x[1] for x in items)

    def split(part, first, n):
        if n == 1:
            for k, size, keys in part:
                seen[k] = first
            return
        spread = [max(x[2][d][0] for x in part) - min(x[2][d][0] for x in part) for d in range(3)]
        d = spread.index(max(spread))
        part = sorted(part, key=lambda x: x[2][d])
        want, below, at = sum(x[1] for x in part) * (n // 2) / n, 0, 0
        while at < len(part) and below + part[at][1] < want:
            below += part[at][1]
            at += 1
        at += abs(below + part[at][1] - want) < abs(below - want)
        split(part[:at], first, n // 2)
        split(part[at:], first + n // 2, n - n // 2)

    seen = {}
    split(items, 0, 6)
    sums = Counter()
    for k, size, _ in items:
        sums[got[k]] += size
    assert seen == got and max(sums.values()) - min(sums.values()) <= 0.1 * total / 6


def test_shards_of_copies_with_an_outlying_id(spark):
    """One id far from all others does not keep a group of copies together."""
    rows = [(k, "same text", "en", "s") for k in range(4000)] + [(10**15, prose(1, 5), "en", "s")]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.02 * sum(sums) / 8 + 200


def vectors():
    r = np.random.default_rng(4)
    rows, centre = [], {}
    for k in range(700):
        label = int(k % 2)
        c = centre.setdefault((label, k % 35), r.normal(size=8))
        rows.append((k, (c + r.normal(size=8) * 0.25).astype(np.float32).tolist(), label, "x"))
    copies = [(1000 + k, rows[5][1], rows[5][2], "x") for k in range(50)]
    odd = [(2000, None, 1, "x"), (2001, [0.0] * 8, 1, "x"), (2002, [float("nan")] + [1.0] * 7, 1, "x"), (2003, [1.0, None], 1, "x"), (2004, rows[0][1], None, "x"), (2005, [], 0, "x"), (2006, [float("inf")] * 8, 0, "x"), (2007, [1.0, 2.0], 0, "x"), (2008, [2.0, 4.0], 0, "x")]
    return rows + copies + odd


@pytest.mark.parametrize("sizes", [(500, 1000), (20, 30), (100, 4096)])
def test_embeddings(spark, monkeypatch, sizes):
    monkeypatch.setattr(embeddings, "CELL", sizes[0])
    monkeypatch.setattr(embeddings, "BLOCK", sizes[1])
    rows = vectors()
    got = {r.vec_id: r for r in embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")).collect()}

    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab, _ in rows if good(v) and lab is not None]
    links = [(a, b) for a, x, p in ok for b, y, q in ok if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    root, n = components([r[0] for r in rows], links), Counter(i for pair in links for i in pair)
    assert len(links) > 1000
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (n[i], root[i], root[i] == i)


def grouped_vectors(groups, each, dim, noise):
    r = np.random.default_rng(8)
    centre = r.normal(size=(groups, dim))
    x = np.repeat(centre, each, axis=0) + r.normal(size=(groups * each, dim)) * noise
    return [(k, "s", v.tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("rows, most", [(grouped_vectors(30, 60, 32, 0.1), 130), (grouped_vectors(1800, 1, 32, 0.0), 1800)])
def test_embedding_cells(spark, monkeypatch, rows, most):
    """Groups get cells of their own; vectors without structure stay in one cell instead of visiting all others."""
    monkeypatch.setattr(embeddings, "CELL", 100)
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    nodes = frame.selectExpr("label", "size(embedding) dim", "vec_id rep", "1L copies", "embedding")
    sizes = Counter(r.cell for r in embeddings.cells(nodes).select("cell").collect())
    assert max(sizes.values()) <= most and sum(sizes.values()) <= 1.2 * len(rows)


def test_rules(docs):
    for r, d in zip(sorted(rules.clean(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), documents()):
        w = WORD.findall(d[1] or "")
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (d[1] or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)), failed)
        assert not (failed and r.kept)


def test_rules_tell_windows_of_a_long_text_apart(spark):
    """Two windows whose hashes agree in the upper 48 bits are two windows, also in a text of 40,000 words."""
    filler = [f"f{k}" for k in range(40_000)]
    alike, again = list(filler), list(filler)
    alike[100:100], alike[30_000:30_000] = ["w375", "w344", "w26"], ["w38", "w92", "w194"]
    again[100:100], again[30_000:30_000] = ["w375", "w344", "w26"], ["w375", "w344", "w26"]
    got = {r.doc_id: r.n_repeat_words for r in rules.clean(spark.createDataFrame([(1, " ".join(alike)), (2, " ".join(again))], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 6}


def test_rules_remove_lines(spark):
    text = prose(1, 80) + ".\nHome | About | Contact | Help\nClick here to sign up\n" + prose(2, 40) + "."
    bars = "\n".join("aa | bb | cc | dd | ee | ff | gg | hh | ii | jj | kk" + str(k) for k in range(12))
    kept = {r.doc_id: r for r in rules.clean(spark.createDataFrame([(1, text), (2, bars + "\n" + prose(3, 20) + ".")], "doc_id long, text string")).collect()}
    assert kept[1].kept and "About" not in kept[1].kept_text and "Click" not in kept[1].kept_text
    assert not kept[2].kept


def test_rules_judge_lines_as_in_plain_python(spark):
    r = random.Random(12)
    parts = ["word", "|", "##", "!!", "Click Here", "privacy policy", "PRIVACY  policy", "read", "more", "<>&", "é…", "x|y", "a\tb", "c\u00a0d"]
    ends = ["", ".", "!", " ", ".  ", ".\r", "”", "…", ")\t", "\x0b"]
    lines = ["".join(x + r.choice([" ", "  ", "\t"]) for x in r.choices(parts, k=r.randint(1, 16))).strip() + r.choice(ends) for _ in range(600)]
    phrases = [f"{before}{phrase}{after}" for phrase in rules.BOILERPLATE for before, after in (("", "."), ("See our ", " now."), ("word " * 10, "."), ("word " * 11, "."))]

    def good(line):
        n, bars, marked = len(WORD.findall(line)), line.count("|"), len(re.findall(r"[#*$%&<>!]{2,}", line))
        ended = n >= 10 or re.search(r"[.!?:;,\"'”’)\]…]\r?$", line.rstrip(" "))
        return ended and not (bars >= 2 and 3 * bars >= n) and not (n <= 12 and any(x in line.lower() for x in rules.BOILERPLATE)) and 3 * marked < n

    rows = list(enumerate(lines + phrases))
    got = {x.doc_id: x.kept_text for x in rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: x if good(x) else "" for k, x in rows} and 100 < sum(map(bool, got.values())) < len(rows) - 100


def test_rules_work_once_per_line_and_window(docs):
    """The words of a line are counted once and repeated windows are picked once, however often later steps use them."""
    plan = rules.clean(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{common.WORD}, 0)") == 1 and plan.count("filter(lambda") == 1


def test_rules_plan_is_native(docs):
    plan = rules.clean(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark):
    r = random.Random(1)
    alphabets = {"en": "the of and ing ion", "de": "der ung sch ein ich", "ru": "при что ого ть ни"}
    rows = [(k, " ".join("".join(r.choices(a.split(), k=2)) for _ in range(r.randint(3, 60))), lang, "lang") for k, (lang, a) in enumerate(list(alphabets.items()) * 60)]
    rows += [(500, None, "en", "x"), (501, "", "de", "x"), (502, "12 34 !!", "en", "x"), (503, "der ung schein", None, "x"), (None, "the of", "en", "x")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    right = [r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 500}
    assert odd == {500: "und", 501: "und", 502: "und", 503: "de"}
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_of_very_many_values(spark):
    """The sample bounds what is learned: of thousands of values of lang those with the most texts."""
    r = random.Random(3)
    alphabets = {"en": "the of and ing ion", "de": "der ung sch ein ich", "ru": "при что ого ть ни"}
    rows = [(k, " ".join("".join(r.choices(a.split(), k=2)) for _ in range(20)), lang) for k, (lang, a) in enumerate(list(alphabets.items()) * 40)]
    rows += [(1000 + k, prose(k, 8), f"rare{k // 2}") for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame, 120)
    assert len(set(model.langs)) <= 30 and {"en", "de", "ru"} <= set(model.langs) and len(model.centroids) <= 90
    got = {x.doc_id: x for x in language.identify(frame, 120).collect()}
    assert len(got) == len(rows) and {x.lang_pred for x in got.values()} <= set(model.langs)
    assert np.mean([got[k].lang_pred == rows[k][2] for k in range(120) if got[k].held_out]) > 0.9


def test_language_is_learned_in_little_memory(spark):
    """One language at a time becomes a matrix: 2,400 texts in 12 languages at once would be one of 39 MB."""
    rows = [(k, " ".join(prose(k % 40, 12).split()[: 4 + k % 9]) + f" {k % 40}", f"l{k % 12}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language.train(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(model.langs)) == 12 and peak < 25 << 20


def test_toxicity_learns_from_document_labels(spark):
    r = random.Random(2)
    rows, marks = [], []
    for k in range(400):
        parts = [prose(k * 31 + j, r.randint(4, 12)) + "." for j in range(r.randint(1, 12))]
        bad = k % 4 == 0
        if bad:
            parts[r.randrange(len(parts))] = f"you {r.choice(['zorgish', 'zorgful', 'blarg'])} thing."
        rows.append((k, " ".join(parts)))
        marks.append((k, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "..."), (None, "blarg.")]
    got = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    text = dict(rows)
    for r in held:
        if r.predicted and r.doc_id % 4 == 0:
            assert any(re.search("zorg|blarg", text[r.doc_id][x.start : x.end]) for x in r.offending)
    assert all(r.score == 0 and r.predicted == 0 for r in got if r.doc_id in (900, 901, 902))


def test_quality_learns(spark):
    r = random.Random(3)
    rows, marks = [], []
    for k in range(400):
        good = k % 3 != 0
        text = prose(k, r.randint(20, 200))
        rows.append((k, text if good else " ".join(w + "***" for w in text.split())))
        marks.append((k, int(good), 0))
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.97


@pytest.fixture(scope="module")
def toy(spark):
    """Documents in two alphabets, some with a bad sentence, some with signs between the words, and odd ones."""
    r = random.Random(12)
    rows, marks = [], []
    for k in range(240):
        parts = [prose(k * 17 + j, r.randint(3, 12)) + "." for j in range(r.randint(1, 8))]
        if k % 4 == 0:
            parts[r.randrange(len(parts))] = f"you {r.choice(['zorgish', 'blarg'])} thing."
        text = " ".join(parts) if k % 3 else " ".join(w + "***" for w in " ".join(parts).split())
        lang = ["en", "ru"][k % 2]
        rows.append((k, text if lang == "en" else text + " " + " ".join(r.choices("при что ого ть ни".split(), k=30)), lang))
        marks.append((k, int(k % 3 > 0), int(k % 4 == 0)))
    rows += [(900, None, "en"), (901, "", "ru"), (902, "1 2 ...", None), (903, "blarg! " * 4000, None), (None, "you blarg.", "en"), (5, rows[5][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), rows


def test_toxicity_is_a_plain_noisy_or(toy):
    frame, marks, rows = toy
    model = toxicity.train(frame, marks)
    assert max(model.weights.values()) > 1
    weights = {f: x for f, x in model.weights.items() if abs(x) > 1e-3}

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", text or ""):
            words = re.findall(r"[^\W\d_]+", sentence.lower())
            known = {w for w in words} | {"^" + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}
            z = model.bias + sum(weights.get(f, 0.0) for f in known)
            clean *= 1 - 1 / (1 + np.exp(-z)) if words else 1
        return 1 - clean

    want = sorted((str(i), round(plain(t), 6)) for i, t, _ in rows)
    assert want == sorted((str(r.doc_id), round(r.score, 6)) for r in toxicity.detect(frame, marks).collect())


def test_quality_is_a_plain_sum_of_tables(toy):
    frame, marks, rows = toy
    model = quality.train(frame, marks, "quality")
    assert model.tables and model.pairs
    found = quality.feature_table(frame).collect()
    assert len(found) == len(rows)
    want = []
    for r in found:
        z = model.bias + sum(t[sum(c <= v for c in cuts)] for t, cuts, v in zip(model.tables, model.cuts, r.x))
        for i, j, first, second, table in model.pairs:
            z += table[sum(c <= r.x[i] for c in first)][sum(c <= r.x[j] for c in second)]
        want.append((str(r.doc_id), round(1 / (1 + np.exp(-z)), 6)))
    assert sorted(want) == sorted((str(r.doc_id), round(r.score, 6)) for r in quality.classify(frame, marks).collect())


def test_language_is_a_plain_cosine(toy):
    frame, _, rows = toy
    model = language.train(frame)
    assert len(model.langs) > 2
    text = {str(i): t for i, t, _ in rows}
    for r in language.identify(frame).collect():
        counts = language.gram_counts(text[str(r.doc_id)] or "")
        if counts is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        x = [np.log1p(n) * w for n, w in zip(counts, model.idf)]
        length = sum(v * v for v in x) ** 0.5
        cosines = [sum(a * b for a, b in zip(x, c) if a) / max(length, 1e-12) for c in model.centroids.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r.lang_pred == model.langs[best] and abs(r.score - cosines[best]) < 1e-6 and r.rejected == (cosines[best] < model.least[best])


def test_quality_tables_learn_interactions():
    """Neither feature tells anything by itself; their pair table does."""
    r = np.random.default_rng(0)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :2] = r.random((2000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_classifiers_on_odd_rows(docs, labels, nothing):
    n = docs.count()
    for got, modulus, rest in ((quality.classify(docs, labels), 5, 0), (toxicity.detect(docs, labels), 3, 1)):
        rows = got.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    unlabelled = labels.where("false")
    assert quality.classify(docs, unlabelled).where("score <> 0.5").count() == 0
    assert toxicity.detect(docs, unlabelled).count() == n
    assert language.identify(docs).count() == n


@pytest.mark.parametrize("name", "quality toxicity shards minhash suffix rules language mixing packing".split())
def test_empty_tables(name, nothing, labels):
    call = {
        "quality": lambda: quality.classify(nothing, labels), "toxicity": lambda: toxicity.detect(nothing, labels), "shards": lambda: shards.shard(nothing),
        "minhash": lambda: minhash.near_duplicates(nothing), "suffix": lambda: suffix.digest(nothing), "rules": lambda: rules.clean(nothing),
        "language": lambda: language.identify(nothing), "mixing": lambda: mixing.mix(nothing), "packing": lambda: packing.pack(nothing),
    }[name]
    assert call().count() == 0


def test_empty_embeddings(spark):
    assert embeddings.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as int) as g")
    got = common.numbered(df, ["g"], ["id"], "n", block_rows=10).collect()
    for g in range(3):
        own = sorted(r.n for r in got if r.g == g)
        assert own == list(range(len(own)))


def test_components(spark):
    r = random.Random(7)
    links = [(k, k + 1) for k in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(150)] + [(500, k) for k in range(501, 700)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    want = components({i for p in links for i in p}, links)
    assert got == {i: want[i] for i in got} and {i for a, b in links if a != b for i in (a, b)} == set(got)
