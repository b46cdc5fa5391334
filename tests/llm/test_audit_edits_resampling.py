"""Operators 11 to 13 against brute force, on hot groups, nulls, repeats, long texts, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORD, brute_repeats, documents, prose

from tallybook.llm import audit, common, edits, resampling, suffix, tries


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(60)] + [(3, 1, 1), (3, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- 11: filters and tries ----------------------------------------------------------------------------------


def failed(rows):
    """Names of the filters that each row fails."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    out = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        bad = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        out.append(bad + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (r[0] is not None and least[text] < r[0]))
    return out


def brute_audit(rows, good, toxic):
    fails = failed(rows)
    want = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for k, name in enumerate(order):
                here = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                gone = sum(name in f and any(e in f for e in order[:k]) for _, f in own)
                want[part, "".join(order), k + 1] = [len(left), len(here), gone, sum(f == name for _, f in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
    total = Counter()
    for (part, order, step), x in want.items():
        total[part, order[step - 1]] += x[1]
    return {(p, o, s): (*x, total[p, o[s - 1]]) for (p, o, s), x in want.items()}


def audited(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def test_audit(docs, labels):
    got = audit.audit(docs, labels)
    good, toxic = {k for k in range(60) if k % 4 or k == 3}, {k for k in range(60) if k % 5 == 0} | {3}
    assert audited(got) == brute_audit(documents(), good, toxic)


@pytest.mark.parametrize("held", [1 << 24, 3000])
def test_duplicates_of_a_hot_text(spark, monkeypatch, held):
    """A third of the rows hold one text, others agree in long prefixes; the smallest id stays, whatever a trie holds."""
    monkeypatch.setattr(audit, "HELD", held)
    base = prose(1, 150)
    rows = [(k, base, "en") for k in range(700, 1500)] + [(k, base + f" {k}", "en") for k in range(700)] + [(2000 + k, base + f" {k % 300}", "fr") for k in range(700)]
    rows += [(700, base, "en")] * 40 + [(None, base, "en")] * 5
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = Counter()
    for r in audit.failures(frame).collect():
        got[r.doc_id, r.part, "".join(n for k, n in enumerate("ABCDE") if r["mask"] >> k & 1)] += r.copies
    assert got == Counter((r[0], r[2], f) for r, f in zip(rows, failed(rows)))


def test_trie_against_a_dictionary():
    r = random.Random(3)
    root, least, end = tries.Node(b""), {}, {}
    for k in range(3000):
        text = bytes(r.choices(b"ab", k=r.randint(0, 12)))
        least[text] = min(least.get(text, 10**9), i := r.randrange(10**6))
        end[text] = tries.insert(root, text, i)
        end[text].rows = [text]
    assert all(end[t].least == least[t] for t in least)
    assert sorted(n.rows[0] for n in tries.terminals(root)) == sorted(least)


def test_ranges_are_even(spark):
    """Near copies that share long prefixes are told apart by prefixes as long as that takes."""
    base = prose(2, 400)
    texts = [base[: 300 + 4 * (k % 500)] + f"{k}" for k in range(4000)] + [prose(k, 20) for k in range(10, 500)]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "data binary").repartition(6)
    starts = tries.range_starts(frame, 4, "test")
    sums = Counter()
    for t in texts:
        sums[tries.range_of(starts, t.encode())] += len(t)
    assert starts[0] == b"" and len(starts) >= 12 and max(sums.values()) < 3 * sum(sums.values()) / len(starts)


# ---- 12: edit embedding -------------------------------------------------------------------------------------


def plain_print(text):
    """The walk step by step, then the bits at the sampled steps."""
    _, stay = edits._coins()
    rows, bit = edits._characters()
    written, step = [], 0
    for c in text:
        n = stay[int(rows[ord(c)]) + step % edits.PERIOD]
        written += [int(bit[ord(c)])] * n
        step += n
    return step, np.array([written[p] for p in edits.sampled(edits._level(step)) if p < step], np.uint8)


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(edits, "LOT_TEXTS", 9)
    rows = sorted([(r[0], r[1] or "") for r in documents() if r[0] is not None])
    got = edits.fingerprints(docs).collect()
    assert len(got) == len(documents())
    found = {r.doc_id: r for r in got}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, r = plain_print(text), plain_print(edited), found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (edits.written(own), edits.written(other))
        assert (r.near_edited, r.near_next) == (edits.likeness(own, other), edits.likeness(own, plain_print(after)))
    # a row without an id has no next document
    base = documents()[-1][1]
    assert found[None].near_next == 0 and found[None].edited_sha256 == hashlib.sha256(base[: len(base) - len(base) // 2].encode()).hexdigest()
    assert found[None].fingerprint == found[8].fingerprint


def test_one_document_and_repeated_ids(spark):
    only = edits.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and only.near_next == 1
    rows = [(1, "aaaa"), (1, "aaaa"), (2, "bb"), (3, None), (3, None)]
    got = edits.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter([(1, "aabb"), (1, "aabb"), (2, "b"), (3, ""), (3, "")])
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == Counter({(i, hashlib.sha256(t.encode()).hexdigest()): n for (i, t), n in want.items()})


def test_likeness_falls_with_edits():
    """Few edits leave most of the walk alike, many or another text do not; means over texts, as a walk may stray for long."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(400)) for _ in range(20)]
    means = []
    for n in (0, 1, 4, 40, 800):
        near = []
        for text in texts:
            cut = list(text)
            for _ in range(n):
                cut[r.randrange(len(cut))] = r.choice(["", "x", "yz"])
            near.append(edits.likeness(plain_print(text), plain_print("".join(cut))))
        means.append(np.mean(near))
    assert means[0] == 1 and means[1] > 0.9 and means[2] > 0.75 and means == sorted(means, reverse=True) and means[4] < 0.3
    assert np.mean([edits.likeness(plain_print(a), plain_print(b)) for a, b in zip(texts, texts[1:])]) < 0.15


def test_walk_of_a_very_long_text():
    points = edits.code_points(prose(9, 120_000))
    alone = edits.walk(points, np.array([0, len(points)]), np.zeros(1, np.int32))
    many = edits.walk(np.concatenate([points] + [points[:50]] * 100), np.append([0], len(points) + 50 * np.arange(101)), np.zeros(101, np.int32))
    assert (many[: len(points)] == alone).all() and (many[-50:] == alone[:50]).all()


def test_near_copies(spark):
    r, rows = random.Random(8), []
    for group in range(12):
        base = prose(100 + group, 250)
        for k in range(6):
            at = r.randrange(len(base))
            rows.append((group * 10 + k, base if k == 1 else base[:at] + "q" + base[at + 1 :]))
    rows += [(1000, None), (1001, ""), (None, rows[0][1])]
    prints = edits.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.component_id for x in edits.near_copies(prints).collect()}
    assert got[None] is None and got[1000] == got[1001] == 1000
    # a walk may stray for long after one edit, so a copy may miss its group, but groups never meet
    together = [Counter(got[g * 10 + k] for k in range(6)).most_common(1)[0][1] for g in range(12)]
    assert sum(together) >= 62 and min(together) >= 3 and all(got[i] // 10 == i // 10 for i in got if i is not None and i < 1000)


def test_near_copies_of_a_band_full_of_strangers(spark, monkeypatch):
    """All fingerprints share every band, as their first halves are equal; each group is found, whoever leads."""
    r = np.random.default_rng(4)
    bits = r.integers(0, 2, 512).astype(np.uint8)

    def turned(x, n, at=256):
        y = x.copy()
        y[r.choice(np.arange(at, 512), n, replace=False)] ^= 1
        return y

    strangers = [np.concatenate([bits[:256], r.integers(0, 2, 256).astype(np.uint8)]) for _ in range(40)]
    made = list(enumerate(strangers))
    made += [(100 + 10 * g + k, turned(strangers[20 + g], 8)) for g in range(5) for k in range(3)]
    chain = [strangers[30]]  # each is like the next, none like the one after it
    for k in range(4):
        chain.append(chain[-1].copy())
        chain[-1][256 + 20 * k : 276 + 20 * k] ^= 1
    made += [(200 + k, x) for k, x in enumerate(chain[1:])]
    made += [(300 + k, turned(strangers[0], 5)) for k in range(12)]
    texts = [(i, edits.written((512, x))) for i, x in made] + [(None, edits.written((512, strangers[1])))]
    prints = [(i, edits.read(t)) for i, t in texts if i is not None]
    want = {i: i for i, _ in prints}
    for _ in prints:
        for i, x in prints:
            for j, y in prints:
                if edits.likeness(x, y) >= edits.NEAR:
                    want[i] = want[j] = min(want[i], want[j])
        if all(want[want[i]] == want[i] for i in want):
            break
    assert want[203] == 30 and want[142] == 24 and want[311] == 0 and len(set(want.values())) == 40
    frame = spark.createDataFrame(texts, "doc_id long, fingerprint string")
    for cell in (edits.CELL, 7):  # bands dealt to many cells give the same
        monkeypatch.setattr(edits, "CELL", cell)
        got = {x.doc_id: x.component_id for x in edits.near_copies(frame).collect()}
        assert got.pop(None) is None and got == want


def test_rooted(spark):
    """Only joined fingerprints are looked up; those that no leader has joined keep their rows and are their own roots."""
    members = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8)], "rep long, band long")
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    got = edits._rooted(members, roots)
    assert got.columns == ["rep", "band", "root"]
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1), (2, 7, 1), (2, 8, 1), (3, 8, 3)]
    assert sorted(map(tuple, edits._rooted(members, roots.limit(0)).collect())) == [(1, 7, 1), (2, 7, 2), (2, 8, 2), (3, 8, 3)]


def test_alike_is_likeness():
    r = np.random.default_rng(5)
    base = r.integers(0, 2, 4000).astype(np.uint8)
    prints = []
    for steps in (0, 1, 3, 200, 500, 512, 520, 700, 1000, 1024, 1100, 1150, 2100):
        size = int(np.searchsorted(edits.sampled(edits._level(steps)), steps))
        for flips in (0, 3, 14, 40):
            bits = base[edits.sampled(edits._level(steps))[:size]].copy()
            bits[r.integers(0, max(1, size), flips if size else 0)] ^= 1
            prints.append((steps, bits))
    prints = [p for p in prints if p[0]]
    want = [[edits.likeness(a, b) >= edits.NEAR for b in prints] for a in prints]
    assert edits._alike(prints, prints, edits.NEAR).tolist() == want and 0.05 < np.mean(want) < 0.9


# ---- 13: resampling -----------------------------------------------------------------------------------------


def brute_resample(rows, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    have, want = Counter(bucket(w) for _, t in rows for w in words(t)), Counter(bucket(w) for t in target for w in words(t))
    s, t = sum(have.values()), sum(want.values())
    out = []
    for i, text in rows:
        found = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000)))) for b in map(bucket, words(text))]
        weight = sum(found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
    able = sorted((r for r in out if r[0] is not None and r[1] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(able[: 10 * len(able) // 100], 1)}
    return {(*r, rank.get(r[0])) for r in out}


def test_resample(spark, docs, monkeypatch):
    target = spark.createDataFrame([(1, prose(3, 200)), (2, "Ba KO ri"), (3, None)], "item_id long, text string")
    rows = [(r[0], r[1]) for r in documents()]
    found = resampling.resample(docs, target).collect()
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found} == brute_resample(rows, [r.text for r in target.collect()])
    assert resampling.drawn(docs, target).columns == docs.columns
    # a long text read in small pieces has the same words, also in longer runs
    long = spark.createDataFrame([(1, prose(6, 3000))], "doc_id long, text string")
    whole = resampling.features(long, 3).first().buckets
    monkeypatch.setattr(common.pieces, "__defaults__", (100,))
    assert Counter(next(iter(resampling._featured(3)(iter(long.toArrow().to_batches())))).column("buckets").to_pylist()[0]) == Counter(whole)


def test_radix_sort(spark):
    r = random.Random(4)
    rows = [(r.choice([-(2**63), 2**63 - 1, 0, -5, 7]), r.randrange(-(10**6), 10**6)) for _ in range(500)] + [(3, 3)] * 200
    placed = resampling.radix_placed(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "at", "test", block_rows=50).collect()
    assert [(x.a, x.b) for x in sorted(placed, key=lambda x: x["at"])] == sorted(rows)
    assert sorted(x["at"] for x in placed) == list(range(len(rows)))


# ---- all of them, and the stages ----------------------------------------------------------------------------


def test_empty_tables(spark, nothing, docs, labels):
    none = spark.createDataFrame([], "item_id long, text string")
    assert audit.audit(nothing, labels).count() == edits.fingerprints(nothing).count() == resampling.resample(nothing, none).count() == 0
    assert edits.near_copies(edits.fingerprints(nothing)).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()
    assert audit.audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


CLASHING = "rate target source_size _score score _id _left id left gone _gone again _again row n _size _copies _key key _row h".split()


@pytest.mark.parametrize("n", [0, 40])
def test_stages_keep_clashing_columns(spark, sf, n):
    """Extra columns with the names that stages use inside pass through; an empty table passes all stages."""
    own = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n)
    docs = own.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf), "test-stage")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("window", [400, 240])
def test_window_is_a_parameter(spark, window):
    """Passages of 51 to 60 short words that repeat across documents go with a shorter window; both agree with brute force."""
    r = random.Random(21)
    passages = [" ".join("".join(r.choices("abcdeftu", k=r.randint(3, 5))) for _ in range(r.randint(51, 60))) for _ in range(6)]
    rows = [(k, f"{prose(300 + k, 40)} {passages[k % 6]} {prose(400 + k, 40)}") for k in range(18)] + [(50, prose(500, 90)), (51, "-" * 300), (52, "-" * 900)]
    want = brute_repeats(rows, window)
    found = suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    for x in found:
        assert (x.n_removed or 0) == want[x.doc_id][1], x.doc_id
    if window == 240:
        cut = {x.doc_id: x.text for x in suffix.cleaned(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
        assert not any(p[20:-20] in t for p in passages for t in cut.values()) and cut[50] == rows[18][1]
