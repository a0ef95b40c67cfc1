"""Periodic runs, centroid clustering and repeated passages against plain versions, and their rare inputs."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from playseq.llm import centroids, packing, periodic, queries, substrings
from playseq.llm.words import window_hashes, word_hashes
from tests.conftest import SF


# -- periodic runs -------------------------------------------------------------------------------


def plain_runs(words):
    """All lags, all maximal stretches, and the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, n, letters):
    words = []
    while len(words) < n:
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        words += block * rng.choice((1, 1, 2, 3, 4, 5, 9)) + block[: rng.randrange(len(block))]
    return words[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_all_lags(seed):
    rng = random.Random(seed)
    words = periodic_words(rng, rng.randrange(0, 260), "ab" if seed % 3 else "abcdefghij")
    codes = np.array([ord(w) for w in words], np.int64)
    assert periodic.find_runs(codes) == plain_runs(words)


def test_runs_inside_runs_and_long_periods():
    inner = "x x x x x x x y".split()
    words = inner * 5 + [f"u{i}" for i in range(700)] * 4 + ["z"] * 6
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = periodic.find_runs(np.array([numbers[w] for w in words]))
    assert (0, 40, 8) in found and (40, 2800, 700) in found and (2840, 6, 1) in found and len(found) == 8
    assert periodic.best_run(found) == (0, 7, 1)
    assert periodic.best_run([(3, 8, 2), (1, 12, 3)]) == (3, 8, 2) and periodic.best_run([]) is None


def test_runs_of_one_repeated_word_are_linear():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    square = np.tile(np.arange(1000), 300)
    assert periodic.find_runs(square) == [(0, 300_000, 1000)]


def test_periodic_runs_rare_inputs(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x x x x x x", "c"), (4, "a b a b a b a b\x0ba  q", "d"), (4, "a b a b a b a b\x0ba  q", "d"), (5, "    é é é é é", "e"), (6, "w " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.periodic_runs(df, ["doc_id", "text", "runs"]).select("doc_id", "text", "runs", "best", "collapsed").collect()
    found = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 7 and len(found) == 6
    assert found[1, None].runs == [] and found[1, None].best is None and found[1, None].collapsed == "" == found[2, ""].collapsed
    assert found[None, "x x x x x x"].collapsed == "x" and found[4, rows[3][1]].collapsed == "a b q"
    assert tuple(found[4, rows[3][1]].best) == (0, 9, 2)
    # A no-break space is part of a word; five equal words are no run.
    assert found[5, rows[5][1]].collapsed == rows[5][1]
    assert found[6, rows[6][1]].collapsed == "w"
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_op11_equals_a_plain_version(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    for row in docs.select("doc_id", "text").orderBy("doc_id").limit(120).collect():
        words = (row.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = got[row.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


# -- centroids -----------------------------------------------------------------------------------


def plain_lloyd(rows, clusters, rounds, size):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centre = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centre))

    for _ in range(rounds):
        owned = [[] for _ in centre]
        for _, v in kept:
            owned[nearest(v)[1]].append(v)
        centre = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(owned, centre)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = {k: sum(d for _, c, d in out if c == k) for k in range(len(centre))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted([(i, k, d, sums[k], sum(sums.values()), digest[k]) for i, k, d in out], key=repr)


def test_lloyd_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=20) * (1 + i % 3)]) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 19), (202, [None] * 20), (203, [float("nan")] * 20), (204, [float("inf")] + [0.0] * 19), (None, [0.5] * 20), (5, rows[5][1]), (7, [-9.0] * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string")
    got = sorted((tuple(r) for r in centroids.lloyd(df, clusters=7, size=20).collect()), key=repr)
    assert got == plain_lloyd(rows, 7, 3, 20)


def test_lloyd_with_fewer_vectors_than_clusters(spark):
    rows = [("a", [1.0, 2.0]), ("b", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = {r.vec_id: (r.cluster, r.distance, r.inertia) for r in centroids.lloyd(df, size=2).collect()}
    # Both start a centroid at the same place, and the first takes both.
    assert got == {"a": (0, 0, 0), "b": (0, 0, 0)}
    assert centroids.lloyd(df.limit(0), size=2).collect() == [] and centroids.lloyd(df, size=3).collect() == []


# -- repeated passages ---------------------------------------------------------------------------


def plain_repeats(rows, window):
    least = {}
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None:
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        off = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if least[tuple(words[k : k + window])] < i:
                    off |= set(range(k, k + window))
        out.append((i, len(words), len(off), b" ".join(w for k, w in enumerate(words) if k not in off).decode()))
    return sorted(out, key=repr)


def found_repeats(df, window):
    rows = substrings.remove_repeats(df, window=window).collect()
    for r in rows:
        assert sum(b - a for a, b in (tuple(s) for s in r.removed)) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("window, batch", [(13, 600), (13, 8_000_000), (4, 300), (1, 300)])
def test_repeats_equal_a_plain_version(spark, monkeypatch, window, batch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 4000)
    rng = random.Random(window)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    rows = []
    for i in range(120):
        words = [w for _ in range(rng.randrange(0, 5)) for w in rng.choice(pool)[rng.randrange(4) :]] + [f"x{i}"]
        rows.append((i if i % 17 else None, " ".join(words) + ("\n" if i % 2 else "")))
    rows += [(3, rows[9][1]), (3, rows[9][1]), (500, None), (501, ""), (502, " \t"), (503, rows[8][1].replace(" ", "\x0c")), (504, rows[8][1].replace(" ", " ")), (505, rows[8][1].upper())]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, batch string").repartition(5)
    assert found_repeats(df, window) == plain_repeats(rows, window)


def test_repeats_rare_inputs(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([("b", text), ("a", text), ("é", text + " more"), (None, text)], "doc_id string, text string")
    assert found_repeats(df, 13) == sorted([("a", 40, 0, text), ("b", 40, 40, ""), ("é", 41, 40, "more"), (None, 40, 0, text)], key=repr)
    assert found_repeats(df.limit(0), 13) == []
    # Words are the same with or without a neighbour of over a million bytes.
    long = " ".join(f"v{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "w " + " ".join(f"v{i}" for i in range(150_000, 150_020)))], "doc_id long, text string")
    assert [r[2] for r in found_repeats(df, 13)] == [0, 20]


def test_many_copies_make_no_pairs(spark):
    """A passage in all documents: one entry for each batch and hash travels."""
    common = " ".join(f"c{i}" for i in range(60))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(common), F.lit(" own"), F.col("id")).alias("text"))
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()}
    assert got[0][0] == 0 and all(got[i] == (60, f"own{i}") for i in range(1, 3000))


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        numbers = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        flags = [rng.random(len(numbers)) < 0.3 for _ in range(2)]
        read, marks = packing.unpacked(packing.packed(numbers, *flags), len(numbers), 2)
        assert np.array_equal(read, numbers) and all(np.array_equal(a, b) for a, b in zip(marks, flags))


def test_word_hashes():
    texts = [b"one two\tthree", None, b"", b"  two ", b"x" * 3_000_000, b"three"]
    hashes, bounds = word_hashes(texts)
    assert bounds.tolist() == [0, 3, 3, 3, 4, 5, 6]
    assert hashes[1] == hashes[3] and hashes[2] == hashes[5] and len(set(hashes.tolist())) == 4
    assert len(window_hashes(hashes, 7)) == 0 and len(window_hashes(hashes, 6)) == 1
