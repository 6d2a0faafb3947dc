"""Operators of round three: vector codes, clustering, circulant MinHash, against plain Python."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import kmeans, minhash, simhash, vector_codes, vectors

INF, NAN = float("inf"), float("nan")
VDDL = "vec_id long, embedding array<float>, label int"


def _vectors(n, dims, seed, ids=None):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.4, (5, dims))
    x = (centres[rnd.integers(0, 5, n)] + rnd.normal(0, 0.1, (n, dims))).astype(np.float32)
    return [((ids[i] if ids else i), x[i].tolist(), int(i % 3) if i % 5 else None) for i in range(n)]


ODD = [(900, None, 1), (901, [1.0, None] + [0.0] * 62, 1), (902, [NAN] + [0.0] * 63, 1), (903, [INF] + [0.0] * 63, 1), (904, [-INF] + [0.0] * 63, None), (905, [0.5] * 63, 1), (906, [], 1)]


# --- bounds and distances
def test_distances_are_exact():
    rnd = np.random.default_rng(1)
    for top in (1 << 8, 1 << 26):
        x, c = rnd.integers(-top, top, (40, 16)), rnd.integers(-top, top, (9, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert vectors.squared(x, c).tolist() == want
    with pytest.raises(ValueError):
        import pyarrow as pa

        vectors.floors(pa.array([[1e30, 0.0]]), 64, 2)


# --- vector codes
@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest_with_ties(seed):
    rnd = np.random.default_rng(seed)
    entries = rnd.integers(-3, 4, (60, 3)) if seed % 2 else rnd.integers(-2000, 2000, (256, 16))  # many equal and tied entries, or spread ones
    x = np.concatenate([entries, rnd.integers(entries.min(), entries.max() + 1, (500, entries.shape[1]))])
    index, d = vector_codes.nearest(x, entries, vector_codes.ball_tree(entries))
    full = vectors.squared(x, entries)
    assert index.tolist() == full.argmin(1).tolist() and d.tolist() == full.min(1).tolist()


def test_tree_measures_fewer_distances():
    rnd = np.random.default_rng(5)
    middles = rnd.integers(-4000, 4000, (32, 16))
    entries = np.concatenate([m + rnd.integers(-50, 50, (8, 16)) for m in middles])
    x = entries[rnd.integers(0, 256, 2000)] + rnd.integers(-40, 40, (2000, 16))
    measured = []
    index, _ = vector_codes.nearest(x, entries, vector_codes.ball_tree(entries), measured)
    assert index.tolist() == vectors.squared(x, entries).argmin(1).tolist()
    assert measured[0] < 0.3 * len(x) * len(entries)


def _codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, tuple(math.floor(scale * x) for x in v), lab) for i, v, lab in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    find = lambda v, b: min(range(len(b)), key=lambda e: (dist(v, b[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for _, v, _ in kept:
                got[find(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(got[e]) for c in zip(*got[e])) if got[e] else b for e, b in enumerate(books[p])]
    out, by_label = [], collections.Counter()
    for i, v, lab in kept:
        e = [find(cut(v, p), books[p]) for p in range(parts)]
        err = sum(dist(cut(v, p), books[p][x]) for p, x in enumerate(e))
        by_label[lab] += err
        out.append((i, "".join(f"{x:02x}" for x in e), err, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], sha) for i, c, e, lab in out), key=str)


def test_codes_of_odd_rows(spark):
    rows = _vectors(70, 64, 2)
    rows += [rows[3], rows[3], (None, rows[4][1], None), (5, rows[6][1], 7)]  # repeated rows, a null id, an id twice
    df = spark.createDataFrame(rows + ODD, VDDL).withColumns({c: F.lit(1) for c in ("group", "n", "code", "vec", "dims", "error")}).repartition(3)
    got = vector_codes.compress(df, entries=20)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == _codes(rows, entries=20)


def test_codes_of_small_and_empty_tables(spark):
    none = spark.createDataFrame([], VDDL)
    assert vector_codes.compress(none).collect() == [] and kmeans.cluster(none).collect() == []
    bad = spark.createDataFrame(ODD[:5], VDDL)
    assert vector_codes.compress(bad).collect() == [] and kmeans.cluster(bad).collect() == []
    three = _vectors(3, 64, 3)
    assert sorted(map(tuple, vector_codes.compress(spark.createDataFrame(three, VDDL)).collect()), key=str) == _codes(three)
    blank = spark.createDataFrame([(1, [], None), (2, [], 1)], VDDL)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in vector_codes.compress(blank).collect()) == [(1, "00000000", 0), (2, "00000000", 0)]
    uneven = vector_codes.compress(spark.createDataFrame([(1, [0.1] * 6, 1), (2, [0.2] * 6, 1), (3, [0.3] * 5, 1)], VDDL))
    assert sorted(r["vec_id"] for r in uneven.collect()) == [1, 2]
    with pytest.raises(ValueError):
        vector_codes.compress(none, entries=300)


# --- clustering
def _clusters(rows, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, mark(r[0]), r[1]))
    cents = [v for _, v in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        got = collections.defaultdict(list)
        for _, v in kept:
            got[near(v)[1]].append(v)
        cents = [tuple(sum(c) // len(got[j]) for c in zip(*got[j])) if got[j] else c0 for j, c0 in enumerate(cents)]
    out, inertia = [], collections.Counter()
    for i, v in kept:
        d, j = near(v)
        inertia[j] += d
        out.append((i, j, d))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out), key=str)


def test_clusters_of_odd_rows(spark):
    rows = _vectors(120, 64, 4)
    rows += [rows[3]] * 30 + [(None, rows[4][1], None), (5, rows[6][1], 7)]
    df = spark.createDataFrame(rows + ODD, VDDL).withColumns({c: F.lit(1) for c in ("cluster", "q", "n", "vec", "upper", "distance")}).repartition(3)
    got = kmeans.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == _clusters(rows)
    few = _vectors(5, 64, 8)
    assert sorted(map(tuple, kmeans.cluster(spark.createDataFrame(few, VDDL)).collect()), key=str) == _clusters(few)


@pytest.mark.parametrize("seed", range(4))
def test_exponion_keeps_ties_and_scans_less(seed):
    """Round after round the same as a plain search, on a small grid where ties abound and on spread groups."""
    rnd = np.random.default_rng(seed)
    if seed % 2:
        q, cents = rnd.integers(-3, 4, (400, 2)), rnd.integers(-3, 4, (12, 2))
    else:
        middles = rnd.integers(-3000, 3000, (24, 8))
        q = np.concatenate([m + rnd.integers(-60, 60, (60, 8)) for m in middles])
        cents = q[rnd.choice(len(q), 24, replace=False)]
    of, up, low, before, scanned = np.zeros(len(q), np.int64), np.full(len(q), INF), np.zeros(len(q)), None, []
    for _ in range(8):
        if before is not None:
            up, low = kmeans.moved_bounds(of, up, low, before, cents)
        of, up, low = kmeans.exponion(q, of, up, low, cents, scanned)
        full = vectors.squared(q, cents)
        assert of.tolist() == full.argmin(1).tolist()
        rows = np.arange(len(q))
        assert (up >= np.sqrt(full[rows, of])).all()
        full[rows, of] = 1 << 60
        assert (low <= np.sqrt(full.min(1))).all()
        before, cents = cents, np.array([q[of == j].sum(0) // (of == j).sum() if (of == j).any() else c for j, c in enumerate(cents)])
    if not seed % 2:
        assert sum(scanned[1:]) < 0.5 * 7 * len(q) * len(cents)


# --- circulant MinHash
def _minhash(rows, shingle=2, threshold=80):
    sets = [minhash.shingle_set(t, shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    comp = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp)), key=str)


def test_shifted_permutation_estimates_similarity():
    """Coordinates agree as often as the sets are alike; both permutations are one-to-one."""
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 50_000).astype(np.uint64))
    assert np.unique(minhash.permute(x, minhash.FIRST)).size == np.unique(minhash.permute(x, minhash.SECOND)).size == x.size
    for share in (0.2, 0.5, 0.8):
        n = 600
        both = int(2 * n * share / (1 + share))
        s = minhash.signatures([x[:n], x[n - both : 2 * n - both]], range(2000))
        assert abs((s[0] == s[1]).mean() - share) < 0.05
    # coordinate k is the least of the second permutation at places shifted by k, whatever blocks the sets are met in
    long = [x[:3], x[:40_000], x[100:101]]
    s = minhash.signatures(long, range(5, 9))
    for row, codes in zip(s, long):
        assert row.tolist() == [int(minhash.permute(minhash.permute(codes, minhash.FIRST) - np.uint64(k), minhash.SECOND).min()) for k in range(5, 9)]


def test_codes_are_one_to_one_with_shingles():
    rnd = random.Random(3)
    for shingle in (1, 2, 3, 5):
        for n in (0, 1, 2, 4, 5, 300):
            text = " ".join(rnd.choice("aBc") * rnd.randint(1, 2) for _ in range(n))
            assert np.unique(minhash.shingle_codes(text, shingle, {})).size == minhash.shingle_codes(text, shingle, {}).size == len(minhash.shingle_set(text, shingle))


def _near_group(rnd, n, edits, size=60):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(size)] = f"x{rnd.randrange(30)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limit", [4, 2048])
def test_near_duplicates_of_large_groups(spark, limit, monkeypatch):
    """A group whose members lie on both sides of the threshold, by one task, by further levels and by blocks."""
    monkeypatch.setattr(minhash, "QUERIES", 16)
    monkeypatch.setattr(minhash, "MEMBERS", 32)
    rnd = random.Random(7)
    texts = _near_group(rnd, 150, 14) + _near_group(rnd, 40, 3) + [f"alone {i} {i * 7} words of its own {i}" for i in range(40)]
    texts += texts[:20]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, bucket_limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == _minhash(rows)


def test_near_duplicates_of_odd_rows(spark, odd, clash, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = _minhash(rows)
    assert sorted(map(tuple, minhash.near_duplicates(odd, shingle=2).collect()), key=str) == want
    assert sorted(map(tuple, minhash.near_duplicates(clash, shingle=2).collect()), key=str) == want
    assert minhash.near_duplicates(none).collect() == []


def test_threshold_is_inclusive(spark):
    a = [f"t{i}" for i in range(10)]  # nine pairs; eight in common of ten in all
    rows = [(1, " ".join(a)), (2, " ".join(a[:9] + ["other"])), (3, " ".join(["z"] + a[1:9] + ["q"])), (4, "A b"), (5, "a  B"), (6, "b a")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()))
    assert got == sorted(_minhash(rows), key=str)
    assert [r[2] for r in got] == [1, 1, 3, 4, 4, 6]


def test_components_of_a_hub(spark):
    """A node larger than its very many neighbours: the small-star join is split."""
    n = 3000
    edges = spark.createDataFrame([(10**6, i) for i in range(n)] + [(i, i + 5000) for i in range(0, n, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == n + 1 + len(range(0, n, 7))
