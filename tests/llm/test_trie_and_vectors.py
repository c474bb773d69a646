"""Conversation tries, nearest neighbours and whitening against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from folio.llm import binary_codes, prefix_trie, whitening

TURNS = "conv_id long, turn long, role string, text string, depth string, path int"


def _rebuilt(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(s[2], s[4]) for s in sorted(v)] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: (*own.get(c - c % 5, [])[: heads[c]], *turns[heads[c] :]) for c, turns in own.items()}


def _trie(rows):
    paths = _rebuilt(rows)
    members, kids = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))) for p, m in members.items()}
    return sorted(
        [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()], key=repr
    )


def _conversations(n, seed):
    rng, rows = random.Random(seed), []
    for c in range(n):
        hot = rng.random() < 0.3  # copies of one conversation, and one first turn
        for t in range(6 if hot else rng.choice([1, 2, 3, 5, 9, 12, 40])):
            turn = (c, t, "user", "the same") if hot or t == 0 and rng.random() < 0.4 else (c, None if rng.random() < 0.05 else t, rng.choice(["user", "bot", None]), rng.choice(["x", "yé", "zz" * 50, None, ""]))
            rows.append((*turn, "other", 1))
    return [*rows, (None, 1, "user", "nobody's", None, None), *rows[:3], *[(7 * n + 3, t, "user", str(t), None, None) for t in range(300)]]


@pytest.mark.parametrize(("n", "shard_nodes"), [(0, 50), (1, 10), (60, 9), (300, 40), (300, 400), (200, 1 << 18)])
def test_prefix_trie(spark, n, shard_nodes):
    rows = _conversations(n, n + shard_nodes) if n else []
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), shard_nodes)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _trie(rows)


@pytest.mark.parametrize("block", [2, 8, 64])
def test_findclose(block):
    rng, bits, open_ = random.Random(block), [], 0
    while len(bits) < 3_000 or open_:
        up = open_ == 0 and len(bits) < 3_000 or open_ and len(bits) < 3_000 and rng.random() < 0.52
        open_ += 1 if up else -1
        bits.append(int(up))
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.flatnonzero(bits)
    pairs = prefix_trie.Parentheses(np.array(bits, np.int8), block)
    assert pairs.findclose(opens, 500).tolist() == [want[i] for i in opens.tolist()]
    assert pairs.leaf_pairs().tolist() == [i for i in opens.tolist() if bits[i + 1] == 0]


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = 5 + rng.standard_normal((n, dim)) + 3 * rng.standard_normal((4, dim))[rng.integers(0, 4, n)]
    rows[: n // 10] = rows[:1]  # one very common vector
    return [(i, v, "x") for i, v in enumerate(rows.astype(np.float32).tolist())]


ODD = [(7_000_000, None, "x"), (7_000_001, [], None), (7_000_002, [0.0] * 8, None), (7_000_100, [1.0, None] * 4, "x"), (7_000_200, [float("nan")] + [1.0] * 7, "x"), (7_000_300, [float("inf")] + [1.0] * 7, "x"), (None, [1.0] * 8, "x")]


def _nearest(rows, k=10):
    by = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[i] = min(by.get(i, v), v)
    out = []
    for q in (i for i in by if i % 100 == 0):
        others = [(float(np.sqrt(((np.array(v) - np.array(by[q])) ** 2).sum())), i) for i, v in by.items() if i != q and len(v) == len(by[q])]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(others)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim"), [(0, 8), (5, 8), (1_000, 8), (1_500, 70)])
def test_nearest(spark, n, dim):
    rows = [*_vectors(n, dim, n), *ODD, (100, [1.0, 2.0], "short"), (8_000_000, [1.0, 2.5], "short"), *_vectors(n, dim, n)[:5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    found = sorted(tuple(r) for r in binary_codes.nearest_to_some(frame).collect())
    want = _nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in rows])
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in found], [r[3] for r in want], rtol=1e-13, atol=0)


def test_nearest_in_passes_and_large_values(spark):
    rows = [(i, [x * 1e200 for x in v], "x") for i, v, _ in _vectors(400, 6, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    every = binary_codes.ready(frame, "vec_id", "embedding")
    index = binary_codes.build_index(every, "vec_id", "embedding")
    found = binary_codes.nearest(index, every, "vec_id", "embedding", 3, broadcast_bytes=2_000)
    assert sorted(r.query_id for r in found.where("rank = 1").collect()) == list(range(400))
    scores = {(r.query_id, r.vec_id): r.score for r in found.collect()}
    assert all(np.isfinite(s) for s in scores.values())
    small = np.array([v for _, v, _ in _vectors(400, 6, 3)])
    for q in (0, 77, 399):
        apart = np.sqrt(((small - small[q]) ** 2).sum(1))
        assert sorted(s for (a, _), s in scores.items() if a == q) == pytest.approx([s * 1e200 for s in sorted(np.delete(apart, q))[:3]], rel=1e-9)


def test_error_bounds_hold_and_prune():
    rows = np.array([v for _, v, _ in _vectors(3_000, 64, 9)])
    centres = binary_codes.fit_centres(rows)
    codes, asked = binary_codes.encode(rows, centres, 31), binary_codes.ask(np.arange(50), rows[:50], centres, 31)
    low, high = binary_codes.bounds(asked, slice(0, 50), codes, binary_codes.WIDTH)
    true = ((rows[:50, None] - rows) ** 2).sum(2)
    assert (true >= low).mean() > 0.985 and (true <= high).mean() > 0.985
    best = binary_codes.Best(np.full((50, 10), np.inf), np.full((50, 10), 1 << 60))
    assert binary_codes.search_chunk(asked, best, np.arange(3_000), rows, codes, binary_codes.WIDTH) < 0.5 * 50 * 3_000


@pytest.mark.parametrize(("dim", "most", "steep"), [(64, 32, 1), (200, 12, 4), (20, 32, 1), (33, 32, 3), (5, 1, 0)])
def test_jacobi_davidson(dim, most, steep):
    q = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    values = 50 * np.exp(-2 * steep * np.arange(dim) / dim)
    values[2:4] = values[2]  # a repeated eigenvalue
    matrix = (q * values) @ q.T
    found = whitening.jacobi_davidson(lambda y: matrix @ y, dim, most)
    assert np.allclose(found.values, np.sort(values)[::-1][: min(most, dim)], rtol=1e-12)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(min(most, dim)), atol=1e-13)
    assert found.residuals.max() < 1e-12 * values[0]


def _whitened(rows):
    """By the whole covariance and its eigenvectors."""
    kept = [(i, v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([np.float32(v) for _, v in kept], float)).astype(np.int64) + 1_000_000
    n, apart = len(x), len(x) * x - x.sum(0)
    values, vectors = np.linalg.eigh((apart / n).T @ (apart / n) / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    return [i for i, _ in kept], n, (apart**2).sum(1), (apart / n) @ vectors / np.sqrt(values), values / (np.square(apart / n).sum() / n)


@pytest.mark.parametrize(("n", "dim"), [(300, 8), (500, 50)])
def test_whitening(spark, n, dim):
    odd = [(i, v, x) for i, v, x in ODD if v is None or len(v) != 8]
    some = [(i, v if v is None else v * (dim // 8), x) for i, v, x in ODD[3:6]]
    rows = [*_vectors(n, dim, n), *odd, *some, (None, [2.0] * dim, None), *_vectors(n, dim, n)[:4], (9_000_000, [1.0] * (dim + 1), "longer")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(3)).toPandas()
    ids, count, deviation, white, explained = _whitened([r for r in rows if r[1] is None or len(r[1]) == dim])
    size = white.shape[1]
    assert len(got) == count * size and set(got.n) == {count}
    order = np.argsort([-1 if i is None else i for i in ids], kind="stable")
    got = got.assign(vec_id=got.vec_id.fillna(-1), row=np.arange(len(got)) // size).sort_values(["vec_id", "row", "component"], kind="stable")
    assert got.deviation.to_numpy()[::size].tolist() == deviation[order].tolist()
    mine = got.whitened.to_numpy().reshape(-1, size)
    want = white[order] * np.sign((white[order] * mine).sum(0))
    assert np.abs(mine - want).max() < 1e-9
    assert np.allclose(got.explained.to_numpy()[:size], explained, rtol=1e-10)
    assert got.identity_error.max() < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_whitening_of_flat_and_large_vectors(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1} and abs(got.explained[0] - 1) < 1e-12
    large = [(i, [1e30 * (i % 2), float(i % 7), -1e300]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).toPandas()
    assert np.isfinite(got.whitened).all() and (got.deviation > 0).all()
