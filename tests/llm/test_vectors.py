"""Clustering, neighbours and whitening against plain versions."""

import hashlib

import numpy as np
import pytest

from logsluice.llm import clustering, neighbours, vectors, whitening
from logsluice.llm.common import materialize

SCHEMA = "vec_id long, embedding array<double>, v string, uid long, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], "x", 1, 2) for i, x in rows], SCHEMA)


def odd(dim):
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    return [(700, None), (701, [None] + [1.0] * (dim - 1)), (702, [nan] * dim), (703, [1.0] * (dim - 1) + [-inf]), (704, [])]


def test_annulus_search_is_exact():
    rng = np.random.default_rng(1)
    pruned = 0
    for trial in range(120):
        d, n, k = (int(rng.integers(1, x)) for x in (9, 80, 30))
        big = [3, 40, 10**6, 1 << 30, 1 << 70][trial % 5]
        spread = rng.choice([1, big], (n + k, 1))  # many of one norm, some far away
        both = [[int(v) * int(s) for v in row] for row, (s,) in zip(rng.integers(-3, 4, (n + k, d)).tolist(), spread.tolist(), strict=True)]
        x, cs = both[:n], both[n:]
        who, best, compared = clustering.nearest(np.array(x, np.float64), cs)
        for i, v in enumerate(x):
            v = [int(float(y)) for y in v]
            apart = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cs]
            assert int(best[i]) == min(apart) and who[i] == apart.index(min(apart))
        pruned += n * k - compared
    assert pruned > 0


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, [int(np.floor(scale * y)) for y in x]) for i, x in rows if x is not None and len(x) == dims and all(y is not None and np.isfinite(y) for y in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", r[1]))
    cs = [x for _, x in order[:k]]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((apart(x, c), j) for j, c in enumerate(cs)) for _, x in kept]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cs)):
            mine = [x for (_, x), (_, at) in zip(kept, got, strict=True) if at == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    per = {j: sum(d for d, at in got if at == j) for j in range(len(cs))}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got, strict=True)), key=str)


@pytest.mark.parametrize("many", [3, 260])
def test_clusters(spark, many):
    rng = np.random.default_rng(many)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 5])).tolist()) for i in range(many)] + odd(6) + [(800, [1.0] * 5)]
    rows += [(i, [0.5] * 6) for i in range(900, 900 + many)] + [(5, [0.25] * 6), (5, [0.25] * 6), (None, [-3.0] * 6)]  # a group of copies, an id of several rows
    got = clustering.clustered(frame(spark, rows).repartition(5), k=7, rounds=3, scale=64, dims=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 7, 3, 64, 6)


def test_clusters_of_large_numbers_and_of_none(spark):
    rows = [(i, [float(10 ** (3 * i)), -1.0]) for i in range(8)]
    got = clustering.clustered(frame(spark, rows), k=3, dims=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(*r[:2], *(min(v, (1 << 63) - 1) for v in r[2:5]), r[5]) for r in plain_clusters(rows, 3, 3, 64, 2)]
    none = clustering.clustered(frame(spark, odd(64)))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_neighbours(rows, k, every):
    kept = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q % every == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for b, (i, y) in enumerate(kept) if b != a and len(y) == len(x))
            out += [(q, n, i, d) for n, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_exact_neighbours_with_ties_copies_and_shared_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-1, 2, 3).tolist()) for i in range(60)]  # a grid: many equal distances and equal vectors
    rows += [(10, [1, 1, 1]), (10, [1, 1, 1]), (20, [0, 0, 0]), (30, None), (None, [1, 1, 1]), (40, [1, 2]), (50, [2, 1]), (61, [2, 2]), (70, [5.0]), *odd(3)]
    got = neighbours.neighbours(frame(spark, rows).repartition(4), k=4, every=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    # grids this small are found whole: probes are fitted to 0.97 of the neighbours, and ties let ids differ only where a bucket was not probed
    want = plain_neighbours(rows, 4, 10)
    have = sorted(tuple(r) for r in got.collect())
    assert [r[:2] for r in have] == [r[:2] for r in want]
    assert sum(a == b for a, b in zip(have, want, strict=True)) >= 0.9 * len(want)
    every = vectors.usable(frame(spark, rows), "vec_id", "embedding").where("id IS NOT NULL AND exists(v, x -> x <> 0)").coalesce(1).selectExpr("monotonically_increasing_id() AS uid", "*")
    every, asked = materialize(every, "every"), materialize(every.where("id % 10 = 0"), "asked")
    found = neighbours._best(neighbours._exact(every, asked, 4), 4).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in found.collect()) == want


def test_no_neighbours(spark):
    assert neighbours.neighbours(frame(spark, odd(4))).count() == 0
    assert neighbours.neighbours(frame(spark, [(100, [1.0, 2.0])])).count() == 0
    got = neighbours.neighbours(frame(spark, [(100, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [1.0, 2.5]), (1, [1.0])])).collect()
    assert [tuple(r) for r in got] == [(100, 1, 7, 0.0), (100, 2, 3, 0.5)]


@pytest.mark.parametrize("axes", [1, 2])
def test_probes_and_buckets_agree(axes):
    """The first bucket a query probes is the one it would be stored in, probes are all buckets once, and turns keep lengths."""
    rng = np.random.default_rng(5)
    for dim in (1, 3, 8, 20):
        t = neighbours.Tables(dim, axes)
        x = neighbours._unit(rng.normal(size=(30, dim)))
        for table in range(neighbours.TABLES):
            probes = t.probed(x, table, t.buckets)
            assert (probes[:, 0] == t.bucket(x, table)).all() and (np.sort(probes, axis=1) == np.arange(t.buckets)).all()
            assert np.allclose((t.turned(x, table, 0)[:, : t.size] ** 2).sum(1), 1)


def test_recall_on_a_hot_cluster(spark):
    """A third of all rows are near copies of one vector, and a third of those are equal."""
    rng = np.random.default_rng(7)
    base, n = rng.normal(size=16), 3000
    rows = []
    for i in range(n):
        x = rng.normal(size=16) if i % 3 else base + (0 if i % 9 else 0.01 * rng.normal(size=16))
        rows.append((i, x.tolist()))
    got = [tuple(r) for r in neighbours.neighbours(frame(spark, rows).repartition(6), every=30).collect()]
    want = plain_neighbours(rows, 10, 30)
    assert sorted(r[:2] for r in got) == [r[:2] for r in want]
    pairs = {(q, i) for q, _, i, _ in want}
    assert sum((q, i) in pairs for q, _, i, _ in got) >= 0.9 * len(want)


def test_two_axes_find_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CROWDED", 4)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1600)]
    df = frame(spark, rows)
    seen = []
    fit = neighbours.fitted
    monkeypatch.setattr(neighbours, "fitted", lambda *a: seen.append(fit(*a)) or seen[-1])
    got = [tuple(r) for r in neighbours.neighbours(df, every=20).collect()]
    assert seen[0][0] == {8: 2} and seen[0][1][8] <= neighbours.MOST_PROBES
    pairs = {(q, i) for q, _, i, _ in plain_neighbours(rows, 10, 20)}
    assert sum((q, i) in pairs for q, _, i, _ in got) >= 0.9 * len(pairs) and len(got) == len(pairs)


def plain_whitening(rows, k, dim):
    kept = [(i, [int(np.floor(1024 * y)) + 100_000 for y in x]) for i, x in rows if x is not None and len(x) == dim and all(y is not None and np.isfinite(y) for y in x)]
    n = len(kept)
    s = [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    d = [[n * a - b for a, b in zip(x, s, strict=True)] for _, x in kept]
    c = np.array([[y / n for y in row] for row in d])
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    known = values > 1e-12 * max((c * c).sum() / n, 1e-300)
    z = c @ vectors_[:, known] / np.sqrt(values[known])
    return [i for i, _ in kept], n, [sum(y * y for y in row) for row in d], z, values[known] / ((c * c).sum() / n)


@pytest.mark.parametrize(("dim", "decay", "passes"), [(5, 0.5, "all"), (40, 0.8, "few"), (40, 0.999, "all")])
def test_whitening(spark, dim, decay, passes):
    rng = np.random.default_rng(dim)
    mix = np.linalg.qr(rng.normal(size=(dim, dim)))[0] * decay ** np.arange(dim)[:, None]
    if passes == "few":
        mix[8:] = 0  # eight directions and the rounding to whole numbers
    rows = [(i, (rng.normal(size=dim) @ mix * 3 + 1).tolist()) for i in range(400)] + [(None, [1.0] * dim), (7, [0.5] * dim), (7, [0.5] * dim), *odd(dim)]
    df = frame(spark, rows).repartition(5)
    ids, n, dev, z, explained = plain_whitening(rows, 8, dim)
    got = whitening.whitened(df).collect()
    assert len(got) == len(ids) * z.shape[1]
    want = {}
    for i, d, row in zip(ids, dev, z, strict=True):
        want.setdefault((i, d), row)
    signs = {}
    for r in got:
        j = r["component"] - 1
        value = want[r["vec_id"], r["deviation"]][j]
        signs.setdefault(j, np.sign(value * r["whitened"])) if abs(value) > 1e-3 else None
        assert r["n"] == n and abs(r["whitened"] - signs.get(j, 1) * value) < 1e-8 and abs(r["explained"] / explained[j] - 1) < 1e-9 and r["identity_error"] < 1e-9
    blocks = vectors.packed(vectors.usable(df, "vec_id", "embedding").where("size(v) > 0"), 1024)
    sums = [sum(int(np.floor(1024 * x[j])) + 100_000 for _, x in rows if x and None not in x and np.isfinite(x).all()) for j in range(dim)]
    _, _, _, widths = whitening.components(blocks, 100_000, n, sums, 8)
    assert (widths[-1] == dim) == (passes == "all") and len(widths) <= whitening.POWER_PASSES + 1


def test_whitening_without_variance(spark):
    assert whitening.whitened(frame(spark, odd(3))).count() == 0
    assert whitening.whitened(frame(spark, [(1, [0.5, 0.5])])).count() == 0
    line = [(i, [0.5 * i, 0.5 * i, 1.0]) for i in range(9)]
    got = whitening.whitened(frame(spark, line + [(100 + i, [float(i % 4)]) for i in range(8)])).collect()
    assert {(r["component"], r["n"]) for r in got} == {(1, 9), (1, 8)}
    assert all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    huge = whitening.whitened(frame(spark, [(i, [float(10**i), 1.0]) for i in range(0, 40, 4)])).collect()
    assert len(huge) == 10 and max(r["deviation"] for r in huge) == (1 << 63) - 1


def test_sums_are_exact(spark):
    rows = [(i % 3, i, [str(10**30 + i), str(-i)]) for i in range(500)]
    got = vectors.added(spark.createDataFrame(rows, "slot int, part long, values array<string>"), "string").collect()
    assert {r["slot"]: [int(v) for v in r["values"]] for r in got} == {s: [sum(10**30 + i for i in range(s, 500, 3)), -sum(range(s, 500, 3))] for s in range(3)}
