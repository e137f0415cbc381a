"""Centroid clustering and nearest neighbours against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import centroids, neighbours

SCHEMA = "vec_id bigint, embedding array<double>"


def plain_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, [min(max(int(np.floor(scale * v)), -centroids.LIMIT), centroids.LIMIT) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [list(x) for _, x in kept[:k]]

    def assign():
        out = []
        for _, x in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(cs)):
            mine = [x for (_, x), (_, c) in zip(kept, got) if c == j]
            if mine:
                cs[j] = [sum(v) // len(mine) for v in zip(*mine)]
    got = assign()
    sums = [sum(d for d, c in got if c == j) for j in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((str(i), c, d, sums[c], sum(sums), sha[c]) for (i, _), (d, c) in zip(kept, got))


def clusters(df, **options):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **options).collect())


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (6, dims))
    rows = [(i, (middle[rng.integers(6)] + rng.normal(0, 0.4, dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are copies
    rows += [(None, rows[1][1]), (5, rows[2][1]), (5, rows[2][1]), (-1, None), (-2, []), (-3, [1.0] * (dims - 1)), (-4, [None] + [1.0] * (dims - 1)), (-5, [float("nan")] * dims), (-6, [float("inf")] * dims), (-7, [0.0] * dims), (-8, [1e300] * dims), (-9, [-0.5 / 64] * dims)]
    return rows


@pytest.mark.parametrize("lead", [1, 5, 12])
def test_clusters_against_brute_force(spark, lead):
    rows = vectors(1, 120, 12)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("x"), "x": F.lit(1)})
    assert clusters(df.repartition(5), k=7, rounds=3, dims=12, lead=lead) == plain_clusters(rows, 7, 3, 12)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [9.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clusters(df, k=16, rounds=3, dims=2) == plain_clusters(rows, 16, 3, 2)  # fewer vectors than centroids, ties, empty centroids
    none = centroids.cluster(df.where("false"), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_filter_is_a_lower_bound_and_saves_distances():
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 200, (16, 64))
    x = np.rint(middle[rng.integers(0, 16, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int64)
    cov = np.cov(x.T)
    values, axes = np.linalg.eigh(cov)
    rotation = centroids.Rotation(x.mean(axis=0), axes[:, np.argsort(-values)], 16)
    lead, rest = rotation(x.astype(float))
    c = np.rint(middle).astype(np.int64)
    c_lead, c_rest = rotation(c.astype(float))
    true = ((x[:, None, :] - c) ** 2).sum(axis=2)
    assert (((lead[:, None] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2 <= true * (1 + 1e-9) + 1e-6).all()
    number, distance, computed = centroids.nearest(x, lead, rest, c, rotation)
    assert (number == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all() and computed < 1.2 * len(x)


def plain_neighbours(rows, k, every):
    good = [(i, np.array(e, float)) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    out = []
    for q, (i, x) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(sum(a * b for a, b in zip(x, y))), j) for r, (j, y) in enumerate(good) if r != q and len(x) == len(y))[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(near, 1)]
    return sorted((i, rank, j, round(-s, 9)) for i, rank, j, s in out)


def test_neighbours_against_brute_force(spark):
    rows = vectors(3, 150, 8) + [(1000 + i, [float(i), 1.0]) for i in range(3)] + [(2000, [1.0, 2.0, 3.0])]
    rows = [(i, e) for i, e in rows if i != -8]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(None).cast("string")})
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, 7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == plain_neighbours(rows, 7, 5)
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 5 == 0, 7).count() == 0
    assert neighbours.nearest(df, F.lit(False), 7).count() == 0


def test_recall_of_the_graph(spark):
    """Vectors of many lengths, one large group of near copies, one of equal ones: well over one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 24)) + 2 * rng.normal(size=(8, 24))[rng.integers(0, 8, 5000)]
    x *= rng.uniform(0.7, 1.3, (5000, 1))
    x[:600] = x[0] + rng.normal(0, 0.01, (600, 24))
    x[600:1200] = x[600]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(8)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    s = x[::20] @ x.T
    s[np.arange(250), np.arange(0, 5000, 20)] = -np.inf
    kth = -np.sort(-s, axis=1)[:, 19]
    found = got.groupby("query_id")["score"].apply(np.array)
    assert len(found) == 250 and all(len(v) == 20 for v in found)
    assert np.mean([(found[20 * i] >= kth[i] - 1e-9).mean() for i in range(250)]) > 0.95
    for r in got.sample(300, random_state=1).itertuples():
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12) and r.query_id != r.vec_id
    copies = got[(got.query_id >= 600) & (got.query_id < 1200)]
    assert (copies.sort_values(["query_id", "rank"]).groupby("query_id")["score"].apply(lambda v: (np.diff(v) <= 0).all())).all()
