import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import lattice


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 3, (500, 8))
    y = lattice.decode_e8(x)
    d = ((x - y) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    for r in lattice.ROOTS:
        assert (d <= ((x - y - r) ** 2).sum(axis=1) + 1e-9).all()
    twice = np.rint(y * 2)
    assert (np.ptp(twice % 2, axis=1) == 0).all() and (y.sum(axis=1) % 2 < 1e-9).all()


def test_roots():
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)


def cloud(seed, n=500):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, n // 2 if i % 3 else 5)]
        x[i] += rng.normal(size=24) * rng.uniform(0, 0.16) * np.linalg.norm(x[i]) / np.sqrt(24) if i % 7 else 0
    return x.astype(np.float32), rng.integers(0, 3, n // 2).tolist()


def brute(rows, cosine=0.98):
    n = len(rows)
    unit = [None] * n
    for i, (_, e, l) in enumerate(rows):
        if l is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            v = np.array(e, float)
            unit[i] = v / np.linalg.norm(v)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    lab = [r[0] for r in rows]
    while True:
        new = [min([lab[i], *(lab[j] for j in link[i])]) if lab[i] is not None else None for i in range(n)]
        if new == lab:
            return sorted(((r[0], len(link[i]), lab[i], r[0] == lab[i]) for i, r in enumerate(rows)), key=str)
        lab = new


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("seed,limit", [(0, 1024), (1, 16)])
def test_against_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(lattice, "CELL_ROWS", limit)
    x, labels = cloud(seed)
    rows = [(i, v.tolist(), (labels * 2)[i] if i % 3 else 0) for i, v in enumerate(x)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = brute(rows)
    links = sum(w[1] for w in want)
    assert links > 300 and sum(g[1] for g in got) >= 0.99 * links
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.97 and all(g[1] <= w[1] for g, w in zip(got, want))


def cell(unit, side=None):
    """Rows that share one group, at home in it, and no other."""
    n = len(unit)
    lists = [[7, 1000 + i] for i in range(n)]
    side = np.zeros(n, int) if side is None else np.array(side)
    return pa.table({"__g": [1] * n, "gid": [7] * n, "side": side, "node": np.arange(n) + 100, "mult": [1] * n, "label": ["a"] * n, "vec": [list(u) for u in unit], "gids": lists, "homes": [[True, True]] * n})


def roots(table):
    node = table.column("node").to_pylist()
    found = {n: i for i, n in enumerate(node)}
    root = np.arange(len(node))
    part = lattice._links(table, 0.98)
    for a, b in zip(part.column("node").to_pylist(), part.column("root").to_pylist()):
        root[found[a]] = found[b]
    return root.tolist()


def star(leaves):
    """Leaves, which link with the hub alone, then the hub."""
    x = np.vstack([np.eye(leaves, leaves + 1) * 0.17, np.zeros((1, leaves + 1))])
    x[:, -1] = 1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chain(order):
    a = 0.15 * np.asarray(order, float)
    return np.column_stack([np.cos(a), np.sin(a)])


@pytest.mark.parametrize("leaves", [2, 9, 400])
def test_a_hub_after_its_leaves_joins_them_all(leaves):
    x = star(leaves)
    assert (x[:-1] @ x[-1] >= 0.98).all() and (x[:2] @ x[1])[0] < 0.98
    assert roots(cell(x)) == [0] * (leaves + 1)


def test_chains_in_any_order_are_one_set():
    rng = np.random.default_rng(0)
    for n in (3, 20, 40):
        for _ in range(20):
            assert roots(cell(chain(rng.permutation(n)))) == [0] * n
    two = np.vstack([np.c_[chain([0, 2, 1]), np.zeros((3, 2))], np.c_[np.zeros((3, 2)), chain([1, 0, 2])]])
    assert roots(cell(two)) == [0, 0, 0, 3, 3, 3]
    assert roots(cell(chain([0, 2, 1]), [0, 0, 1])) == [0, 0, 0]  # two chunks: the last row is the other side


def test_components_of_stars_and_chains(spark):
    """Ids and links of the whole operator, exactly."""
    rng = np.random.default_rng(5)
    rows = []
    for label in range(40):
        q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
        x = star(6) @ q[:7] if label % 2 else chain(rng.permutation(5)) @ q[:2]
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(x)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_oddities(spark):
    v = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    rows = [(5, v, 1), (2, v, 1), (2, v, 1), (7, [x * 1e-20 for x in v], 1), (8, v, 2), (9, v, None), (10, None, 1), (11, [], 1), (12, [0.0] * 9, 1), (13, [float("nan")] + v[1:], 1), (14, [None] + v[1:], 1), (15, [float("inf")] + v[1:], 1), (16, [1.0, 2.0], 1), (17, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link(df).collect()), key=str)
    assert got == brute(rows)
    assert lattice.link(df.where("false")).count() == 0


def test_labels_of_any_type(spark):
    v, w = [0.1, 0.2, 0.3], [0.3, -0.2, 0.1]
    for kind, labels in (("string", ["x", "y", "x", "y", None]), ("bigint", [1 << 40, 2, 1 << 40, 2, None]), ("binary", [b"x", b"y", b"x", b"y", None])):
        rows = [(i, e, l) for i, (e, l) in enumerate(zip([v, w, [2 * a for a in v], w, v], labels))]
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link(spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>, label {kind}")).collect()), key=str)
        assert got == brute(rows), kind


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_at_the_threshold(dim):
    """Pairs exactly at the cosine share a cell with one of them at home."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 2000, dim))
    a = lattice.unit_rows(a)
    b = lattice.unit_rows(b - (a * b).sum(axis=1)[:, None] * a)
    ca, cb = lattice.cells(a), lattice.cells(0.98 * a + np.sqrt(1 - 0.98**2) * b)
    assert ((ca[:, :, :1] == cb) | (cb[:, :, :1] == ca)).any(axis=(1, 2)).mean() > 0.998


def test_query_recall(spark):
    from panelwright.llm.entries import SQL, op10_lattice_dedup
    import duckdb

    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = con.execute(SQL["op10_lattice_dedup"]).df().set_index("vec_id").sort_index()
    got = op10_lattice_dedup(spark, d).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == want.n_links).mean() > 0.99 and (got.component_id == want.component_id).mean() > 0.99
