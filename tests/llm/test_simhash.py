import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import graph, simhash


def plain(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAÉ \t\n.,", max_size=400))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_of_long_and_missing_texts():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def classes(fps):
    lab = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    while True:
        new = np.array([lab[row].min() for row in near])
        if (new == lab).all():
            return lab
        lab = new


def planted(n, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for i in range(n // 2, n):
        fps[i] = fps[rng.integers(0, i)]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(fps)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def components_of(spark, fps):
    ids = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "__fp long")
    names = {r.node: r.root for r in graph.components(simhash.linked(ids)).collect()}
    return [names.get(int(x), int(x)) for x in fps.view(np.int64)]


def test_index_loses_no_link(spark):
    fps = planted(600, 1)
    assert same_partition(components_of(spark, fps), classes(fps).tolist())


def test_large_groups_are_divided_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate((planted(100, 3), np.uint64(0xABCD << 48) ^ rng.integers(0, 1 << 40, 200, dtype=np.uint64), np.array([sum(1 << int(b) for b in rng.choice(24, 4)) for _ in range(150)], np.uint64))))
    assert same_partition(components_of(spark, fps), classes(fps).tolist())


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and got[7000] == got[7001]
    assert 5000 not in got and len(set(got.values())) == 3
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_every_oddity(spark):
    rows = [(5, "One two three four"), (3, "one TWO three  four"), (9, None), (8, ""), (None, "lonely words here now"), (None, "other words that differ a lot"), (5, "One two three four"), (11, "word " * 30_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8 and {r.doc_id: r.component_id for r in got if r.doc_id} == {5: 3, 3: 3, 9: 8, 8: 8, 11: 11}
    assert {r.fingerprint for r in got if r.doc_id in (8, 9)} == {"0" * 16}
    kept = simhash.keep_one(df)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 8, 11] and kept.columns == df.columns
    assert simhash.keep_one(df.where("false")).count() == 0 == simhash.near_duplicates(df.where("false")).count()


def test_query_against_brute_force(spark, sf):
    from panelwright.llm.entries import op2_simhash_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fps = np.array([plain(t) for t in docs.text], np.uint64)
    lab = classes(fps)
    least = {k: docs.doc_id[lab == k].min() for k in set(lab)}
    got = op2_simhash_dedup(spark, sf).toPandas().set_index("doc_id")
    for i, d in enumerate(docs.doc_id):
        assert got.fingerprint[d] == f"{fps[i]:016x}" and got.component_id[d] == least[lab[i]]
