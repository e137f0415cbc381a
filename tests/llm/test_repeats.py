import collections

import numpy as np
import pytest

from panelwright.llm import recompression, repeats, suffix_levels


def texts(seed, n=60, words=6):
    """Small alphabets, copies, passages, runs and periods."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(words)]
    out, passage = [], " ".join(rng.choice(vocab, 90))
    for i in range(n):
        body = " ".join(rng.choice(vocab, rng.integers(0, 150)))
        kind = i % 6
        out.append([body, f"{body} {passage} {body[:50]}", out[-1] if out else "", " ".join(["run"] * int(rng.integers(1, 200))), " ".join(["p", "q"] * int(rng.integers(1, 90))), f"{passage} é {passage}"][kind])
    return out


def words_left(rows, window):
    first = {}
    split = [(i, t.encode().split() if t else []) for i, t in rows]
    for i, w in sorted(split, key=lambda x: x[0]):
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def bytes_left(rows, window):
    raw = [(i, t.encode() if t else b"") for i, t in rows]
    seen = collections.Counter(b[a : a + window] for _, b in raw for a in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - window + 1):
            if seen[b[a : a + window]] > 1:
                gone[a : a + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("seed,words", [(0, 2), (1, 6), (2, 500)])
def test_words_against_brute_force(spark, seed, words):
    rows = list(enumerate(texts(seed, words=words)))
    got = recompression.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(words_left(rows, 50))


@pytest.mark.parametrize("seed,words,batches", [(3, 2, 2), (4, 6, 4), (5, 500, 1)])
def test_bytes_against_brute_force(spark, seed, words, batches):
    rows = list(enumerate(texts(seed, words=words)))
    got = suffix_levels.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), batches=batches).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(bytes_left(rows, 200))


def test_parts_of_very_long_texts(spark, monkeypatch):
    """With parts and blocks of a few hundred windows every row is a long one."""
    rows = [(0, "".join(chr(97 + (i * i + i // 7) % 23) for i in range(5000))), (1, "".join(chr(97 + (i * i + i // 7) % 23) for i in range(900, 2500)))]
    for module in (suffix_levels, recompression, repeats):
        monkeypatch.setattr(module, "PART", 300)
    monkeypatch.setattr(recompression, "BLOCK", 500)
    got = suffix_levels.removed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(bytes_left(rows, 200))
    rng = np.random.default_rng(9)
    base = " ".join(rng.choice([f"w{i}" for i in range(40)], 2000))
    rows = [(3, base), (5, base[4000:] + " " + base[:3000]), (7, "lead " + base[1000:5000]), (8, base)]
    got = recompression.removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(words_left(rows, 50))


def test_ids_pass_unchanged(spark):
    long = " ".join(f"x{i}" for i in range(120))
    big, last = (1 << 53) + 1, (1 << 63) - 1
    df = spark.createDataFrame([(big, long), (None, "a b"), (last, long + " y"), (None, long), (None, "z " * 70)], "doc_id bigint, text string").coalesce(1)
    key = lambda r: str(r)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in recompression.removed(df).collect()), key=key)
    assert got == sorted([(big, 120, 0), (None, 2, 0), (last, 121, 120), (None, 120, 120), (None, 70, 0)], key=key)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_levels.removed(df).collect()), key=key)
    n = len(long)
    assert got == sorted([(big, n, n), (None, 3, 0), (last, n + 2, n), (None, n, n), (None, 140, 0)], key=key)


def test_oddities(spark):
    long = " ".join(f"x{i}" for i in range(120))
    rows = [(None, long), (4, long), (4, long), (2, None), (3, ""), (9, long + " tail"), (None, "a b")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, tag int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in recompression.removed(df).collect())
    assert got == [(-1, 0), (-1, 120), (2, 0), (3, 0), (4, 0), (4, 0), (9, 120)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes - r.n_removed) for r in suffix_levels.removed(df).collect())
    assert got == [(-1, 0), (-1, 3), (2, 0), (3, 0), (4, 0), (4, 0), (9, 5)]
    for op in (recompression, suffix_levels):
        assert op.removed(df.where("false")).count() == 0
        assert op.removed(df.where("text is null or doc_id = 3")).count() == 2


def test_equal_windows_give_equal_anchors():
    """Whatever stands around a passage, its windows choose the same symbols."""
    rng = np.random.default_rng(0)
    core = rng.integers(1, 40, 120)
    found = []
    for trial in range(20):
        left, right = (rng.integers(1, 40, rng.integers(0, 90)) for _ in range(2))
        words = np.concatenate((left, core, right))
        block = recompression.Block.of_words(np.array([trial]), np.array([len(words)]), 50, words)
        names = words.copy()
        for k, kind in enumerate(recompression.ROUNDS, 1):
            block.replace(kind, k, np.arange(len(block.asks(kind, k)[0])) if trial % 2 else None)
        chosen = {int(s): (int(names[s]), int(s) - len(left)) for s in np.flatnonzero(block.live)}
        for first, count, anchor, source in zip(block.first, block.count, block.anchor, block.source):
            chosen.update({int(s): (int(anchor), int(source) - len(left)) for s in range(first, first + count)})
        found.append([chosen[len(left) + s] for s in range(120 - 50 + 1)])
    assert all(f == found[0] for f in found)
    assert len({name for name, _ in found[0] if name < 0}) >= 2 and len(set(found[0])) < 35  # high symbols, each for many windows


def test_what_one_document_has_drops_out():
    words = np.arange(1, 201)
    block = recompression.Block.of_words(np.array([7]), np.array([200]), 50, words)
    names, several = block.asks("pair", 1)
    assert len(names) > 20 and not several.any()
    block.replace("pair", 1, np.empty(0, np.int64))
    assert not block.live.any() and (block.name == 0).all()


def test_hash_pairs_are_polynomials():
    rng = np.random.default_rng(1)
    for top in (300, repeats.PRIME):
        unit = rng.integers(0, top, 20_000, dtype=np.uint64)
        start = rng.integers(0, 19_000, 20)
        for base, got in zip(repeats._POINTS, repeats.RangeHash(unit)(start, start + 70)):
            for s, h in zip(start.tolist(), got.tolist()):
                assert h == sum(int(u) * pow(base, j, repeats.PRIME) for j, u in enumerate(unit[s : s + 70])) % repeats.PRIME


def test_level_family_merges_geometrically(spark):
    family = suffix_levels.LevelFamily()
    for b in [[1, 2], [3, 2], [4, 5], [5, 6], [7, 7], [1, 8]]:
        family.add(spark.createDataFrame([(bytes([x]) * 9,) for x in b], "suffix binary"))
    assert [s for s, _ in family.levels] == [4, 1, 1]
    assert {r.suffix[0] for r in family.matches().collect()} == {2, 5, 7, 1}
    places = {r.suffix[0]: r.places for r in family.levels[0][1].collect()}
    assert places == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1}
    plan = family.levels[0][1].join(family.levels[1][1].hint("merge"), "suffix")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan  # levels meet by a merge scan of their files
    family.close()


def test_an_open_family_meets_later_batches(spark):
    family = suffix_levels.LevelFamily()
    text = bytes(np.random.default_rng(3).integers(97, 123, 900, dtype=np.uint8)).decode()
    suffix_levels.repeated_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), batches=1, family=family)
    before = family.matches().count()
    suffix_levels.repeated_spans(spark.createDataFrame([(2, text)], "doc_id bigint, text string"), batches=1, family=family)
    assert before == 0 and family.matches().count() > 0 and [s for s, _ in family.levels] == [1, 1]
    family.close()


def test_calls_with_one_family_are_as_one_call(spark):
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    a, b, c = word(700), word(300), word(250)
    calls = [[(1, a + word(80)), (2, word(400)), (None, None)], [(3, word(50) + a), (4, b + word(30) + b)], [(5, c), (6, word(90) + b), (7, a[100:500]), (8, "é" * 150 + c)]]
    schema = "doc_id bigint, text string"
    spans = lambda df: sorted((str(r.doc_id), r.text, r.spans) for r in df.collect())
    family = suffix_levels.LevelFamily()
    for k in range(3):
        got = suffix_levels.repeated_spans(spark.createDataFrame(calls[k], schema), batches=1 + k, family=family)
        so_far = [row for call in calls[: k + 1] for row in call]
        assert spans(got) == spans(suffix_levels.repeated_spans(spark.createDataFrame(so_far, schema)))
    family.close()


def test_query_merges_levels(spark, sf, monkeypatch):
    from panelwright.llm.entries import op7_suffix_dedup

    sizes = []
    close = suffix_levels.LevelFamily.close
    monkeypatch.setattr(suffix_levels.LevelFamily, "close", lambda self: (sizes.append([s for s, _ in self.levels]), close(self)))
    op7_suffix_dedup(spark, sf)
    assert sizes == [[2, 1, 1]]
