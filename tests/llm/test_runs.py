"""Run detection against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import runs


def plain_runs(w, least=6, periods=4):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 9, 200]))}" for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            p = rng.randint(1, 9)
            unit = [f"u{rng.randrange(4)}" for _ in range(p)] * rng.randint(2, 9)
            at = rng.randint(0, len(w))
            w[at:at] = unit[: len(unit) - rng.randint(0, p - 1)]
        out.append(w)
    return out


def test_many_texts_at_once():
    for seed in range(60):
        some = texts(seed, 7)
        words, ids, begin = runs.word_ids([" ".join(w) for w in some])
        low, high, q = runs.runs_of(ids, begin)
        got = list(zip(low.tolist(), (high - low).tolist(), q.tolist()))
        assert got == [(s + int(b), n, p) for w, b in zip(some, begin) for s, n, p in plain_runs(w)]


def test_regular_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    for text in (fib[-1], thue, "ab" * 300, "a" * 500, "aab" * 40 + "aba" * 30, "abcabc" * 9 + "abd" * 8):
        w = list(text)
        ids = np.array([ord(c) for c in w])
        low, high, q = runs.runs_of(ids, np.array([0, len(ids)]))
        assert list(zip(low.tolist(), (high - low).tolist(), q.tolist())) == plain_runs(w)
    low, high, q = runs.runs_of(np.zeros(300_000, np.int64), np.array([0, 300_000]))
    assert (low.tolist(), high.tolist(), q.tolist()) == ([0], [300_000], [1])
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int64), np.array([0, 9]), periods=3)


def test_documents(spark):
    some = [" ".join(w) for w in texts(99, 40)]
    rows = [(i, t) for i, t in enumerate(some)] + [(7, some[7]), (None, "x " * 9), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "é é é é é é\vé"), (1004, "a a " * 12)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id bigint, text string, runs int, n_words string")
    got = sorted((str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.kept) for r in runs.collapsed(df.repartition(4)).collect())
    want = []
    for i, t in rows:
        w = [x for x in (t or "").replace("\v", " ").replace("\t", " ").replace("\n", " ").split(" ") if x]
        found = plain_runs(w)
        want.append((str(i), len(w), found, kept(w, found)))
    assert got == sorted(want)
    assert runs.collapsed(df.where("false")).count() == 0


def test_a_long_text(spark):
    rng = np.random.default_rng(1)
    w = [f"w{k}" for k in rng.integers(0, 5000, 200_000)]
    w[50_000:90_000] = (w[50_000:50_700] * 60)[:40_000]
    (r,) = runs.collapsed(spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string")).collect()
    (x,) = [x for x in r.runs if x.length > 1000]
    assert x.period == 700 and x.start <= 50_000 and x.start + x.length >= 90_000 and r.n_words == 200_000 and len(r.kept.split()) == 200_000 - x.length + 700 - sum(y.length - y.period for y in r.runs if y.length <= 1000)


def test_planted_ends_and_best_run(spark):
    rows = [(i, " ".join(f"t{i}_{j}" for j in range(i % 90))) for i in range(400)] + [(None, "a b"), (3, None), (11, ""), (12, "\n")]
    got = {}
    for r in runs.planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    due = 0
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            due += 1
            assert " ".join(w[j if j < a else a + (j - a) % p] for j in range(n)) in got[i]
        else:
            assert t in got[i]
    assert due > 20
    df = spark.createDataFrame([([(3, 12, 3), (0, 8, 2), (20, 40, 10), (1, 4, 1)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r.b and tuple(r.b) for r in df.select(runs.best_run(F.col("runs")).alias("b")).collect()] == [(3, 12, 3), None]


def test_query_against_brute_force(spark, sf):
    from panelwright.llm.entries import op13_run_detection

    docs = {r.doc_id: (r.text or "") for r in runs.planted(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in op13_run_detection(spark, sf).collect():
        w = [x.decode() for x in docs[r.doc_id].encode().split()]
        if len(w) > 600:
            continue
        found = plain_runs(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, found).encode()).hexdigest()
