import numpy as np
import hashlib
import re

import pytest

from panelwright.llm import decontamination as dc, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if t else []


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for item, q in items:
            v = fold(q)
            k = min(window, len(v))
            for a in range(len(v) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps for long"), (2, "Short: item!"), (3, ""), (4, None), (5, "Ünïcode wörds Ärger"), (6, "short item")]
DOCS = [(1, "so THE quick, brown fox jumps over the lazy dog and it"), (2, "nothing here"), (3, None), (4, ""), (5, "a short\nitem and a short-item"), (6, "ünïcode wörds Ärger x"), (7, "Ünïcode wörds Ärger x"), (8, "quick brown fox jumps over the lazy dog and then it sleeps for long " * 3), (8, "again short item"), (None, "short item"), ((1 << 53) + 1, "short item " * 3), ((1 << 63) - 1, "x " * 30_000 + "short item")]


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, limit):
    docs = spark.createDataFrame([(a, b, 0) for a, b in DOCS], "doc_id bigint, text string, n_hit int")
    items = spark.createDataFrame([*ITEMS, (None, "nothing here")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in dc.scan(docs, items, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(DOCS, ITEMS)
    spans = {r.doc_id: r.spans for r in dc.scan(docs, items, broadcast_bytes=limit).where("doc_id in (1, 5)").collect()}
    assert spans == {1: [[1, 11]], 5: [[1, 3], [5, 7]]}
    assert dc.scan(docs.where("false"), items, broadcast_bytes=limit).count() == 0
    assert dc.scan(docs, items.where("false"), broadcast_bytes=limit).where("n_hit > 0").count() == 0


def test_dropping(spark, monkeypatch):
    docs = spark.createDataFrame([(a, b, 0) for a, b in DOCS], "doc_id bigint, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted([str(i) for i, _, n, _ in brute(DOCS, ITEMS) if n == 0])
    for limit in (dc.BROADCAST_BYTES, 0):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
        kept = dc.drop_contaminated(docs, items)
        assert sorted(str(r.doc_id) for r in kept.collect()) == want and kept.columns == docs.columns


def test_query_digest(spark, sf):
    from panelwright.llm.entries import op8_decontamination

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    some = [r for r in op8_decontamination(spark, sf).collect() if r.contaminated][:3]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in some:
        (_, n, hit, found), = brute([(r.doc_id, text[r.doc_id])], [(x.item_id, x.text) for x in items])
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found)) and r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_license_scan(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    pad = " ".join(f"word{i}" for i in range(60))
    near = apache.replace("with the License.", "with this licence.")
    rows = [(1, f"{pad} {mit} {pad}"), (2, f"{pad}\n{near}\n{pad}"), (3, pad), (4, None), (5, ""), (6, mit.upper()), (1, f"{pad} {mit} {pad}"), (7, f"{mit} {pad} {mit}"), (8, "Licensed under the Apache")]
    got = licenses.scan(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id bigint, text string, matches int")).collect()
    by = {r.doc_id: [(m.template, m.word) for m in r.matches] for r in got}
    assert len(got) == 9 and by[1] == [("MIT", 60)] and by[3] == by[4] == by[5] == by[8] == [] and by[6] == [("MIT", 0)] and by[7] == [("MIT", 0), ("MIT", 65)]
    assert ("Apache-2.0-header", 60) in by[2]
    passes = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), at_once=30).collect()
    assert sorted(map(str, passes)) == sorted(map(str, got))


def test_a_full_license_with_changes_is_found(spark):
    words = licenses.TEMPLATES["MIT-full"].split()
    words[30:32] = ["other", "words", "here"]
    rows = [((1 << 53) + 1, "x " * 500 + " ".join(words) + " y" * 500), (None, "\t".join(words[3:])), ((1 << 63) - 1, " ".join(words[80:]))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, [m.word // 2 for m in r.matches if m.template == "MIT-full"]) for r in got] == [(rows[0][0], [250]), (None, [0]), (rows[2][0], [])]


def test_licenses_in_comments_are_found(spark):
    import textwrap

    long = {n: t for n, t in licenses.TEMPLATES.items() if n in ("MIT-full", "ISC-full", "Apache-2.0-header", "BSD", "MIT-grant")}
    rows = []
    for name, text in long.items():
        for width in (72, 78):
            for mark in ("# ", " * ", "// ", "", ";; ", "-- "):
                lines = [mark + line for line in textwrap.wrap(text, width)]
                rows.append((f"{name}|{width}|{mark}", "\n".join(["x = 1", *lines, "def f(): return 2"])))
    got = {r.doc_id: {m.template for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(got) == 60 and all(key.split("|")[0] in found for key, found in got.items())


def test_probes_lose_nothing(spark):
    """Any text that lacks all probes of a template lacks more than a fifth of its shingles."""
    rng = np.random.default_rng(5)
    for name, text in licenses.TEMPLATES.items():
        words = licenses.words_of(text)
        held = licenses._Templates([(name, text)])
        ((k, probe),) = held.probes.items()
        s = licenses.shingles(words)
        left = ~np.isin(s, probe)
        assert len(np.unique(s[left])) < licenses.CONTAINMENT * len(np.unique(s))
        for _ in range(20):
            some = [w for w in words if rng.random() > 0.1]
            found = held._likely([(0, some)])
            share = len(np.intersect1d(licenses.shingles(some), s)) / len(np.unique(s)) if len(some) >= k else 0
            assert found or share < licenses.CONTAINMENT


def test_each_kind_of_license_line_is_found(spark):
    """The bare notice has fewer words than a shingle; the five kinds are the license lines of the documents."""
    from panelwright.llm.entries import op9_license_scan

    lines = {"All rights reserved.": "ARR-notice", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_license_scan(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    for line, name in lines.items():
        ids = [r.doc_id for r in docs if r.text and line in r.text.split("\n")]
        assert ids and all(name in got[i].licenses.split(",") and got[i].n_matches >= 1 for i in ids)
        held = {r.doc_id for r in docs if r.text and line in r.text}
        assert {i for i, r in got.items() if name in r.licenses.split(",")} <= held
    (r,) = licenses.scan(spark.createDataFrame([(1, "One two three\nAll rights reserved.\nAll rights are reserved.")], "doc_id bigint, text string")).collect()
    assert [(m.template, m.word, m.n_words, m.containment) for m in r.matches] == [("ARR-notice", 3, 3, 1.0)]


def test_license_scan_agrees_with_plain_containment(spark, sf):
    names, sets = zip(*[(n, licenses.shingles(licenses.words_of(t))) for n, t in licenses.TEMPLATES.items()])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: {m.template for m in r.matches} for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        words = licenses.words_of(r.text)
        want = set()
        for n, s in zip(names, sets):
            k, m = min(licenses.SHINGLE, len(licenses.words_of(licenses.TEMPLATES[n]))), len(s)
            for a in range(max(1, len(words) - m - k + 2)):
                if len(set(licenses.shingles(words[a : a + m + k - 1]).tolist()) & set(s.tolist())) / len(set(s.tolist())) >= licenses.CONTAINMENT and len(words) >= k:
                    want.add(n)
                    break
        assert got[r.doc_id] == want


def test_pieces_of_a_long_text_are_its_windows():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 50, 3 * dc.PIECE + 17)]
    text = " ".join(words)
    seen, most = {}, 0
    for piece in dc._pieces([5], [text], [3, 10], 10):
        most = max(most, len(piece["at"]))
        for at, size, h1, h2 in zip(*(piece[c].tolist() for c in ("at", "size", "h1", "h2"))):
            assert (at, size) not in seen
            seen[at, size] = (h1, h2)
    assert most <= dc.PIECE and sorted(seen) == sorted((i, n) for n in (3, 10) for i in range(len(words) - n + 1))
    by_words = {}
    for (at, size), h in seen.items():
        assert by_words.setdefault(tuple(words[at : at + size]), h) == h
    assert len(set(by_words.values())) == len(by_words)
    assert list(dc._pieces([1, 2], [None, ""], None, 10)) == [] and [p["size"].tolist() for p in dc._pieces([1], ["a b"], None, 10)] == [[2]]
