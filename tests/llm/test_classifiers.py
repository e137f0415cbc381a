import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import quality, toxicity


def docs(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9))) for _ in range(3000)]
    insults = ["blorgface", "snivelrat"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, rng.integers(20, 120)))
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            w = insults[i % 2]
            words.insert(int(rng.integers(0, len(words))), w if i % 3 else w[:4] + "x" + w[4:])
        if poor:
            words = [w + "%%%" for w in words]
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_ordinal_model_recovers_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    z = x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000)
    m = quality.CumulativeLink.fit(x.astype(np.float32), np.digitize(z, [-1.0, 1.5]), steps=800, l2=0.0)
    np.testing.assert_allclose(m.weights, [2, -1, 0], atol=0.2)
    np.testing.assert_allclose(m.thresholds, [-1, 1.5], atol=0.2)


def test_quality_on_held_out_rows(spark):
    d, l = docs(spark)
    model = quality.fit(d, quality.grades_of(l))
    got = quality.score(d, model).join(l, "doc_id").withColumn("h", quality.held_out()).where("h").toPandas()
    p = np.stack(got.p_grade)
    assert ((p[:, 0] >= 0.5) == (got.quality == 1)).mean() > 0.97 and (p[:, 0] >= p[:, 1]).all()
    kept = {r.doc_id for r in quality.accept(d, model).collect()}
    assert len(kept & set(range(0, 400, 7))) <= 2 and len(kept) > 335


def test_quality_oddities(spark):
    d, l = docs(spark, 60)
    odd = spark.createDataFrame([(None, None, 1.0), (7, "", 1.0), (7, "", 1.0), (8, "word " * 40_000, 1.0)], "doc_id bigint, text string, expected_grade double")
    model = quality.fit(d, quality.grades_of(l.union(spark.createDataFrame([(None, 1, 1), (1, None, 0), (2, 0, None)], l.schema))))
    assert quality.score(odd, model).where("expected_grade between 0 and 2").count() == 4
    assert quality.score(odd.where("false"), model).count() == 0
    empty = quality.fit(d, quality.grades_of(l.where("false")))
    assert quality.accept(d, empty).count() == 60


def test_one_text_of_an_id_whatever_the_order(spark):
    some = spark.createDataFrame([(1, 2), (2, 0)], "doc_id bigint, grade int")
    rows = [(1, "b"), (1, "a"), (2, None), (2, "c"), (3, "d")]
    for r in (rows, rows[::-1]):
        got = quality.one_text_each(spark.createDataFrame(r, "doc_id bigint, text string"), some)
        assert sorted((x.doc_id, x.text) for x in got.collect()) == [(1, "a"), (2, "c")]
    held = spark.createDataFrame([(None,), (7,)], "doc_id bigint").select(quality.held_out().alias("h")).collect()
    assert all(r.h is not None for r in held)


def by_hand(s, t):
    """The kernel from its definition: letters in order, five positions at most, DECAY a skipped letter."""

    def table(words):
        found = {}
        for w in words:
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(w))):
                        key = w[i] + w[j] + w[k]
                        found[key] = found.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        return found

    def size(words):  # repeats left aside
        return sum(toxicity.DECAY ** (2 * (j - 2)) * (j - 1) * max(len(w) - j, 0) for w in words for j in range(2, toxicity.SPAN)) ** 0.5

    a, b = table(s), table(t)
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / size(s) / size(t)


def test_kernel_is_the_subsequence_kernel():
    phrases = [["you", "idiot"], ["the", "quick", "brown", "fox"], ["idxiot"], ["banana"], ["what", "a", "clown"]]
    marks = ["idiot", "clown", "brow", "nana"]
    want = [[by_hand(p, [m]) for m in marks] for p in phrases]
    np.testing.assert_allclose(toxicity.kernel(phrases, marks), want, atol=0.06)  # but for slots that two subsequences share


def test_kernel_tolerates_gaps():
    k = toxicity.kernel([["idiot"], ["idxiot"], ["iidiot"], ["garden"], ["tiodi"]], ["idiot"])[:, 0]
    assert k[0] > 0.9 and k[1] > 0.5 and k[2] > 0.5 and k[3] < 0.1 and k[4] < 0.5


def test_machine_against_the_kernel_machine():
    """With every training phrase a landmark, the machine is the kernel machine: the same values from the kernel matrix alone."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(60)]
    y = np.where(np.arange(60) < 20, 1.0, -1.0)
    words[:20] = [w[:3] + "zyx" + w[3:] for w in words[:20]]
    gram = toxicity.kernel([[w] for w in words], words)
    gram = (gram + gram.T) / 2
    value, vector = np.linalg.eigh(gram)
    ok = value > 1e-9 * value.max()
    x = gram @ (vector[:, ok] / np.sqrt(value[ok]))
    weight = np.full(60, 1 / 60)
    w = toxicity._svm(x, y, weight, l2=1e-3)
    # by hand: minimise l2 |f|^2 / 2 + sum weight max(0, 1 - y (K a + b))^2 / 2 by plain gradient steps over a and b
    a, b, step = np.zeros(60), 0.0, 0.3
    for _ in range(60_000):
        f = gram @ a + b
        slack = np.maximum(0, 1 - y * f) * y * weight
        a -= step * (1e-3 * a - slack)
        b -= step * (1e-8 * b - slack.sum())
    np.testing.assert_allclose(x @ w[:-1] + w[-1], gram @ a + b, atol=0.02)


def test_units():
    assert toxicity.units("You i d i o t, i-d.i!o*t É!") == ["you", "idiot", "idiot", "é"]
    assert toxicity.units(None) == toxicity.units("") == toxicity.units("12 !!") == []


def test_long_units_are_cut_and_unicode_spaces_part_words():
    text = "".join(chr(97 + i * 7 % 26) for i in range(200))
    got = toxicity.units(text)
    assert all(len(u) == 12 for u in got) and got[0] == text[:12] and got[-1] == text[-12:]
    assert all(any(text[i : i + 10] in u for u in got) for i in range(191))
    assert toxicity.units("ab " + "x" * 64 + " cd") == ["ab", "x" * 64, "cd"]
    assert toxicity.units("ab " + "x" * 65 + " cd") == ["ab", *["x" * 12] * 19, "cd"]
    assert toxicity.units("one\u3000two\u2003three\u2019s \u201cfour\u201d") == ["one", "two", "threes", "four"]
    assert set(toxicity.units("x " * 500)) == {"x" * 12}


def test_an_insult_inside_a_long_run_counts_as_in_a_short_one(spark):
    d, l = docs(spark, 600, 1)
    model = toxicity.fit(d, l)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("wzkqjy"), 5)) for _ in range(40)]
    for n in (0, 10, 20, 39):
        run = [*words[:n], "blorgface", *words[n:]]
        for text in ("_".join(run), "/".join(run), "\u3000".join(run)):
            assert model.score(text) > 0.3 and model.score(text.replace("blorgface", "wzkqj")) < 0.3


def test_sentences_and_phrases():
    _, _, sentence = toxicity.letters("One two. Three four five\nsix? seven i.d.i o.t eight")
    assert sentence.tolist() == [0, 0, 1, 1, 1, 2, 3, 3, 3, 3]
    first, after = toxicity._phrases(np.array([0] * 6 + [1] * 2 + [2]))
    n = toxicity.PHRASE
    assert list(zip(first.tolist(), after.tolist())) == [*((i, i + n) for i in range(6 - n + 1)), (6, 8), (8, 9)]


def test_phrase_scores_are_the_kernel_expansion():
    marks, weights = ["idiot", "clown"], [1.0, -0.5]
    direction = np.zeros(1 << toxicity.BITS)
    for m, w in zip(marks, weights):
        np.add.at(direction, *(lambda at, v: (at, w * v))(*toxicity.subsequences(m)))
    words = ["idiots", "clowns", "abc", "ab", "idixot", "down"]
    value, first, after = toxicity.phrase_scores(" ".join(words) + ". clown", direction)
    np.testing.assert_allclose(value, toxicity.kernel([(words + ["clown"])[i:j] for i, j in zip(first, after)], marks) @ weights, atol=1e-6)


def test_an_insult_of_two_plain_words(spark):
    """Each of the two words is common in clean documents; in one sentence they are the insult."""
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(4, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(800):
        sentences = [list(rng.choice(vocab, rng.integers(3, 5))) for _ in range(6)]
        kind = i % 4
        if kind == 0:
            sentences[2] = [sentences[2][0], "wexwix", "yokzuk", sentences[2][1]]
        elif kind == 1:
            sentences[0][1] = "wexwix"
        elif kind == 2:
            sentences[4][1] = "yokzuk"
        rows.append((i, ". ".join(map(" ".join, sentences)) + "."))
        labels.append((i, 1, int(kind == 0)))
    d, l = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score(d, toxicity.fit(d, l)).join(l, "doc_id").where(quality.held_out()).toPandas()
    bad, good = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert (bad.to_numpy()[:, None] > good.to_numpy()).mean() > 0.9 and (bad >= 0.3).mean() > 0.8


def test_toxicity_on_held_out_rows(spark):
    d, l = docs(spark, 600, 1)
    model = toxicity.fit(d, l)
    got = toxicity.score(d, model).join(l, "doc_id").withColumn("h", quality.held_out()).where("h").toPandas()
    hit = got.score >= 0.3
    assert hit[got.toxic == 1].mean() > 0.95 and hit[got.toxic == 0].mean() < 0.05
    assert model.score("some words and a blorg-face here") > 0.3


def test_toxicity_oddities(spark):
    d, l = docs(spark, 60)
    odd = spark.createDataFrame([(None, None, "x"), (7, "", "x"), (7, "", "x"), (8, "abc " * 40_000, "x")], "doc_id bigint, text string, score string")
    for labels in (l, l.where("false"), l.withColumn("toxic", F.lit(1))):
        assert toxicity.score(odd, toxicity.fit(d, labels)).where("score between 0 and 1").count() == 4
