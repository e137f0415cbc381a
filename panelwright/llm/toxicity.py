"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystrom landmarks.

Labelled documents are bags of sentences: a toxic one has some toxic sentence, a clean one has none.
The machine is trained on sentences, each with its document's label: in each round every document
of the sample gives the sentence that the machine so far takes for its most toxic one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out, one_text_each
from .store import frozen, long_texts, release, tasks

SPAN = 5  #: a subsequence of three letters reaches over this many at most
DECAY = 0.6  #: for each letter that is skipped
PHRASE = 4  #: words; a longer sentence is weighed by every run of so many words in it
FIT_DOCS = 4000  #: bound on the labelled documents of each class that the model is fitted on
LANDMARKS = 256  #: words that span the space of the machine
CANDIDATES = 1200  #: words of either class that landmarks are chosen among: the most typical ones
ROUNDS = 5  #: of choosing sentences and fitting
BITS = 16
_STEPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_WEIGHT = [DECAY ** (j - 2) for _, j in _STEPS]
_LONGEST = 64  #: letters of a unit; a longer run is cut into pieces
_PIECE, _STRIDE = 12, 3  #: letters of a piece, about those of a word, and between the starts of pieces


def letters(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters of ``text``, the number of the unit that each is in, and of each unit's sentence.

    A unit is a run of non-space characters less all but its letters; single letters that stand
    alone next to one another make one unit ("i d i o t", "i-d.i o t"). A unit of more than _LONGEST
    letters is cut into pieces of _PIECE, each a unit of its own, so a word in a long run is not
    weighed against the run's length: any 10 letters lie whole in some piece. A sentence ends with
    the line, and after a word that ends in a full stop, question or exclamation mark.
    """
    none = np.empty(0, np.int64)
    if not text:
        return np.empty(0, np.uint32), none, none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0x85) | (c == 0xA0) | (c == 0x1680) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029) | (c == 0x202F) | (c == 0x205F) | (c == 0x3000)
    stop = (c == 46) | (c == 33) | (c == 63) | ((c >= 0x3001) & (c <= 0x3002))
    ends = space & ((c == 10) | (c == 13) | np.append(False, stop[:-1]))
    token, sentence = np.cumsum(space), np.cumsum(ends)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~space)
    odd = np.unique(c[letter & (c > 0x24F)])  # few in a text, so each is looked up once
    if len(odd):
        letter &= ~np.isin(c, odd[[unicodedata.category(chr(x))[0] in "PZC" and not 0xD800 <= x <= 0xDFFF for x in odd.tolist()]])
    c, token, sentence = c[letter], token[letter], sentence[letter]
    if not len(c):
        return c, none, none
    first = np.concatenate(([True], token[1:] != token[:-1]))
    size = np.diff(np.append(np.flatnonzero(first), len(c)))
    joined = np.concatenate(([False], (size[1:] == 1) & (size[:-1] == 1)))
    unit = np.repeat(np.cumsum(~joined) - 1, size)
    sentence = sentence[np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))]
    return _cut(c, unit, sentence)


def _cut(c: np.ndarray, unit: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(unit)
    if size.max() <= _LONGEST:
        return c, unit, sentence
    pieces = np.where(size > _LONGEST, -(-(size - _PIECE) // _STRIDE) + 1, 1)
    of = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.where(size[of] > _LONGEST, _PIECE, size[of])
    begin = (np.cumsum(size) - size)[of] + np.minimum(nth * _STRIDE, size[of] - length)  # the last piece ends with the unit
    at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return c[at], np.repeat(np.arange(len(of)), length), sentence[of]


def _slot(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def _self_weight(n: np.ndarray) -> np.ndarray:
    """The length of a unit of n letters in the space of subsequences, repeats left aside."""
    total = sum(w * w * np.maximum(n - j, 0) for (_, j), w in zip(_STEPS, _WEIGHT))
    return np.sqrt(np.maximum(total, 1.0))


def _phrases(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First unit and the unit after the last of every phrase: each run of PHRASE units of a sentence, or all of a shorter one."""
    begin = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    size = np.diff(np.append(begin, len(sentence)))
    count = np.maximum(size - PHRASE + 1, 1)
    first = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return first, first + np.repeat(np.minimum(size, PHRASE), count)


def phrase_scores(text: str | None, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """<normalised subsequence map of a phrase, direction> for every phrase of the text, with its first unit and the unit after its last."""
    c, unit, sentence = letters(text)
    if not len(c):
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
    value = np.zeros(len(c))
    for (i, j), w in zip(_STEPS, _WEIGHT):
        if len(c) > j:
            inside = unit[j:] == unit[:-j]
            value[:-j] += w * direction[_slot(c[:-j], c[i : len(c) - j + i], c[j:])] * inside
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    total = np.concatenate(([0.0], np.cumsum(np.add.reduceat(value, starts))))
    norm = np.concatenate(([0.0], np.cumsum(_self_weight(np.diff(np.append(starts, len(c)))) ** 2)))
    first, after = _phrases(sentence)
    return (total[after] - total[first]) / np.sqrt(norm[after] - norm[first]), first, after


def units(text: str | None) -> list[str]:
    c, unit, _ = letters(text)
    if not len(c):
        return []
    cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
    whole = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    edges = [0, *cuts.tolist(), len(whole)]
    return [whole[i:j] for i, j in zip(edges, edges[1:])]


def subsequences(*words: str) -> tuple[np.ndarray, np.ndarray]:
    """The explicit map of the kernel for a phrase: slots of the three-letter subsequences of its words and their weights, of length about one."""
    slots, weights, norm = [], [], 0.0
    for word in words:
        c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts = [(_slot(c[:-j], c[i : len(c) - j + i], c[j:]), w) for (i, j), w in zip(_STEPS, _WEIGHT) if len(c) > j]
        slots += [x for x, _ in parts]
        weights += [np.full(len(x), w) for x, w in parts]
        norm += float(_self_weight(np.array(len(c))) ** 2)
    if not slots:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate(slots).astype(np.int64), np.concatenate(weights) / np.sqrt(norm)


def landmark_table(marks: list[str]) -> np.ndarray:
    """[slot, mark]: the maps of the landmarks, side by side."""
    table = np.zeros((1 << BITS, len(marks)), np.float32)
    for k, mark in enumerate(marks):
        at, weight = subsequences(mark)
        np.add.at(table[:, k], at, weight.astype(np.float32))
    return table


def kernel(phrases: list[list[str]], marks: list[str]) -> np.ndarray:
    """Kernel values [phrase, mark]."""
    table = landmark_table(marks)
    out = np.zeros((len(phrases), len(marks)))
    for row, words in zip(out, phrases):
        at, weight = subsequences(*words)
        row[:] = weight @ table[at]
    return out


class ToxicityModel:
    """A direction in the subsequence space, spanned by the landmarks, an offset, and a calibration."""

    def __init__(self, direction: np.ndarray, slope: float, shift: float):
        self.direction, self.slope, self.shift = direction, slope, shift

    def score(self, text: str | None) -> float:
        found = phrase_scores(text, self.direction)[0]
        best = float(found.max()) if len(found) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30))))


def _landmarks(words: list[str], weights: np.ndarray, n: int) -> list[int]:
    """Greedy: the word with the most weight left; words like it lose weight by their kernel with it."""
    maps, left, chosen = [subsequences(w) for w in words], weights.astype(np.float64).copy(), []
    ends = np.cumsum([len(at) for at, _ in maps])
    at, weight = (np.concatenate([m[k] for m in maps]) for k in (0, 1)) if maps else (None, None)
    while len(chosen) < min(n, len(words)) and left.max(initial=0.0) > 0:
        i = int(left.argmax())
        chosen.append(i)
        mine = np.zeros(1 << BITS)
        np.add.at(mine, *maps[i])
        total = np.concatenate(([0.0], np.cumsum(mine[at] * weight)))
        like = np.diff(total[np.concatenate(([0], ends))])
        left *= 1 - np.clip(like, 0, 1)
        left[i] = 0
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-5) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps on the active rows; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    reg[-1, -1] = 1e-8
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, sa = x[active], weight[active]
        new = np.linalg.solve(reg + (xa * sa[:, None]).T @ xa, (xa * sa[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Learn from at most ``fit_docs`` documents a class (the least by hash of their id), never from held-out ids.

    The sample is written once. Spark counts for every word the toxic and the clean documents with it;
    the CANDIDATES most typical words of either class reach the driver, and landmarks are chosen among
    them: each stands for what is like it. A sentence of the sample becomes its kernel values with the
    landmarks, made orthonormal. Which sentence of a document trains the machine is chosen anew in each
    round, by Spark; all that reaches the driver is one vector of a sentence for each document. Chosen
    sentences of clean documents stay in the training set, those of toxic ones are replaced.

    Rows without id or label are not used; of several labels of one id the highest counts, of several
    texts the least. Without documents of both classes all texts get one low score.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = ids.where("toxic = 1").orderBy(*order).limit(fit_docs).union(ids.where("toxic = 0").orderBy(*order).limit(fit_docs))
    rows = frozen(one_text_each(docs, some), "sample")
    rows_by_doc = rows.repartition(tasks(docs.sparkSession), "doc_id")

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(w, t) for text, t in zip(frame["text"], frame["toxic"]) for w in dict.fromkeys(units(text)) if len(w) >= 3]
            yield pd.DataFrame(out, columns=["unit", "toxic"]).astype({"toxic": "int32"})

    counts = rows_by_doc.mapInPandas(words, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    counts = frozen(counts, "units")
    per = rows.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    of = ids.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    n_bad, n_good = per.get(1, 0), per.get(0, 0)
    model = ToxicityModel(np.zeros(1 << BITS, np.float32), 1.0, -2.0)
    if n_bad and n_good:
        lift = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
        bad = counts.withColumn("gain", F.col("bad") * lift).where("gain > 0").orderBy(F.desc("gain"), "unit").limit(CANDIDATES).toPandas()
        good = counts.withColumn("gain", F.col("good").cast("double")).where(lift < 0.5).orderBy(F.desc("gain"), "unit").limit(CANDIDATES).toPandas()
        marks = []
        for part in (bad, good):
            marks += [part["unit"].iloc[i] for i in _landmarks(part["unit"].tolist(), part["gain"].to_numpy(), LANDMARKS // 2)]
        marks = list(dict.fromkeys(marks))
        if len(bad) and marks:
            share = of[1] / (of[0] + of[1])
            model = _trained(rows_by_doc, marks, dict(zip(bad["unit"], bad["gain"])), share / n_bad, (1 - share) / n_good)
    release(rows, counts)
    return model


def _trained(rows: DataFrame, marks: list[str], gain: dict[str, float], w_bad: float, w_good: float) -> ToxicityModel:
    gram = kernel([[m] for m in marks], marks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    ok = value > 1e-4 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])  # Nystrom: k(x, Z) K_ZZ^(-1/2)
    share = np.array([max(gain.get(m, 0.0), 0.0) for m in marks])
    weights = (share / max(share.sum(), 1e-9)) @ gram @ root  # at first the sentence most like the toxic landmarks
    held = rows.sparkSession.sparkContext.broadcast((landmark_table(marks), root))
    kept: pd.DataFrame | None = None
    for _ in range(ROUNDS):
        direction = (held.value[0] @ (root @ weights)).astype(np.float32)
        chosen = _witnesses(rows, held, direction)
        clean = chosen[chosen["toxic"] == 0]
        kept = clean if kept is None else pd.concat([kept, clean]).drop_duplicates(["doc_id", "phrase"])
        train = pd.concat([chosen[chosen["toxic"] == 1], kept])
        y = np.where(train["toxic"] == 1, 1.0, -1.0)
        x = np.frombuffer(b"".join(train["x"]), np.float32).reshape(len(train), -1).astype(np.float64)
        weights = _svm(x, y, np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum()))[:-1]
    direction = (held.value[0] @ (root @ weights)).astype(np.float32)
    last = _witnesses(rows, held, direction)
    slope, shift = _platt(last["best"].to_numpy(), last["toxic"].to_numpy(), w_bad, w_good)
    held.unpersist()
    return ToxicityModel(direction, slope, shift)


def _witnesses(rows: DataFrame, held, direction: np.ndarray) -> pd.DataFrame:
    """For each document the phrase that ``direction`` takes for its most toxic one, as a vector, and its value; in the order of ids."""
    toward = rows.sparkSession.sparkContext.broadcast(direction)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, root = held.value
        for frame in frames:
            out = []
            for doc, text, toxic in zip(frame["doc_id"], frame["text"], frame["toxic"]):
                value, first, after = phrase_scores(text, toward.value)
                best, vector, at = 0.0, np.zeros(root.shape[1], np.float32), -1
                if len(value):
                    at = int(value.argmax())
                    best = float(value[at])
                    slot, weight = subsequences(*units(text)[first[at] : after[at]])
                    vector = (weight @ table[slot] @ root).astype(np.float32) if len(slot) else vector
                out.append((doc, toxic, best, at, vector.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "best", "phrase", "x"]).astype({"doc_id": "int64", "toxic": "int32", "phrase": "int64"})

    return rows.mapInPandas(run, "doc_id long, toxic int, best double, phrase long, x binary").toPandas().sort_values("doc_id", ignore_index=True)


def _platt(x: np.ndarray, y: np.ndarray, w_bad: float, w_good: float) -> tuple[float, float]:
    """Logistic calibration of the most toxic sentence of a document, classes weighted as labelled, by Newton steps."""
    weight = np.where(y == 1, w_bad, w_good)
    a = np.column_stack((x, np.ones(len(x))))
    p = np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        hess = (a * (weight * mu * (1 - mu))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (weight * (y - mu)) - 1e-6 * p)
        p = p + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` in [0, 1], from the whole text alone; higher is likelier toxic.

    A text without letters (null, empty) has the score of no evidence. Repeated rows score alike; an
    empty table gives an empty result; a column called score is replaced.
    """
    held = long_texts(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score).astype("float64")

    return docs.withColumn("score", run(F.coalesce(F.col(text_col), F.lit(""))))
