"""Periodic runs of words: Re-Pair grammars, boundary runs found once a rule, maximal intervals merged.

The words of a batch of documents are compressed together: each Re-Pair round replaces pairs that
occur more than once, the more frequent of two that overlap first, until few are left; a balanced tree
over each document's last symbols closes its derivation. A rule's expansion is where its first
occurrence lies, so nothing is expanded. A run lies whole in the expansion of some lowest node and crosses
the boundary between its two parts; what crosses a rule's boundary is computed at its first
occurrence and moved to all others. Parts of one run that smaller nodes found are merged into it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import mixed, ranges
from .store import long_texts, without

LEAST = 6  #: words of a run at least
PERIODS = 4  #: periods of a run at least; four and more are certain to hold two on one side of any boundary
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20  #: (node, period) pairs looked at together
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_ids(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, the ids of all of them in order, and where each text begins (and the end)."""
    words = [t.encode().split() if t else [] for t in texts]
    held = np.empty(sum(map(len, words)), object)
    held[:] = [w for some in words for w in some]
    ids = pd.factorize(held)[0].astype(np.int64) if len(held) else np.empty(0, np.int64)
    return words, ids, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


class _Text:
    """Words with prefix sums that tell at a glance, and never wrongly deny, that two neighbouring stretches are equal."""

    def __init__(self, word: np.ndarray):
        self.word = word
        with np.errstate(over="ignore"):
            self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(word), _BASE))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(word.astype(np.uint64) + np.uint64(1)) * self.power[:-1])))

    def squares(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether [at, at + q) and [at + q, at + 2q) seem equal."""
        first, middle, last = self.sums[at], self.sums[at + q], self.sums[at + 2 * q]
        return (middle - first) * self.power[q] == last - middle

    def reach(self, i: int, j: int, step: int, room: int) -> int:
        """How many words from i and j on, backward if step is -1, are equal; ``room`` at most."""
        done, width = 0, 64
        while done < room:
            n = min(width, room - done)
            a, b = i + step * done, j + step * done
            x, y = (self.word[a : a + n], self.word[b : b + n]) if step > 0 else (self.word[a - n + 1 : a + 1][::-1], self.word[b - n + 1 : b + 1][::-1])
            differ = np.flatnonzero(x != y)
            if len(differ):
                return done + int(differ[0])
            done, width = done + n, width * 2
        return done


def _boundary_runs(text: _Text, start: np.ndarray, mid: np.ndarray, end: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, ...]:
    """Runs inside [start, end) that cross ``mid``, for many nodes: (node, from, to, period).

    Half of a run of four periods lies on one side of the boundary, so a square of its period ends or begins there.
    """
    found: list[tuple[int, int, int, int]] = []
    for left in (True, False):
        side = mid - start if left else end - mid
        top = np.minimum(side // 2, (end - start) // periods)
        top[end - start < least] = 0
        live = np.flatnonzero(top > 0)
        groups = np.cumsum(top[live]) // _CHUNK
        for some in np.split(live, np.flatnonzero(np.diff(groups)) + 1):
            if not len(some):
                continue
            node, q = np.repeat(some, top[some]), ranges(np.ones(len(some), np.int64), top[some])
            near, far = (mid[node] - 1, mid[node] - 1 - q) if left else (mid[node], mid[node] + q)
            same = np.flatnonzero(text.word[near] == text.word[far])
            node, q = node[same], q[same]
            same = text.squares(mid[node] - 2 * q if left else mid[node], q)
            node, q = node[same], q[same]
            cuts = np.flatnonzero(np.diff(node)) + 1
            for k, mine in zip(node[np.r_[0, cuts]].tolist() if len(node) else [], np.split(q, cuts)):
                a, m, b = int(start[k]), int(mid[k]), int(end[k])
                while len(mine):
                    p = int(mine[0])
                    at = m - 2 * p if left else m  # the square
                    if text.reach(at, at + p, 1, p) < p:
                        mine = mine[1:]
                        continue
                    low = at - text.reach(at - 1, at + p - 1, -1, at - a)
                    high = at + 2 * p + text.reach(at + p, at + 2 * p, 1, b - at - 2 * p)
                    if high - low >= max(least, periods * p) and low < m < high:
                        found.append((k, low, high, p))
                    mine = mine[1:]  # longer squares inside it have multiples of this period: the same run
                    mine = mine[m - 2 * mine < low] if left else mine[m + 2 * mine > high]
    table = np.array(found, np.int64).reshape(-1, 4)
    return tuple(table.T)


def _round(name: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair a Re-Pair round replaces, and the pair's number at each: of overlapping pairs the more frequent."""
    none = np.empty(0, np.int64)
    if len(name) < 2:
        return none, none
    inside = doc[:-1] == doc[1:]
    _, code, count = np.unique(name[:-1][inside] * (int(name.max()) + 1) + name[1:][inside], return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank = np.empty(len(count), np.int64)
    rank[order] = np.arange(len(count))
    rank[count < 2] = -1
    place = np.full(len(inside), -1, np.int64)
    place[inside] = rank[code.ravel()]
    change = np.flatnonzero(np.diff(place, prepend=-2))
    offset = np.arange(len(place)) - np.repeat(change, np.diff(np.append(change, len(place))))
    before, after = np.concatenate(([-1], place[:-1])), np.concatenate((place[1:], [-1]))
    taken = np.flatnonzero((place >= 0) & (offset % 2 == 0) & (before <= place) & (after <= place))
    return taken, place[taken]


def _moved(found: tuple[np.ndarray, ...], first: np.ndarray, rule: np.ndarray, at: np.ndarray) -> Spans:
    """Runs found at the first occurrence of rules, at all their occurrences (rule, at)."""
    node, low, high, q = found
    order = np.argsort(rule, kind="stable")
    held = rule[order]
    begin, stop = np.searchsorted(held, node), np.searchsorted(held, node, "right")
    where = at[order[ranges(begin, stop - begin)]]
    which = np.repeat(np.arange(len(node)), stop - begin)
    move = where - first[node[which]]
    return low[which] + move, high[which] + move, q[which]


def maximal(spans: list[Spans]) -> Spans:
    """Intervals of one period that share a period's length are one run; in order of start, then period."""
    low, high, q = (np.concatenate(x) for x in zip(*spans)) if spans else (np.empty(0, np.int64),) * 3
    order = np.lexsort((low, q))
    low, high, q = low[order], high[order], q[order]
    if len(low):
        reach = q << 40  # periods apart, so that the running maximum starts anew with each
        upto = np.maximum.accumulate(high + reach) - reach
        fresh = np.r_[True, (q[1:] != q[:-1]) | (low[1:] > upto[:-1] - q[1:])]
        first = np.flatnonzero(fresh)
        low, high, q = low[first], np.maximum.reduceat(high, first), q[first]
    order = np.lexsort((q, low))
    return low[order], high[order], q[order]


def runs_of(word: np.ndarray, begin: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> Spans:
    """All runs of the texts word[begin[i] : begin[i + 1]]: (from, to, period), positions in ``word``.

    A run is a stretch with smallest period q, at least ``max(least, periods * q)`` words long, that no neighbour extends.
    """
    if periods < 4:
        raise ValueError("periods must be four at least")
    text = _Text(word)
    at, size, name = np.arange(len(word)), np.ones(len(word), np.int64), word.astype(np.int64)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    spans: list[Spans] = []

    def merged(taken: np.ndarray, names: np.ndarray) -> None:
        nonlocal at, size, name, doc
        size[taken] += size[taken + 1]
        name[taken] = names
        left = np.ones(len(at), bool)
        left[taken + 1] = False
        at, size, name, doc = at[left], size[left], name[left], doc[left]

    while True:  # grammar rules
        taken, code = _round(name, at, doc)
        if len(taken) * 50 < len(name) or not len(taken):
            break
        rules, first, rule = np.unique(code, return_index=True, return_inverse=True)
        rep = taken[first]
        found = _boundary_runs(text, at[rep], at[rep + 1], at[rep + 1] + size[rep + 1], least, periods)
        spans.append(_moved(found, at[rep], rule.ravel(), at[taken]))
        merged(taken, int(name.max()) + 1 + rule.ravel())
    while len(at) > 1:  # a balanced tree over what is left of each document
        change = np.flatnonzero(np.diff(doc, prepend=-1))
        offset = np.arange(len(doc)) - np.repeat(change, np.diff(np.append(change, len(doc))))
        taken = np.flatnonzero((offset[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(taken):
            break
        found = _boundary_runs(text, at[taken], at[taken + 1], at[taken + 1] + size[taken + 1], least, periods)
        spans.append(found[1:])
        merged(taken, name[taken])
    return maximal(spans)


def collapsed(docs: DataFrame, least: int = LEAST, periods: int = PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> one row each: ``(doc_id, n_words, runs, kept)``.

    Words are what stands between spaces and the characters U+0009 to U+000D. runs lists (start, length,
    period), word numbers from 0, by start, then period. kept is the text without repetitions: a word is dropped if any run contains it
    after that run's first period; the words left are joined by one space.

    Documents are compressed in the Arrow batches that Spark hands out (bounded by bytes), and a run never
    leaves its document, so there is no shuffle, and equal or hot texts are nothing special. A text of any length is worked on
    whole, in memory proportional to its words. Null and empty texts have no words, no runs and an empty ``kept``. Null or
    repeated ids are carried through; other columns are ignored. An empty table gives an empty result.
    """

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words, ids, begin = word_ids(frame.column("text").to_pylist())
            low, high, q = runs_of(ids, begin, least, periods)
            gone = np.zeros(len(ids) + 1, np.int64)
            np.add.at(gone, low + q, 1)
            np.add.at(gone, high, -1)
            keep = np.cumsum(gone[:-1]) == 0
            of = np.searchsorted(begin, low, "right") - 1
            kept = []
            for k, some in enumerate(words):
                mine = keep[begin[k] : begin[k + 1]]
                kept.append(b" ".join(some if mine.all() else compress(some, mine.tolist())))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(low - begin[of]), pa.array(high - low), pa.array(q)], fields=list(_RUN)),
            )
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(np.diff(begin)), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return long_texts(rows).mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def best_run(runs) -> F.Column:
    """Of a ``runs`` column the run of greatest exact length / period, on ties the first; null if there is none."""
    better = lambda best, run: best.isNull() | (run.length * best.period > best.length * run.period)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end in one document of ten: the text under the rule of the query's contract, its words joined by one space.

    h = crc32(decimal id), g = h div 10; where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    rows = without(docs, "__g", "__due").withColumns({"__due": F.coalesce(h % 10 == 0, F.lit(False)), "__g": F.expr("0L") + F.floor(h / 10)})
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def altered(w):
        n = F.size(w).cast("long")
        bound = F.transform(F.array(F.struct(w.alias("w"), n.alias("n"), F.pmod("__g", n).alias("a"))), lambda s: F.struct(s.w.alias("w"), s.n.alias("n"), s.a.alias("a"), (F.floor((s.n - s.a) / (F.pmod(F.col("__g"), F.lit(8)) + 3)) + 1).alias("p")))
        texts = F.transform(bound, lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s.n - 1), lambda i: F.get(s.w, F.when(i < s.a, i).otherwise(s.a + F.pmod(i - s.a, s.p)).cast("int"))), " "))
        return F.when(F.size(w) > 0, F.get(texts, F.lit(0)))

    changed = F.get(F.transform(F.array(words), altered), F.lit(0))
    return rows.withColumn(text_col, F.when(F.col("__due"), F.coalesce(changed, F.col(text_col))).otherwise(F.col(text_col))).drop("__g", "__due")
