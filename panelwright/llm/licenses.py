"""License scans: MinHash bands over overlapping word windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import word_hashes
from .repeats import mixed
from .store import frozen, long_texts

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 16, 2
TEMPLATE_WORDS = 200_000  #: words of the templates that travel to the tasks at once; more take further passes

# The usual short notices of well-known licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ARR-notice": "All rights reserved.",
    "ARR": "All rights reserved. No part may be reproduced without permission.",
}

_ODD = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mixed(_ODD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BATCH = 1 << 14  #: words whose windows are hashed at once


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased: marks of comments and line ends are no words."""
    return text.encode().translate(_PLAIN).split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the SHINGLE-word shingles in order; fewer words are one shingle."""
    unit = word_hashes(words)
    return _chained(unit, min(SHINGLE, len(unit))) if len(unit) else unit


def _chained(unit: np.ndarray, k: int) -> np.ndarray:
    n = len(unit) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = (total ^ unit[i : i + n]) * _STEP
        total ^= total >> np.uint64(29)
    return total


def _band_keys(least: list[np.ndarray]) -> np.ndarray:
    key = least[0]
    for more in least[1:]:
        key = mixed(key) ^ more
    return key


class _Templates:
    """Templates by shingle length and number of shingles; for each width a sorted table of band keys a band."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.exact: list[tuple[str, int, set[tuple[bytes, ...]]]] = []
        widths: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        probes: dict[int, set[int]] = {}
        for name, text in texts:
            words = words_of(text)
            if words:
                s, k = shingles(words), min(SHINGLE, len(words))
                least = (s[None, :] * _ODD[:, None] + _ADD[:, None]).min(axis=1)
                widths.setdefault((k, len(s)), []).append((len(self.exact), least))
                self.exact.append((name, k, {tuple(words[i : i + k]) for i in range(len(s))}))
                distinct = {int(h): sum(map(len, words[i : i + k])) for i, h in enumerate(s)}
                telling = sorted(distinct, key=lambda h: (-distinct[h], h))  # long words are rare ones
                probes.setdefault(k, set()).update(telling[: int(len(distinct) * (1 - CONTAINMENT) + 1e-9) + 1])
        #: shingle length -> so many shingles of each template that a window with CONTAINMENT of it can't lack them all
        self.probes = {k: np.array(sorted(of), np.uint64) for k, of in probes.items()}
        #: shingle length -> width -> for each band: sorted keys, and the templates that have them
        self.tables: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for (k, width), members in widths.items():
            bands = []
            for band in range(BANDS):
                rows = range(band * ROWS, (band + 1) * ROWS)
                keys = _band_keys([np.array([least[r] for _, least in members], np.uint64) for r in rows])
                order = np.argsort(keys)
                bands.append((keys[order], np.array([m for m, _ in members])[order]))
            self.tables.setdefault(k, {})[width] = bands
        self.pad = max((k + w for k, of in self.tables.items() for w in of), default=1)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (template, first word, words, containment): the best window of each run of matching windows of a template."""
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        held, total = [], 0
        for i, words in enumerate(map(words_of, texts)):
            held.append((i, words))
            total += len(words)
            if total >= BATCH:
                self._batch(self._likely(held), found)
                held, total = [], 0
        self._batch(self._likely(held), found)
        return [sorted(f, key=lambda x: (x[1], x[0])) for f in found]

    def _likely(self, docs: list[tuple[int, list[bytes]]]) -> list[tuple[int, list[bytes]]]:
        """The texts that hold a probe of some template; no other can match, so most texts are never slid over."""
        if not docs:
            return docs
        length = np.array([len(w) for _, w in docs])
        ends = np.cumsum(length)
        unit = word_hashes([w for _, words in docs for w in words])
        live = np.zeros(len(docs), bool)
        for k, probe in self.probes.items():
            if len(unit) < k:
                continue
            s = _chained(unit, k)
            at = np.flatnonzero(probe[np.minimum(np.searchsorted(probe, s), len(probe) - 1)] == s)
            doc = np.searchsorted(ends, at, "right")
            live[doc[at + k <= ends[doc]]] = True
        return [docs[i] for i in np.flatnonzero(live).tolist()]

    def _batch(self, docs: list[tuple[int, list[bytes]]], found: list) -> None:
        """Texts end to end, each followed by padding that is never a minimum, so a window may run over its text's end."""
        if not docs:
            return
        length = np.array([len(w) for _, w in docs])
        start = np.cumsum(length + self.pad) - (length + self.pad)
        unit = np.zeros(int(start[-1] + length[-1] + self.pad), np.uint64)
        for (_, w), o in zip(docs, start.tolist()):
            unit[o : o + len(w)] = word_hashes(w)
        for k, of_width in self.tables.items():
            s = _chained(unit, k)
            outside = np.full(len(s), _ALL)
            for o, n in zip(start.tolist(), length.tolist()):
                outside[o : o + max(n - k + 1, 0)] = 0
            for width, hits in self._banded(s, outside, of_width).items():
                runs: dict[tuple[int, int], list[tuple[float, int]]] = {}
                for i, m in hits:
                    d = int(np.searchsorted(start, i, "right")) - 1
                    at, words = i - int(start[d]), docs[d][1]
                    end = min(at + width, len(words) - k + 1)
                    want = self.exact[m][2]
                    share = len({tuple(words[j : j + k]) for j in range(at, end)} & want) / len(want)
                    if share >= CONTAINMENT:
                        best = runs.setdefault((m, d), [])
                        if best and at - best[-1][1] < width:
                            best[-1] = max((share, at), best[-1], key=lambda x: x[0])
                        else:
                            best.append((share, at))
                for (m, d), best in runs.items():
                    found[docs[d][0]] += [(self.exact[m][0], at, min(width + k - 1, len(docs[d][1]) - at), share) for share, at in best]

    def _banded(self, s: np.ndarray, outside: np.ndarray, of_width: dict) -> dict[int, list[tuple[int, int]]]:
        """(window, template) that agree in all rows of some band, by width.

        A hash function is slid over the texts once, by doubling, for all widths; a band's keys are
        looked up in the sorted table of its width, so the number of templates hardly counts.
        """
        hits: dict[int, set[tuple[int, int]]] = {}
        for band in range(BANDS):
            least: dict[int, list[np.ndarray]] = {width: [] for width in of_width}
            for row in range(band * ROWS, (band + 1) * ROWS):
                slid = {1: (s * _ODD[row] + _ADD[row]) | outside}
                reach = 1
                while 2 * reach <= max(of_width):
                    slid[2 * reach] = np.minimum(slid[reach][:-reach], slid[reach][reach:])
                    reach *= 2
                for width in of_width:
                    x, half = slid[1 << (width.bit_length() - 1)], 1 << (width.bit_length() - 1)
                    least[width].append(x if half == width else np.minimum(x[: len(x) - (width - half)], x[width - half :]))
            for width, bands in of_width.items():
                keys, members = bands[band]
                value = _band_keys(least[width])
                low = np.searchsorted(keys, value)
                for i in np.flatnonzero((keys[np.minimum(low, len(keys) - 1)] == value) & (outside[: len(value)] == 0)).tolist():
                    for m in members[low[i] : np.searchsorted(keys, value[i], "right")].tolist():
                        hits.setdefault(width, set()).add((i, m))
        return {width: sorted(found) for width, found in hits.items()}


_MATCHES = pa.list_(pa.struct([("template", pa.string()), ("word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", at_once: int = TEMPLATE_WORDS) -> DataFrame:
    """One row for each row of ``docs``: its id and ``matches``, an array of (template, word, n_words, containment).

    Words are runs of letters and digits, so a notice is found behind the marks of a comment and over line ends. A text without
    any of a template's probes, a fifth of its shingles and one more, cannot hold CONTAINMENT of it and is left; in the others
    windows as wide as a template start at every word; their MinHash over SHINGLE-word shingles is
    cut into BANDS bands of ROWS. A window that holds CONTAINMENT of a template's shingles has a
    Jaccard similarity of at least 2/3 with it and shares a band with a probability of
    1 - (1 - (2/3)**2)**16 > 0.9999; containment is then counted exactly on the words.

    Templates of more than ``at_once`` words in all are scanned in as many passes as they take. Ids of
    any kind are given back as they are. Null and empty texts match nothing; repeated rows each get
    a row; an empty table gives an empty result; other columns are ignored.
    """
    templates = list(TEMPLATES.items()) if templates is None else templates
    groups: list[list[tuple[str, str]]] = [[]]
    total = 0
    for name, text in templates:
        total += len(words_of(text))
        if total > at_once and groups[-1]:
            groups.append([])
            total = len(words_of(text))
        groups[-1].append((name, text))
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = out.schema["__id"].dataType.simpleString()
    for k, group in enumerate(groups):
        held = out.sparkSession.sparkContext.broadcast(_Templates(group))

        def run(frames: Iterator[pa.RecordBatch], held=held, k: int = k) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                found = held.value.scan(frame.column("__text").to_pylist())
                rows = [[{"template": a, "word": b, "n_words": c, "containment": d} for a, b, c, d in t] for t in found]
                if k:
                    rows = [sorted(x + y, key=lambda m: (m["word"], m["template"])) for x, y in zip(frame.column("matches").to_pylist(), rows)]
                yield pa.RecordBatch.from_arrays([frame.column("__id"), frame.column("__text"), pa.array(rows, _MATCHES)], ["__id", "__text", "matches"])

        out = long_texts(out).mapInArrow(run, f"__id {kind}, __text string, matches array<struct<template:string,word:int,n_words:int,containment:double>>")
        if k + 1 < len(groups):
            out = frozen(out, "scanned")
    return out.select(F.col("__id").alias(id_col), "matches")
