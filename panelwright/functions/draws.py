"""Random numbers that depend on a key, a seed and a counter alone, in whole numbers that SQL, Spark and numpy compute alike.

A number below 2**31 is stirred by two multiplications modulo 2**31 and two shifts. A key is 52 bits of the MD5 of its
columns' text; seed, both halves of the key, and the counter are stirred in one after the other. No product passes 2**62.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 31
A, B = 1103515245, 1566083941


def key_number(*key: str) -> Column:
    """The first 52 bits of the MD5 of the columns as texts, joined by |; nulls are left out."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long")


def _let(value: Column, formula) -> Column:
    """``formula`` of a value that is worked out once, however often the formula names it."""
    return F.get(F.transform(F.array(value), formula), F.lit(0))


def _stirred(v: Column) -> Column:
    twice = _let(v % SPAN * A % SPAN, lambda x: x.bitwiseXOR(F.shiftright(x, 15)) * B % SPAN)
    return _let(twice, lambda x: x.bitwiseXOR(F.shiftright(x, 13)))


def draw(number: Column, seed: int, counter: int = 0) -> Column:
    """A whole number below SPAN for each :func:`key_number`."""
    both = _let(number, lambda n: _stirred(_stirred(n % SPAN + seed).bitwiseXOR(F.shiftright(n, 31))))
    return _stirred(both + counter)


def uniform(number: Column, seed: int, counter: int = 0) -> Column:
    return draw(number, seed, counter) / float(SPAN)


def stirred(v: np.ndarray) -> np.ndarray:
    """:func:`draw`'s step on arrays of unsigned 64-bit numbers."""
    once = v % np.uint64(SPAN) * np.uint64(A) % np.uint64(SPAN)
    twice = (once ^ (once >> np.uint64(15))) * np.uint64(B) % np.uint64(SPAN)
    return twice ^ (twice >> np.uint64(13))


def base(number: np.ndarray, seed: int) -> np.ndarray:
    """What :func:`draw` has before the counter."""
    n = number.astype(np.uint64)
    return stirred(stirred(n % np.uint64(SPAN) + np.uint64(seed)) ^ (n >> np.uint64(31)))


def poisson_edges(most: int = 12) -> list[int]:
    """A Poisson variable of mean one is the number of these that a draw reaches."""
    p = total = math.exp(-1)
    out = []
    for k in range(1, most):
        out.append(int(total * SPAN))
        p /= k
        total += p
    return out
