"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column | str, default: float = 0.0) -> Column:
    """A double, with null, NaN, infinities and unparsable text replaced by ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(default))).otherwise(x)


def null_if_nan(c: Column) -> Column:
    """Null instead of NaN, so that "undefined" has one form only."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, null (or ``default``) where b is 0 or either is null."""
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def has_word(text: Column, word: Column) -> Column:
    """Whether ``word``, whatever it is made of, stands in ``text`` by itself, whatever its case: no letter, digit or underscore touches it."""
    return F.regexp_like(F.upper(text), F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.upper(word), F.lit(r"\E(?![\p{L}\p{N}_])")))


def plain_words(text: Column) -> Column:
    """The runs of letters, digits and underscores of ``text``, in upper case."""
    return F.filter(F.split(F.upper(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that carry one of ``names``, whatever their case."""
    taken = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of ``terms`` occurs in ``text`` as a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def present(*pairs: tuple[Column, Column]) -> Column:
    """The values whose conditions hold, as an array in the given order."""
    return F.filter(F.array(*[F.when(c, v) for c, v in pairs]), lambda x: x.isNotNull())
