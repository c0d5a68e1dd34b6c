"""Numeric column functions with pandas' null conventions made explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_count(x: Column) -> Column:
    return F.log1p(F.coalesce(x, F.lit(0)).cast("double"))


def ln_positive(x: Column) -> Column:
    """Natural logarithm, null for zero and below."""
    return F.when(x > 0, F.log(x.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_unguarded(a: Column, b: Column) -> Column:
    """a / b as floating point divides: plus or minus infinity where b is 0 and a isn't, NaN for 0 / 0, null for null."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def market_cap(price: Column, shares: Column) -> Column:
    """Absolute price (quotes are marked by a negative sign) times shares outstanding."""
    return F.abs(price.cast("double")) * shares


def growth(now: Column, before: Column) -> Column:
    return ratio(now - before, F.abs(before))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def finite(x: Column) -> Column:
    """The value, null for NaN and infinities."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def numeric(x: Column, default: float | None = None) -> Column:
    n = x.cast("string").try_cast("double")
    return F.coalesce(n, F.lit(default)) if default is not None else n


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def argmax(labels: tuple[str, ...], scores: list[Column]) -> Column:
    """Label of the largest score; the first label wins ties."""
    rows = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(l).alias("label")) for i, (l, s) in enumerate(zip(labels, scores, strict=True))]
    return F.array_max(F.array(*rows))["label"]


def margin(scores: list[Column]) -> Column:
    """Largest minus second largest."""
    s = F.sort_array(F.array(*scores), asc=False)
    return F.abs(s[0] - s[1])


def compare(left: Column, operator: str, right) -> Column:
    """A comparison given by name: ==, !=, >=, <=, >, <, in, not_in; null counts as false."""
    made = {
        "==": lambda: left == right,
        "!=": lambda: left != right,
        ">=": lambda: left >= right,
        "<=": lambda: left <= right,
        ">": lambda: left > right,
        "<": lambda: left < right,
        "in": lambda: left.isin(*right),
        "not_in": lambda: ~left.isin(*right),
    }
    if operator not in made:
        raise ValueError(f"unknown operator {operator}")
    return F.coalesce(made[operator](), F.lit(False))
