"""Fixed-effects least squares with entity-clustered errors: distributed sums, a small solve on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.numbers import finite


@dataclass
class Fit:
    """A fitted model: terms, coefficients, clustered standard errors, t and two-sided normal p-values, rows used."""

    terms: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int

    @property
    def t(self) -> np.ndarray:
        return self.coef / self.se

    @property
    def p(self) -> np.ndarray:
        return np.array([math.erfc(abs(t) / math.sqrt(2)) for t in self.t])

    def rows(self, model: str) -> list[tuple]:
        return [(model, k, float(c), float(s), float(t), float(p), self.n) for k, c, s, t, p in zip(self.terms, self.coef, self.se, self.t, self.p, strict=True)]


class TooManyEffects(ValueError):
    """More entities than dummies are solved for; :func:`within_ols` takes any number."""


def fe_ols(panel: DataFrame, y: str, xs: list[str], entity: str, time: str, max_effects: int = 2000) -> Fit:
    """OLS of y on xs with entity and time dummies and errors clustered by entity.

    Rows with nulls or infinities are dropped. The dummies' moments are sums by entity and time, so only
    (terms + entities + periods) squared numbers reach the driver; above ``max_effects`` entities use
    :func:`within_ols`. Rank-deficient dummies are solved by the pseudo-inverse, as statistical packages do.
    """
    cols = [y, *xs]
    df = panel.select(entity, time, *[finite(F.col(c)).alias(c) for c in cols]).na.drop(subset=[entity, time, *cols])
    moments = df.groupBy(entity, time).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j])
    cells = moments.limit(max_effects * 200 + 1).collect()
    entities, times = sorted({r[entity] for r in cells}), sorted({r[time] for r in cells})
    if len(entities) > max_effects or len(cells) > max_effects * 200:
        raise TooManyEffects("too many entities for dummies; use within_ols")
    # order: constant, xs, entity dummies but the first, time dummies but the first
    ei = {e: 1 + len(xs) + k - 1 for k, e in enumerate(entities)}
    ti = {t: len(xs) + len(entities) + k - 1 for k, t in enumerate(times)}
    size = len(xs) + len(entities) + len(times) - 1
    xtx, xty, yty, n = np.zeros((size, size)), np.zeros(size), 0.0, 0
    k = len(cols)
    per = []
    for r in cells:
        q = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                q[i, j] = q[j, i] = r[f"q_{i}_{j}"]
        s = np.array([r[f"s_{c}"] for c in cols])
        dummies = [0, *([ei[r[entity]]] if r[entity] != entities[0] else []), *([ti[r[time]]] if r[time] != times[0] else [])]
        here = [*dummies, *range(1, 1 + len(xs))]
        block = np.zeros((len(here), len(here)))
        d = len(dummies)
        block[:d, :d] = r["n"]
        block[:d, d:] = s[1:]
        block[d:, :d] = s[1:, None]
        block[d:, d:] = q[1:, 1:]
        xtx[np.ix_(here, here)] += block
        right = np.concatenate((np.full(d, s[0]), q[1:, 0]))
        xty[here] += right
        yty += q[0, 0]
        n += r["n"]
        per.append((r[entity], here, block, right))
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    # score of a cluster: X_g' y_g - X_g' X_g beta, summed over the cluster's cells
    score: dict = {}
    for e, here, block, right in per:
        score.setdefault(e, np.zeros(size))[here] += right - block @ beta[here]
    meat = sum(np.outer(u, u) for u in score.values())
    g, rank = len(entities), np.linalg.matrix_rank(xtx)
    factor = g / (g - 1) * (n - 1) / (n - rank) if g > 1 and n > rank else 1.0
    cov = factor * inverse @ meat @ inverse
    keep = slice(0, 1 + len(xs))
    return Fit(["Intercept", *xs], beta[keep], np.sqrt(np.maximum(np.diag(cov)[keep], 0)), int(n))


def within_ols(panel: DataFrame, y: str, xs: list[str], entity: str, time: str, max_periods: int = 500) -> Fit:
    """The same slopes for any number of entities: everything (time dummies too) less its entity mean, then sums of products.

    One aggregation by entity joined back; the driver sees the periods and (terms + periods) squared numbers.
    """
    cols = [y, *xs]
    df = panel.select(entity, time, *[finite(F.col(c)).alias(c) for c in cols]).na.drop(subset=[entity, time, *cols])
    periods = sorted(r[0] for r in df.select(time).distinct().limit(max_periods + 1).collect())
    if len(periods) > max_periods:
        raise ValueError("too many periods for dummies")
    names = [*[f"_x{i}" for i in range(len(xs))], *[f"_d{i}" for i in range(1, len(periods))]]
    wide = df.select(entity, F.col(y).alias("_y"), *[F.col(x).alias(f"_x{i}") for i, x in enumerate(xs)], *[(F.col(time) == p).cast("double").alias(f"_d{i}") for i, p in enumerate(periods) if i])
    means = wide.groupBy(entity).agg(*[F.avg(c).alias(f"m{c}") for c in ["_y", *names]])
    low = wide.join(means, entity).select(entity, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in ["_y", *names]])
    k = len(names)
    products = low.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, "_y"]) if i <= j]).first()
    xtx = np.array([[products[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ np.array([products[f"q{i}_{k}"] for i in range(k)])
    residual = F.col("_y") - sum((F.col(c) * float(b) for c, b in zip(names, beta, strict=True)), F.lit(0.0))
    scores = low.withColumn("_u", residual).groupBy(entity).agg(*[F.sum(F.col(c) * F.col("_u")).alias(f"u{i}") for i, c in enumerate(names)])
    m = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    g = m["g"]
    cov = inverse @ meat @ inverse * (g / (g - 1) if g > 1 else 1.0)
    return Fit(list(xs), beta[: len(xs)], np.sqrt(np.maximum(np.diag(cov)[: len(xs)], 0)), int(products["n"]))


COEFFICIENTS = "model string, term string, coef double, se double, t double, p double, n long"


def _varying(panel: DataFrame, y: str, xs: list[str], entity: str, time: str) -> list[str]:
    """The terms that differ within some entity, in the rows that a model of y on all of them uses."""
    df = panel.select(entity, time, *[finite(F.col(c)).alias(c) for c in [y, *xs]]).na.drop()
    spread = df.groupBy(entity).agg(*[(F.min(c) < F.max(c)).alias(c) for c in xs])
    found = spread.agg(*[F.max(c).alias(c) for c in xs]).first()
    return [c for c in xs if found[c]]


def run_models(panel: DataFrame, specs: dict[str, tuple[str, list[str]]], entity: str, time: str, max_effects: int = 2000) -> DataFrame:
    """Coefficient table of several models, by the within estimator (no intercept; terms that the entities absorb are left
    out) where there are too many entities for dummies. A model whose columns are absent or that is singular is left out.
    """
    rows = []
    for name, (y, xs) in specs.items():
        if not {y, *xs} <= set(panel.columns):
            continue
        try:
            try:
                rows += fe_ols(panel, y, xs, entity, time, max_effects).rows(name)
            except TooManyEffects:
                vary = _varying(panel, y, xs, entity, time)
                if vary:
                    rows += within_ols(panel, y, vary, entity, time).rows(name)
        except np.linalg.LinAlgError:
            continue
    return panel.sparkSession.createDataFrame(rows, COEFFICIENTS)


def stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def journal_table(coefficients: DataFrame) -> DataFrame:
    """(model, term, cell) with cells like "0.123** (0.050)"."""
    star = F.when(F.col("p") < 0.01, "***").when(F.col("p") < 0.05, "**").when(F.col("p") < 0.1, "*").otherwise("")
    return coefficients.select("model", "term", F.format_string("%.3f%s (%.3f)", "coef", star, "se").alias("cell"))
