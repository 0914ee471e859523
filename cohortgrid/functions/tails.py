"""Distribution tails as vectorised functions over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1.0) / (a + b + 2.0)
    out = np.where(
        low,
        front * _beta_fraction(a, b, inner) / a,
        1.0 - front * _beta_fraction(b, a, 1.0 - inner) / b,
    )
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    tt, dd = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    p = beta_inc(dd / 2.0, 0.5, dd / (dd + tt * tt))
    return np.where(ok, p, np.nan)


def normal_two_sided(z):
    z = np.asarray(z, float)
    return np.where(np.isfinite(z), _erfc(np.abs(np.where(np.isfinite(z), z, 0.0)) / math.sqrt(2.0)), np.nan)


def gamma_q(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    term = 1.0 / a
    total = term.copy()
    for n in range(1, 500):
        term = term * safe / (a + n)
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-16):
            break
    series = 1.0 - front * total
    b = safe + 1.0 - a
    c = np.full_like(b, 1.0 / _TINY)
    d = 1.0 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    out = np.where(safe < a + 1.0, series, front * h)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


def chi2_upper(stat, df):
    stat, df = np.asarray(stat, float), np.asarray(df, float)
    ok = np.isfinite(stat) & np.isfinite(df) & (df > 0)
    q = gamma_q(np.where(ok, df, 2.0) / 2.0, np.where(ok, np.maximum(stat, 0.0), 0.0) / 2.0)
    return np.where(ok, q, np.where(df == 0, 1.0, np.nan))


def normal_quantile(p):
    """Inverse normal: Newton steps in log space from a logistic start, symmetric about one half."""
    p = np.asarray(p, float)
    lower = np.clip(np.minimum(p, 1.0 - p), 1e-300, 0.5)
    x = np.where(lower > 0.02, -np.log((1 - lower) / lower) / 1.702, -np.sqrt(-2.0 * np.log(lower)))
    for _ in range(60):
        cdf = np.maximum(0.5 * _erfc(-x / math.sqrt(2.0)), 1e-320)
        pdf = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        step = np.clip((np.log(cdf) - np.log(lower)) * cdf / np.maximum(pdf, 1e-320), -1.0, 1.0)
        x = x - step
        if np.all(np.abs(step) < 1e-15 * np.maximum(np.abs(x), 1.0)):
            break
    out = np.where(p <= 0.5, x, -x)
    return np.where((p > 0) & (p < 1), out, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


#: Rows of the smaller side up to which the rank-sum law is counted out; rows of the other side from which its limit is taken.
FEW_RANKS, MANY_RANKS = 8, 100_000


def rank_sum_table(m: int, n: int) -> np.ndarray:
    """P(U <= k) for k from 0 to mn / 2: the arrangements of m and n rows without ties, counted by U.

    Their generating function is a product of (1 - q^(n+i)) / (1 - q^i) for i from 1 to m.
    """
    c = np.zeros(m * n // 2 + 1)
    c[0] = 1.0
    for i in range(1, m + 1):
        if n + i < len(c):
            c[n + i :] -= c[: len(c) - n - i].copy()
        for j in range(min(i, len(c))):
            c[j::i] = np.cumsum(c[j::i])
    return np.cumsum(c) / math.comb(m + n, m)


def rank_sum_two_sided(n1, n2, u):
    """Exact two-sided p of a rank sum without ties, where one side has FEW_RANKS rows at most.

    With MANY_RANKS rows or more on the other side the law's limit is used, that of a sum of uniform
    variates, which is then right to some three digits in the far tail and to more in the middle.
    """
    n1, n2, u = (np.asarray(x, float) for x in (n1, n2, u))
    out = np.full(len(u), np.nan)
    tables: dict[tuple[int, int], np.ndarray] = {}
    for i in np.flatnonzero(np.isfinite(u) & np.isfinite(n1) & np.isfinite(n2)):
        m, n = sorted((int(n1[i]), int(n2[i])))
        k = int(min(u[i], m * n - u[i]))
        if n < MANY_RANKS:
            if (m, n) not in tables:
                tables[m, n] = rank_sum_table(m, n)
            p = tables[m, n][k]
        else:
            x = (k + 0.5 + m / 2) / (n + 1)
            p = sum((-1) ** j * math.comb(m, j) * (x - j) ** m for j in range(int(x) + 1)) / math.factorial(m)
        out[i] = min(1.0, 2 * p)
    return out


@F.pandas_udf(DoubleType())
def rank_sum_pvalue(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series(rank_sum_two_sided(n1.to_numpy(float), n2.to_numpy(float), u.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(stat.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_score(p: pd.Series) -> pd.Series:
    return pd.Series(normal_quantile(p.to_numpy(float)))
