"""Tail probabilities, as Arrow-batched column functions.

Spark has no incomplete gamma or beta.  These are the standard series and
continued fractions on numpy arrays; they run on aggregate-sized tables only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300
_STEPS = 200_000  # steps grow with the root of the parameters; beyond this it is an error


def gamma_q(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[x <= 0] = 1.0
    series = (x > 0) & (x < a + 1)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1.0 / aa
        total, n = term.copy(), aa.copy()
        for _ in range(_STEPS):
            n = n + 1
            term = term * xx / n
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function has not settled")
        out[series] = 1.0 - total * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    frac = (x > 0) & (x >= a + 1)
    if frac.any():
        aa, xx = a[frac], x[frac]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, _STEPS):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d[np.abs(d) < _TINY] = _TINY
            c = b + an / c
            c[np.abs(c) < _TINY] = _TINY
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < 1e-15):
                break
        else:
            raise ArithmeticError("the fraction of the incomplete gamma function has not settled")
        out[frac] = h * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    return np.clip(out, 0.0, 1.0)


def _beta_fraction(a, b, x):
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d[np.abs(d) < _TINY] = _TINY
    d = 1.0 / d
    h = d.copy()
    for m in range(1, _STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d[np.abs(d) < _TINY] = _TINY
            c = 1.0 + num / c
            c[np.abs(c) < _TINY] = _TINY
            d = 1.0 / d
            delta = d * c
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    else:
        raise ArithmeticError("the fraction of the incomplete beta function has not settled")
    return h


def beta_i(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    inside = (x > 0) & (x < 1)
    if inside.any():
        aa, bb, xx = a[inside], b[inside], x[inside]
        front = np.exp(
            _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        )
        low = xx < (aa + 1.0) / (aa + bb + 2.0)
        res = np.empty_like(xx)
        if low.any():
            res[low] = front[low] * _beta_fraction(aa[low], bb[low], xx[low]) / aa[low]
        if (~low).any():
            res[~low] = 1.0 - front[~low] * _beta_fraction(bb[~low], aa[~low], 1.0 - xx[~low]) / bb[~low]
        out[inside] = res
    return out


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(gamma_q(dof.to_numpy(float) / 2.0, x.to_numpy(float) / 2.0))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    tt, v = t.to_numpy(float), dof.to_numpy(float)
    return pd.Series(beta_i(v / 2.0, 0.5, v / (v + tt * tt)))


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ff, a, b = f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    return pd.Series(beta_i(b / 2.0, a / 2.0, b / (b + a * ff)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2.0)) for v in z.to_numpy(float)])


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of [[a, b], [c, d]].

    Terms are summed outward from the two cut points with the ratio recurrence
    and stop once they no longer change the double-precision sum, so the cost
    does not grow with the size of the margins.
    """
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    lf = math.lgamma
    base = lf(r1 + 1) + lf(n - r1 + 1) + lf(c1 + 1) + lf(n - c1 + 1) - lf(n + 1)

    def logp(k: int) -> float:
        return base - lf(k + 1) - lf(r1 - k + 1) - lf(c1 - k + 1) - lf(n - r1 - c1 + k + 1)

    limit = logp(a) + 1e-7
    mode = min(hi, max(lo, (r1 + 1) * (c1 + 1) // (n + 2)))

    def tail(start: int, stop: int, step: int) -> float:
        # start: first k on this side with logp(k) <= limit (monotone from the mode)
        k, far = start, stop
        if (far - k) * step < 0:
            return 0.0
        if logp(far) > limit:
            return 0.0
        if logp(k) > limit:
            inside, outside = k, far
            while abs(outside - inside) > 1:
                mid = (inside + outside) // 2
                if logp(mid) > limit:
                    inside = mid
                else:
                    outside = mid
            k = outside
        total = term = math.exp(logp(k))
        while k != stop:
            if step > 0:
                term *= (r1 - k) * (c1 - k) / ((k + 1) * (n - r1 - c1 + k + 1))
            else:
                term *= k * (n - r1 - c1 + k) / ((r1 - k + 1) * (c1 - k + 1))
            k += step
            total += term
            if term < total * 1e-18:
                break
        return total

    return min(1.0, tail(mode + 1, hi, 1) + tail(mode, lo, -1))

