"""P-values on the driver, from counts or statistics that Spark has already reduced."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_regularised(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(1 - x, b, a)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi_square(table: np.ndarray) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p); Yates's correction for 2 x 2 as usual."""
    t = np.asarray(table, float)
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    if min(t.shape) < 2:
        raise ValueError("a chi-square test needs two rows and two columns with counts")
    expected = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
    off = np.abs(t - expected)
    if t.shape == (2, 2):
        off = off - min(0.5, off.min())
    stat = float((off**2 / expected).sum())
    df = (t.shape[0] - 1) * (t.shape[1] - 1)
    return stat, df, gamma_upper(df / 2, stat / 2)


def fisher_2x2(table: np.ndarray) -> float:
    """Two-sided exact p-value: all tables as improbable as this one, or more.

    Probabilities follow from the most probable table's by ratios of neighbours; tables
    40 standard deviations away weigh nothing in a double, so any counts will do.
    """
    (a, b), (c, d) = [[int(x) for x in row] for row in np.asarray(table)]
    n1, n2, k, n = a + b, c + d, a + c, a + b + c + d
    if min(n1, n2, k, n - k) == 0:
        return 1.0
    mode, sd = (k + 1) * (n1 + 1) // (n + 2), math.sqrt(k * (n1 / n) * (n2 / n) * (n - k) / max(1, n - 1))
    reach = int(40 * sd) + 20
    x = np.arange(max(0, k - n2, min(a, mode - reach)), min(k, n1, max(a, mode + reach)) + 1, dtype=float)
    ratio = np.log(n1 - x[:-1]) + np.log(k - x[:-1]) - np.log(x[:-1] + 1) - np.log(n2 - k + x[:-1] + 1)
    p = np.concatenate([[0.0], np.cumsum(ratio)])
    p -= p.max()
    return float(min(1.0, np.exp(p[p <= p[a - int(x[0])] + 1e-7]).sum() / np.exp(p).sum()))


def shapiro_wilk(values: np.ndarray) -> float | None:
    """p-value of the W test of normality by Royston's approximation (1995, AS R94), for 3 to 5000 values that aren't all equal."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        return None
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(ss) + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            second = m[-2] / math.sqrt(ss) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    # Scaled first: W does not change, and squares can't overflow.
    y = (x - x.mean()) / (x[-1] - x[0])
    w = min(1.0, float((a @ y) ** 2 / (y @ y)))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return 1.0
    z, log_n = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if z >= gamma:
            return 0.0
        z = -math.log(gamma - z)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return 0.5 * math.erfc((z - mean) / sd / math.sqrt(2))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2, df = r * r * (n - 2) / (1 - r * r), n - 2
    return beta_regularised(df / (df + t2), df / 2, 0.5)
