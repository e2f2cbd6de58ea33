"""Special functions and small numeric helpers as native column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Hart's rational approximation of the normal tail (published coefficients).
HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Wichura's algorithm AS 241 (published coefficients), highest power first.
AS241_CENTRE_TOP = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
    45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
    133.14166789178437745, 3.387132872796366608,
)
AS241_CENTRE_BOTTOM = (
    5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
    21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
    42.313330701600911252, 1.0,
)
AS241_MIDDLE_TOP = (
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
)
AS241_MIDDLE_BOTTOM = (
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
)
AS241_FAR_TOP = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
)
AS241_FAR_BOTTOM = (
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
)
P_FLOOR = 1e-300
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polynomial(x: Column, coefficients) -> Column:
    """Horner form, highest power first."""
    total = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        total = total * x + F.lit(float(c))
    return total


def clean(c: Column | str) -> Column:
    """NaN and infinities count as missing."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_number(c: Column | str) -> Column:
    """Text to double; blanks, words, NaN and infinities become null."""
    return clean(col(c).cast("string").try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def saturate(x: Column | str, scale: float) -> Column:
    """1 - exp(-x/scale), held inside [0, 1]."""
    return clip(F.lit(1.0) - F.exp(-col(x) / F.lit(float(scale))), 0, 1)


def normal_tail(x: Column) -> Column:
    """P(Z > x)."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2.0)
    near = bell * polynomial(a, HART_TOP) / polynomial(a, HART_BOTTOM)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = bell / fraction / F.lit(2.506628274631)
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, 1.0 - tail).otherwise(tail)


def normal_tail_inverse(p: Column) -> Column:
    """x with P(Z > x) = p, for p strictly between 0 and 1."""
    q = F.lit(0.5) - p
    r = F.lit(0.180625) - q * q
    centre = q * polynomial(r, AS241_CENTRE_TOP) / polynomial(r, AS241_CENTRE_BOTTOM)
    depth = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    m, f = depth - 1.6, depth - 5.0
    outer = F.when(
        depth <= 5, polynomial(m, AS241_MIDDLE_TOP) / polynomial(m, AS241_MIDDLE_BOTTOM)
    ).otherwise(polynomial(f, AS241_FAR_TOP) / polynomial(f, AS241_FAR_BOTTOM))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(F.abs(q) <= 0.425, centre)
        .when(q < 0, -outer)
        .otherwise(outer)
    )


def sigma_of_p(p: Column, limit: float = 10.0) -> Column:
    """One-sided significance of a p-value, held inside [0, limit]."""
    return (
        F.when(p >= 1, F.lit(0.0))
        .when(p <= 0, F.lit(float(limit)))
        .otherwise(clip(normal_tail_inverse(F.greatest(p, F.lit(P_FLOOR))), 0, limit))
    )


def ln_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after moving the argument up by ten."""
    y = x + 10.0
    product = x
    for k in range(1, 10):
        product = product * (x + float(k))
    i = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) + i * (F.lit(-1 / 360) + i * (F.lit(1 / 1260) + i * F.lit(-1 / 1680)))) / y
    return (y - 0.5) * F.log(y) - y + F.lit(HALF_LN_2PI) + series - F.log(product)


def ln_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def _sum_terms(first: Column, ratio, last: Column) -> Column:
    """Sum of last+1 terms, each the one before times ratio(i)."""
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc, i):
        term = acc["term"] * ratio(i.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, start, step)["total"]


#: Nodes and weights of Gauss-Legendre quadrature on (0, 1).
_X, _W = np.polynomial.legendre.leggauss(48)
NODES, WEIGHTS = ((_X + 1) / 2).tolist(), (_W / 2).tolist()
#: Counts from which tails are integrated; below, their finite sums have so few terms.
MANY = 100


def _integral(start: Column, end: Column, density) -> Column:
    """Integral of a smooth density between two points, by a fixed number of nodes."""
    nodes = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(NODES, WEIGHTS)))
    total = F.aggregate(nodes, F.lit(0.0), lambda acc, n: acc + n["w"] * density(start + (end - start) * n["x"]))
    return F.abs(end - start) * total


@pandas_udf(DoubleType())
def _beyond(m: pd.Series, x: pd.Series) -> pd.Series:
    """Integral of the density with mode m, relative to it, from x away from the mode; null where either is."""
    m, x = m.to_numpy(float), x.to_numpy(float)
    with np.errstate(all="ignore"):
        s = np.sqrt(m)
        far = np.where(x > m, np.maximum(m + 12.0 * s, x + 8.0 * s), np.maximum(0.0, np.minimum(m - 8.0 * s, x - 6.0 * s)))
        total = np.zeros(len(m))
        for node, weight in zip(NODES, WEIGHTS):
            off = (x + (far - x) * node - m) / m
            total += weight * np.exp(m * (np.log1p(off) - off))
        return pd.Series(np.abs(far - x) * total)


@pandas_udf(DoubleType())
def _geometric_like(first: pd.Series, rate: pd.Series, base: pd.Series, last: pd.Series) -> pd.Series:
    """Sum of last+1 terms, the i-th the one before times rate / (base + i)."""
    term, rate, base, last = (c.to_numpy(float) for c in (first, rate, base, last))
    total = term.copy()
    with np.errstate(all="ignore"):
        for i in range(1, int(np.nanmax(last, initial=0.0)) + 1):
            term = term * (rate / (base + i))
            total = np.where(i <= last, total + term, total)
    return pd.Series(total)


@pandas_udf(DoubleType())
def _gamma_sum(h: pd.Series, shift: pd.Series, terms: pd.Series) -> pd.Series:
    """Sum of exp(-h) h^(i + shift) / Gamma(i + shift + 1) over i below ``terms``; ``shift`` is one number."""
    h, terms = h.to_numpy(float), terms.to_numpy(float)
    total, start = np.where(np.isnan(h), np.nan, 0.0), float(shift.iloc[0]) if len(shift) else 0.0
    with np.errstate(all="ignore"):
        log = np.log(h)
        for i in range(int(np.nanmax(terms, initial=0.0))):
            total = np.where(i < terms, total + np.exp((i + start) * log - h - math.lgamma(i + start + 1.0)), total)
    return pd.Series(total)


def _stirling(n: Column) -> Column:
    """ln n! less its leading terms, for large n."""
    return F.lit(1.0) / (12.0 * n) - F.lit(1.0) / (360.0 * n * n * n)


def gamma_tails(a: Column, x: Column) -> tuple[Column, Column]:
    """Lower and upper regularised incomplete gamma function for a >= MANY.

    The density is integrated from x away from its mode, in logarithms relative to the mode, so nothing
    under- or overflows and small tails keep their digits; the work is the same for any a.
    """
    m = a - 1.0
    above = x > m
    side = _beyond(m, x.cast("double"))
    side = clip(side / F.sqrt(2 * math.pi * m) * F.exp(-_stirling(m)), 0, 1)
    return F.when(above, 1.0 - side).otherwise(side), F.when(above, side).otherwise(1.0 - side)


def poisson_tail(n: Column, rate: Column) -> Column:
    """P(X >= n) for a Poisson rate, at any count. Small tails are summed or integrated upwards, so none is lost to rounding."""
    n, rate = n.cast("double"), rate.cast("double")
    few = F.least(n, F.lit(float(MANY)))
    lower = 1.0 - _geometric_like(F.exp(-rate), rate, F.lit(0.0), few - 1.0)
    first = F.exp(few * F.log(rate) - rate - ln_gamma(few + 1.0))
    upper = _geometric_like(first, rate, few, F.lit(2.0 * MANY))
    many = gamma_tails(F.greatest(n, F.lit(float(MANY))), rate)[0]
    tail = F.when(n >= MANY, many).when(n > rate, upper).otherwise(lower)
    empty = F.when(n <= 0, F.lit(1.0)).otherwise(F.lit(1e-30))
    return F.when(rate <= 0, empty).when(n <= 0, F.lit(1.0)).otherwise(clip(tail, P_FLOOR, 1))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(chi2 > x) for whole degrees of freedom: finite closed sums for few, the incomplete gamma function for many."""
    h = x.cast("double") / 2.0
    dof = dof.cast("int")
    few = F.least(dof, F.lit(2 * MANY + 1))

    def closed(shift: float, terms: Column) -> Column:
        return _gamma_sum(h, F.lit(shift), terms.cast("double"))

    even = closed(0.0, F.floor(few / 2))
    odd = normal_tail(F.sqrt(x)) * 2.0 + closed(0.5, F.floor((few - 1) / 2))
    many = gamma_tails(F.greatest(dof / 2.0, F.lit(float(MANY))), h)[1]
    return F.when(x <= 0, F.lit(1.0)).when(dof >= 2 * MANY, many).when(dof % 2 == 0, even).otherwise(odd)


def kolmogorov_tail(distance: Column, n_effective: Column, terms: int = 60) -> Column:
    """Limiting p-value of a Kolmogorov-Smirnov distance."""
    lam2 = n_effective * distance * distance
    ks = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2),
    )
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(clip(2.0 * total, 0, 1))


def sidak(p: Column, n: Column | float) -> Column:
    """1 - (1 - p)^n without losing small p."""
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n.cast("double")
    return F.when(p >= 1, F.lit(1.0)).otherwise(clip(-F.expm1(n * F.log1p(-p)), P_FLOOR, 1))


def bonferroni(p: Column, n: Column | float) -> Column:
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n
    return F.least(F.lit(1.0), p * n)


class Hypergeometric:
    """Marked ones among ``drawn`` out of a population with ``marked`` ones, drawn without replacement.

    Sums go outward from a value, each term from the one before by their ratio, over twelve standard deviations and 60 steps at most; what lies
    beyond is below 1e-30 of the whole. So the work grows with the square root of the counts.
    """

    def __init__(self, population: Column, marked: Column, drawn: Column):
        self.n, self.m, self.d = (c.cast("double") for c in (population, marked, drawn))
        self.low, self.top = F.greatest(F.lit(0.0), self.d + self.m - self.n), F.least(self.m, self.d)
        self.mean = self.d * self.m / self.n
        self.variance = F.when(self.n > 1, self.mean * (1 - self.m / self.n) * (self.n - self.d) / (self.n - 1)).otherwise(F.lit(0.0))
        self.reach = F.ceil(12.0 * F.sqrt(F.greatest(self.variance, F.lit(0.0)))) + 60.0
        self.mode = F.least(F.greatest(F.floor((self.d + 1) * (self.m + 1) / (self.n + 2)).cast("double"), self.low), self.top)

    def share(self, k: Column) -> Column:
        """P(X = k)."""
        inside = F.exp(ln_choose(self.m, k) + ln_choose(self.n - self.m, self.d - k) - ln_choose(self.n, self.d))
        return F.when((k < self.low) | (k > self.top), F.lit(0.0)).otherwise(inside)

    def up(self, i: Column) -> Column:
        """P(X = i) over P(X = i - 1)."""
        return (self.m - i + 1) * (self.d - i + 1) / (i * (self.n - self.m - self.d + i))

    def at_least(self, k: Column) -> Column:
        """P(X >= k), from the side of k on which the sum is small."""
        k = F.least(F.greatest(k.cast("double"), self.low), self.top + 1)
        upward = _sum_terms(self.share(k), lambda i: self.up(k + i), F.least(self.top - k, self.reach))
        downward = _sum_terms(self.share(k - 1), lambda i: 1.0 / self.up(k - i), F.least(k - 1 - self.low, self.reach))
        return F.when(k > self.top, F.lit(0.0)).when(k <= self.low, F.lit(1.0)).when(k > self.mode, clip(upward, 0, 1)).otherwise(clip(1.0 - downward, 0, 1))

    def two_sided(self, k: Column) -> Column:
        """Fisher's exact test: the probability of all values that are no likelier than ``k``."""
        k = k.cast("double")
        limit, above = self.share(k) * (1 + 1e-7), k > self.mode
        own = F.when(above, self.at_least(k)).otherwise(1.0 - self.at_least(k + 1))
        # the other side, from the mode outward; terms fall, so those under the limit are its end
        room = F.when(above, self.mode - self.low).otherwise(self.top - self.mode)
        steps = F.least(room, 2.0 * F.abs(k - self.mode) + self.reach).cast("int")
        ratio = lambda i: F.when(above, 1.0 / self.up(self.mode - i + 1)).otherwise(self.up(self.mode + i))
        every = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        start = F.struct(self.share(self.mode).alias("term"), F.lit(0.0).alias("total"))

        def step(acc, i):
            term = acc["term"] * ratio(i)
            return F.struct(term.alias("term"), (acc["total"] + F.when(term <= limit, term).otherwise(0.0)).alias("total"))

        other = F.aggregate(every, start, step)["total"]
        return F.when(limit >= self.share(self.mode), F.lit(1.0)).when((k < self.low) | (k > self.top), F.lit(0.0)).otherwise(clip(own + other, 0, 1))


def hypergeometric_tail(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) when drawing without replacement."""
    return Hypergeometric(population, marked, drawn).at_least(k)


def beta_tails(a: Column, b: Column, x: Column) -> tuple[Column, Column]:
    """Lower and upper regularised incomplete beta function for a and b >= MANY, like `gamma_tails`."""
    p, q = a - 1.0, b - 1.0
    n = p + q
    mode = p / n
    s = F.sqrt(p * q / (n * n * n))
    above = x > mode
    far = F.when(above, F.least(F.lit(1.0), F.greatest(mode + 12.0 * s, x + 8.0 * s))).otherwise(F.greatest(F.lit(0.0), F.least(mode - 12.0 * s, x - 8.0 * s)))

    def density(t: Column) -> Column:
        u, v = (t - mode) / mode, (mode - t) / (1.0 - mode)
        return F.exp(p * (F.log1p(u) - u) + q * (F.log1p(v) - v))

    scale = (n + 1.0) * F.sqrt(n / (2 * math.pi * p * q)) * F.exp(_stirling(n) - _stirling(p) - _stirling(q))
    side = clip(_integral(x, far, density) * scale, 0, 1)
    return F.when(above, 1.0 - side).otherwise(side), F.when(above, side).otherwise(1.0 - side)


def binomial_tail(k: Column, n: Column, share: Column) -> Column:
    """P(X >= k) for n independent trials, at any count: finite sums next to an end, the incomplete beta function else."""
    k, n = k.cast("double"), n.cast("double")
    odds = share / (1.0 - share)
    first = F.exp(ln_choose(n, k) + k * F.log(share) + (n - k) * F.log1p(-share))
    upward = _sum_terms(first, lambda i: (n - k - i + 1.0) / (k + i) * odds, F.least(n - k, F.lit(2.0 * MANY)))
    few = F.least(k, F.lit(float(MANY)))
    below = _sum_terms(F.exp(n * F.log1p(-share)), lambda i: (n - i + 1.0) / i * odds, few - 1)
    large = F.lit(float(MANY))
    many = beta_tails(F.greatest(k, large), F.greatest(n - k + 1.0, large), share)[0]
    total = F.when(n - k < MANY, upward).when(k >= MANY, many).when(k > n * share, upward).otherwise(1.0 - below)
    return (
        F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).when(share <= 0, F.lit(0.0))
        .when(share >= 1, F.lit(1.0)).otherwise(clip(total, 0, 1))
    )


def harmonic_match(interval: Column, period: Column, tolerance: float = 0.05, highest: int = 10) -> Column:
    """Best small-integer relation of two periods; a negative order means the inverse ratio."""
    ratio = interval / period
    inverse = F.when(interval > 0, period / interval).otherwise(F.lit(0.0))

    def residuals(r, sign):
        return F.transform(
            F.sequence(F.lit(1), F.lit(highest)),
            lambda n: F.struct(
                (F.abs(r - n) / n).alias("residual"),
                F.lit(0 if sign > 0 else 1).alias("side"),
                (n * sign).alias("harmonic"),
            ),
        )

    best = F.array_min(F.concat(residuals(ratio, 1), residuals(inverse, -1)))
    none = best["residual"] >= 1
    residual = F.when(none, F.lit(1.0)).otherwise(best["residual"])
    return F.struct(
        (residual < tolerance).alias("is_match"),
        ratio.alias("ratio"),
        F.when(none, F.lit(0)).otherwise(best["harmonic"]).alias("harmonic"),
        residual.alias("residual"),
    )


def student_tail(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom: a finite sum for few, the same integral by nodes for many."""
    a, v = F.abs(t), dof.cast("double")
    few = F.least(v, F.lit(2.0 * MANY))
    theta = F.atan(a / F.sqrt(few))
    c2 = F.cos(theta) * F.cos(theta)
    even = F.sin(theta) * _sum_terms(F.lit(1.0), lambda i: (2 * i - 1) / (2 * i) * c2, F.floor(few / 2) - 1)
    odd_sum = F.sin(theta) * F.cos(theta) * _sum_terms(F.lit(1.0), lambda i: 2 * i / (2 * i + 1) * c2, F.floor((few - 1) / 2) - 1)
    odd = F.lit(2 / math.pi) * (theta + F.when(few >= 3, odd_sum).otherwise(F.lit(0.0)))
    inside = F.when(few % 2 == 0, even).otherwise(odd)
    start = F.atan(a / F.sqrt(v))
    rest = _integral(start, F.least(F.lit(math.pi / 2), start + 14.0 / F.sqrt(v)), lambda f: F.exp((v - 1.0) / 2.0 * F.log1p(-F.sin(f) * F.sin(f))))
    i = F.lit(1.0) / v
    ratio = F.sqrt(v / 2.0) * (1.0 - i / 4.0 + i * i / 32.0 + 5.0 * i * i * i / 128.0 - 21.0 * i * i * i * i / 2048.0)
    many = 2.0 / math.sqrt(math.pi) * ratio * rest
    return clip(F.when(v > 2 * MANY, many).otherwise(1.0 - inside), 0, 1)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation coefficient of n pairs."""
    n = n.cast("double")
    t = r * F.sqrt((n - 2) / (1.0 - r * r))
    return F.when(n <= 2, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(student_tail(t, n - 2))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate Pearson correlation; null when either side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
