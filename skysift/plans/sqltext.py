"""SQL text fragments used by the check statements (DuckDB dialect)."""

from __future__ import annotations

from skysift.functions.numeric import (
    AS241_CENTRE_BOTTOM, AS241_CENTRE_TOP, AS241_FAR_BOTTOM, AS241_FAR_TOP,
    AS241_MIDDLE_BOTTOM, AS241_MIDDLE_TOP, HART_BOTTOM, HART_TOP,
)


def sep(ra1, dec1, ra2, dec2) -> str:
    return (
        f"degrees(2e0*asin(sqrt(least(1e0, sin((radians({dec2})-radians({dec1}))/2)**2 + "
        f"cos(radians({dec1}))*cos(radians({dec2}))*sin((radians({ra2})-radians({ra1}))/2)**2))))"
    )


def flat(ra1, dec1, ra2, dec2) -> str:
    d = f"least(abs({ra1}-{ra2}), 360-abs({ra1}-{ra2}))"
    return f"sqrt(({d}*cos(radians(({dec1}+{dec2})/2)))**2 + ({dec1}-{dec2})**2)"


def mod360(x) -> str:
    return f"((({x}) % 360e0) + 360e0) % 360e0"


def poly(x, coefficients) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total}*({x}) + {c!r}::DOUBLE)"
    return total


def normal_tail(x) -> str:
    """x must be a plain column name."""
    a = f"abs({x})"
    near = f"exp(-{a}*{a}/2)*{poly(a, HART_TOP)}/{poly(a, HART_BOTTOM)}"
    fraction = f"({a}+0.65e0)"
    for k in (4, 3, 2, 1):
        fraction = f"({a}+{k}e0/{fraction})"
    far = f"exp(-{a}*{a}/2)/{fraction}/2.506628274631e0"
    tail = f"(CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} < 0 THEN 1e0-{tail} ELSE {tail} END)"


def normal_tail_inverse(p) -> str:
    """p must be a plain column name."""
    q = f"(0.5e0-{p})"
    r = f"(0.180625e0-{q}*{q})"
    centre = f"{q}*{poly(r, AS241_CENTRE_TOP)}/{poly(r, AS241_CENTRE_BOTTOM)}"
    depth = f"sqrt(-ln(least({p}, 1e0-{p})))"
    m, f = f"({depth}-1.6e0)", f"({depth}-5e0)"
    outer = (
        f"(CASE WHEN {depth} <= 5 THEN {poly(m, AS241_MIDDLE_TOP)}/{poly(m, AS241_MIDDLE_BOTTOM)} "
        f"ELSE {poly(f, AS241_FAR_TOP)}/{poly(f, AS241_FAR_BOTTOM)} END)"
    )
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {centre} "
        f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)"
    )


def sigma_of_p(p) -> str:
    return (
        f"(CASE WHEN {p} >= 1 THEN 0e0 WHEN {p} <= 0 THEN 10e0 "
        f"ELSE least(10e0, greatest(0e0, {normal_tail_inverse(p)})) END)"
    )


def poisson_tail(n, rate) -> str:
    """Tail by direct summation of terms in log space, upwards from n."""
    return (
        f"(CASE WHEN {n} <= 0 THEN 1e0 WHEN {rate} <= 0 THEN 1e-30 ELSE least(1e0, greatest(1e-300, "
        f"CASE WHEN {n} > {rate} THEN list_sum(list_transform(range(0, (200 + 12*sqrt({n}))::BIGINT), lambda i: "
        f"exp(({n}+i)*ln({rate}) - {rate} - lgamma({n}+i+1)))) "
        f"ELSE 1e0 - list_sum(list_transform(range(0, ({n})::BIGINT), lambda i: "
        f"exp(i*ln({rate}) - {rate} - lgamma(i+1e0)))) END)) END)"
    )


def even_chi_square_tail(x, pairs) -> str:
    """P(chi2 > x) with 2*pairs degrees of freedom."""
    return (
        f"(CASE WHEN {x} <= 0 THEN 1e0 ELSE list_sum(list_transform(range(0, ({pairs})::BIGINT), lambda i: "
        f"exp(-({x})/2 + i*ln(({x})/2) - lgamma(i+1e0)))) END)"
    )


def gal_lat(ra, dec) -> str:
    return (
        f"degrees(asin(sin(radians({dec}))*sin(radians(27.1284e0)) + "
        f"cos(radians({dec}))*cos(radians(27.1284e0))*cos(radians({ra}-192.8595e0))))"
    )


def best(table: str, key: str, order: str) -> str:
    """First row per key."""
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


def cone(left: str, right: str, radius: str, lk: str, columns: str, la="ra", ld="dec", ra="ra", rd="dec",
         zone: float = 0.1) -> str:
    """Pairs within a radius (degrees, at most `zone`), by declination zones."""
    d = sep(f"a.{la}", f"a.{ld}", f"b.{ra}", f"b.{rd}")
    return (
        f"SELECT * FROM (SELECT {columns}, {d} AS sep_deg, {radius} AS lim FROM {left} a, "
        f"(VALUES (-1), (0), (1)) o(k), {right} b "
        f"WHERE floor((b.{rd}+90)/{zone}) = floor((a.{ld}+90)/{zone}) + o.k) WHERE sep_deg <= lim"
    )
