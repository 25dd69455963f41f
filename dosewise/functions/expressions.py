"""Special functions as native expressions: Spark has no erfc, no binomial coefficients and no Kolmogorov tail."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def rarefied_share(total: str | Column, count: str | Column, g: int | Column) -> Column:
    """C(total - count, g) / C(total, g): the chance that g genes of `total` miss an allele seen `count` times."""
    total, count = (F.col(x) if isinstance(x, str) else x for x in (total, count))
    g = F.lit(g) if isinstance(g, int) else g
    return F.aggregate(F.sequence(F.lit(0), (g - 1).cast("int")), F.lit(1.0), lambda acc, i: acc * F.greatest(total - count - i, F.lit(0)) / (total - i))


def rarefied_richness(genes: str | Column, alt: str | Column, g: int | Column) -> Column:
    """Expected number of alleles among g genes of a biallelic locus; null where there are fewer genes."""
    genes, alt = (F.col(x) if isinstance(x, str) else x for x in (genes, alt))
    return F.when(genes >= g, 2 - rarefied_share(genes, alt, g) - rarefied_share(genes, genes - alt, g))


def erfc(x: str | Column) -> Column:
    """The complementary error function, to about 1e-14 relative: a series below 2.5, a continued fraction above."""
    x = F.col(x) if isinstance(x, str) else x
    a = F.abs(x)
    sq = a * a
    # erf(a) = 2 a exp(-a^2) / sqrt(pi) * (1 + 2a^2/3 (1 + 2a^2/5 (1 + ...)))
    series = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda acc, k: 1 + acc * 2 * sq / (2 * k + 1))
    low = 1 - 2 * a * F.exp(-sq) / math.sqrt(math.pi) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), a, lambda acc, k: a + k / 2.0 / acc)
    high = F.exp(-sq) / math.sqrt(math.pi) / fraction
    tail = F.when(a < 2.5, low).otherwise(high)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def chi2_tail(x: str | Column) -> Column:
    """P(X > x) of chi-square with one degree of freedom."""
    x = F.col(x) if isinstance(x, str) else x
    return erfc(F.sqrt(x / 2))


def chi2_critical(alpha: float) -> float:
    """The x with chi2_tail(x) = alpha."""
    return NormalDist().inv_cdf(alpha / 2) ** 2


def ks_tail(lam: str | Column) -> Column:
    """Kolmogorov's tail; 1 below 0.03, where the truncated series has not converged."""
    lam = F.col(lam) if isinstance(lam, str) else lam
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.03, 1.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def hashed(*parts) -> Column:
    """A number from 0 to 2**32 - 1, the same in any engine that has md5: its first eight hex digits over the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 8), 16, 10).cast("long")


def as_number(x: str | Column, otherwise: float | None = None) -> Column:
    """Text as a double; what is no number is `otherwise` (null), and so is NaN, which compares as the largest number."""
    x = F.col(x) if isinstance(x, str) else x
    number = F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
    return number if otherwise is None else F.coalesce(number, F.lit(float(otherwise)))


def prefix_tokens(x: str | Column, n: int = 2, sep: str = "_") -> Column:
    """The first n tokens of text, joined; null with fewer."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.size(F.split(x, sep)) >= n, F.substring_index(x, sep, n))


def shown(x: str | Column, digits: int = 4, signed: bool = False) -> Column:
    """A number for display: fixed digits, a dash for null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f", x))


def km_to_degrees(km: str | Column, latitude: str | Column) -> Column:
    """Degrees of longitude that a distance spans at a latitude."""
    km, latitude = (F.col(c) if isinstance(c, str) else c for c in (km, latitude))
    return km / (111.32 * F.cos(F.radians(latitude)))
