"""Exact quantiles by sketched brackets, and the distribution functions that tests need.

A sketch merged over all tasks says about where a quantile lies. One counting pass then proves it:
rows outside the brackets collapse to one count per gap, rows inside to a count per value, and
running sums of those give every rank. A bracket that missed its rank is widened; the sketch decides
how often the data are read (twice, as a rule), never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.text import let
from retort.operators.stored import stored, with_running_sums

#: Accuracy of the sketches (entries kept in each) and half the first width of a bracket.
ACCURACY = 5_000
HALF_WIDTH = 1.0 / 1_000


def _cells(rows: DataFrame, groups: list[str], value: str, shares: list[float], half: float) -> DataFrame:
    """Counts per group, bin and value: odd bins are inside a bracket and keep their values."""
    v = F.col(value)
    if half >= 1:  # everything is inside
        return rows.groupBy(*groups, F.lit(1).alias("_bin"), v.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    # brackets that meet are one
    spans: list[list[float]] = []
    for s in sorted(shares):
        low, high = max(0.0, s - half), min(1.0, s + half)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    marks = [m for span in spans for m in span]
    proper = F.when(~F.isnan(v.cast("double")), v)
    sketch = rows.groupBy(*groups).agg(F.percentile_approx(proper, marks, ACCURACY).alias("_marks"))
    sketch = stored(sketch, "sketches")
    if groups:
        named = sketch.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_marks")
        on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
        placed = rows.join(named, on)
    else:
        placed = rows.withColumn("_marks", sketch.select("_marks").scalar())
    bin_ = F.lit(0)
    for i in range(0, len(marks), 2):
        low, high = F.get("_marks", F.lit(i)), F.get("_marks", F.lit(i + 1))
        bin_ = bin_ + F.when(v > high, 2).when(v >= low, 1).otherwise(0)
    placed = placed.withColumn("_bin", bin_)
    kept = F.when(F.col("_bin") % 2 == 1, v)
    return placed.groupBy(*groups, "_bin", kept.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))


def bracketed_percentiles(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, one column per name in ``fractions``, and ``n_values``.

    Rows without a value don't count; a group without any has no row, a null group is a group. NaN
    is the greatest value. ``df`` is read once for the sketch and once for each try of brackets.
    """
    rows = df.select(*groups, F.col(value)).filter(F.col(value).isNotNull())
    shares, half = list(fractions.values()), HALF_WIDTH
    while True:
        cells = with_running_sums(_cells(rows, groups, value, shares, half), [*groups, "_bin", "_value"], "_n", "_before")
        first = cells.groupBy(*groups).agg(F.min("_before").alias("_first"), F.sum("_n").alias("n_values"))
        if groups:
            named = first.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_first", "n_values")
            cells = cells.join(named, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
        else:
            cells = cells.withColumns({"_first": F.lit(0), "n_values": first.select("n_values").scalar()})
        before = F.col("_before") - F.col("_first")
        picks, results = [], []
        for name, share in fractions.items():
            spot = F.lit(share) * (F.col("n_values") - 1)
            for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
                here = (before <= rank) & (rank < before + F.col("_n"))
                picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{name}_{side}"))
            lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
            results.append((lo + (hi - lo) * (spot - F.floor(spot))).cast("double").alias(name))
        found = stored(cells.groupBy(*groups, "n_values").agg(*picks), "quantiles")  # a row per group
        missed = " OR ".join(f"`_{name}_{side}` IS NULL" for name in fractions for side in ("lo", "hi"))
        if half >= 1 or found.filter(missed).isEmpty():
            return found.select(*groups, "n_values", *results)
        half *= 16


# The coefficients of Lanczos' approximation of the gamma function (g = 7, nine terms).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function of a number of at least 0.5."""
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz' method."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(state: Column, term: Column) -> Column:
        d, c = 1 / safe(1 + term * state["d"]), safe(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        once = F.transform(F.array(half(state, even)), lambda s: half(s, odd))
        return F.get(once, F.lit(0))

    numbers = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i.cast("double"))
    return F.aggregate(numbers, begin, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """Regularised incomplete beta function of a, b of 0.5 at least and x from 0 to 1."""
    swap = x >= (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    sides = F.struct(
        F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x")
    )

    def tail(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)
        return F.exp(front) * _beta_fraction(a, b, x, steps) / a

    inner = let(let(sides, tail), lambda t: F.when(swap, 1 - t).otherwise(t))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of ``n`` pairs under Student's t; NULL below three pairs."""
    given = F.struct(((n - 2).cast("double") / 2).alias("a"), (1 - r * r).alias("x"))
    p = let(given, lambda g: incomplete_beta(g["a"], F.lit(0.5), g["x"]))
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), p)
