"""Score functions as columns: outcomes, bounds, rates, decay, verdicts, ordered reasons."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BENEFIT, BOTH_BAD, BOTH_GOOD, HARM

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def rate(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def paired_outcome(direct: Column, reuse: Column, threshold: Column) -> Column:
    d, r = direct >= threshold, reuse >= threshold
    return F.when(d & ~r, HARM).when(~d & r, BENEFIT).when(d & r, BOTH_GOOD).when(~d & ~r, BOTH_BAD)


def wilson_upper(successes: Column, n: Column) -> Column:
    """Upper end of the 95 % Wilson interval; 1 without trials, never above 1."""
    k, m = successes.cast("double"), n.cast("double")
    p = F.try_divide(k, m)
    z2 = Z95 * Z95
    centre = p + z2 / (m * 2.0)
    spread = F.sqrt(p * (1.0 - p) / m + z2 / (m * 4.0 * m)) * Z95
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(centre + spread, 1.0 + F.try_divide(F.lit(z2), m))))


def finite(c: Column) -> Column:
    """True for numbers proper: null, NaN and infinities aren't."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def unit_score(c: Column) -> Column:
    return finite(c) & (c >= 0) & (c <= 1)


def half_life_decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def paired_verdict(baseline: Column, treatment: Column, threshold: Column) -> Column:
    known = baseline.isNotNull() & treatment.isNotNull() & threshold.isNotNull()
    fail = (baseline >= threshold) & (treatment < threshold)
    ok = (treatment >= threshold) & (treatment > baseline)
    return F.when(known, F.when(fail, "fail").when(ok, "pass").otherwise("uncertain"))


def close(a: Column, b: Column, absolute: float = 1e-9, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in the order given; a rule that is null counts as broken (it holds)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in rules]))
