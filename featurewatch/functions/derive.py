"""Derived features and banding as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurewatch.functions.encode import map_literal
from featurewatch.functions.nulls import flag

# ---- fixed values (must equal the reference's constants) ----------------
REFERENCE_YEAR = 2022
RATIO_EPS = 0.01
EXPECTED_MAX_AGE_BY_PHASE = {0: 8, 1: 10, 2: 12, 3: 14, 4: 15, 5: 16, 6: 17, 7: 18, 8: 19}
EXPECTED_AGE_FALLBACK = 15
RISK_BANDS = [(0.8, "Muito Alto"), (0.6, "Alto"), (0.4, "Moderado"), (0.2, "Baixo")]
RISK_BAND_LOWEST = "Muito Baixo"
LABEL_AT_RISK = "Em Risco"
LABEL_NOT_AT_RISK = "Sem Risco"
DECISION_THRESHOLD = 0.5
# --------------------------------------------------------------------------


def years_since(c: Column, ref_year: int = REFERENCE_YEAR) -> Column:
    """``ref_year - year``."""
    return F.lit(ref_year) - c


def years_since_or_count(c: Column, ref_year: int = REFERENCE_YEAR) -> Column:
    """A value above 100 is a year (-> ref_year - int(value)), else already a count."""
    return F.when(c > 100, F.lit(ref_year) - c.try_cast("int")).otherwise(c)


def delta_neutral(later: Column, earlier: Column, had_history: Column) -> Column:
    """D3: ``later - earlier``, forced to 0 when there was no history."""
    return F.when(had_history == 0, F.lit(0)).otherwise(later - earlier)


def delta_neutral_serving(later: Column, earlier: Column, had_history: Column,
                          supplied: Column | None = None) -> Column:
    """No history -> 0; both codes present -> difference; else supplied value or 0."""
    sup = supplied if supplied is not None else F.lit(None)
    return (F.when(had_history == 0, F.lit(0))
            .when(later.isNotNull() & earlier.isNotNull(), later - earlier)
            .otherwise(F.coalesce(sup, F.lit(0))))


def _moments(cols: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(count, mean, sum of squared deviations) of the non-null values, as plain
    arithmetic over a column list fixed at plan time (no array lambdas, so the
    projection stays inside whole-stage codegen).  Two-pass like numpy."""
    xs = [c.cast("double") for c in cols]
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    mean = F.try_divide(total, n)          # NULL for an all-NULL row, never an ANSI error
    ss = sum((F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs), F.lit(0.0))
    return n, mean, ss


def _std(cols: Sequence[Column], least: int) -> Column:
    """Sample std of at least ``least`` (2 or more) non-null values, else NULL.  The condition is in the divisor, not
    around the sum: Spark computes a repeated expression (the mean) once only where it is not under a condition."""
    n, _, ss = _moments(cols)
    return F.sqrt(ss / F.when(n >= least, n - 1))


def rowwise_std(cols: Sequence[Column]) -> Column:
    """Row-wise sample std (ddof 1) over non-null values; NULL below 2 values."""
    return _std(cols, 2)


def rowwise_std_serving(cols: Sequence[Column], supplied: Column | None = None, min_values: int = 3) -> Column:
    """Supplied value wins; std when >= 3 values present, else 0.0."""
    comp = F.coalesce(_std(cols, min_values), F.lit(0.0))
    return F.coalesce(supplied, comp) if supplied is not None else comp


def ratio_eps(num: Column, den: Column, eps: float = RATIO_EPS) -> Column:
    """``num / (den + eps)``; NULL propagates; a zero denominator gives NULL."""
    return F.try_divide(num.cast("double"), den.cast("double") + F.lit(eps))


def ratio_eps_serving(num: Column, den: Column, supplied: Column | None = None, eps: float = RATIO_EPS) -> Column:
    """D7 scoring variant: NULL inputs count as 0, supplied value wins."""
    comp = ratio_eps(F.coalesce(num.cast("double"), F.lit(0.0)), F.coalesce(den.cast("double"), F.lit(0.0)), eps)
    return F.coalesce(supplied, comp) if supplied is not None else comp


def expected_delta(age: Column, phase_code: Column,
                   expected: Mapping[int, int] = EXPECTED_MAX_AGE_BY_PHASE) -> tuple[Column, Column]:
    """(age - expected age of the phase, mismatch flag delta > 0 with NULL -> 0)."""
    delta = age - F.try_element_at(map_literal(expected), phase_code.try_cast("int"))
    return delta, flag(delta > 0)


def expected_delta_serving(age: Column, phase_code: Column, supplied: Column | None = None,
                           expected: Mapping[int, int] = EXPECTED_MAX_AGE_BY_PHASE,
                           fallback: int = EXPECTED_AGE_FALLBACK) -> tuple[Column, Column]:
    """Supplied delta wins; unmapped phase -> expected ``fallback``; missing age -> 0.0."""
    exp = F.coalesce(F.try_element_at(map_literal(expected), F.coalesce(phase_code, F.lit(0)).try_cast("int")),
                     F.lit(fallback))
    comp = F.when(age.isNotNull(), age.cast("double") - exp).otherwise(F.lit(0.0))
    delta = F.coalesce(supplied.cast("double"), comp) if supplied is not None else comp
    return delta, flag(delta > 0)


def risk_band(p: Column) -> Column:
    """Muito Alto >= .8, Alto >= .6, Moderado >= .4, Baixo >= .2, else Muito Baixo; NULL -> NULL."""
    out = None
    for t, name in RISK_BANDS:
        out = F.when(p >= t, name) if out is None else out.when(p >= t, name)
    return F.when(p.isNotNull(), out.otherwise(RISK_BAND_LOWEST))


def risk_label(prediction: Column) -> Column:
    """Label text of the 0/1 prediction."""
    return F.when(prediction == 1, LABEL_AT_RISK).otherwise(LABEL_NOT_AT_RISK)
