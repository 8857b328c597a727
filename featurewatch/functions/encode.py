"""Categorical encoding, flags and imputation as column expressions.

Every function returns a ``Column`` (or a DataFrame -> DataFrame transform) of
built-in expressions, so whole-stage codegen covers them; dictionaries are
inlined as ``map(...)`` literals.  Large dictionaries go through
``encode_lookup_join`` instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.functions.nulls import flag

# ---- fixed values (must equal the reference's dictionaries) -------------
GENDER_MAP = {"Menina": 0, "Menino": 1}
SCHOOL_MAP = {"Escola Pública": 0, "Rede Decisão": 1, "Escola JP II": 2}
STONE_MAP = {"Quartzo": 1, "Ágata": 2, "Ametista": 3, "Topázio": 4}
PHASE_MAP = {"Alfa": 0, "Fase 1": 1, "Fase 2": 2, "Fase 3": 3, "Fase 4": 4,
             "Fase 5": 5, "Fase 6": 6, "Fase 7": 7, "Fase 8": 8}
# Ordered: the more specific phrase must be tested before its prefix.
REVIEWER_RULES = [
    ("Mantido na mesma fase com ressalvas", 2),
    ("Promovido de fase", 4),
    ("Mantido na mesma fase", 3),
    ("Em observação", 1),
    ("Sem informação", 0),
]
TRUTHY = ("sim", "yes", "true", "1")
TARGET_THRESHOLD = -1
# --------------------------------------------------------------------------


def map_literal(mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def target_flag(c: Column, threshold: float = TARGET_THRESHOLD) -> Column:
    """``c <= threshold`` -> 1, else 0; NULL -> 0."""
    return flag(c <= F.lit(threshold))


def encode_map_default(c: Column, mapping: Mapping, default: int = 0) -> Column:
    """Dictionary code, unmapped or NULL -> ``default``."""
    return F.coalesce(F.try_element_at(map_literal(mapping), c), F.lit(default))


def encode_ordinal_null(c: Column, mapping: Mapping) -> Column:
    """Dictionary code, unmapped -> NULL."""
    return F.try_element_at(map_literal(mapping), c)


def presence_neutral_fill(raw: Column, mapping: Mapping) -> tuple[Column, Column]:
    """(flag = raw present, code with NULL -> 0).  An unmapped non-null raw
    value yields flag 1 and code 0."""
    return raw.isNotNull().cast("int"), F.coalesce(encode_ordinal_null(raw, mapping), F.lit(0))


def encode_map_numeric_fallback(c: Column, mapping: Mapping) -> Column:
    """E5: dictionary, else numeric parse, else 0; truncated to int."""
    return F.coalesce(F.try_element_at(map_literal(mapping), c).cast("double"),
                      c.try_cast("double"), F.lit(0.0)).try_cast("int")


def flag_equals(c: Column, value: str = "Sim") -> Column:
    """Exact, case-sensitive equality; NULL -> 0."""
    return flag(c == F.lit(value))


def flag_contains(c: Column, needle: str = "Destaque") -> Column:
    """String contains ``needle``; NULL -> 0."""
    return flag(F.contains(c, F.lit(needle)))


def encode_first_match(c: Column, rules: Sequence[tuple[str, int]] = tuple(REVIEWER_RULES),
                       default: int = 0) -> Column:
    """lower+trim, first phrase contained wins (rule order), else default; NULL -> default."""
    norm = F.lower(F.trim(c))
    out = None
    for phrase, code in rules:
        cond = F.contains(norm, F.lit(phrase.lower()))
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return F.coalesce(out.otherwise(F.lit(default)), F.lit(default))


def flag_present(c: Column) -> Column:
    """1 when not NULL."""
    return c.isNotNull().cast("int")


def flag_and_drop(df: DataFrame, source: str, flag_name: str) -> DataFrame:
    """Presence flag, then drop the source column."""
    return df.withColumn(flag_name, flag_present(F.col(f"`{source}`"))).drop(source)


def impute_median(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the exact (interpolated) median of each column over
    ``fit`` (default: the same frame).  All columns are reduced to
    ``(column, value) -> count`` in one pass and ranked by ranges, so no task
    holds a column's values; the medians are attached by one scalar subquery.  A
    column without any value keeps its NULLs."""
    from featurewatch.operators.log_stats import exact_percentiles
    src = fit if fit is not None else df
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    long = src.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "__column", "__value")
    med = exact_percentiles(long, "__value", [0.5], groups=["__column"]).agg(
        F.struct(*[F.max(F.when(F.col("__column") == c, F.col("p_0"))).alias(f"m{i}") for i, c in enumerate(cols)]).alias("medians")).scalar()
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), med[f"m{i}"]) for i, c in enumerate(cols)})


def flag_lenient(df: DataFrame, name: str) -> Column:
    """Strings sim/yes/true/1 (any case) -> 1, other text -> 0, number ->
    int, absent column or NULL -> 0.  Dispatch on the column type at plan time."""
    if name not in df.columns:
        return F.lit(0)
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if isinstance(dt, T.StringType):
        return flag(F.lower(c).isin(*TRUTHY))
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    return F.coalesce(c.try_cast("int"), F.lit(0))


def encode_serving(df: DataFrame, name: str, mapping: Mapping, default: int = 0) -> Column:
    """Scoring-time encoding: numeric passes through, text is mapped,
    unmapped / absent -> default (no numeric parse of text)."""
    if name not in df.columns:
        return F.lit(default)
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return encode_map_default(c, mapping, default)
    return F.coalesce(c.try_cast("int"), F.lit(default))


def encode_lookup_join(df: DataFrame, key: str, dim: DataFrame, dim_key: str, code_col: str,
                       out: str, default: int | None = 0) -> DataFrame:
    """Dictionary lookup as a join; the planner and adaptive execution
    choose broadcast or shuffle by the dictionary's size in bytes."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(code_col).alias(out))
    j = df.join(d, df[key] == F.col("__k"), "left").drop("__k")
    return j if default is None else j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
