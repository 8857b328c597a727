"""Projections, renames, schema conformance and row validation.

Column availability checks happen at plan time on ``df.columns`` (no job),
so the emitted plan only touches columns that exist and Catalyst prunes the
scan to exactly those.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.functions.nulls import nan_to_null

log = logging.getLogger(__name__)

# ---- fixed values: store-safe names of the reference's special columns ----
COLUMN_RENAME_MAP = {
    "INDE 22": "INDE_22",
    "Idade 22": "Idade_22",
    "Nº Av": "N_Av",
}
COLUMN_RENAME_INVERSE = {v: k for k, v in COLUMN_RENAME_MAP.items()}
# ---------------------------------------------------------------------------


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def select_features(df: DataFrame, wanted: Sequence[str], target: str | None = None) -> DataFrame:
    """Wanted features in the given order; absent ones skipped (warning)."""
    present = [c for c in wanted if c in df.columns]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        log.warning("features not found, skipped: %s", missing)
    cols = present + ([target] if target and target in df.columns else [])
    return df.select(*[_q(c) for c in cols])


def select_features_subset(df: DataFrame, selected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """User subset; keep the available ones, error when none is available."""
    avail = [c for c in selected if c in df.columns]
    if not avail:
        raise ValueError(f"none of the selected features is available: {list(selected)}")
    return df.select(*[_q(c) for c in list(keep) + avail])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename present columns (``withColumnsRenamed``; absent keys ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def conform_schema(df: DataFrame, feature_names: Sequence[str], keep: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Exactly ``feature_names`` in order, absent -> NULL, all cast to double
    with unparseable values (and NaN) -> NULL, and rounded if ``digits`` is given.
    Integer columns can hold neither NaN nor decimals: the cast is all they need,
    which keeps the generated code of a wide projection small enough to be compiled."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [_q(k) for k in keep]
    for c in feature_names:
        if c not in types:
            e = F.lit(None).cast("double")
        elif isinstance(types[c], T.IntegralType):
            e = _q(c).cast("double")
        else:
            e = nan_to_null(_q(c).try_cast("double"))
            e = e if digits is None else F.round(e, digits)
        cols.append(e.alias(c))
    return df.select(*cols)


def coerce_fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: numeric coercion (bad -> NULL) then NULL -> 0 (store ingest)."""
    return df.withColumns({c: F.coalesce(nan_to_null(_q(c).try_cast("double")), F.lit(0.0))
                           for c in cols if c in df.columns})


def resolve_alias(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The first alias that is a *present column* wins (a present NULL does
    not fall through to the next alias, unlike ``coalesce``)."""
    for a in aliases:
        if a in df.columns:
            return _q(a)
    return F.lit(None)


def parse_feature_refs(refs: Sequence[str]) -> dict[str, list[str]]:
    """P10: ``view:feature`` references grouped by view, order kept."""
    out: dict[str, list[str]] = {}
    for r in refs:
        view, _, feat = r.partition(":")
        if not feat:
            raise ValueError(f"bad feature reference {r!r}; expected 'view:feature'")
        out.setdefault(view, []).append(feat)
    return out


# ---------------------------------------------------------------- validation

@dataclass(frozen=True)
class Rule:
    """A named row rule; ``check`` is true for a valid row.  NULL input fails
    ``required`` rules only; range rules pass on NULL (optional fields)."""
    name: str
    check: Column


def required(c: str) -> Rule:
    return Rule(f"{c}:required", _q(c).isNotNull())


def in_range(c: str, lo: float | None = None, hi: float | None = None) -> Rule:
    e = _q(c)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (e >= lo)
    if hi is not None:
        cond = cond & (e <= hi)
    return Rule(f"{c}:range", e.isNull() | cond)


def one_of(c: str, values: Sequence) -> Rule:
    return Rule(f"{c}:domain", _q(c).isNull() | _q(c).isin(*values))


def validate_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``violations`` = names of failed rules (ARRAY<STRING>), ``valid`` flag.
    Split with ``filter(valid)`` / ``filter(~valid)`` into clean / quarantine."""
    fails = [F.when(~F.coalesce(r.check, F.lit(False)), F.lit(r.name)) for r in rules]
    v = F.filter(F.array(*fails), lambda x: x.isNotNull())
    return df.withColumn("violations", v).withColumn("valid", F.size("violations") == 0)


def validate_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """P6 summary: rows, valid, quarantined and the violation count per rule,
    in one aggregate over the (raw or validated) table."""
    validated = df
    # counts come straight from the rule predicates (no array scan per row)
    fails = [~F.coalesce(r.check, F.lit(False)) for r in rules]
    any_fail = F.lit(False)
    for f in fails:
        any_fail = any_fail | f
    aggs = [F.count(F.lit(1)).alias("rows"), F.count_if(~any_fail).alias("valid"),
            F.count_if(any_fail).alias("quarantined")]
    aggs += [F.count_if(f).alias(f"v{i}") for i, f in enumerate(fails)]
    a = validated.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations"))
                     for i, r in enumerate(rules)])
    return a.select("rows", "valid", "quarantined", F.inline(rows))
