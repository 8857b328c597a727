"""Preparation chains (E15, D12, D13): lazy ``withColumns`` steps, one job.

``student_*`` functions follow the reference's raw schema (FIXTURES F1) and
guard every step on column presence at plan time.  ``apply_steps`` runs an
arbitrary ordered list of ``{output: Column}`` steps, which is how the same
chain runs on other tables (see plans/q_features.py).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurewatch.functions import derive as D
from featurewatch.functions import encode as E
from featurewatch.functions.project import conform_schema, resolve_alias

Step = Callable[[DataFrame], dict[str, Column]]

# Feature order expected by the model (fixed value of the reference; IAN off by default).
MODEL_FEATURES = [
    "IAA", "IEG", "IPS", "IDA", "IPV", "IAN", "INDE 22", "Matem", "Portug",
    "Idade 22", "Genero_encoded", "Escola_encoded", "Anos_na_PM", "Fase_encoded",
    "Pedra_20_encoded", "Pedra_21_encoded", "Pedra_22_encoded",
    "Evolucao_pedra_20_22", "Evolucao_pedra_21_22", "tinha_pedra_20", "tinha_pedra_21",
    "Ponto_virada_flag", "Indicado_flag", "Destaque_IEG_flag", "Destaque_IDA_flag", "Destaque_IPV_flag",
    "Tem_nota_ingles", "Rec_av1_encoded", "Rec_av2_encoded",
    "Cf", "Ct", "Nº Av", "tem_ranking_cf", "tem_ranking_ct",
    "Variancia_indicadores", "Ratio_IDA_IEG",
]
MODEL_FEATURES_NO_IAN = [f for f in MODEL_FEATURES if f != "IAN"]
TARGET = "risco_defasagem"
INDICATORS = ["IAA", "IEG", "IPS", "IDA", "IPV"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply ordered steps; each sees the columns produced by earlier ones."""
    for step in steps:
        cols = step(df)
        if cols:
            df = df.withColumns(cols)
    return df


# ------------------------------------------------------------- E15 (training)

def student_preprocess(df: DataFrame, threshold: float = E.TARGET_THRESHOLD,
                       impute_from: DataFrame | None = None) -> DataFrame:
    """E1 target -> E2..E9 encodings -> E10/E11 missing values; row count unchanged."""
    has = set(df.columns)
    out: dict[str, Column] = {}
    if "Defas" in has:
        out[TARGET] = E.target_flag(_c("Defas"), threshold)
    if "Gênero" in has:
        out["Genero_encoded"] = E.encode_map_default(_c("Gênero"), E.GENDER_MAP)
    if "Instituição de ensino" in has:
        out["Escola_encoded"] = E.encode_map_default(_c("Instituição de ensino"), E.SCHOOL_MAP)
    for y in ("20", "21", "22"):
        if f"Pedra {y}" in has:
            out[f"Pedra_{y}_encoded"] = E.encode_ordinal_null(_c(f"Pedra {y}"), E.STONE_MAP)
    for y in ("20", "21"):
        if f"Pedra {y}" in has:
            flag, code = E.presence_neutral_fill(_c(f"Pedra {y}"), E.STONE_MAP)
            out[f"tinha_pedra_{y}"] = flag
            out[f"Pedra_{y}_encoded"] = code
    if "Fase" in has:
        out["Fase_encoded"] = E.encode_map_numeric_fallback(_c("Fase"), E.PHASE_MAP)
    if "Atingiu PV" in has:
        out["Ponto_virada_flag"] = E.flag_equals(_c("Atingiu PV"))
    if "Indicado" in has:
        out["Indicado_flag"] = E.flag_equals(_c("Indicado"))
    for d in ("IEG", "IDA", "IPV"):
        if f"Destaque {d}" in has:
            out[f"Destaque_{d}_flag"] = E.flag_contains(_c(f"Destaque {d}"))
    for i in (1, 2):
        if f"Rec Av{i}" in has:
            out[f"Rec_av{i}_encoded"] = E.encode_first_match(_c(f"Rec Av{i}"))
    for src, name in (("Cf", "tem_ranking_cf"), ("Ct", "tem_ranking_ct")):
        if src in has:
            out[name] = E.flag_present(_c(src))
    df = df.withColumns(out)
    df = E.impute_median(df, ["Matem", "Portug"], fit=impute_from)
    if "Inglês" in df.columns:
        df = E.flag_and_drop(df, "Inglês", "Tem_nota_ingles")
    return df


# ------------------------------------------------------------- D12 (training)

def student_features(df: DataFrame, ref_year: int = D.REFERENCE_YEAR) -> DataFrame:
    """D1, D3, D5, D7, D8 on the preprocessed table; original columns kept."""
    has = set(df.columns)
    out: dict[str, Column] = {}
    if "Ano ingresso" in has:
        out["Anos_na_PM"] = D.years_since(_c("Ano ingresso"), ref_year)
    for y in ("20", "21"):
        if f"Pedra_{y}_encoded" in has and "Pedra_22_encoded" in has:
            flag = _c(f"tinha_pedra_{y}") if f"tinha_pedra_{y}" in has else F.lit(1)
            out[f"Evolucao_pedra_{y}_22"] = D.delta_neutral(_c("Pedra_22_encoded"), _c(f"Pedra_{y}_encoded"), flag)
    ind = [c for c in INDICATORS if c in has]
    if len(ind) >= 3:
        out["Variancia_indicadores"] = D.rowwise_std([_c(c) for c in ind])
    if "IDA" in has and "IEG" in has:
        out["Ratio_IDA_IEG"] = D.ratio_eps(_c("IDA"), _c("IEG"))
    if "Idade 22" in has and "Fase_encoded" in has:
        delta, mismatch = D.expected_delta(_c("Idade 22"), _c("Fase_encoded"))
        out["delta_idade_fase"] = delta
        out["mismatch_idade_fase"] = mismatch
    return df.withColumns(out)


# --------------------------------------------------------------- D13 (serving)

_DIRECT = {  # model feature -> accepted input names, first present wins (fixed value)
    "IAA": ["IAA"], "IEG": ["IEG"], "IPS": ["IPS"], "IDA": ["IDA"], "IPV": ["IPV"], "IAN": ["IAN"],
    "INDE 22": ["INDE 22", "INDE_22"], "Matem": ["Matem"], "Portug": ["Portug"],
    "Idade 22": ["Idade 22", "Idade_22"], "Cf": ["Cf"], "Ct": ["Ct"], "Nº Av": ["Nº Av", "N_Av"],
}


def serving_features(df: DataFrame, feature_names: Sequence[str] = tuple(MODEL_FEATURES_NO_IAN),
                     keep: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Request rows (any alias spelling) -> model features in model order, rounded if ``digits`` is given.
    One alias table covers spaced, accented and underscored names, so fields
    the reference silently lost (gender, PV, highlights) are honoured."""
    cols = set(df.columns)

    def pick(*names):
        return resolve_alias(df, names)

    def first(*names):
        return next((n for n in names if n in cols), None)

    f: dict[str, Column] = {name: pick(*aliases) for name, aliases in _DIRECT.items()}
    g = first("Genero_encoded", "Gênero", "Genero")
    f["Genero_encoded"] = E.encode_serving(df, g, E.GENDER_MAP) if g else F.lit(0)
    s = first("Escola_encoded", "Instituição de ensino", "Instituicao_ensino")
    f["Escola_encoded"] = E.encode_serving(df, s, E.SCHOOL_MAP) if s else F.lit(0)
    ph = first("Fase_encoded", "Fase")
    f["Fase_encoded"] = E.encode_serving(df, ph, E.PHASE_MAP) if ph else F.lit(0)
    an = first("Anos_na_PM", "Ano ingresso", "Ano_ingresso")
    f["Anos_na_PM"] = D.years_since_or_count(_c(an)) if an else F.lit(None)
    for y in ("20", "21", "22"):
        p = first(f"Pedra_{y}_encoded", f"Pedra {y}", f"Pedra_{y}")
        if p is None:
            f[f"Pedra_{y}_encoded"] = F.lit(None).cast("int")
        elif df.schema[p].dataType.simpleString() == "string":
            f[f"Pedra_{y}_encoded"] = E.encode_ordinal_null(_c(p), E.STONE_MAP)
        else:
            f[f"Pedra_{y}_encoded"] = _c(p).try_cast("int")
    for y in ("20", "21"):
        f[f"tinha_pedra_{y}"] = f[f"Pedra_{y}_encoded"].isNotNull().cast("int")
    for y in ("20", "21"):
        sup = _c(f"Evolucao_pedra_{y}_22") if f"Evolucao_pedra_{y}_22" in cols else None
        f[f"Evolucao_pedra_{y}_22"] = D.delta_neutral_serving(
            f["Pedra_22_encoded"], f[f"Pedra_{y}_encoded"], f[f"tinha_pedra_{y}"], sup)
    for y in ("20", "21"):
        f[f"Pedra_{y}_encoded"] = F.when(f[f"tinha_pedra_{y}"] == 0, F.lit(0)).otherwise(f[f"Pedra_{y}_encoded"])
    f["tem_ranking_cf"] = f["Cf"].isNotNull().cast("int")
    f["tem_ranking_ct"] = f["Ct"].isNotNull().cast("int")
    ing = first("Inglês", "Ingles")
    if "Tem_nota_ingles" in cols:
        f["Tem_nota_ingles"] = F.coalesce(_c("Tem_nota_ingles").try_cast("int"),
                                          _c(ing).isNotNull().cast("int") if ing else F.lit(0))
    else:
        f["Tem_nota_ingles"] = _c(ing).isNotNull().cast("int") if ing else F.lit(0)
    for name, keys in (("Ponto_virada_flag", ("Ponto_virada_flag", "Atingiu_PV", "Atingiu PV")),
                       ("Indicado_flag", ("Indicado_flag", "Indicado")),
                       ("Destaque_IEG_flag", ("Destaque_IEG_flag", "Destaque_IEG", "Destaque IEG")),
                       ("Destaque_IDA_flag", ("Destaque_IDA_flag", "Destaque_IDA", "Destaque IDA")),
                       ("Destaque_IPV_flag", ("Destaque_IPV_flag", "Destaque_IPV", "Destaque IPV"))):
        k = first(*keys)
        if k is None:
            f[name] = F.lit(0)
        elif name.startswith("Destaque") and df.schema[k].dataType.simpleString() == "string":
            # highlight text: lenient truthy words or the "Destaque ..." phrase
            f[name] = F.greatest(E.flag_lenient(df, k), E.flag_contains(_c(k)))
        else:
            f[name] = E.flag_lenient(df, k)
    for i in (1, 2):
        k = first(f"Rec_av{i}_encoded", f"Rec Av{i}")
        if k is None:
            f[f"Rec_av{i}_encoded"] = F.lit(0)
        elif df.schema[k].dataType.simpleString() == "string":
            f[f"Rec_av{i}_encoded"] = E.encode_first_match(_c(k))
        else:
            f[f"Rec_av{i}_encoded"] = F.coalesce(_c(k).try_cast("int"), F.lit(0))
    sup_std = _c("Variancia_indicadores") if "Variancia_indicadores" in cols else None
    f["Variancia_indicadores"] = D.rowwise_std_serving([f[c] for c in INDICATORS], sup_std)
    sup_ratio = _c("Ratio_IDA_IEG") if "Ratio_IDA_IEG" in cols else None
    f["Ratio_IDA_IEG"] = D.ratio_eps_serving(f["IDA"], f["IEG"], sup_ratio)
    sup_delta = _c("delta_idade_fase") if "delta_idade_fase" in cols else None
    f["delta_idade_fase"], f["mismatch_idade_fase"] = D.expected_delta_serving(
        f["Idade 22"], f["Fase_encoded"], sup_delta)
    staged = df.select(*[_c(k) for k in keep], *[e.alias(n) for n, e in f.items()])
    return conform_schema(staged, feature_names, keep=keep, digits=digits)
