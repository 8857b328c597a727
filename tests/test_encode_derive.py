"""Encodings, derived features and the preparation chains (E*, D*, P*)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurewatch.functions import derive as D
from featurewatch.functions import encode as E
from featurewatch.functions import project as P
from featurewatch.operators.pipeline import (MODEL_FEATURES_NO_IAN, TARGET, serving_features, student_features,
                                             student_preprocess)


def test_target_threshold_rows(spark):
    df = spark.createDataFrame([(-3,), (-1,), (0,), (2,), (None,)], "Defas int")
    got = [r[0] for r in df.select(E.target_flag(F.col("Defas"))).collect()]
    assert got == [1, 1, 0, 0, 0]   # null Defas -> 0 (pandas comparison is false)


def test_encodings_basic(spark):
    df = spark.createDataFrame([("Menina", "Ágata", "Fase 3"), ("Menino", "X", "3"), (None, None, "9x"),
                                ("Outro", "Topázio", "3.7"), ("Menina", "Quartzo", None)], "g string, p string, f string")
    out = df.select(E.encode_map_default(F.col("g"), E.GENDER_MAP).alias("g"),
                    E.encode_ordinal_null(F.col("p"), E.STONE_MAP).alias("p"),
                    E.encode_map_numeric_fallback(F.col("f"), E.PHASE_MAP).alias("f")).collect()
    assert [r.g for r in out] == [0, 1, 0, 0, 0]
    assert [r.p for r in out] == [2, None, None, 4, 1]
    assert [r.f for r in out] == [3, 3, 0, 3, 0]


def test_presence_neutral_fill_unmapped(spark):
    df = spark.createDataFrame([("Ágata",), (None,), ("Unknown",)], "p string")
    flag, code = E.presence_neutral_fill(F.col("p"), E.STONE_MAP)
    rows = df.select(flag.alias("f"), code.alias("c")).collect()
    assert [(r.f, r.c) for r in rows] == [(1, 2), (0, 0), (1, 0)]


@pytest.mark.parametrize("text,code", [
    ("Mantido na mesma fase com ressalvas", 2), ("Promovido de fase", 4), ("Mantido na mesma fase", 3),
    ("Em observação", 1), ("Sem informação", 0), (None, 0), ("algo novo", 0),
    ("  MANTIDO NA MESMA FASE com ressalvas extra ", 2), ("promovido DE FASE", 4)])
def test_first_match_order(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(E.encode_first_match(F.col("t"))).first()[0] == code


def test_flags(spark):
    df = spark.createDataFrame([("Sim", "Destaque IEG", "yes"), ("sim", "Não", "TRUE"), (None, None, "nao")],
                               "a string, d string, l string")
    rows = df.select(E.flag_equals(F.col("a")).alias("a"), E.flag_contains(F.col("d")).alias("d"),
                     E.flag_lenient(df, "l").alias("l"), E.flag_lenient(df, "absent").alias("x")).collect()
    assert [(r.a, r.d, r.l, r.x) for r in rows] == [(1, 1, 1, 0), (0, 0, 1, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("vals", [[1.0, 2.0, 3.0, 10.0], [1.0, 2.0, 3.0], [5.0], [2.5, 2.5, 7.0, 1.0, 9.0, 4.0]])
def test_impute_median_equals_numpy(spark, vals):
    rows = [(v,) for v in vals] + [(None,)]
    df = spark.createDataFrame(rows, "Matem double")
    out = E.impute_median(df, ["Matem"]).collect()
    assert out[-1].Matem == pytest.approx(float(np.median(vals)))


def test_rowwise_std_matches_numpy(spark):
    rows = [(1.0, 2.0, 4.0, None, 8.0), (None, None, 3.0, None, None), (2.0, None, 2.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    out = df.select(D.rowwise_std([F.col(c) for c in "abcde"]).alias("s"),
                    D.rowwise_std_serving([F.col(c) for c in "abcde"]).alias("v")).collect()
    assert out[0].s == pytest.approx(np.std([1, 2, 4, 8], ddof=1))
    assert out[1].s is None and out[1].v == 0.0
    assert out[2].s == pytest.approx(0.0) and out[2].v == 0.0


def test_ratio_and_bands(spark):
    df = spark.createDataFrame([(5.0, 0.0, 0.85), (None, 1.0, 0.6), (2.0, -0.01, 0.2), (1.0, 1.0, 0.19999)],
                               "a double, b double, p double")
    out = df.select(D.ratio_eps(F.col("a"), F.col("b")).alias("r"), D.risk_band(F.col("p")).alias("band")).collect()
    assert out[0].r == pytest.approx(500.0) and out[1].r is None and out[2].r is None
    assert [r.band for r in out] == ["Muito Alto", "Alto", "Baixo", "Muito Baixo"]


def test_expected_delta(spark):
    df = spark.createDataFrame([(12, 1), (10, 1), (20, 9), (None, 3)], "age int, ph int")
    d, m = D.expected_delta(F.col("age"), F.col("ph"))
    ds, ms = D.expected_delta_serving(F.col("age"), F.col("ph"))
    out = df.select(d.alias("d"), m.alias("m"), ds.alias("ds"), ms.alias("ms")).collect()
    assert [(r.d, r.m) for r in out] == [(2, 1), (0, 0), (None, 0), (None, 0)]
    assert [r.ds for r in out] == [2.0, 0.0, 5.0, 0.0]   # unmapped phase -> 15


def test_preprocess_keeps_rows_and_domains(students):
    pre = student_preprocess(students)
    assert pre.count() == students.count()
    assert "Inglês" not in pre.columns and "Tem_nota_ingles" in pre.columns
    r = pre.agg(F.min("Genero_encoded"), F.max("Genero_encoded"), F.max("Escola_encoded"),
                F.count_if(F.col("Matem").isNull()), F.min("Fase_encoded"), F.max("Fase_encoded"),
                F.min("Rec_av1_encoded"), F.max("Rec_av1_encoded")).first()
    assert (r[0], r[1]) == (0, 1) and r[2] <= 2 and r[3] == 0 and r[4] >= 0 and r[5] <= 8 and 0 <= r[6] <= r[7] <= 4
    # target equals Defas <= -1 for every row
    assert pre.filter(F.col(TARGET) != (F.col("Defas") <= -1).cast("int")).count() == 0


def test_features_neutral_delta(students):
    feats = student_features(student_preprocess(students))
    bad = feats.filter((F.col("tinha_pedra_20") == 0) & (F.col("Evolucao_pedra_20_22") != 0)).count()
    assert bad == 0
    assert {"Anos_na_PM", "Variancia_indicadores", "Ratio_IDA_IEG", "mismatch_idade_fase"} <= set(feats.columns)
    assert "delta_idade_fase" not in MODEL_FEATURES_NO_IAN   # leak-prone column excluded from the model


def test_serving_request_mapping(spark):
    rows = [("Menina", 2018, "Topázio", "Ágata", "Sim", "Não", "Fase 3", 7.5),
            ("Menino", 4, "Topázio", None, "não", "sim", "Alfa", None)]
    df = spark.createDataFrame(rows, "Genero string, Ano_ingresso int, `Pedra 22` string, `Pedra 20` string, "
                                     "Atingiu_PV string, Indicado string, Fase string, `Inglês` double")
    out = serving_features(df).collect()
    a, b = out
    assert a.Genero_encoded == 0 and b.Genero_encoded == 1
    assert a.Anos_na_PM == 4 and b.Anos_na_PM == 4
    assert a.Pedra_22_encoded == 4 and a.Evolucao_pedra_20_22 == 2 and a.tinha_pedra_20 == 1
    assert b.Pedra_20_encoded == 0 and b.tinha_pedra_20 == 0 and b.Evolucao_pedra_20_22 == 0
    assert a.Ponto_virada_flag == 1 and a.Indicado_flag == 0 and b.Indicado_flag == 1
    assert a.Fase_encoded == 3 and b.Fase_encoded == 0
    assert a.Tem_nota_ingles == 1 and b.Tem_nota_ingles == 0
    assert a.IAA is None   # unknown feature -> NULL
    assert list(out[0].asDict()) == MODEL_FEATURES_NO_IAN


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1.0, "x", None)], "a double, b string, c double")
    assert P.select_features(df, ["c", "zz", "a"]).columns == ["c", "a"]
    with pytest.raises(ValueError):
        P.select_features_subset(df, ["nope"])
    conf = P.conform_schema(df, ["b", "a", "missing"]).first()
    assert conf.b is None and conf.a == 1.0 and conf.missing is None
    assert P.coerce_fill_zero(df, ["b", "c"]).first().asDict() == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert P.parse_feature_refs(["v:a", "v:b", "w:c"]) == {"v": ["a", "b"], "w": ["c"]}
    with pytest.raises(ValueError):
        P.parse_feature_refs(["bad"])


def test_alias_present_null_does_not_fall_through(spark):
    df = spark.createDataFrame([(None, 5.0)], "INDE_22 double, other double")
    v = df.select(P.resolve_alias(df, ["INDE 22", "INDE_22", "other"]).alias("x")).first().x
    assert v is None


def test_validate_rows(spark):
    df = spark.createDataFrame([(5.0, "A"), (11.0, "A"), (None, "Q")], "x double, k string")
    rules = [P.required("x"), P.in_range("x", 0, 10), P.one_of("k", ["A"])]
    v = P.validate_rows(df, rules).collect()
    assert [r.violations for r in v] == [[], ["x:range"], ["x:required", "k:domain"]]
    s = {r.rule: r.violations for r in P.validate_summary(P.validate_rows(df, rules), rules).collect()}
    assert s == {"x:required": 1, "x:range": 1, "k:domain": 1}


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    out = P.conform_schema(df, ["x"]).collect()
    assert out[0].x is None and not math.isnan(out[1].x)


def test_row_std_is_not_under_a_condition(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    for f, want in ((D.rowwise_std, [1.527525, 1.414214, None]), (D.rowwise_std_serving, [1.527525, 0.0, 0.0])):
        out = df.select(F.round(f([F.col(c) for c in "abc"]), 6).alias("v"))
        assert [r.v for r in out.collect()] == want
        # under a condition Spark computes the mean anew at each of its places
        assert "THEN SQRT" not in out._jdf.queryExecution().optimizedPlan().toString().upper()


def test_conform_schema_rounds_only_what_can_have_decimals(spark):
    df = spark.createDataFrame([(7, 1.23456789, "2.3456789", float("nan")), (None, None, "x", -0.5)], "i int, d double, s string, n double")
    out = P.conform_schema(df, ["i", "d", "s", "n", "absent"], digits=6)
    assert [tuple(r) for r in out.collect()] == [(7.0, 1.234568, 2.345679, None, None), (None, None, None, -0.5, None)]
    assert "round" not in P.conform_schema(df, ["i"], digits=6)._jdf.queryExecution().executedPlan().toString()


def test_serving_projection_is_small_enough_to_be_compiled(spark, tmp_path):
    """HotSpot interprets methods above 8000 bytes of bytecode."""
    from featurewatch.plans.q_features import Q
    from featurewatch.sources.tables import SCHEMAS
    values = {"l_orderkey": 1, "l_linenumber": 2, "l_partkey": 3, "l_suppkey": 60, "l_quantity": 7.0, "l_extendedprice": 12345.678,
              "l_discount": 0.07, "l_tax": 0.02, "l_returnflag": "A", "l_linestatus": "F"}
    row = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMAS["lineitem"].fields]
    spark.range(1).select(*row).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = Q["pipeline_serving_features"](spark, str(tmp_path))
    first = out.first()
    assert (first["IAA"], first["IDA"], first["Idade 22"], first["Fase_encoded"], first["Nº Av"]) == (1.4, 1.234568, 10.0, 2.0, 3.0)
    codegen = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString
    text = codegen(out._jdf.queryExecution().executedPlan())
    assert max(int(part.split(";")[0].split(")")[0]) for part in text.split("maxMethodCodeSize:")[1:]) < 8000
