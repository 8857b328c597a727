"""Encoding, derived-feature, projection and validation queries (E*, D*, P*, J9)
on the driver tables.  Each key applies the library function to driver
columns chosen for the same role as in the reference (see SURVEY §7.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurewatch.functions import derive as D
from featurewatch.functions import encode as E
from featurewatch.functions import project as P
from featurewatch.operators.pipeline import apply_steps
from featurewatch.sources.tables import load

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LI_KEY_SQL = ", ".join(LI_KEY)

SEGMENT_MAP = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "MACHINERY": 3}
SEGMENT_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 END"
PRIORITY_MAP = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 1}
PRIORITY_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 "
                "WHEN '5-LOW' THEN 1 END")
STATUS_MAP = {"F": 1}
PRIORITY_TEXT_MAP = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
NAME_RULES = [("small gizmo", 5), ("small", 4), ("gear", 3), ("bolt", 2), ("ring", 1)]


def _mixed_priority():
    """Text that is sometimes a dictionary word, sometimes a number, sometimes junk."""
    return (F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
            .when(F.col("o_orderstatus") == "O", F.substring("o_orderpriority", 1, 1))
            .otherwise(F.concat(F.lit("x"), F.col("o_orderpriority"))))


MIXED_SQL = ("CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' "
             "THEN substring(o_orderpriority, 1, 1) ELSE 'x' || o_orderpriority END")
MIXED_CODE_SQL = (f"CAST(trunc(coalesce(CAST(CASE {MIXED_SQL} WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 "
                  f"WHEN '3-MEDIUM' THEN 3 END AS DOUBLE), TRY_CAST({MIXED_SQL} AS DOUBLE), 0.0)) AS INTEGER)")


# ------------------------------------------------------------------ E1-E14

@q("target_threshold")
def target_threshold(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", "c_acctbal", E.target_flag(F.col("c_acctbal"), -1).alias("target"))


SQL["target_threshold"] = """
SELECT c_custkey, c_acctbal, CAST(coalesce(c_acctbal <= -1, false) AS INTEGER) AS target FROM customer"""


@q("encode_map_default")
def encode_map_default(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", E.encode_map_default(F.col("c_mktsegment"), SEGMENT_MAP).alias("segment_code"))


SQL["encode_map_default"] = f"SELECT c_custkey, coalesce({SEGMENT_SQL}, 0) AS segment_code FROM customer"


@q("encode_ordinal_null")
def encode_ordinal_null(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", E.encode_ordinal_null(F.col("o_orderpriority"), PRIORITY_MAP).alias("priority_code"))


SQL["encode_ordinal_null"] = f"SELECT o_orderkey, {PRIORITY_SQL} AS priority_code FROM orders"


@q("presence_neutral_fill")
def presence_neutral_fill(spark, d):
    o = load(spark, d, "orders")
    flag, code = E.presence_neutral_fill(F.nullif(F.col("o_orderstatus"), F.lit("P")), STATUS_MAP)
    return o.select("o_orderkey", flag.alias("had_status"), code.alias("status_code"))


SQL["presence_neutral_fill"] = """
SELECT o_orderkey, CAST(nullif(o_orderstatus, 'P') IS NOT NULL AS INTEGER) AS had_status,
  coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS status_code FROM orders"""


@q("encode_map_numeric_fallback")
def encode_map_numeric_fallback(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", E.encode_map_numeric_fallback(_mixed_priority(), PRIORITY_TEXT_MAP)
                    .alias("priority_num"))


SQL["encode_map_numeric_fallback"] = f"SELECT o_orderkey, {MIXED_CODE_SQL} AS priority_num FROM orders"


@q("flag_equals")
def flag_equals(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", E.flag_equals(F.col("c_mktsegment"), "BUILDING").alias("is_building"))


SQL["flag_equals"] = """
SELECT c_custkey, CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INTEGER) AS is_building FROM customer"""


@q("flag_contains")
def flag_contains(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", E.flag_contains(F.col("p_name"), "gear").alias("is_gear"))


SQL["flag_contains"] = """
SELECT p_partkey, CAST(coalesce(contains(p_name, 'gear'), false) AS INTEGER) AS is_gear FROM part"""


@q("encode_first_match")
def encode_first_match(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", E.encode_first_match(F.col("p_name"), NAME_RULES).alias("name_code"))


_FIRST_MATCH_SQL = ("CASE WHEN contains(lower(trim(p_name)), 'small gizmo') THEN 5 "
                    "WHEN contains(lower(trim(p_name)), 'small') THEN 4 WHEN contains(lower(trim(p_name)), 'gear') THEN 3 "
                    "WHEN contains(lower(trim(p_name)), 'bolt') THEN 2 WHEN contains(lower(trim(p_name)), 'ring') THEN 1 "
                    "ELSE 0 END")
SQL["encode_first_match"] = f"SELECT p_partkey, {_FIRST_MATCH_SQL} AS name_code FROM part"


def _balance():
    return F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))


@q("flag_present")
def flag_present(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", E.flag_present(_balance()).alias("has_balance"))


SQL["flag_present"] = """
SELECT c_custkey, CAST((CASE WHEN c_acctbal >= 0 THEN c_acctbal END) IS NOT NULL AS INTEGER) AS has_balance FROM customer"""


@q("flag_and_drop")
def flag_and_drop(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", _balance().alias("balance"))
    return E.flag_and_drop(c, "balance", "has_balance")


SQL["flag_and_drop"] = """
SELECT c_custkey, c_mktsegment, CAST((CASE WHEN c_acctbal >= 0 THEN c_acctbal END) IS NOT NULL AS INTEGER) AS has_balance
FROM customer"""


@q("impute_median")
def impute_median(spark, d):
    li = load(spark, d, "lineitem").select(
        *LI_KEY, F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))
    return E.impute_median(li, ["discount", "tax"])


SQL["impute_median"] = f"""WITH t AS (
  SELECT {LI_KEY_SQL}, CASE WHEN l_discount > 0 THEN l_discount END AS discount,
         CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem)
SELECT {LI_KEY_SQL}, coalesce(discount, (SELECT median(discount) FROM t)) AS discount,
  coalesce(tax, (SELECT median(tax) FROM t)) AS tax FROM t"""


@q("flag_lenient")
def flag_lenient(spark, d):
    ev = load(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return ev.select("event_id", E.flag_lenient(ev, "k").alias("flag_k"),
                     E.flag_lenient(ev, "event_type").alias("flag_type"),
                     E.flag_lenient(ev, "absent_field").alias("flag_absent"))


SQL["flag_lenient"] = """
SELECT event_id,
  CAST(coalesce(lower(json_extract_string(props, '$.k')) IN ('sim', 'yes', 'true', '1'), false) AS INTEGER) AS flag_k,
  CAST(coalesce(lower(event_type) IN ('sim', 'yes', 'true', '1'), false) AS INTEGER) AS flag_type,
  0 AS flag_absent
FROM events"""


@q("encode_serving")
def encode_serving(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", E.encode_serving(c, "c_mktsegment", SEGMENT_MAP).alias("segment_code"),
                    E.encode_serving(c, "c_nationkey", SEGMENT_MAP).alias("nation_code"),
                    E.encode_serving(c, "absent_field", SEGMENT_MAP).alias("absent_code"))


SQL["encode_serving"] = f"""
SELECT c_custkey, coalesce({SEGMENT_SQL}, 0) AS segment_code, coalesce(c_nationkey, 0) AS nation_code, 0 AS absent_code
FROM customer"""


@q("encode_lookup_join")
def encode_lookup_join(spark, d):
    li = load(spark, d, "lineitem").select(*LI_KEY)
    part = load(spark, d, "part")
    return E.encode_lookup_join(li, "l_partkey", part, "p_partkey", "p_size", "size_code")


SQL["encode_lookup_join"] = f"""
SELECT {LI_KEY_SQL}, coalesce(p.p_size, 0) AS size_code FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey"""


# ------------------------------------------------------- E15: preprocess chain

def _preprocess_steps():
    def s1(df):
        flag, code = E.presence_neutral_fill(F.nullif(F.col("o_orderstatus"), F.lit("P")), STATUS_MAP)
        return {"target": E.target_flag(F.col("o_totalprice"), 150000.0),
                "priority_code": E.encode_ordinal_null(F.col("o_orderpriority"), PRIORITY_MAP),
                "had_status": flag, "status_code": code,
                "priority_num": E.encode_map_numeric_fallback(_mixed_priority(), PRIORITY_TEXT_MAP),
                "is_urgent": E.flag_equals(F.col("o_orderpriority"), "1-URGENT"),
                "is_low": E.flag_contains(F.col("o_orderpriority"), "LOW"),
                "price": F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice"))}
    return [s1]


def preprocessed_orders(spark, d):
    o = load(spark, d, "orders")
    df = apply_steps(o, _preprocess_steps())
    df = E.impute_median(df, ["price"])
    return df.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "target", "priority_code",
                     "had_status", "status_code", "priority_num", "is_urgent", "is_low", "price")


_PRE_SQL = f"""pre0 AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
    CAST(coalesce(o_totalprice <= 150000.0, false) AS INTEGER) AS target,
    {PRIORITY_SQL} AS priority_code,
    CAST(nullif(o_orderstatus, 'P') IS NOT NULL AS INTEGER) AS had_status,
    coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS status_code,
    {MIXED_CODE_SQL} AS priority_num,
    CAST(coalesce(o_orderpriority = '1-URGENT', false) AS INTEGER) AS is_urgent,
    CAST(coalesce(contains(o_orderpriority, 'LOW'), false) AS INTEGER) AS is_low,
    CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price0
  FROM orders),
pre AS (SELECT * EXCLUDE (price0), coalesce(price0, (SELECT median(price0) FROM pre0)) AS price FROM pre0)"""


@q("pipeline_preprocess")
def pipeline_preprocess(spark, d):
    return preprocessed_orders(spark, d)


SQL["pipeline_preprocess"] = f"WITH {_PRE_SQL} SELECT * FROM pre"


# ------------------------------------------------------------------ D1-D11

@q("years_since")
def years_since(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", D.years_since(F.year("o_orderdate")).cast("long").alias("years"))


SQL["years_since"] = "SELECT o_orderkey, CAST(2022 - year(o_orderdate) AS BIGINT) AS years FROM orders"


@q("years_since_or_count")
def years_since_or_count(spark, d):
    o = load(spark, d, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).otherwise(2001 - F.year("o_orderdate"))
    return o.select("o_orderkey", D.years_since_or_count(raw).cast("long").alias("years"))


SQL["years_since_or_count"] = """WITH t AS (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) ELSE 2001 - year(o_orderdate) END AS raw FROM orders)
SELECT o_orderkey, CAST(CASE WHEN raw > 100 THEN 2022 - raw ELSE raw END AS BIGINT) AS years FROM t"""


def _delta_inputs(spark, d):
    o = load(spark, d, "orders")
    flag, code = E.presence_neutral_fill(F.nullif(F.col("o_orderstatus"), F.lit("P")), STATUS_MAP)
    return o.select("o_orderkey", E.encode_ordinal_null(F.col("o_orderpriority"), PRIORITY_MAP).alias("later"),
                    code.alias("earlier"), flag.alias("had"))


_DELTA_SQL = f"""t AS (SELECT o_orderkey, {PRIORITY_SQL} AS later,
  coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS earlier,
  CAST(nullif(o_orderstatus, 'P') IS NOT NULL AS INTEGER) AS had FROM orders)"""


@q("delta_neutral")
def delta_neutral(spark, d):
    t = _delta_inputs(spark, d)
    return t.select("o_orderkey", D.delta_neutral(F.col("later"), F.col("earlier"), F.col("had")).alias("delta"))


SQL["delta_neutral"] = f"""WITH {_DELTA_SQL}
SELECT o_orderkey, CASE WHEN had = 0 THEN 0 ELSE later - earlier END AS delta FROM t"""


@q("delta_neutral_serving")
def delta_neutral_serving(spark, d):
    t = _delta_inputs(spark, d)
    return t.select("o_orderkey", D.delta_neutral_serving(F.col("later"), F.col("earlier"), F.col("had"))
                    .alias("delta"))


SQL["delta_neutral_serving"] = f"""WITH {_DELTA_SQL}
SELECT o_orderkey, CASE WHEN had = 0 THEN 0 WHEN later IS NOT NULL AND earlier IS NOT NULL THEN later - earlier
  ELSE 0 END AS delta FROM t"""


def _row_values():
    return [F.when(F.col("l_quantity") > 10, F.col("l_quantity")),
            F.when(F.col("l_linenumber") > 3, F.col("l_extendedprice") / 1000),
            F.when(F.col("l_discount") > 0, F.col("l_discount") * 100),
            F.when(F.col("l_tax") > 0, F.col("l_tax") * 100)]


_ROW_SQL = f"""t AS (SELECT {LI_KEY_SQL}, list_filter([
    CASE WHEN l_quantity > 10 THEN l_quantity END, CASE WHEN l_linenumber > 3 THEN l_extendedprice / 1000 END,
    CASE WHEN l_discount > 0 THEN l_discount * 100 END, CASE WHEN l_tax > 0 THEN l_tax * 100 END],
    lambda x: x IS NOT NULL) AS v FROM lineitem),
s AS (SELECT *, len(v) AS n, list_sum(v) / len(v) AS mu FROM t),
s2 AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) AS ss FROM s)"""


@q("rowwise_std")
def rowwise_std(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(*LI_KEY, F.round(D.rowwise_std(_row_values()), 6).alias("row_std"))


SQL["rowwise_std"] = f"""WITH {_ROW_SQL}
SELECT {LI_KEY_SQL}, round(CASE WHEN n >= 2 THEN sqrt(ss / (n - 1)) END, 6) AS row_std FROM s2"""


@q("rowwise_std_serving")
def rowwise_std_serving(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(*LI_KEY, F.round(D.rowwise_std_serving(_row_values()), 6).alias("row_std"))


SQL["rowwise_std_serving"] = f"""WITH {_ROW_SQL}
SELECT {LI_KEY_SQL}, round(CASE WHEN n >= 3 THEN sqrt(ss / (n - 1)) ELSE 0.0 END, 6) AS row_std FROM s2"""


@q("ratio_eps")
def ratio_eps(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(*LI_KEY, F.round(D.ratio_eps(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"))


SQL["ratio_eps"] = f"SELECT {LI_KEY_SQL}, round(l_discount / (l_tax + 0.01), 6) AS ratio FROM lineitem"

_EXP_SQL = ("CASE l_linenumber + 2 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 14 WHEN 4 THEN 15 "
            "WHEN 5 THEN 16 WHEN 6 THEN 17 WHEN 7 THEN 18 WHEN 8 THEN 19 END")


@q("expected_delta_flag")
def expected_delta_flag(spark, d):
    li = load(spark, d, "lineitem")
    delta, flag = D.expected_delta(F.col("l_quantity"), F.col("l_linenumber") + 2)
    return li.select(*LI_KEY, delta.alias("delta"), flag.alias("mismatch"))


SQL["expected_delta_flag"] = f"""
SELECT {LI_KEY_SQL}, l_quantity - ({_EXP_SQL}) AS delta,
  CAST(coalesce(l_quantity - ({_EXP_SQL}) > 0, false) AS INTEGER) AS mismatch FROM lineitem"""


@q("expected_delta_serving")
def expected_delta_serving(spark, d):
    li = load(spark, d, "lineitem")
    delta, flag = D.expected_delta_serving(F.col("l_quantity"), F.col("l_linenumber") + 2)
    return li.select(*LI_KEY, delta.alias("delta"), flag.alias("mismatch"))


SQL["expected_delta_serving"] = f"""
SELECT {LI_KEY_SQL}, l_quantity - coalesce({_EXP_SQL}, 15) AS delta,
  CAST(l_quantity - coalesce({_EXP_SQL}, 15) > 0 AS INTEGER) AS mismatch FROM lineitem"""

_BAND_SQL = """CASE WHEN p >= 0.8 THEN 'Muito Alto' WHEN p >= 0.6 THEN 'Alto' WHEN p >= 0.4 THEN 'Moderado'
  WHEN p >= 0.2 THEN 'Baixo' ELSE 'Muito Baixo' END"""


@q("risk_band")
def risk_band(spark, d):
    ev = load(spark, d, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("p"))
    return ev.select("event_id", F.round("p", 6).alias("probability"), D.risk_band(F.col("p")).alias("risk_level"),
                     D.risk_label((F.col("p") >= D.DECISION_THRESHOLD).cast("int")).alias("label"))


SQL["risk_band"] = f"""WITH t AS (SELECT event_id, least(value / 100.0, 1.0)::DOUBLE AS p FROM events)
SELECT event_id, round(p, 6) AS probability, {_BAND_SQL} AS risk_level,
  CASE WHEN p >= 0.5 THEN 'Em Risco' ELSE 'Sem Risco' END AS label FROM t"""


@q("risk_band_distribution")
def risk_band_distribution(spark, d):
    ev = load(spark, d, "events").select(D.risk_band(F.least(F.col("value") / 100.0, F.lit(1.0))).alias("risk_level"))
    g = ev.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
    total = ev.agg(F.count(F.lit(1))).scalar()
    return g.select("risk_level", "count", F.round(F.col("count") / total, 4).alias("share"))


SQL["risk_band_distribution"] = f"""WITH t AS (SELECT least(value / 100.0, 1.0)::DOUBLE AS p FROM events)
SELECT {_BAND_SQL} AS risk_level, count(*) AS count, round(count(*) / (SELECT count(*) FROM t), 4) AS share
FROM t GROUP BY 1"""


# ------------------------------------------------------- D12: features chain

@q("pipeline_features")
def pipeline_features(spark, d):
    pre = preprocessed_orders(spark, d)

    def s1(df):
        return {"years": D.years_since(F.year("o_orderdate")).cast("long"),
                "delta": D.delta_neutral(F.col("priority_code"), F.col("status_code"), F.col("had_status")),
                "ratio": F.round(D.ratio_eps(F.col("price") / 100000, F.col("priority_num")), 6),
                "row_std": F.round(D.rowwise_std([F.col("priority_code"), F.col("status_code"),
                                                   F.col("priority_num")]), 6)}
    return apply_steps(pre, [s1])


SQL["pipeline_features"] = f"""WITH {_PRE_SQL},
v AS (SELECT *, list_filter([CAST(priority_code AS DOUBLE), CAST(status_code AS DOUBLE), CAST(priority_num AS DOUBLE)],
        lambda x: x IS NOT NULL) AS vals FROM pre),
m AS (SELECT *, list_sum(vals) / len(vals) AS mu FROM v),
m2 AS (SELECT *, list_sum(list_transform(vals, lambda x: (x - mu) * (x - mu))) AS ss FROM m)
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, target, priority_code, had_status, status_code, priority_num,
  is_urgent, is_low, price,
  CAST(2022 - year(o_orderdate) AS BIGINT) AS years,
  CASE WHEN had_status = 0 THEN 0 ELSE priority_code - status_code END AS delta,
  round((price / 100000) / (priority_num + 0.01), 6) AS ratio,
  round(CASE WHEN len(vals) >= 2 THEN sqrt(ss / (len(vals) - 1)) END, 6) AS row_std
FROM m2"""


# ----------------------------------------------------------------- P1-P7

@q("select_features")
def select_features(spark, d):
    li = load(spark, d, "lineitem")
    return P.select_features(li, ["l_tax", "l_quantity", "l_missing_feature", "l_discount"], target="l_returnflag")


SQL["select_features"] = "SELECT l_tax, l_quantity, l_discount, l_returnflag FROM lineitem"


@q("select_features_subset")
def select_features_subset(spark, d):
    li = load(spark, d, "lineitem")
    return P.select_features_subset(li, ["l_extendedprice", "not_a_column", "l_tax"], keep=LI_KEY)


SQL["select_features_subset"] = f"SELECT {LI_KEY_SQL}, l_extendedprice, l_tax FROM lineitem"

RENAME = {"l_quantity": "Quantidade Nº", "l_extendedprice": "Preço total"}


@q("rename_roundtrip")
def rename_roundtrip(spark, d):
    li = load(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice")
    special = P.rename_columns(li, RENAME)                              # read-side names
    return P.rename_columns(special, {v: k for k, v in RENAME.items()})  # back to store-safe names


SQL["rename_roundtrip"] = f"SELECT {LI_KEY_SQL}, l_quantity, l_extendedprice FROM lineitem"


@q("conform_schema")
def conform_schema(spark, d):
    o = load(spark, d, "orders")
    return P.conform_schema(o, ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "absent_feature"],
                            keep=["o_orderkey"])


SQL["conform_schema"] = """
SELECT o_orderkey, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, TRY_CAST(o_custkey AS DOUBLE) AS o_custkey,
  TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus, TRY_CAST(o_orderpriority AS DOUBLE) AS o_orderpriority,
  CAST(NULL AS DOUBLE) AS absent_feature FROM orders"""


@q("coerce_fill_zero")
def coerce_fill_zero(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return P.coerce_fill_zero(o, ["o_orderstatus", "o_totalprice", "o_orderpriority"])


SQL["coerce_fill_zero"] = """
SELECT o_orderkey, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 0.0) AS o_orderstatus,
  coalesce(TRY_CAST(o_totalprice AS DOUBLE), 0.0) AS o_totalprice,
  coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 0.0) AS o_orderpriority FROM orders"""


def _rules():
    return [P.required("l_shipdate"), P.in_range("l_quantity", 1, 40), P.in_range("l_discount", 0, 0.08),
            P.one_of("l_returnflag", ["A", "R"])]


_VIOL_SQL = """concat_ws(',',
    CASE WHEN l_shipdate IS NULL THEN 'l_shipdate:required' END,
    CASE WHEN NOT (l_quantity IS NULL OR (l_quantity >= 1 AND l_quantity <= 40)) THEN 'l_quantity:range' END,
    CASE WHEN NOT (l_discount IS NULL OR (l_discount >= 0 AND l_discount <= 0.08)) THEN 'l_discount:range' END,
    CASE WHEN NOT (l_returnflag IS NULL OR l_returnflag IN ('A', 'R')) THEN 'l_returnflag:domain' END)"""


@q("validate_rows")
def validate_rows(spark, d):
    li = load(spark, d, "lineitem")
    v = P.validate_rows(li, _rules())
    return v.select(*LI_KEY, F.concat_ws(",", "violations").alias("violations"), "valid")


SQL["validate_rows"] = f"""SELECT {LI_KEY_SQL}, {_VIOL_SQL} AS violations, {_VIOL_SQL} = '' AS valid FROM lineitem"""


@q("validate_summary")
def validate_summary(spark, d):
    li = load(spark, d, "lineitem")
    rules = _rules()
    return P.validate_summary(P.validate_rows(li, rules), rules)


SQL["validate_summary"] = f"""WITH v AS (SELECT {_VIOL_SQL} AS viol FROM lineitem),
a AS (SELECT count(*) AS rows, count(*) FILTER (WHERE viol = '') AS valid, count(*) FILTER (WHERE viol <> '') AS quarantined,
  count(*) FILTER (WHERE contains(viol, 'l_shipdate:required')) AS v0, count(*) FILTER (WHERE contains(viol, 'l_quantity:range')) AS v1,
  count(*) FILTER (WHERE contains(viol, 'l_discount:range')) AS v2, count(*) FILTER (WHERE contains(viol, 'l_returnflag:domain')) AS v3
  FROM v)
SELECT rows, valid, quarantined, 'l_shipdate:required' AS rule, v0 AS violations FROM a
UNION ALL SELECT rows, valid, quarantined, 'l_quantity:range', v1 FROM a
UNION ALL SELECT rows, valid, quarantined, 'l_discount:range', v2 FROM a
UNION ALL SELECT rows, valid, quarantined, 'l_returnflag:domain', v3 FROM a"""


@q("alias_resolve")
def alias_resolve(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(*LI_KEY, P.resolve_alias(li, ["quantity", "l_quantity"]).alias("quantity"),
                     P.resolve_alias(li, ["l_extendedprice", "price"]).alias("price"),
                     P.resolve_alias(li, ["x_feature", "y_feature"]).cast("double").alias("missing"))


SQL["alias_resolve"] = f"""
SELECT {LI_KEY_SQL}, l_quantity AS quantity, l_extendedprice AS price, CAST(NULL AS DOUBLE) AS missing FROM lineitem"""


# ------------------------------------------------------ D13: serving features

def serving_requests(spark, d):
    """Scoring requests in the reference's field spellings (spaced, accented
    and underscored), one per line item; some fields absent, some NULL."""
    li = load(spark, d, "lineitem")
    c = F.col
    return li.select(
        *LI_KEY,
        (c("l_quantity") / 5).alias("IAA"), (c("l_discount") * 100).alias("IEG"), (c("l_tax") * 100).alias("IPS"),
        F.when(c("l_linenumber") > 1, c("l_extendedprice") / 10000).alias("IDA"),
        c("l_linenumber").cast("double").alias("IPV"),
        ((c("l_quantity") / 5 + c("l_discount") * 100) / 2).alias("INDE_22"),
        F.when(c("l_returnflag") != "N", c("l_quantity") / 5).alias("Matem"),
        (c("l_tax") * 100).alias("Portug"),
        (6 + c("l_linenumber") * 2).alias("Idade_22"),
        F.when(c("l_returnflag") == "A", "Menina").when(c("l_returnflag") == "R", "Menino").otherwise("Outro")
        .alias("Gênero"),
        F.when(c("l_linestatus") == "F", "Escola Pública").otherwise("Rede Decisão").alias("Instituição de ensino"),
        F.concat(F.lit("Fase "), c("l_linenumber").cast("string")).alias("Fase"),
        (F.year("l_shipdate") - 5).alias("Ano_ingresso"),
        F.when(c("l_linestatus") == "F", "Ágata").alias("Pedra 20"),
        F.when(c("l_returnflag") == "R", "Quartzo").when(c("l_returnflag") == "A", "Pedra X").alias("Pedra 21"),
        F.when(c("l_quantity") > 25, "Topázio").otherwise("Ametista").alias("Pedra 22"),
        F.when(c("l_discount") > 0.05, "Sim").otherwise("Não").alias("Atingiu_PV"),
        F.when(c("l_tax") > 0.04, "yes").otherwise("no").alias("Indicado"),
        F.when(c("l_discount") >= 0.09, "Destaque IEG").otherwise("Não").alias("Destaque_IEG"),
        F.when(c("l_quantity") > 40, c("l_quantity") / 5).alias("Inglês"),
        F.when(c("l_suppkey") > 50, c("l_suppkey").cast("double")).alias("Cf"),
        F.lit(3).alias("N_Av"),
        F.when(c("l_linestatus") == "F", "Mantido na mesma fase com ressalvas").otherwise("  promovido de FASE ")
        .alias("Rec Av1"))


@q("pipeline_serving_features")
def pipeline_serving_features(spark, d):
    from featurewatch.operators.pipeline import serving_features
    r = serving_requests(spark, d)
    return serving_features(r, keep=LI_KEY, digits=6)


_SERVING_REQ_SQL = f"""r AS (SELECT {LI_KEY_SQL},
  l_quantity / 5 AS "IAA", l_discount * 100 AS "IEG", l_tax * 100 AS "IPS",
  CASE WHEN l_linenumber > 1 THEN l_extendedprice / 10000 END AS "IDA", CAST(l_linenumber AS DOUBLE) AS "IPV",
  (l_quantity / 5 + l_discount * 100) / 2 AS "INDE_22",
  CASE WHEN l_returnflag <> 'N' THEN l_quantity / 5 END AS "Matem", l_tax * 100 AS "Portug",
  6 + l_linenumber * 2 AS "Idade_22",
  CASE l_returnflag WHEN 'A' THEN 'Menina' WHEN 'R' THEN 'Menino' ELSE 'Outro' END AS "Gênero",
  CASE WHEN l_linestatus = 'F' THEN 'Escola Pública' ELSE 'Rede Decisão' END AS "Instituição de ensino",
  'Fase ' || CAST(l_linenumber AS VARCHAR) AS "Fase", year(l_shipdate) - 5 AS "Ano_ingresso",
  CASE WHEN l_linestatus = 'F' THEN 'Ágata' END AS "Pedra 20",
  CASE l_returnflag WHEN 'R' THEN 'Quartzo' WHEN 'A' THEN 'Pedra X' END AS "Pedra 21",
  CASE WHEN l_quantity > 25 THEN 'Topázio' ELSE 'Ametista' END AS "Pedra 22",
  CASE WHEN l_discount > 0.05 THEN 'Sim' ELSE 'Não' END AS "Atingiu_PV",
  CASE WHEN l_tax > 0.04 THEN 'yes' ELSE 'no' END AS "Indicado",
  CASE WHEN l_discount >= 0.09 THEN 'Destaque IEG' ELSE 'Não' END AS "Destaque_IEG",
  CASE WHEN l_quantity > 40 THEN l_quantity / 5 END AS "Inglês",
  CASE WHEN l_suppkey > 50 THEN CAST(l_suppkey AS DOUBLE) END AS "Cf", 3 AS "N_Av",
  CASE WHEN l_linestatus = 'F' THEN 'Mantido na mesma fase com ressalvas' ELSE '  promovido de FASE ' END AS "Rec Av1"
FROM lineitem)"""

_STONE = "CASE {c} WHEN 'Quartzo' THEN 1 WHEN 'Ágata' THEN 2 WHEN 'Ametista' THEN 3 WHEN 'Topázio' THEN 4 END"
_REC = ("CASE WHEN contains(lower(trim(\"Rec Av1\")), 'mantido na mesma fase com ressalvas') THEN 2 "
        "WHEN contains(lower(trim(\"Rec Av1\")), 'promovido de fase') THEN 4 "
        "WHEN contains(lower(trim(\"Rec Av1\")), 'mantido na mesma fase') THEN 3 "
        "WHEN contains(lower(trim(\"Rec Av1\")), 'em observação') THEN 1 "
        "WHEN contains(lower(trim(\"Rec Av1\")), 'sem informação') THEN 0 ELSE 0 END")


def _serving_sql():
    p20, p21, p22 = (_STONE.format(c=f'"Pedra {y}"') for y in ("20", "21", "22"))
    ind = '["IAA", "IEG", "IPS", "IDA", "IPV"]'
    truthy = "('sim', 'yes', 'true', '1')"
    cols = {
        "IAA": '"IAA"', "IEG": '"IEG"', "IPS": '"IPS"', "IDA": '"IDA"', "IPV": '"IPV"',
        "INDE 22": '"INDE_22"', "Matem": '"Matem"', "Portug": '"Portug"', "Idade 22": '"Idade_22"',
        "Genero_encoded": "coalesce(CASE \"Gênero\" WHEN 'Menina' THEN 0 WHEN 'Menino' THEN 1 END, 0)",
        "Escola_encoded": ("coalesce(CASE \"Instituição de ensino\" WHEN 'Escola Pública' THEN 0 "
                           "WHEN 'Rede Decisão' THEN 1 WHEN 'Escola JP II' THEN 2 END, 0)"),
        "Anos_na_PM": 'CASE WHEN "Ano_ingresso" > 100 THEN 2022 - "Ano_ingresso" ELSE "Ano_ingresso" END',
        "Fase_encoded": ("coalesce(CASE \"Fase\" WHEN 'Alfa' THEN 0 WHEN 'Fase 1' THEN 1 WHEN 'Fase 2' THEN 2 "
                         "WHEN 'Fase 3' THEN 3 WHEN 'Fase 4' THEN 4 WHEN 'Fase 5' THEN 5 WHEN 'Fase 6' THEN 6 "
                         "WHEN 'Fase 7' THEN 7 WHEN 'Fase 8' THEN 8 END, 0)"),
        "Pedra_20_encoded": f"CASE WHEN ({p20}) IS NULL THEN 0 ELSE {p20} END",
        "Pedra_21_encoded": f"CASE WHEN ({p21}) IS NULL THEN 0 ELSE {p21} END",
        "Pedra_22_encoded": p22,
        "Evolucao_pedra_20_22": f"CASE WHEN ({p20}) IS NULL THEN 0 WHEN ({p22}) IS NOT NULL THEN ({p22}) - ({p20}) ELSE 0 END",
        "Evolucao_pedra_21_22": f"CASE WHEN ({p21}) IS NULL THEN 0 WHEN ({p22}) IS NOT NULL THEN ({p22}) - ({p21}) ELSE 0 END",
        "tinha_pedra_20": f"CAST(({p20}) IS NOT NULL AS INTEGER)",
        "tinha_pedra_21": f"CAST(({p21}) IS NOT NULL AS INTEGER)",
        "Ponto_virada_flag": f"CAST(coalesce(lower(\"Atingiu_PV\") IN {truthy}, false) AS INTEGER)",
        "Indicado_flag": f"CAST(coalesce(lower(\"Indicado\") IN {truthy}, false) AS INTEGER)",
        "Destaque_IEG_flag": (f"greatest(CAST(coalesce(lower(\"Destaque_IEG\") IN {truthy}, false) AS INTEGER), "
                              "CAST(coalesce(contains(\"Destaque_IEG\", 'Destaque'), false) AS INTEGER))"),
        "Destaque_IDA_flag": "0", "Destaque_IPV_flag": "0",
        "Tem_nota_ingles": 'CAST("Inglês" IS NOT NULL AS INTEGER)',
        "Rec_av1_encoded": _REC, "Rec_av2_encoded": "0",
        "Cf": '"Cf"', "Ct": "NULL", "Nº Av": '"N_Av"',
        "tem_ranking_cf": 'CAST("Cf" IS NOT NULL AS INTEGER)', "tem_ranking_ct": "0",
        "Variancia_indicadores": ("CASE WHEN len(v) >= 3 THEN sqrt(list_sum(list_transform(v, lambda x: "
                                  "(x - list_sum(v) / len(v)) * (x - list_sum(v) / len(v)))) / (len(v) - 1)) ELSE 0.0 END"),
        "Ratio_IDA_IEG": 'coalesce("IDA", 0.0) / (coalesce("IEG", 0.0) + 0.01)',
    }
    from featurewatch.operators.pipeline import MODEL_FEATURES_NO_IAN
    sel = ", ".join(f'round(TRY_CAST({cols[n]} AS DOUBLE), 6) AS "{n}"' for n in MODEL_FEATURES_NO_IAN)
    return (f"WITH {_SERVING_REQ_SQL},\nrv AS (SELECT *, list_filter({ind}, lambda x: x IS NOT NULL) AS v FROM r)\n"
            f"SELECT {LI_KEY_SQL}, {sel} FROM rv")


SQL["pipeline_serving_features"] = _serving_sql()
