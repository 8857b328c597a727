"""Feature-store queries (S3-S7, S19, J1-J3, W6, P10) on orders / lineitem.

Entity: customer (``cust_id`` = ``o_custkey`` as text).  Views:
``orders_value`` (order total, event time = order date, tie-break = order key),
``orders_status`` (encoded priority / status), ``orders_daily`` (daily spend,
an aggregate view) and ``customer_profile`` (balance, nation; stamped with a
fixed snapshot time).  Entity rows for retrieval are line items at their ship
date.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.functions.project import parse_feature_refs
from featurewatch.operators.asof import ViewInput, asof_join_union, latest_per_key, online_lookup
from featurewatch.plans.q_features import LI_KEY, LI_KEY_SQL, preprocessed_orders
from featurewatch.sources import feature_store as FS
from featurewatch.sources.tables import load

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


CUSTOMER = FS.EntityDef("customer", "cust_id")
ORDERS_VALUE = FS.FeatureView("orders_value", CUSTOMER, T.StructType([
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderkey", T.LongType())]),
    tags={"source": "orders"})
ORDERS_STATUS = FS.FeatureView("orders_status", CUSTOMER, T.StructType([
    T.StructField("priority_code", T.LongType()), T.StructField("status_code", T.LongType()),
    T.StructField("o_orderkey", T.LongType())]), tags={"source": "orders", "encoded": "true"})
CUSTOMER_PROFILE = FS.FeatureView("customer_profile", CUSTOMER, T.StructType([
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_nationkey", T.LongType())]),
    online=True, tags={"source": "customer"})
PROFILE_TIME = "2001-08-01 00:00:00"
VIEWS = [ORDERS_VALUE, ORDERS_STATUS, CUSTOMER_PROFILE]


def orders_value(spark, d):
    return FS.ingest_view(load(spark, d, "orders"), ORDERS_VALUE, "o_custkey", "o_orderdate")


def orders_daily(spark, d):
    o = load(spark, d, "orders")
    return (o.groupBy(F.col("o_custkey").cast("string").alias("cust_id"), F.col("o_orderdate").alias(FS.EVENT_TS))
            .agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n_orders")))


def entity_rows(spark, d):
    li = load(spark, d, "lineitem").select(*LI_KEY)
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust_id"))
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")


_FV_SQL = """fv AS (SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp,
  TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice, TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey,
  CAST(o_orderdate AS DATE) AS event_date FROM orders)"""
_ENT_SQL = f"""ent AS (SELECT {', '.join('l.' + c for c in LI_KEY)}, CAST(o.o_custkey AS VARCHAR) AS cust_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
_DAILY_SQL = """dv AS (SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp,
  sum(o_totalprice) AS spend, count(*) AS n_orders FROM orders GROUP BY 1, 2)"""


# ---------------------------------------------------------------- S3 ingest

@q("fv_ingest_orders_value")
def fv_ingest_orders_value(spark, d):
    return orders_value(spark, d)


SQL["fv_ingest_orders_value"] = f"WITH {_FV_SQL} SELECT * FROM fv"


@q("fv_ingest_orders_status")
def fv_ingest_orders_status(spark, d):
    return FS.ingest_view(preprocessed_orders(spark, d), ORDERS_STATUS, "o_custkey", "o_orderdate")


SQL["fv_ingest_orders_status"] = """
SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 END AS BIGINT) AS priority_code,
  CAST(coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS BIGINT) AS status_code,
  o_orderkey, CAST(o_orderdate AS DATE) AS event_date
FROM orders"""


@q("fv_ingest_customer_profile")
def fv_ingest_customer_profile(spark, d):
    return FS.ingest_view(load(spark, d, "customer"), CUSTOMER_PROFILE, "c_custkey", PROFILE_TIME)


SQL["fv_ingest_customer_profile"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS cust_id, TIMESTAMP '{PROFILE_TIME}' AS event_timestamp, c_acctbal,
  CAST(c_nationkey AS BIGINT) AS c_nationkey, DATE '{PROFILE_TIME[:10]}' AS event_date FROM customer"""


@q("fv_ingest_views")
def fv_ingest_views(spark, d):
    """S3: one wide frame split into its views, NULL features as 0; a view without any column is skipped."""
    nothing = FS.FeatureView("nothing", CUSTOMER, T.StructType([T.StructField("no_such_column", T.DoubleType())]))
    wide = preprocessed_orders(spark, d).join(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    wide = wide.withColumn("o_totalprice", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")))
    tables = FS.ingest_features(wide, [ORDERS_VALUE, ORDERS_STATUS, nothing], "o_custkey", "o_orderdate", fill_zero=True)
    parts = [t.select(F.lit(name).alias("view"), "cust_id", FS.EVENT_TS, "o_orderkey",
                      F.explode(F.create_map(*[x for c in ("o_totalprice", "priority_code", "status_code") if c in t.columns
                                               for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))
             for name, t in tables.items()]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


SQL["fv_ingest_views"] = """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp, o_orderkey,
  coalesce(CASE WHEN o_totalprice >= 50000 THEN o_totalprice END, 0.0) AS price,
  coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 END, 0) AS priority,
  coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS status FROM orders)
SELECT 'orders_value' AS view, cust_id, event_timestamp, o_orderkey, 'o_totalprice' AS feature, CAST(price AS DOUBLE) AS value FROM o
UNION ALL SELECT 'orders_status', cust_id, event_timestamp, o_orderkey, 'priority_code', CAST(priority AS DOUBLE) FROM o
UNION ALL SELECT 'orders_status', cust_id, event_timestamp, o_orderkey, 'status_code', CAST(status AS DOUBLE) FROM o"""


# ------------------------------------------------------------ S4 / S5 / W6

_LATEST_SQL = """SELECT cust_id, event_timestamp, o_totalprice, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY event_timestamp DESC, o_orderkey DESC) AS rn
  FROM fv {where}) WHERE rn = 1"""


@q("fv_materialize_latest")
def fv_materialize_latest(spark, d):
    return FS.materialize(orders_value(spark, d), "cust_id", start="1999-01-01", end="2001-08-01",
                          tiebreak="o_orderkey")


SQL["fv_materialize_latest"] = f"WITH {_FV_SQL} " + _LATEST_SQL.format(
    where="WHERE event_timestamp >= TIMESTAMP '1999-01-01' AND event_timestamp <= TIMESTAMP '2001-08-01'")


def _own_view(name):
    """A declared view under a name of this run, so that a run starts from an empty store."""
    return FS.FeatureView(f"{name}_{uuid.uuid4().hex}", CUSTOMER, ORDERS_VALUE.schema)


@q("fv_materialize_default")
def fv_materialize_default(spark, d):
    """S4 with the default window: the 365 days up to the newest row; the published table is read back."""
    view = _own_view("orders_value")
    FS.publish(spark, view, orders_value(spark, d), tiebreak="o_orderkey")
    return FS.read_snapshot(spark, view.name)


SQL["fv_materialize_default"] = f"WITH {_FV_SQL} " + _LATEST_SQL.format(
    where="WHERE event_timestamp >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")


@q("fv_materialize_incremental")
def fv_materialize_incremental(spark, d):
    """S5 in two runs over a stored view: the first publishes a snapshot and its high-water mark, the second reads
    both and scans only the months after the mark."""
    view = _own_view("orders_value")
    FS.write_view(spark, view.name, orders_value(spark, d), key="cust_id")
    stored = FS.read_view(spark, view)
    FS.publish(spark, view, stored, end="2000-01-01", tiebreak="o_orderkey", days=None)
    FS.publish(spark, view, stored, end="2001-08-01", tiebreak="o_orderkey")
    return FS.read_snapshot(spark, view.name)


SQL["fv_materialize_incremental"] = f"WITH {_FV_SQL} " + _LATEST_SQL.format(
    where="WHERE event_timestamp <= TIMESTAMP '2001-08-01'")


@q("fv_materialize_late")
def fv_materialize_late(spark, d):
    """S5 with rows that come late: a quarter of the orders is ingested after the first run, with event times before
    and after its mark; the second run merges them by the list of files that the first one has read."""
    view, rows = _own_view("orders_value"), orders_value(spark, d)
    FS.write_view(spark, view.name, rows.filter("o_orderkey % 4 <> 0"), key="cust_id")
    FS.publish(spark, view, FS.read_view(spark, view), end="2000-01-01", tiebreak="o_orderkey", days=None, late_rows=True)
    FS.write_view(spark, view.name, rows.filter("o_orderkey % 4 = 0"), key="cust_id")
    FS.publish(spark, view, FS.read_view(spark, view), end="2001-08-01", tiebreak="o_orderkey", late_rows=True)
    return FS.read_snapshot(spark, view.name)


SQL["fv_materialize_late"] = SQL["fv_materialize_incremental"]


@q("latest_per_key")
def latest_per_key_q(spark, d):
    return latest_per_key(orders_value(spark, d), "cust_id", FS.EVENT_TS, ["o_totalprice", "o_orderkey"],
                          tiebreak="o_orderkey")


SQL["latest_per_key"] = f"WITH {_FV_SQL} " + _LATEST_SQL.format(where="")


# ------------------------------------------------------------- S6 / S7 / S19

DECLARED_ORDERS = T.StructType([
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderstatus", T.LongType()),
    T.StructField("o_orderpriority", T.LongType()), T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_clerk", T.StringType())])


@q("fv_schema_check")
def fv_schema_check(spark, d):
    return FS.schema_check(load(spark, d, "orders"), "orders_declared", DECLARED_ORDERS)


SQL["fv_schema_check"] = """WITH a AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE o_totalprice IS NULL) AS n0, count(*) FILTER (WHERE o_totalprice IS NOT NULL AND TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NULL) AS b0,
  count(*) FILTER (WHERE o_orderstatus IS NULL) AS n1, count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS BIGINT) IS NULL) AS b1,
  count(*) FILTER (WHERE o_orderpriority IS NULL) AS n2, count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS BIGINT) IS NULL) AS b2,
  count(*) FILTER (WHERE o_orderdate IS NULL) AS n3, count(*) FILTER (WHERE o_orderdate IS NOT NULL AND TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NULL) AS b3
  FROM orders)
SELECT 'orders_declared' AS view, 'o_totalprice' AS "column", 'double' AS declared_type, true AS present, n AS n_rows, n0 AS n_null, b0 AS n_uncastable FROM a
UNION ALL SELECT 'orders_declared', 'o_orderstatus', 'bigint', true, n, n1, b1 FROM a
UNION ALL SELECT 'orders_declared', 'o_orderpriority', 'bigint', true, n, n2, b2 FROM a
UNION ALL SELECT 'orders_declared', 'o_orderdate', 'timestamp_ntz', true, n, n3, b3 FROM a
UNION ALL SELECT 'orders_declared', 'o_clerk', 'string', false, n, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM a"""


@q("fv_inventory")
def fv_inventory(spark, d):
    path = FS.write_view(spark, "orders_value", orders_value(spark, d), mode="overwrite", key="cust_id")
    inv = FS.inventory(spark, path)
    reg = FS.registry_table(spark, [ORDERS_VALUE]).groupBy("view").agg(F.count(F.lit(1)).alias("n_features"))
    # the number of files is the writer's choice, so the files are summed up
    whole = inv.agg(F.sum("rows").alias("rows"), F.min("min_event_ts").alias("min_event_ts"), F.max("max_event_ts").alias("max_event_ts"),
                    (F.min("file_size") > 0).alias("all_have_bytes"))
    return whole.withColumn("view", F.lit("orders_value")).join(reg, "view", "left")


SQL["fv_inventory"] = """SELECT 'orders_value' AS view, count(*) AS rows, min(o_orderdate) AS min_event_ts, max(o_orderdate) AS max_event_ts,
  true AS all_have_bytes, 2 AS n_features FROM orders"""


@q("pipeline_materialize")
def pipeline_materialize(spark, d):
    """Preprocess -> ingest -> write -> check -> materialise, as one job chain."""
    tables = FS.ingest_features(preprocessed_orders(spark, d), [ORDERS_STATUS], "o_custkey", "o_orderdate")
    FS.write_view(spark, "orders_status", tables["orders_status"], mode="overwrite", key="cust_id")
    stored = FS.read_view(spark, ORDERS_STATUS)
    check = FS.schema_check(stored, ORDERS_STATUS.name, ORDERS_STATUS.schema)
    bad = check.filter(~F.col("present") | (F.col("n_uncastable") > 0)).count()
    if bad:
        raise ValueError(f"stored view {ORDERS_STATUS.name} does not match its declaration")
    extra = FS.undeclared_columns(stored, ORDERS_STATUS)
    if extra:
        raise ValueError(f"stored view {ORDERS_STATUS.name} has undeclared columns: {extra}")
    FS.apply_views(spark, VIEWS)
    latest = FS.publish(spark, ORDERS_STATUS, stored, tiebreak="o_orderkey", incremental=False, days=None)
    return latest.select("cust_id", FS.EVENT_TS, "priority_code", "status_code", "o_orderkey")


SQL["pipeline_materialize"] = """WITH s AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 END AS BIGINT) AS priority_code,
    CAST(coalesce(CASE nullif(o_orderstatus, 'P') WHEN 'F' THEN 1 END, 0) AS BIGINT) AS status_code, o_orderkey FROM orders)
SELECT cust_id, event_timestamp, priority_code, status_code, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY event_timestamp DESC, o_orderkey DESC) AS rn FROM s)
WHERE rn = 1"""


# ---------------------------------------------------------------- J1 / J2

def _value_view(spark, d, prefix=""):
    return ViewInput("orders_value", orders_value(spark, d), "cust_id", FS.EVENT_TS, ["o_totalprice"],
                     tiebreak="o_orderkey", ttl_days=365, prefix=prefix)


_ASOF_SQL = f"""WITH {_FV_SQL}, {_ENT_SQL},
j AS (SELECT ent.*, fv.o_totalprice, fv.event_timestamp AS feature_ts,
        row_number() OVER (PARTITION BY {', '.join('ent.' + c for c in LI_KEY)}
                           ORDER BY fv.event_timestamp DESC, fv.o_orderkey DESC) AS rn
      FROM ent LEFT JOIN fv ON ent.cust_id = fv.cust_id AND fv.event_timestamp <= ent.l_shipdate
                            AND fv.event_timestamp >= ent.l_shipdate - INTERVAL 365 DAY)
SELECT {LI_KEY_SQL}, cust_id, o_totalprice, feature_ts FROM j WHERE rn = 1"""


@q("asof_join_ttl")
def asof_join_ttl(spark, d):
    return asof_join_union(entity_rows(spark, d), "cust_id", "l_shipdate", [_value_view(spark, d)], bucket_days=90)


SQL["asof_join_ttl"] = _ASOF_SQL


@q("asof_join_union")
def asof_join_union_q(spark, d):
    return asof_join_union(entity_rows(spark, d), "cust_id", "l_shipdate", [_value_view(spark, d)])


SQL["asof_join_union"] = _ASOF_SQL


def _multi_sql(value_cols: str, daily_cols: str) -> str:
    return f"""WITH {_FV_SQL}, {_ENT_SQL}, {_DAILY_SQL},
a AS (SELECT ent.*, fv.o_totalprice, fv.event_timestamp AS feature_ts,
        row_number() OVER (PARTITION BY {', '.join('ent.' + c for c in LI_KEY)}
                           ORDER BY fv.event_timestamp DESC, fv.o_orderkey DESC) AS rn
      FROM ent LEFT JOIN fv ON ent.cust_id = fv.cust_id AND fv.event_timestamp <= ent.l_shipdate
                            AND fv.event_timestamp >= ent.l_shipdate - INTERVAL 365 DAY),
b AS (SELECT ent.*, dv.spend AS d_spend, dv.n_orders AS d_n_orders, dv.event_timestamp AS d_feature_ts,
        row_number() OVER (PARTITION BY {', '.join('ent.' + c for c in LI_KEY)} ORDER BY dv.event_timestamp DESC) AS rn
      FROM ent LEFT JOIN dv ON ent.cust_id = dv.cust_id AND dv.event_timestamp <= ent.l_shipdate
                            AND dv.event_timestamp >= ent.l_shipdate - INTERVAL 30 DAY)
SELECT {', '.join('a.' + c for c in LI_KEY)}, a.cust_id, {value_cols}, {daily_cols}
FROM (SELECT * FROM a WHERE rn = 1) a JOIN (SELECT * FROM b WHERE rn = 1) b USING ({LI_KEY_SQL})"""


@q("asof_multi_view")
def asof_multi_view(spark, d):
    daily = ViewInput("orders_daily", orders_daily(spark, d), "cust_id", FS.EVENT_TS, ["spend", "n_orders"],
                      ttl_days=30, prefix="d_")
    return asof_join_union(entity_rows(spark, d), "cust_id", "l_shipdate", [_value_view(spark, d), daily])


SQL["asof_multi_view"] = _multi_sql("a.o_totalprice, a.feature_ts", "b.d_spend, b.d_n_orders, b.d_feature_ts")

FEATURE_REFS = ["orders_value:o_totalprice", "orders_daily:spend"]


@q("feature_refs_projection")
def feature_refs_projection(spark, d):
    refs = parse_feature_refs(FEATURE_REFS)
    sources = {
        "orders_value": lambda: ViewInput("orders_value", orders_value(spark, d), "cust_id", FS.EVENT_TS,
                                          refs["orders_value"], tiebreak="o_orderkey", ttl_days=365),
        "orders_daily": lambda: ViewInput("orders_daily", orders_daily(spark, d), "cust_id", FS.EVENT_TS,
                                          refs["orders_daily"], ttl_days=30, prefix="d_"),
    }
    views = [sources[v]() for v in refs]  # only referenced views, only referenced columns
    return asof_join_union(entity_rows(spark, d), "cust_id", "l_shipdate", views)


SQL["feature_refs_projection"] = _multi_sql("a.o_totalprice, a.feature_ts", "b.d_spend, b.d_feature_ts")


# ---------------------------------------------------------------------- J3

@q("online_lookup")
def online_lookup_q(spark, d):
    latest = FS.materialize(orders_value(spark, d), "cust_id", tiebreak="o_orderkey")
    ids = (load(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
           .select(F.col("c_custkey").cast("string").alias("cust_id")))
    return online_lookup(ids, "cust_id", latest)


SQL["online_lookup"] = f"""WITH {_FV_SQL}, l AS ({_LATEST_SQL.format(where="")}),
ids AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS cust_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT ids.cust_id, l.event_timestamp, l.o_totalprice, l.o_orderkey, l.cust_id IS NOT NULL AS found
FROM ids LEFT JOIN l USING (cust_id)"""
