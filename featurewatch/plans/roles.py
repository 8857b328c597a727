"""Role mapping: which driver table plays which part of the reference's data
model (SURVEY §7.2).  Each role is defined twice, once as a Spark plan and
once as the equivalent SQL fragment used by the DuckDB oracle, and the two
must stay in lockstep.

* prediction log      <- ``events``   (one prediction per event)
* request status      <- ``events.event_type``
* feedback            <- ``events`` of type purchase (confirm a logged id)
* classification pairs<- ``labels`` (prediction = quality, outcome = toxic)
* feature view        <- ``orders`` keyed by customer, event time = order date
* entity rows         <- ``lineitem`` x ``orders`` (customer, ship date)
* reference/production<- ``lineitem`` return flag 'A' / 'R'
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurewatch.sources.tables import load

DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def np_percentile_sql(sorted_list: str, q: float) -> str:
    """numpy.percentile (linear) of a sorted DuckDB list, same float steps as Spark."""
    pos = f"((len({sorted_list}) - 1) * CAST({q} AS DOUBLE))"
    a = f"{sorted_list}[CAST(floor({pos}) AS BIGINT) + 1]"
    b = f"{sorted_list}[CAST(ceil({pos}) AS BIGINT) + 1]"
    t = f"({pos} - floor({pos}))"
    return f"(CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {t}) ELSE {a} + ({b} - {a}) * {t} END)"


def sround(expr: str, digits: int) -> str:
    """DuckDB rounding with Spark's semantics: HALF_UP on the shortest decimal
    text of the double (Spark rounds 33.745 to 33.75; DuckDB's binary round
    gives 33.74)."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 22)), {digits}) AS DOUBLE)"

# ------------------------------------------------------------ prediction log

LOG_SQL = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS prediction_id, event_id AS seq, ts AS "timestamp",
         CAST(value >= 50 AS INTEGER) AS prediction,
         least(value / 100.0, 1.0)::DOUBLE AS probability,
         value AS latency_ms,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS feat_k,
         CASE WHEN event_type <> 'view' THEN value END AS feat_value,
         event_type,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status_code,
         user_id
  FROM events)"""


def prediction_log(spark: SparkSession, d: str) -> DataFrame:
    """S9 on the driver table: each event is one logged prediction."""
    return log_from_events(load(spark, d, "events"))


def log_from_events(ev: DataFrame) -> DataFrame:
    """Events (batch or stream) -> prediction-log rows."""
    from featurewatch.operators.log_stats import build_log
    return build_log(
        ev,
        id_col=F.col("event_id").cast("string"),
        seq_col=F.col("event_id"),
        ts_col=F.col("ts"),
        prediction=(F.col("value") >= 50).cast("int"),
        probability=F.least(F.col("value") / 100.0, F.lit(1.0)),
        latency_ms=F.col("value"),
        # the props JSON plus the event value, which 'view' events do not carry
        features=F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("value"),
                         F.when(F.col("event_type") != "view", F.col("value").cast("string")))),
        extra={"event_type": F.col("event_type"), "user_id": F.col("user_id"),
               "status_code": F.when(F.col("event_type") == "error", 500)
               .when(F.col("event_type") == "signup", 404).otherwise(200)},
    )


FB_LATEST_SQL = """fb AS (
  SELECT prediction_id, outcome AS actual_outcome, feedback_timestamp FROM (
    SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY feedback_timestamp DESC, fb_seq DESC) AS rn
    FROM fb_raw) WHERE rn = 1)"""

FEEDBACK_SQL = """fb_raw AS (
  SELECT CAST(user_id * 100 + TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS prediction_id,
         CAST(value >= 50 AS INTEGER) AS outcome, ts AS feedback_timestamp, event_id AS fb_seq
  FROM events WHERE event_type = 'purchase')"""


def feedback_raw(spark: SparkSession, d: str) -> DataFrame:
    """Feedback calls: a purchase event confirms the outcome of the prediction
    whose id is ``user_id * 100 + k``; some ids are unknown, some repeat."""
    return feedback_from_events(load(spark, d, "events"))


def feedback_from_events(ev: DataFrame) -> DataFrame:
    ev = ev.filter(F.col("event_type") == "purchase")
    return ev.select(
        (F.col("user_id") * 100 + F.get_json_object("props", "$.k").try_cast("bigint"))
        .cast("string").alias("prediction_id"),
        (F.col("value") >= 50).cast("int").alias("outcome"),
        F.col("ts").alias("feedback_timestamp"),
        F.col("event_id").alias("fb_seq"))


# --------------------------------------------------------- drift (lineitem)

def drift_long(spark: SparkSession, d: str, extra_prod: bool = False) -> DataFrame:
    from featurewatch.operators.drift import PROD, REF
    li = load(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    side = F.when(F.col("l_returnflag") == "A", REF).otherwise(PROD)
    feats = list(DRIFT_FEATURES)
    cols = {c: F.col(c).cast("double") for c in feats}
    if extra_prod:
        # l_linestatus is text: no value parses (INSUFFICIENT); l_linenumber is
        # logged in production only (UNKNOWN to the reference).
        cols["l_linestatus"] = F.col("l_linestatus").try_cast("double")
        cols["l_linenumber"] = F.when(side == PROD, F.col("l_linenumber").cast("double"))
    from featurewatch.functions.nulls import nan_to_null
    wide = li.select(side.alias("side"), *[nan_to_null(e).alias(n) for n, e in cols.items()])
    long = wide.unpivot(["side"], list(cols), "feature", "value")
    if extra_prod:
        long = long.filter(~((F.col("feature") == "l_linenumber") & (F.col("side") == REF)))
    return long.select("feature", "side", "value")


def drift_long_sql(extra_prod: bool = False) -> str:
    feats = list(DRIFT_FEATURES)
    parts = [f"SELECT '{c}' AS feature, side, CAST({c} AS DOUBLE) AS value FROM src" for c in feats]
    if extra_prod:
        parts.append("SELECT 'l_linestatus' AS feature, side, TRY_CAST(l_linestatus AS DOUBLE) AS value FROM src")
        parts.append("SELECT 'l_linenumber' AS feature, side, CAST(l_linenumber AS DOUBLE) AS value "
                     "FROM src WHERE side = 'production'")
    return ("src AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'reference' ELSE 'production' END AS side, * "
            "FROM lineitem WHERE l_returnflag IN ('A', 'R')),\n"
            "long AS (" + "\n UNION ALL ".join(parts) + ")")
