"""Scans of the input tables (S1) with explicit schemas.

Reading with a declared schema skips inference (a full extra pass at scale)
and lets Catalyst prune columns and push filters into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, D, I, S, TS = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "embeddings": _schema(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan one table with an explicit schema.  A missing path raises
    ``AnalysisException`` (PATH_NOT_FOUND) at plan time, like the reference's
    file-not-found error."""
    return spark.read.schema(schema or SCHEMAS[name]).parquet(table_path(sf_dir, name))


def scan_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct-free profile in ONE aggregate pass.

    The wide aggregate (2 counters per column) is map-side combined, then the
    single result row is unpivoted to one row per column."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in df.columns:
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"nn__{c}"))
    wide = df.agg(*aggs)
    stacked = wide.unpivot(["__n"], [f"nn__{c}" for c in df.columns], "col", "non_null")
    return stacked.select(
        F.regexp_replace("col", "^nn__", "").alias("column_name"),
        F.col("__n").alias("n_rows"),
        F.col("non_null").alias("n_non_null"),
        (F.col("__n") - F.col("non_null")).alias("n_null"),
    )
