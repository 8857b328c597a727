"""Shared fixtures: one local Spark session, a scalable student-table
generator (FIXTURES F1, hash-based values from ``spark.range``) and small
literal frames for formula checks."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ck = tempfile.mkdtemp(prefix="fw-test-")
    s = (SparkSession.builder.master("local[4]").appName("featurewatch-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", ck)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from featurewatch.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


def _pick(h, values):
    """Deterministic choice from ``values`` by a hash column."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def student_table(spark, n: int = 200):
    """Raw student rows in the reference's schema (names with spaces/accents)."""
    i = F.col("id")

    def h(salt):
        return F.abs(F.xxhash64(i, F.lit(salt)))

    def u(salt):  # uniform [0, 1)
        return (h(salt) % 1000000) / 1000000.0

    stones = ["Quartzo", "Ágata", "Ametista", "Topázio"]
    phases = ["Alfa"] + [f"Fase {k}" for k in range(1, 9)]
    recs = ["Mantido na mesma fase com ressalvas", "Promovido de fase", "Mantido na mesma fase",
            "Em observação", "Sem informação"]
    return spark.range(n).select(
        F.concat(F.lit("RA-"), i.cast("string")).alias("RA"),
        _pick(h(1), phases).alias("Fase"),
        (7 + h(2) % 13).cast("int").alias("Idade 22"),
        _pick(h(3), ["Menina", "Menino"]).alias("Gênero"),
        (2016 + h(4) % 7).cast("int").alias("Ano ingresso"),
        _pick(h(5), ["Escola Pública"] * 17 + ["Rede Decisão"] * 2 + ["Escola JP II"]).alias("Instituição de ensino"),
        F.when(u(6) < 0.4, _pick(h(7), stones)).alias("Pedra 20"),
        F.when(u(8) < 0.55, _pick(h(9), stones)).alias("Pedra 21"),
        _pick(h(10), stones).alias("Pedra 22"),
        F.round(2.5 + u(11) * 7, 3).alias("INDE 22"),
        (1 + h(12) % 192).cast("int").alias("Cf"),
        (1 + h(13) % 18).cast("int").alias("Ct"),
        (2 + h(14) % 3).cast("int").alias("Nº Av"),
        _pick(h(15), recs).alias("Rec Av1"),
        _pick(h(16), recs).alias("Rec Av2"),
        F.round(3 + u(17) * 7, 2).alias("IAA"),
        F.round(2 + u(18) * 8, 2).alias("IEG"),
        F.round(4 + u(19) * 6, 2).alias("IPS"),
        F.round(2 + u(20) * 8, 2).alias("IDA"),
        F.round(1 + u(21) * 9, 2).alias("IPV"),
        F.when(u(22) > 0.04, F.round(2 + u(23) * 8, 1)).alias("Matem"),
        F.when(u(24) > 0.04, F.round(2 + u(25) * 8, 1)).alias("Portug"),
        F.when(u(26) < 0.33, F.round(2 + u(27) * 8, 1)).alias("Inglês"),
        F.when(u(28) < 0.15, "Sim").otherwise("Não").alias("Indicado"),
        F.when(u(29) < 0.13, "Sim").otherwise("Não").alias("Atingiu PV"),
        _pick(h(30), [0.0, 5.0, 10.0]).alias("IAN"),
        (h(31) % 8 - 5).cast("int").alias("Defas"),
        F.when(u(32) < 0.2, "Destaque IEG").otherwise("Não").alias("Destaque IEG"),
        F.when(u(33) < 0.2, "Destaque IDA").otherwise("Não").alias("Destaque IDA"),
        F.when(u(34) < 0.2, "Destaque IPV").otherwise("Não").alias("Destaque IPV"),
    )


@pytest.fixture(scope="session")
def students(spark):
    return student_table(spark, 200).cache()
