"""Session construction and shared storage locations.

Everything that has to survive an executor loss (feature-view tables, the
materialised "latest" snapshots, model artefacts, lineage cuts) lives under a
storage root on the shared file system.  The root is taken from the session:
``featurewatch.storage.root`` if set, else ``spark.checkpoint.dir``.  Only
tests and local runs set their own (see ``ensure_checkpoint_dir``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

STORAGE_CONF = "featurewatch.storage.root"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "featurewatch") -> SparkSession:
    """Local/test session.  On a cluster the submitter's session is used as is."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot does not JIT methods above 8000 bytes of bytecode; wide feature
        # projections exceed that, so let Spark fall back for those stages only.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # reliable checkpoints written by materialize() are removed once their
        # DataFrame is garbage-collected (long-running monitoring jobs)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint dir; create a private one only when unset
    and the master is local (tests).  Never overrides a cluster-provided
    setting; a cluster without one is an error, because a folder of the
    driver's machine would lose data there."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="fw-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - remote sessions read spark.checkpoint.dir themselves
        pass
    return current


def let_workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it.
    On a cluster it is installed in the image or sent with --py-files, and
    this changes nothing."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def storage_root(spark: SparkSession) -> str:
    root = spark.conf.get(STORAGE_CONF, None)
    if root:
        return root
    base = ensure_checkpoint_dir(spark)
    root = os.path.join(base, "featurewatch")
    spark.conf.set(STORAGE_CONF, root)
    return root


def storage_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([storage_root(spark).rstrip("/"), *parts])


def materialize(df):
    """Compute ``df`` once into the shared checkpoint directory and return a
    frame over the stored result.  Used where several branches of one plan
    read the same reduced table: without it each branch re-scans the input
    (column pruning makes the branches differ, defeating exchange reuse).
    A reliable checkpoint also cuts lineage, so a lost executor does not
    trigger recomputation from the raw scan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
