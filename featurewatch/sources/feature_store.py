"""Feature views: declaration, ingest, schema check, inventory, materialise
(S2-S7, S19, P3, P10).

A view is a Parquet table ``<root>/views/<name>`` partitioned by
``event_month`` (partition pruning for time-bounded reads), holding the entity
key, ``event_timestamp`` and typed features.  The "online" store is a
``latest`` table per view (one row per key): published versions
``<root>/latest/<name>/v=<n>`` and a one-row state with the version and the
high-water mark of event time that it covers.  Ingest appends by default;
every write goes to the shared storage root, never to a local folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.functions.nulls import nan_to_null
from featurewatch.operators.asof import latest_per_key
from featurewatch.session import storage_path

DEFAULT_TTL_DAYS = 365
EVENT_TS = "event_timestamp"
EVENT_DATE = "event_date"
EVENT_MONTH = "event_month"


@dataclass(frozen=True)
class EntityDef:
    name: str
    join_key: str


@dataclass
class FeatureView:
    """A declared view: name, entity, typed features, ttl, online flag, tags.
    ``sources`` maps feature name -> input column (defaults to the same name)."""
    name: str
    entity: EntityDef
    schema: T.StructType
    ttl_days: int = DEFAULT_TTL_DAYS
    online: bool = True
    tags: Mapping[str, str] = field(default_factory=dict)
    sources: Mapping[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def source_of(self, feature: str) -> str:
        return self.sources.get(feature, feature)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def ingest_view(df: DataFrame, view: FeatureView, source_key: str, event_ts: Column | str | None = None,
                fill_zero: bool = False) -> DataFrame | None:
    """S3 for one view: key + available features, renamed to store names, typed
    with ``try_cast`` (bad -> NULL), optionally NULL -> 0, stamped with the event
    time and its date (partition column).  ``None`` when no feature is available."""
    if source_key not in df.columns:
        raise ValueError(f"key column {source_key!r} is required for ingest")
    avail = [f for f in view.schema.fields if view.source_of(f.name) in df.columns]
    if not avail:
        return None
    if event_ts is None:
        ts = F.current_timestamp().cast("timestamp_ntz")
    elif isinstance(event_ts, str):
        ts = _q(event_ts) if event_ts in df.columns else F.lit(event_ts).cast("timestamp_ntz")
    else:
        ts = event_ts
    cols = [_q(source_key).cast("string").alias(view.entity.join_key), ts.alias(EVENT_TS)]
    for f in avail:
        v = _q(view.source_of(f.name)).try_cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = nan_to_null(v)
        if fill_zero:
            v = F.coalesce(v, F.lit(0).cast(f.dataType))
        cols.append(v.alias(f.name))
    out = df.select(*cols)
    return out.withColumn(EVENT_DATE, F.to_date(EVENT_TS))


def ingest_features(df: DataFrame, views: Sequence[FeatureView], source_key: str,
                    event_ts: Column | str | None = None, fill_zero: bool = False) -> dict[str, DataFrame]:
    """S3: split one wide frame into per-view tables (views without any
    available column are skipped)."""
    out = {}
    for v in views:
        t = ingest_view(df, v, source_key, event_ts, fill_zero)
        if t is not None:
            out[v.name] = t
    return out


def view_path(spark: SparkSession, name: str) -> str:
    return storage_path(spark, "views", name)


def write_view(spark: SparkSession, name: str, table: DataFrame, mode: str = "append",
               key: str | None = None) -> str:
    """Append (default) or overwrite a view table in monthly partition
    directories.  The write is range-partitioned on (month, key): each task
    writes a contiguous slice, so a busy month is split over several tasks
    and the number of files stays bounded by tasks + month boundaries."""
    path = view_path(spark, name)
    t = table.withColumn(EVENT_MONTH, F.date_format(F.col(EVENT_DATE), "yyyy-MM"))
    order = [EVENT_MONTH] + ([key] if key else [c for c in t.columns if c not in (EVENT_MONTH, EVENT_DATE)][:1])
    t.repartitionByRange(*order).write.mode(mode).partitionBy(EVENT_MONTH).parquet(path)
    return path


def read_view(spark: SparkSession, view: FeatureView, start=None, end=None) -> DataFrame:
    """Scan of a view; a time range is pushed down as a partition filter
    on ``event_month`` plus a row filter on ``event_timestamp``.  The month stays
    in the frame, so later time filters (``materialize``) prune as well."""
    df = spark.read.parquet(view_path(spark, view.name))
    if start is not None:
        df = df.filter((F.col(EVENT_MONTH) >= F.date_format(F.lit(start).cast("date"), "yyyy-MM"))
                       & (F.col(EVENT_TS) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.filter((F.col(EVENT_MONTH) <= F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
                       & (F.col(EVENT_TS) <= F.lit(end).cast("timestamp_ntz")))
    return df


def _between(df: DataFrame, start=None, end=None, after=None) -> DataFrame:
    """Rows with event time in [start, end] and > after; months are pruned where the table has them."""
    for bound, inside, month in ((start, lambda t, x: t >= x, lambda m, x: m >= x), (after, lambda t, x: t > x, lambda m, x: m >= x),
                                 (end, lambda t, x: t <= x, lambda m, x: m <= x)):
        if bound is not None:
            b = bound if isinstance(bound, Column) else F.lit(bound)
            df = df.filter(inside(F.col(EVENT_TS), b.cast("timestamp_ntz")))
            if EVENT_MONTH in df.columns:
                df = df.filter(month(F.col(EVENT_MONTH), F.date_format(b.cast("date"), "yyyy-MM")))
    return df


def materialize(table: DataFrame, key: str, start=None, end=None, tiebreak: str | None = None,
                features: Sequence[str] | None = None, days: int | None = None) -> DataFrame:
    """Latest value per key among rows with event time in [start, end].
    Without ``start`` the window is the last ``days`` days before ``end``
    (the store's default is ``DEFAULT_TTL_DAYS``; ``None`` here: unbounded)."""
    if start is None and days is not None and end is not None:
        start = F.lit(end).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    df = _between(table, start, end)
    feats = [c for c in (features or df.columns) if c not in (key, EVENT_TS, EVENT_DATE, EVENT_MONTH)]
    return latest_per_key(df, key, EVENT_TS, feats, tiebreak)


def materialize_incremental(snapshot: DataFrame | None, table: DataFrame, key: str, high_water_mark,
                            end=None, tiebreak: str | None = None) -> DataFrame:
    """Merge rows newer than the stored high-water mark into the previous
    snapshot; the result equals a full materialise up to ``end``.  Only the
    new slice of the table is scanned (partition-pruned on the month)."""
    new = _between(table, end=end, after=high_water_mark)
    feats = [c for c in (snapshot.columns if snapshot is not None else new.columns)
             if c not in (key, EVENT_TS, EVENT_DATE, EVENT_MONTH)]
    cur = new.select(key, EVENT_TS, *feats)
    if snapshot is not None:
        cur = snapshot.select(key, EVENT_TS, *feats).unionByName(cur)
    return latest_per_key(cur, key, EVENT_TS, feats, tiebreak)


_STATE = "version long, high_water_mark timestamp_ntz"


def snapshot_state(spark: SparkSession, name: str) -> tuple[int, object] | None:
    """Version and high-water mark of the published snapshot; ``None`` before the first."""
    folder = storage_path(spark, "latest", name, "_state")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema(_STATE).parquet(folder).agg(F.max("version").alias("v"), F.max_by("high_water_mark", "version").alias("t")).first()
    return None if row.v is None else (row.v, row.t)


def read_snapshot(spark: SparkSession, name: str) -> DataFrame:
    """The published latest-per-key table; an error before the first."""
    state = snapshot_state(spark, name)
    if state is None:
        raise FileNotFoundError(f"view {name!r} was never materialised")
    return spark.read.parquet(storage_path(spark, "latest", name, f"v={state[0]}"))


def _ingested_path(spark: SparkSession, name: str) -> str:
    return storage_path(spark, "latest", name, "_files")


def _unseen_rows(spark: SparkSession, view: FeatureView, table: DataFrame) -> DataFrame | None:
    """The rows of the table's files that no published version has read; ``None`` if there are none.  Only the list of
    files is compared (file names, which the driver lists for any scan), and only new files are opened."""
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "file string")
    seen = spark.read.schema("file string").parquet(_ingested_path(spark, view.name))
    new = [r.file for r in files.join(seen, "file", "left_anti").collect()]
    return spark.read.option("basePath", view_path(spark, view.name)).parquet(*new).select(table.columns) if new else None


def publish(spark: SparkSession, view: FeatureView, table: DataFrame, start=None, end=None, tiebreak: str | None = None,
            incremental: bool = True, days: int | None = DEFAULT_TTL_DAYS, late_rows: bool = False) -> DataFrame:
    """Materialise a view and publish the snapshot.  The first run (or
    ``incremental=False``) takes [start, end], by default the last ``days`` days
    up to the newest row; a later one takes only rows after the stored
    high-water mark and merges them.  A new version is written whole, then
    named in the state, so readers see the old or the new one; returns the table.

    Rows that arrive later with an event time before the mark are passed over,
    as in the reference.  With ``late_rows`` they count: ``table`` is then the
    stored view (``read_view``), each version lists the files that it has read,
    and the next one also merges all rows of files that are not listed, so such
    a row reaches the snapshot if it is newer than the value of its key.  Give
    it from the first run on."""
    key, state = view.entity.join_key, snapshot_state(spark, view.name)
    newest = table.agg(F.max(EVENT_TS)).first()[0] if end is None else end
    if newest is None:
        return read_snapshot(spark, view.name) if state else latest_per_key(
            table, key, EVENT_TS, [c for c in table.columns if c not in (key, EVENT_TS, EVENT_DATE, EVENT_MONTH)], tiebreak)
    if incremental and state:
        before = read_snapshot(spark, view.name)
        late = _unseen_rows(spark, view, table) if late_rows else None
        if late is not None:
            before = materialize_incremental(before, late, key, None, newest, tiebreak)
        out = materialize_incremental(before, table, key, state[1], newest, tiebreak)
    else:
        out = materialize(table, key, start, newest, tiebreak, days=days)
    version = state[0] + 1 if state else 0
    mark = F.lit(newest).cast("timestamp_ntz")
    mark = F.greatest(mark, F.lit(state[1]).cast("timestamp_ntz")) if state and incremental else mark
    out.write.parquet(storage_path(spark, "latest", view.name, f"v={version}"))
    if late_rows:
        spark.createDataFrame([(f,) for f in table.inputFiles()], "file string").write.parquet(f"{_ingested_path(spark, view.name)}/v={version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version"), mark.alias("high_water_mark")).coalesce(1).write.mode(
        "append").parquet(storage_path(spark, "latest", view.name, "_state"))
    return read_snapshot(spark, view.name)


def schema_check(df: DataFrame, view_name: str, declared: T.StructType) -> DataFrame:
    """S6 (re-aimed ``apply``): per declared column — present?, rows, nulls and
    values that do not cast to the declared type.  One wide aggregate over the
    table (map-side combined), unpivoted to one row per column.  See
    ``undeclared_columns`` for columns that the declaration lacks."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    present = []
    for i, f in enumerate(declared.fields):
        if f.name in df.columns:
            c = _q(f.name)
            present.append(i)
            aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
            aggs.append(F.count_if(c.isNotNull() & c.cast("string").try_cast(f.dataType).isNull()).alias(f"b{i}"))
    a = df.agg(*aggs)
    rows = []
    for i, f in enumerate(declared.fields):
        ok = i in present
        rows.append(F.struct(
            F.lit(view_name).alias("view"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("declared_type"), F.lit(ok).alias("present"),
            F.col("__n").alias("n_rows"),
            (F.col(f"n{i}") if ok else F.lit(None).cast("long")).alias("n_null"),
            (F.col(f"b{i}") if ok else F.lit(None).cast("long")).alias("n_uncastable")))
    return a.select(F.inline(F.array(*rows)))


def undeclared_columns(df: DataFrame, view: FeatureView) -> list[str]:
    """Columns of a stored view that are neither declared nor the store's own."""
    known = {view.entity.join_key, EVENT_TS, EVENT_DATE, EVENT_MONTH, *view.features}
    return [c for c in df.columns if c not in known]


def apply_views(spark: SparkSession, views: Sequence[FeatureView]) -> DataFrame:
    """Writes the catalog of declared views to the store and returns it as stored."""
    path = storage_path(spark, "registry")
    registry_table(spark, views).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def registry_table(spark: SparkSession, views: Sequence[FeatureView]) -> DataFrame:
    """Catalog of declared views: one row per (view, feature) with type, ttl, tags."""
    rows = [(v.name, v.entity.name, v.entity.join_key, f.name, f.dataType.simpleString(), v.ttl_days, v.online,
             dict(v.tags)) for v in views for f in v.schema.fields]
    schema = "view string, entity string, join_key string, feature string, dtype string, ttl_days int, " \
             "online boolean, tags map<string,string>"
    return spark.createDataFrame(rows, schema)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per data file of a view: name, size, rows, event-time range."""
    df = spark.read.parquet(path)
    return (df.groupBy(F.col("_metadata.file_name").alias("file_name"),
                       F.col("_metadata.file_size").alias("file_size"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(EVENT_TS).alias("min_event_ts"),
                 F.max(EVENT_TS).alias("max_event_ts")))
