"""Point-in-time (as-of) retrieval and latest-value snapshots.

For every entity row ``(key, t)`` and every feature view, take the newest
feature row with ``ts <= t`` and ``ts >= t - ttl``; entity rows without such
a row keep NULL features.  Ties at equal ``ts`` go to the larger tie-break
value.  Two physical plans:

``asof_join_union``  — the default.  Entity and feature rows of ALL views are
    unioned and sorted once per key; a running ``last(ignorenulls)`` carries
    each view's latest row forward.  A key with more than ``heavy_rows`` rows is
    split into time buckets, instead of one task holding its whole history: the
    latest feature row of each of its (key, bucket) is also put into the buckets
    after it, up to the next bucket that has one or to the end of its TTL.  A
    (key, bucket) with more than ``heavy_rows`` rows is cut once more, at
    quantiles of its own times, and what is latest before each part is put in
    front of it.  Work is linear: one count of keys, one sort, no pairs; rows of
    other keys are neither copied nor counted one by one.

``asof_join_range``  — left range join on the key plus ``groupBy(row id)``
    ``max_by``.  Multiplies rows for keys with dense histories; only for callers
    who know that the TTL window holds few feature rows per entity row.

NULL keys match nothing: such entity rows keep NULL features (dealt over many
buckets, as there may be many), such feature rows are left out, as are feature
rows without a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TTL_DAYS = 365


@dataclass
class ViewInput:
    """One feature view prepared for retrieval."""
    name: str
    df: DataFrame
    key: str
    ts: str
    features: Sequence[str]
    tiebreak: str | None = None
    ttl_days: int | None = DEFAULT_TTL_DAYS
    prefix: str = ""
    extra: dict = field(default_factory=dict)

    def out(self, f: str) -> str:
        return f"{self.prefix}{f}"


def _ttl_ok(ts: Column, ets: Column, ttl_days: int | None) -> Column:
    if ttl_days is None:
        return F.lit(True)
    return ts >= ets - F.make_dt_interval(F.lit(ttl_days))


def latest_per_key(df: DataFrame, key: str, ts: str, cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """Newest row per key (``max_by`` on (ts, tiebreak)); partial aggregation
    keeps a hot key to one row per task before the shuffle."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.struct(F.col(ts))
    payload = F.struct(*[F.col(c) for c in [ts, *cols] if c != key])
    return df.groupBy(key).agg(F.max_by(payload, order).alias("__l")).select(key, "__l.*")


def asof_join_range(entity: DataFrame, ekey: str, ets: str, row_id: Sequence[str], view: ViewInput) -> DataFrame:
    """J1, bounded plan: left range join + max_by per entity row."""
    f = view.df.select(F.col(view.key).alias("__k"), F.col(view.ts).alias("__fts"),
                       *([F.col(view.tiebreak).alias("__tb")] if view.tiebreak else [F.lit(0).alias("__tb")]),
                       *[F.col(c).alias(view.out(c)) for c in view.features])
    cond = (F.col(ekey) == F.col("__k")) & (F.col("__fts") <= F.col(ets)) & \
        _ttl_ok(F.col("__fts"), F.col(ets), view.ttl_days)
    j = entity.join(f, cond, "left")
    payload = F.struct(*[F.col(view.out(c)) for c in view.features], F.col("__fts").alias(f"{view.prefix}feature_ts"))
    best = F.max_by(payload, F.struct(F.col("__fts"), F.col("__tb")))
    # grouping by (key, row id) is satisfied by the join's hash partitioning on
    # the key, so the per-row max_by needs no second shuffle
    group = [ekey] + [c for c in row_id if c != ekey]
    keep = [c for c in entity.columns if c not in group]
    agg = j.groupBy(*group).agg(*[F.first(c).alias(c) for c in keep], best.alias("__b"))
    return agg.select(*entity.columns, "__b.*")


def _bucket(ts: Column, width_days: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(width_days * 86400)).cast("long")


#: A (key, bucket) with more rows than this is cut into parts.
HEAVY_ROWS = 1_000_000
#: Heavy buckets hold at least this share of all rows each, so there are at most as many as its inverse.
LEAST_SHARE = 1e-4
#: Parts of a heavy bucket at most, and places of the first step of the search for a row's part.
PARTS, COARSE = 4096, 64


#: Rows are counted by this many groups of keys first; only the keys of groups with too many rows are counted themselves.
SLOTS = 1 << 16


def _heavy_keys(keys: DataFrame, heavy_rows: int) -> DataFrame | None:
    """The keys (``__k``) with more than ``heavy_rows`` rows and at least ``LEAST_SHARE`` of the rows of all such keys;
    None if there is none."""
    slotted = keys.withColumn("__slot", F.pmod(F.xxhash64("__k"), F.lit(SLOTS)))
    full = slotted.groupBy("__slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_rows).select("__slot")
    found = full.collect()
    if not found:
        return None
    spark = keys.sparkSession
    some = slotted.join(F.broadcast(spark.createDataFrame(found, full.schema)), "__slot", "left_semi")
    rows = some.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_rows).withColumn("all", F.sum("n").over(Window.partitionBy()))
    heavy = rows.filter(F.col("n") >= LEAST_SHARE * F.col("all")).select("__k")
    found = heavy.collect()
    return spark.createDataFrame(found, heavy.schema) if found else None


def _heavy_bounds(times: DataFrame, heavy_rows: int) -> DataFrame | None:
    """(__k, __b, __bounds) of the buckets of ``times`` (__k, __b, __t) that hold too many rows, with the times at which
    each is cut; None if there is none.  At most ``1 / LEAST_SHARE`` rows, so the driver and a broadcast hold them."""
    counted = times.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.filter(F.col("n") > heavy_rows)
    total = F.sum("n").over(Window.partitionBy())
    heavy = rows.withColumn("all", total).filter(F.col("n") >= LEAST_SHARE * F.col("all")).drop("all").collect()
    if not heavy:
        return None
    spark = times.sparkSession
    cells = spark.createDataFrame(heavy, counted.schema)
    most = min(PARTS, max(2, max(-(-r.n // heavy_rows) for r in heavy)))
    cuts = F.percentile_approx("__t", [i / most for i in range(1, most)], 20 * most)
    found = times.join(F.broadcast(cells.select("__k", "__b")), ["__k", "__b"], "left_semi").groupBy("__k", "__b").agg(F.array_distinct(cuts).alias("__bounds"))
    return spark.createDataFrame(found.collect(), found.schema)


def _with_part(df: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """``df`` (__k, __b, __t, ...) with ``__s``: the part of its bucket, 0 in most."""
    if bounds is None:
        return df.withColumn("__s", F.lit(0))
    b = bounds.withColumnsRenamed({"__k": "__hk", "__b": "__hb"}).select(
        "*", F.transform(F.sequence(F.lit(0), F.floor(F.size("__bounds") / COARSE).cast("int")), lambda i: F.get("__bounds", i * COARSE)).alias("__first"))
    j = df.join(F.broadcast(b), (F.col("__k") == F.col("__hk")) & (F.col("__b") == F.col("__hb")), "left")
    t = F.col("__t")
    # the number of bounds at or before the row's time: first among each 64th, then among the 64 there
    step = F.greatest(F.size(F.filter("__first", lambda x: x <= t)) - 1, F.lit(0)) * COARSE
    part = step + F.size(F.filter(F.slice("__bounds", step + 1, F.lit(COARSE)), lambda x: x <= t))
    return j.withColumn("__s", F.when(F.col("__hk").isNull(), 0).otherwise(part)).drop(*b.columns)


def asof_join_union(entity: DataFrame, ekey: str, ets: str, views: Sequence[ViewInput],
                    bucket_days: int = 30, heavy_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """J1/J2, default plan: one union + one sort for all views, keys with more than ``heavy_rows`` rows by time buckets of
    ``bucket_days`` and parts of them.  ``heavy_rows=None``: the rows are not counted first, all keys have buckets and no
    bucket is cut."""
    ecols = entity.columns
    # the key and the time are __k and __t already
    rest = [F.col(c) for c in ecols if c not in (ekey, ets)] or [F.lit(True).alias("__none")]
    n = len(views)
    tied = [j for j, v in enumerate(views) if v.tiebreak]
    no_row = [F.lit(None).cast(_ptype(v, v.df)).alias(f"__p{j}") for j, v in enumerate(views)]
    no_tie = {j: F.lit(None).cast(_tie_type(views[j])).alias(f"__tb{j}") for j in tied}
    astray = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in ecols]), F.lit(1 << 16))    # rows without a key or a time
    stray = F.col("__k").isNull() | F.col("__t").isNull()
    feature_rows = [v.df.filter(F.col(v.key).isNotNull() & F.col(v.ts).isNotNull()).select(
        F.col(v.key).alias("__k"), F.col(v.ts).alias("__t"),
        (F.col(v.tiebreak) if v.tiebreak else F.lit(0)).alias("__tie"),
        F.struct(*[F.col(c).alias(v.out(c)) for c in v.features], F.col(v.ts).alias("__fts")).alias("__p")) for v in views]
    entity_rows = entity.select(F.col(ekey).alias("__k"), F.col(ets).alias("__t"), astray.alias("__astray"), F.struct(*rest).alias("__e"))
    keys = heavy = bounds = None
    if heavy_rows is not None:
        keys = entity_rows.filter(~stray).select("__k")
        for f in feature_rows:
            keys = keys.unionByName(f.select("__k"))
        heavy = _heavy_keys(keys, heavy_rows)

    def dealt(df: DataFrame) -> DataFrame:
        """With the bucket ``__b``: by time for heavy keys, 0 for others."""
        bucket = _bucket(F.col("__t"), bucket_days)
        if heavy is not None:
            hot = F.broadcast(heavy.select(F.col("__k").alias("__hot")))
            df, bucket = df.join(hot, F.col("__k") == F.col("__hot"), "left"), F.when(F.col("__hot").isNotNull(), bucket).otherwise(F.lit(0).cast("long"))
        elif heavy_rows is not None:
            bucket = F.lit(0).cast("long")
        return df.withColumn("__b", bucket).drop("__hot")

    def in_buckets(df: DataFrame) -> DataFrame:
        """The rows of keys that have time buckets."""
        return df.join(F.broadcast(heavy), "__k", "left_semi").select(df.columns) if heavy is not None else df

    entity_rows, feature_rows = dealt(entity_rows).withColumn("__b", F.when(stray, F.col("__astray")).otherwise(F.col("__b"))), [dealt(f) for f in feature_rows]
    if heavy is not None:
        times = in_buckets(entity_rows.filter(~stray).select("__k", "__b", "__t"))
        for f in feature_rows:
            times = times.unionByName(in_buckets(f.select("__k", "__b", "__t")))
        bounds = _heavy_bounds(times, heavy_rows)
    # entity rows: side 1 sorts after feature rows at equal time (ts <= t)
    rows = _with_part(entity_rows.select("__k", "__b", "__t", F.lit(1).alias("__side"), "__e", *no_tie.values(), *no_row), bounds)
    no_entity = F.lit(None).cast(rows.schema["__e"].dataType).alias("__e")
    for j, (v, f) in enumerate(zip(views, feature_rows, strict=True)):
        latest = F.max_by(F.struct("__t", "__tie", "__p"), F.struct("__t", "__tie")).alias("__l")
        newest = in_buckets(f).groupBy("__k", "__b").agg(latest)
        following = F.lead("__b").over(Window.partitionBy("__k").orderBy("__b"))
        if v.ttl_days is None:
            last = F.coalesce(following, entity.agg(F.max(_bucket(F.col(ets), bucket_days))).scalar())
        else:
            last = F.least(following, F.col("__b") + v.ttl_days // bucket_days + 1)    # least() skips NULL
        ahead = newest.withColumn("__last", last).filter(F.col("__last") > F.col("__b")).select(
            "__k", F.explode(F.sequence(F.col("__b") + 1, F.col("__last"))).alias("__b"), "__l.*").select(f.columns)
        parts = [_with_part(f, bounds)]
        if heavy is not None or heavy_rows is None:
            parts.append(ahead.withColumn("__s", F.lit(0)).select(parts[0].columns))
        if bounds is not None:
            # a heavy bucket: the latest row before each of its parts, be it from a bucket before or a part before
            grid = bounds.select("__k", "__b", F.explode(F.sequence(F.lit(0), F.size("__bounds"))).alias("__s"), F.lit(None).cast(newest.schema["__l"].dataType).alias("__l"))
            cells = F.broadcast(bounds.select("__k", "__b"))
            inside = _with_part(f.join(cells, ["__k", "__b"], "left_semi"), bounds).groupBy("__k", "__b", "__s").agg(latest)
            entering = ahead.join(cells, ["__k", "__b"], "left_semi").select("__k", "__b", F.lit(-1).alias("__s"), F.struct("__t", "__tie", "__p").alias("__l"))
            every = grid.unionByName(inside).unionByName(entering).groupBy("__k", "__b", "__s").agg(F.first("__l", ignorenulls=True).alias("__l"))
            earlier = Window.partitionBy("__k", "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
            carried = every.withColumn("__l", F.last("__l", ignorenulls=True).over(earlier)).filter("__s > 0 and __l is not null")
            parts.append(carried.select("__k", "__b", "__l.*", "__s").select(parts[0].columns))
        for part in parts:
            rows = rows.unionByName(part.select(
                "__k", "__b", "__s", "__t", F.lit(0).alias("__side"), no_entity,
                *[F.col("__tie").alias(f"__tb{i}") if i == j else no_tie[i] for i in tied],
                *[F.col("__p").alias(f"__p{i}") if i == j else no_row[i] for i in range(n)]))
    w = (Window.partitionBy("__k", "__b", "__s").orderBy("__t", "__side", *[f"__tb{j}" for j in tied])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = rows.select("__k", "__t", "__side", "__e", *[F.last(f"__p{j}", ignorenulls=True).over(w).alias(f"__p{j}") for j in range(n)])
    ent = filled.filter(F.col("__side") == 1)
    # the union may have widened the key and the time
    own = {c: F.col(at).cast(entity.schema[c].dataType) for c, at in ((ekey, "__k"), (ets, "__t"))}
    out = [(own[c] if c in own else F.col(f"__e.{c}")).alias(c) for c in ecols]
    et = own[ets]
    for j, v in enumerate(views):
        ok = F.col(f"__p{j}").isNotNull() & _ttl_ok(F.col(f"__p{j}.__fts"), et, v.ttl_days)
        for c in v.features:
            out.append(F.when(ok, F.col(f"__p{j}.{v.out(c)}")).alias(v.out(c)))
        out.append(F.when(ok, F.col(f"__p{j}.__fts")).alias(f"{v.prefix}feature_ts"))
    return ent.select(*out)


def _tie_type(v: ViewInput):
    return v.df.schema[v.tiebreak].dataType if v.tiebreak else T.IntegerType()


def _ptype(v: ViewInput, df: DataFrame):
    return df.select(F.struct(*[F.col(c).alias(v.out(c)) for c in v.features],
                              F.col(v.ts).alias("__fts")).alias("x")).schema["x"].dataType


def online_lookup(ids: DataFrame, key: str, latest: DataFrame) -> DataFrame:
    """One row per requested id with its latest values and ``found``.  The
    planner and adaptive execution choose the joins by size in bytes."""
    ids_d = ids.select(key).distinct()
    matched = latest.join(ids_d, key, "left_semi")
    j = ids_d.join(matched.withColumn("found", F.lit(True)), key, "left")
    return j.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
