"""Running sums over a total order without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
For cumulative distributions (KS statistic), positional windows (concept
drift), medians, splits and row numbers over a whole log we use a two-level
scheme instead:

1. ``placed`` deals the rows by ``repartitionByRange(groups, order)`` and
   stores them with the number of their range, ``__part``: rows of one range are
   neighbours in the order, and rows with equal keys share a range, so ties
   behave as in a global window;
2. per (group, range) totals form a tiny table (at most one row per range and
   one more per group); an exclusive running sum over it is what comes before
   each range;
3. these rows are put in front of the rows of their range, and one window per
   (group, range) sums both.

There is no join and no broadcast: what a whole group is known by (``facts``:
sums, least and greatest values) travels with the rows put in front, too.  NULL
groups are groups like any other; NULL order keys come first.  A call runs
two jobs while the plan is built: Spark's sample for the range bounds and the
write of the placed rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurewatch.session import materialize

#: Ranges for each shuffle partition, so that ranges dealt by hash fill all partitions about evenly.
RANGES_PER_PARTITION = 3
#: Number of ranges; None: by the shuffle partitions of the session.
BUCKETS: int | None = None

PART = "__part"
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def placed(df: DataFrame, groups: Sequence[str], order_cols: Sequence[str], buckets: int | None = BUCKETS) -> DataFrame:
    """The rows of ``df``, stored, with the number of their range of (groups, order) in ``__part``."""
    n = buckets or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *groups, *order_cols).withColumn(PART, F.spark_partition_id()))


def running_sums_of(rows: DataFrame, groups: Sequence[str], order_cols: Sequence[str], sums: dict[str, Column],
                    ties_together: bool = True, facts: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``running_sums`` of rows that ``placed`` has stored."""
    groups, facts = list(groups), facts or {}
    cell = [*groups, PART]
    totals = rows.groupBy(*cell).agg(*[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()],
                                     *[_MERGE[kind](e).alias(f"__f_{n}") for n, (kind, e) in facts.items()])
    group = Window.partitionBy(*groups)
    earlier = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    front = totals.select(*cell, *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).cast(totals.schema[f"__s_{n}"].dataType).alias(f"__s_{n}") for n in sums],
                          *[_MERGE[kind](f"__f_{n}").over(group).cast(totals.schema[f"__f_{n}"].dataType).alias(f"__f_{n}") for n, (kind, _) in facts.items()],
                          F.lit(0).alias("__own"))
    own = rows.select("*", *[e.cast(totals.schema[f"__s_{n}"].dataType).alias(f"__s_{n}") for n, e in sums.items()], F.lit(1).alias("__own"))
    both = own.unionByName(front, allowMissingColumns=True)
    w = Window.partitionBy(*cell).orderBy("__own", *order_cols)
    w = (w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties_together
         else w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = [c for c in rows.columns if c != PART]
    out = both.select(*names, "__own", *[F.sum(f"__s_{n}").over(w).alias(n) for n in sums], *[F.first(f"__f_{n}").over(w).alias(n) for n in facts])
    return out.filter("__own = 1").select(*names, *sums, *facts)


def running_sums(df: DataFrame, groups: Sequence[str], order_cols: Sequence[str], sums: dict[str, Column], buckets: int | None = BUCKETS,
                 ties_together: bool = True, facts: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Add inclusive running sums ``{name: expr}`` over ``order_cols`` within ``groups``, and ``facts`` of the whole
    group: ``{name: ("sum" | "min" | "max", expr)}``.

    With ``ties_together`` rows sharing all order values get the same (RANGE frame) running sum, like a cumulative
    distribution.
    """
    return running_sums_of(placed(df, groups, order_cols, buckets), groups, order_cols, sums, ties_together, facts)


def global_row_number(df: DataFrame, order_cols: Sequence[str], groups: Sequence[str] = (),
                      name: str = "rn", buckets: int | None = BUCKETS, count: str | None = None) -> DataFrame:
    """``row_number() over (partition by groups order by order_cols)`` computed by ranges; ``order_cols`` must identify
    rows uniquely.  ``count`` names a column for the number of rows of the group."""
    one = F.lit(1).cast("long")
    return running_sums(df, groups, order_cols, {name: one}, buckets, ties_together=False, facts={count: ("sum", one)} if count else None)
