"""Operator 8: URL filters with dated lists, as a temporal join.

A list is a log of dated entries: a pattern is added to it or removed from it. The log becomes validity intervals, one
row per pattern with its intervals in order. A capture (a URL and the time it was fetched) has a few candidate
patterns: its host and the host's parent domains, and its host with each leading part of the path. The as-of join
looks each candidate up among the patterns and keeps the lists whose interval holds the time of the fetch, so every
capture is judged by the entries that were active when it was fetched, not by today's.

Everything is DataFrame operations. Candidates are made distinct before the lookup: a place is matched a few times
however many captures it has. A hot place or pattern is dealt over ``SALTS`` groups by a salt from the rows that need it:
the lookup runs once for each place and salt that occur, so no join meets a key with more than about its share of rows.
Only candidates as deep as some listed pattern are made, so a URL of many parts costs its length for each depth in the
list, not the square of its length.

Patterns: ``domain:example.org`` (the domain and all below it), ``prefix:example.org/a/b`` (the host exactly, paths
that start with these parts). Captures with a null or unreadable URL or a null time are kept with no match. An
entry with a null list, pattern, action or time is left out. Of entries of one list and pattern at one time a
removal wins. Adding what is active and removing what is not changes nothing. Repeated captures stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a closing dot; null if the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), "^/", "")


#: Groups over which the rows of one place or pattern are dealt.
SALTS = 64


def candidates(host: Column, path: Column, domain_depths: Column, prefix_depths: Column) -> Column:
    """Domain patterns of the host and its parents, prefix patterns of the host and each leading part of the path, where
    a listed pattern has as many labels (``domain_depths``) or parts (``prefix_depths``, both arrays of distinct numbers)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.filter(domain_depths, lambda d: d <= F.size(labels)),
                          lambda d: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.size(labels) - d + 1, d), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.filter(prefix_depths, lambda d: d <= F.size(parts)),
                           lambda d: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), d), "/")))
    return F.array_distinct(F.concat(domains, prefixes))


def depths(patterns: DataFrame) -> Column:
    """One value for all ``pattern``: the numbers of labels of the domains and of parts of the prefixes."""
    count = lambda sign: F.length("pattern") - F.length(F.replace("pattern", F.lit(sign)))
    return patterns.agg(F.struct(F.collect_set(F.when(F.startswith("pattern", F.lit("domain:")), count(".") + 1)).alias("domain"),
                                 F.collect_set(F.when(F.startswith("pattern", F.lit("prefix:")) & (count("/") > 0), count("/"))).alias("prefix")).alias("d")).scalar()


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries: ``list``, ``pattern``, ``action`` ('add' or 'remove'), ``listed_at``. Gives ``list``, ``pattern``, ``since``
    and ``until`` (null: still active) of every stretch in which the pattern is on the list."""
    dated = entries.select(F.col("list").cast("string"), F.col("pattern").cast("string"), F.col("action").cast("string"), F.col("listed_at").cast("timestamp")
                           ).filter("list is not null and pattern is not null and listed_at is not null and action in ('add', 'remove')")
    state = dated.groupBy("list", "pattern", "listed_at").agg(F.min((F.col("action") == "add").cast("int")).alias("active"))
    order = Window.partitionBy("list", "pattern").orderBy("listed_at")
    changes = state.withColumn("before", F.coalesce(F.lag("active").over(order), F.lit(0))).filter("active <> before")
    return changes.withColumn("until", F.lead("listed_at").over(order)).filter("active = 1").select(
        "list", "pattern", F.col("listed_at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture ``id``, ``host``, ``matches`` (array of list, pattern and since, in order) and ``blocked``."""
    intervals = validity_intervals(entries).groupBy("pattern").agg(
        F.array_sort(F.collect_list(F.struct("list", "pattern", "since", "until"))).alias("intervals"))
    seen = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("timestamp").alias("at"))
    salt = F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).alias("salt")
    seen = seen.select("id", "at", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), salt)
    places = seen.filter("host is not null and at is not null").select("host", "path", "salt").distinct()
    known = depths(intervals.select("pattern"))
    places = places.withColumns({"domain_depths": known["domain"], "prefix_depths": known["prefix"]})
    wanted = places.select("host", "path", "salt", F.explode(candidates(*map(F.col, ("host", "path", "domain_depths", "prefix_depths")))).alias("pattern"))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("host", "path", "salt"), F.lit(SALTS)))
    found = wanted.select("pattern", "part").distinct().join(intervals, "pattern")     # a pattern at most SALTS times
    listed = wanted.join(found, ["pattern", "part"]).groupBy("host", "path", "salt").agg(F.flatten(F.collect_list("intervals")).alias("intervals"))
    active = lambda i: (i["since"] <= F.col("at")) & (i["until"].isNull() | (F.col("at") < i["until"]))
    matches = F.array_sort(F.transform(F.filter("intervals", active), lambda i: F.struct(i["list"].alias("list"), i["pattern"].alias("pattern"), i["since"].alias("since"))))
    none = F.array().cast("array<struct<list:string,pattern:string,since:timestamp>>")
    return seen.join(listed, ["host", "path", "salt"], "left").select("id", "host", F.coalesce(matches, none).alias("matches")).withColumn(
        "blocked", F.size("matches") > 0)
