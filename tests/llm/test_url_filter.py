import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from featurewatch.llm import url_filter as uf

DAY = datetime(2024, 1, 1)


def at(n):
    return DAY + timedelta(days=n)


ENTRIES = [("bad", "domain:example.org", "add", at(1)), ("bad", "domain:example.org", "remove", at(5)), ("bad", "domain:example.org", "add", at(9)),
           ("bad", "domain:example.org", "add", at(10)), ("ads", "prefix:a.example.org/x/y", "add", at(0)), ("ads", "domain:b.com", "remove", at(2)),
           ("ads", "domain:c.com", "add", at(3)), ("ads", "domain:c.com", "remove", at(3)), (None, "domain:d.com", "add", at(0)),
           ("ads", None, "add", at(0)), ("ads", "domain:d.com", None, at(0)), ("ads", "domain:d.com", "add", None)]
CAPTURES = [(1, "http://a.example.org/", at(0), []), (2, "http://A.Example.org.:80?q", at(1), ["bad domain:example.org"]), (3, "https://u:p@example.org/x", at(5), []),
            (4, "https://example.org", at(11), ["bad domain:example.org"]), (5, "http://a.example.org/x/y/z?k=1", at(2), ["ads prefix:a.example.org/x/y", "bad domain:example.org"]),
            (6, "http://a.example.org/x/yy", at(6), []), (7, "http://b.com/", at(9), []), (8, "http://c.com/", at(9), []), (9, "http://d.com/", at(9), []),
            (10, None, at(9), []), (11, "not a url", at(9), []), (12, "http://example.org/", None, []), (None, "http://example.org/", at(2), ["bad domain:example.org"]),
            (4, "https://example.org", at(11), ["bad domain:example.org"]), (13, "http://notexample.org/", at(2), []), (14, "http://a.example.org//x//y", at(2), ["ads prefix:a.example.org/x/y", "bad domain:example.org"])]


def test_evaluate(frame):
    captures = frame([(i, u, t, "x") for i, u, t, _ in CAPTURES], "id long, url string, fetched_at timestamp, host string")
    entries = frame(ENTRIES, "list string, pattern string, action string, listed_at timestamp")
    got = uf.evaluate(captures, entries).collect()
    assert sorted(map(str, ((r.id, [f"{m.list} {m.pattern}" for m in r.matches], r.blocked) for r in got))) == sorted(
        map(str, ((i, want, bool(want)) for i, _, _, want in CAPTURES)))
    assert uf.evaluate(captures.limit(0), entries).count() == 0
    assert uf.evaluate(captures, entries.limit(0)).filter("blocked").count() == 0


def test_intervals(frame):
    entries = frame(ENTRIES, "list string, pattern string, action string, listed_at timestamp")
    got = sorted((r.pattern, r.since, r.until) for r in uf.validity_intervals(entries).filter(F.col("list") == "bad").collect())
    assert got == [("domain:example.org", at(1), at(5)), ("domain:example.org", at(9), None)]


def brute(captures, entries):
    """Every capture against every entry, in plain Python."""
    log = {}
    for name, pattern, action, when in entries:
        if None not in (name, pattern, action, when):
            key = (name, pattern, when)
            log[key] = min(log.get(key, 1), int(action == "add"))
    out = []
    for i, host, parts, when in captures:
        labels = host.split(".")
        wanted = {"domain:" + ".".join(labels[k:]) for k in range(len(labels))} | {f"prefix:{host}/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)}
        state = {}
        for (name, pattern, since), active in sorted(log.items(), key=lambda x: x[0][2]):
            if pattern in wanted and since <= when:
                state[name, pattern] = active
        out.append((i, sorted(f"{n} {p}" for (n, p), active in state.items() if active)))
    return sorted(out)


def test_equals_brute_force_with_hot_places(frame):
    rng = random.Random(2)
    hosts = ["a.b.org", "b.org", "c.a.b.org", "x.com", "y.x.com", "org"]
    captures = []
    for i in range(900):
        hot = i % 3 == 0
        captures.append((i, "a.b.org" if hot else rng.choice(hosts), ["x", "y"] if hot else rng.choices("xyz", k=rng.randrange(5)), at(rng.randrange(40) / 2)))
    patterns = [f"domain:{h}" for h in hosts] + [f"prefix:{h}/{'/'.join(rng.choices('xyz', k=rng.randrange(1, 5)))}" for h in hosts for _ in range(6)]
    entries = [(rng.choice(["bad", "ads"]), rng.choice(patterns), rng.choice(["add", "remove"]), at(rng.randrange(20))) for _ in range(300)]
    got = uf.evaluate(frame([(i, f"http://{h}/{'/'.join(p)}", t) for i, h, p, t in captures], "id long, url string, fetched_at timestamp"),
                      frame(entries, "list string, pattern string, action string, listed_at timestamp")).collect()
    assert sorted((r.id, [f"{m.list} {m.pattern}" for m in r.matches]) for r in got) == brute(captures, entries)


def test_very_long_urls(frame):
    deep, dots = "http://h.org/" + "p/" * 50_000, "http://" + "a." * 30_000 + "h.org/x"
    entries = frame([("l", "prefix:h.org/p", "add", at(0)), ("l", "prefix:h.org/p/p/p", "add", at(0)), ("l", "prefix:h.org/p/q", "add", at(0)), ("l", "domain:h.org", "add", at(0))],
                    "list string, pattern string, action string, listed_at timestamp")
    captures = frame([(1, deep, at(1)), (2, dots, at(1)), (3, "x" * 300_000, at(1))], "id long, url string, fetched_at timestamp")
    begun = time.perf_counter()
    got = {r.id: [m.pattern for m in r.matches] for r in uf.evaluate(captures, entries).collect()}
    assert got == {1: ["domain:h.org", "prefix:h.org/p", "prefix:h.org/p/p/p"], 2: ["domain:h.org"], 3: []}
    assert time.perf_counter() - begun < 60


def test_a_hot_place_is_dealt_over_tasks(spark):
    """A third of the captures have one URL: the rows of each task are read from the result."""
    captures = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "http://hot.org/x").otherwise(F.concat(F.lit("http://h"), F.col("id"), F.lit(".org/x"))).alias("url"),
                                        F.lit(at(1)).alias("fetched_at"))
    entries = spark.createDataFrame([("l", "domain:org", "add", at(0))], "list string, pattern string, action string, listed_at timestamp")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "64", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        out = uf.evaluate(captures, entries)
        rows = [r["count"] for r in out.filter("host = 'hot.org' and blocked").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 2000 and max(rows) < 500 and out.filter("blocked").count() == 6000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
