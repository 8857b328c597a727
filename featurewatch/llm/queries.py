"""The registered queries of the numbered operators. Each is thin: it applies its operator to a whole table and
derives the digest columns of its result. ``ORACLE_SQL`` holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from featurewatch.llm import ann, bpe, html_text, langid, ngram_join, packing, periodic_runs, resampling, simhash, substring_dedup, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit_on_others(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit_on_others(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@_query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, id_col="vec_id", vector_col="embedding")


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.scaled_components(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(rows, F.col("id") % 100 == 0, k=10)


ORACLE_SQL["op3_topk"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@_query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


#: The tables hold no list and no fetch times, so the query derives both from ``pages``: hosts, parent domains and
#: first path parts are listed and dropped at dates that a hash of the pattern gives; a page was fetched at a time that
#: its id gives, within the same 30 days.
_FIRST_DAY = 1704067200


def _dated(patterns: DataFrame) -> DataFrame:
    """``list``, ``step`` and ``pattern`` to a log: of every ``step``-th pattern when it is added, dropped, added again."""
    v = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("long")
    entry = lambda when, action, day: F.when(when, F.struct(F.lit(action).alias("action"), day.alias("day")))
    rows = patterns.withColumn("v", v).filter("v % step = 0")
    log = F.array(entry(F.lit(True), "add", F.col("v") % 25), entry(F.col("v") % 4 != 0, "remove", F.col("v") % 25 + 3 + F.col("v") % 7),
                  entry(F.col("v") % 5 == 0, "add", F.col("v") % 25 + 14))
    return rows.select("list", "pattern", F.explode(F.filter(log, lambda e: e.isNotNull())).alias("e")).select(
        "list", "pattern", "e.action", F.timestamp_seconds(F.lit(_FIRST_DAY) + F.col("e.day") * 86400).alias("listed_at"))


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    places = pages.select(host.alias("host"), F.split(path, "/")[0].alias("part")).filter("host is not null").distinct()
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    listed = lambda name, step, pattern: F.struct(F.lit(name).alias("list"), F.lit(step).alias("step"), pattern.alias("pattern"))
    patterns = F.array(listed("hosts", 2, F.concat(F.lit("domain:"), "host")),
                       listed("domains", 1, F.when(parent != "", F.concat(F.lit("domain:"), parent))),
                       listed("paths", 3, F.when(F.col("part") != "", F.concat(F.lit("prefix:"), "host", F.lit("/"), "part"))))
    entries = _dated(places.select(F.explode(patterns).alias("p")).select("p.*").filter("pattern is not null").distinct())
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(_FIRST_DAY) + F.col("page_id") * 7919 % (30 * 86400)))
    out = url_filter.evaluate(captures, entries, "page_id")
    return out.select(F.col("id").alias("page_id"), "host", F.size("matches").cast("long").alias("n_matches"),
                      F.array_join(F.transform("matches", lambda m: F.concat(m["list"], F.lit(" "), m["pattern"])), "; ").alias("matched"), "blocked")


ORACLE_SQL["op8_url_filter"] = r"""
    WITH p AS (
        SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)', 1)), '\.$', ''), '') AS host,
               regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '^/', '') AS path,
               1704067200 + page_id * 7919 % 2592000 AS fetched
        FROM pages),
    c AS (
        SELECT page_id, fetched, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, 1000), '.') AS pattern
        FROM p, unnest(generate_series(1, len(string_split(host, '.')))) AS u(i) WHERE host IS NOT NULL
        UNION
        SELECT page_id, fetched, 'prefix:' || host || '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, i), '/')
        FROM p, unnest(generate_series(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')))) AS u(i) WHERE host IS NOT NULL),
    places AS (SELECT DISTINCT host, split_part(path, '/', 1) AS part FROM p WHERE host IS NOT NULL),
    patterns AS (
        SELECT DISTINCT 'hosts' AS list, 2 AS step, 'domain:' || host AS pattern FROM places
        UNION SELECT DISTINCT 'domains', 1, 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM places WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
        UNION SELECT DISTINCT 'paths', 3, 'prefix:' || host || '/' || part FROM places WHERE part <> ''),
    h AS (SELECT list, pattern, v FROM (SELECT *, CAST('0x' || substr(md5(pattern), 1, 4) AS BIGINT) AS v FROM patterns) WHERE v % step = 0),
    log AS (
        SELECT list, pattern, 1 AS active, v % 25 AS day FROM h
        UNION ALL SELECT list, pattern, 0, v % 25 + 3 + v % 7 FROM h WHERE v % 4 <> 0
        UNION ALL SELECT list, pattern, 1, v % 25 + 14 FROM h WHERE v % 5 = 0),
    latest AS (
        SELECT c.page_id, l.list, l.pattern, arg_max(l.active, l.day * 2 + 1 - l.active) AS active
        FROM c JOIN log l ON l.pattern = c.pattern AND 1704067200 + l.day * 86400 <= c.fetched
        GROUP BY ALL),
    m AS (SELECT page_id, count(*) AS n, string_agg(list || ' ' || pattern, '; ' ORDER BY list, pattern) AS matched FROM latest WHERE active = 1 GROUP BY page_id)
    SELECT p.page_id, p.host, coalesce(m.n, 0) AS n_matches, coalesce(m.matched, '') AS matched, coalesce(m.n, 0) > 0 AS blocked
    FROM p LEFT JOIN m ON m.page_id = p.page_id"""


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), sizes=range(1, 2), buckets=10_000, seed=2024, percent=10, min_words=20)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: a table of its 256 steps is folded over the bytes of each distinct word.
ORACLE_SQL["op13_resampling"] = r"""
    WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
    w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    v AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    d AS (SELECT doc_id, unnest(words) AS word FROM w),
    e AS (SELECT unnest(words) AS word FROM v),
    crc AS (
        SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                                     lambda c, b: xor(c >> 8, step[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket
        FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM e)), steps),
    s AS (SELECT bucket, count(*) AS n FROM d JOIN crc USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM e JOIN crc USING (word) GROUP BY bucket),
    total AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
    gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE)))) AS BIGINT) AS g
             FROM s LEFT JOIN t USING (bucket), total),
    weights AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM d JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
    r AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
                 CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) AS h
          FROM w LEFT JOIN weights USING (doc_id)),
    x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM r),
    y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                 count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM y"""


def _looped(docs: DataFrame) -> DataFrame:
    """Gives the documents that a hash of the id names a periodic end: word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def altered(w):
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # the array of one item binds the words to a name, so they are split once a text
    looped = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, altered(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


@_query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.detect(_looped(_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
                      F.floor(F.try_divide(1000 * F.col("strongest.length"), F.col("strongest.period"))).alias("exponent_milli"),
                      F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: Pairs come from an index of shingles; those of very frequent shingles make it slow beyond small tables.
ORACLE_SQL["op12_ngram_join"] = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
                                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
    d AS (SELECT doc_id, coalesce(len(shingles), 0) AS n, shingles FROM s),
    u AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM d),
    pairs AS (
        SELECT x.doc_id AS a, y.doc_id AS b
        FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
    reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), doc_id)) AS component_id FROM d"""
