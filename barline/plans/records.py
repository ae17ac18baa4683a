"""Queries on records: reading and writing, duplicates, ledgers, facts, documents, scores of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import joins
from barline.sources import sinks
from barline.sources.tables import DAILY_SQL, daily_prices, millis, table

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
D = "(PARTITION BY symbol ORDER BY day"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def scan_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return sinks.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", 3)


@query("""WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN embedding[1:10] ELSE embedding END AS e FROM embeddings WHERE label IS NOT NULL), m AS (SELECT len(e) AS n FROM v GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)
SELECT vec_id, CAST(len(e) AS INTEGER) AS dim FROM v, m WHERE len(e) = m.n""")
def modal_length_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Only the vectors of the commonest length, which is one row."""
    v = table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("e"))
    mode = v.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    return v.withColumn("dim", F.size("e")).join(F.broadcast(mode), "dim").select("vec_id", "dim")


@query("""SELECT table_name, column_name FROM (VALUES ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('orders', 'o_orderpriority')) t(table_name, column_name)""")
def column_introspection(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "orders").columns
    return spark.createDataFrame([("orders", c) for c in names], "table_name string, column_name string")


@query("""WITH s AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) END AS volume FROM orders GROUP BY 1, 2)
SELECT symbol, count(*) AS sessions, count(volume) AS known, min(day) AS first_day, max(day) AS last_day, CAST(sum(volume) AS BIGINT) AS volume, round(sum(close), 2) AS total FROM s WHERE volume IS NULL OR volume > 1 GROUP BY symbol""")
def csv_snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Prices written as text, a folder a symbol, and read again: empty fields are null, days of a single order no sessions."""
    o = table(spark, d, "orders")
    s = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("close"), F.count("*").alias("volume"))
    path = sinks.scratch(spark, "csv")
    sinks.write_csv(s.withColumn("volume", F.when(F.col("volume") % 3 != 0, F.col("volume"))), path, "symbol")
    back = sinks.read_csv(spark, path, "day date, close double, volume long, symbol string").where("volume IS NULL OR volume > 1")
    return back.groupBy("symbol").agg(F.count("*").alias("sessions"), F.count("volume").alias("known"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("volume").alias("volume"), F.round(F.sum("close"), 2).alias("total"))


@query("""SELECT o_orderpriority AS symbol, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS verified FROM orders GROUP BY 1""")
def json_records_verified(spark: SparkSession, d: str) -> DataFrame:
    """Records as lines of JSON, read again only if their digest is that of what was written; the path is the digest."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), "o_orderkey", "o_totalprice")
    path = sinks.write_once(o, sinks.scratch(spark, "records"))
    sound = sinks.verify(spark, path)
    text_path = sinks.scratch(spark, "json")
    spark.read.parquet(path).write.json(text_path)
    back = spark.read.schema(o.schema).json(text_path)
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("verified", F.lit(sound))


@query("""SELECT o_orderstatus AS status, o_orderkey % 4 AS shard, count(*) + CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE 0 END AS n, CAST(sum(CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS versions FROM orders GROUP BY 1, 2""")
def replace_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table by partitions, of which one is written anew: the others stay."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).alias("shard"))
    path = sinks.scratch(spark, "slices")
    sinks.replace_slices(o.withColumn("version", F.lit(1)).repartition("shard"), path, ["shard"])
    sinks.replace_slices(o.where("shard = 1").withColumn("version", F.lit(2)).repartition("shard"), path, ["shard"])
    back = spark.read.schema("o_orderkey long, status string, version int, shard long").parquet(path)
    return back.groupBy("status", "shard").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT k, v, 'first' AS writer FROM a UNION ALL SELECT k, v, 'second' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def insert_ignore_first_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("writer", F.lit("first"))
    b = o.where("o_orderkey % 3 = 1").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v")).withColumn("writer", F.lit("second"))
    path = sinks.scratch(spark, "first-wins")
    a.write.parquet(path)
    sinks.insert_missing(spark, path, b, ["k"])
    return spark.read.schema(a.schema).parquet(path)


@query("""WITH f AS (SELECT DISTINCT o_custkey % 500 AS file FROM orders), r AS (SELECT o_custkey % 50 AS run, max(o_orderkey) AS seen_at, list(DISTINCT o_custkey % 500) AS files FROM orders GROUP BY 1), k AS (SELECT unnest(files) AS file FROM (SELECT files FROM r ORDER BY seen_at DESC, run DESC LIMIT 10))
SELECT file FROM f WHERE file NOT IN (SELECT file FROM k)""")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    """Files that none of the ten newest runs refers to."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("file"), (F.col("o_custkey") % 50).alias("run"), "o_orderkey")
    runs = o.groupBy("run").agg(F.max("o_orderkey").alias("at"), F.collect_set("file").alias("files"))
    return sinks.unreachable(o.select("file").distinct(), runs, 10)


@query("""SELECT o_orderstatus AS scope, count(*) AS before, count(*) FILTER (o_orderpriority IS NOT DISTINCT FROM '5-LOW' OR o_totalprice < 50000) AS deleted, count(*) FILTER (NOT (o_orderpriority IS NOT DISTINCT FROM '5-LOW' OR o_totalprice < 50000)) AS after FROM orders GROUP BY 1""")
def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each scope before, deleted and after a clean-up, which is planned in one scan."""
    gone = F.col("o_orderpriority").eqNullSafe("5-LOW") | (F.col("o_totalprice") < 50000)
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("scope")).agg(F.count("*").alias("before"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("after"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0)) AS a FROM pages)
SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS title, count(*) AS n FROM l GROUP BY ALL""")
def listing_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of raw pages, by pattern."""
    found = F.expr("""regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0)""")
    a = table(spark, d, "pages").select("page_id", F.explode(found).alias("a"))
    return a.groupBy("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("title")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, 'licen[sc]e|copyright') THEN 'legal' WHEN len(regexp_extract_all(t, '[0-9]+')) >= 5 THEN 'numeric' WHEN length(t) < 200 THEN 'short' ELSE 'text' END AS kind, CAST(len(regexp_extract_all(t, '[0-9]+')) AS INTEGER) AS numbers, regexp_extract(t, '[0-9]+(\\.[0-9]+)?', 0) AS first_number,
  regexp_matches(t, '[a-z0-9._]+@[a-z0-9.]+') OR regexp_matches(t, 'password|secret|api[_-]?key') AS withheld FROM x""")
def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of text by ordered patterns, numbers in them, and what must not be shown."""
    t = F.lower(F.coalesce("text", F.lit("")))
    numbers = F.size(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)))
    kind = F.when(t.rlike("licen[sc]e|copyright"), "legal").when(numbers >= 5, "numeric").when(F.length(t) < 200, "short").otherwise("text")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), numbers.alias("numbers"), F.regexp_extract(t, r"[0-9]+(\.[0-9]+)?", 0).alias("first_number"), (t.rlike("[a-z0-9._]+@[a-z0-9.]+") | t.rlike("password|secret|api[_-]?key")).alias("withheld"))


@query("""WITH r AS (SELECT user_id % 50 AS k, CAST(ts AS DATE) AS day, CAST(floor(value / 100) AS BIGINT) AS v FROM events), g AS (SELECT k, day, count(*) AS copies, count(DISTINCT v) AS kinds, min(v) AS v FROM r GROUP BY k, day)
SELECT k, day, copies, CASE WHEN kinds > 1 THEN 'conflict' WHEN copies > 1 THEN 'collapsed' ELSE 'single' END AS state, CASE WHEN kinds = 1 THEN v END AS v FROM g""")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """Equal records of a key become one, different ones are a conflict and have no value."""
    r = table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), F.to_date("ts").alias("day"), F.floor(F.col("value") / 100).alias("v"))
    g = r.groupBy("k", "day").agg(F.count("*").alias("copies"), F.min("v").alias("v"), F.max("v").alias("w"))
    same = F.col("v") == F.col("w")
    return g.select("k", "day", "copies", F.when(~same, "conflict").when(F.col("copies") > 1, "collapsed").otherwise("single").alias("state"), F.when(same, F.col("v")).alias("v"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS market, event_id, CAST(floor(value) AS BIGINT) AS trials, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE user_id % 20 = 0),
c AS (SELECT market, event_id, n, sha256('' || '|' || CAST(event_id AS VARCHAR) || ',' || CAST(trials AS VARCHAR)) AS chain FROM e WHERE n = 1 UNION ALL SELECT e.market, e.event_id, e.n, sha256(c.chain || '|' || CAST(e.event_id AS VARCHAR) || ',' || CAST(e.trials AS VARCHAR)) FROM c JOIN e ON e.market = c.market AND e.n = c.n + 1)
SELECT market, count(*) AS entries, arg_max(chain, n) AS head FROM c GROUP BY market""")
def hash_chained_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The last link of each market's chain, in which every entry's digest covers the one before: a fold over a ledger, which is
    bounded by what was registered by hand."""
    e = table(spark, d, "events").where("user_id % 20 = 0").select(F.col("event_type").alias("market"), "event_id", F.floor("value").alias("trials"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "trials"))), lambda r: F.concat_ws(",", r["event_id"], r["trials"]))
    g = e.groupBy("market").agg(F.count("*").alias("entries"), lines.alias("lines"))
    return g.select("market", "entries", F.aggregate("lines", F.lit(""), lambda s, x: F.sha2(F.concat(s, F.lit("|"), x), 256)).alias("head"))


@query("""WITH e AS (SELECT event_type AS market, user_id AS study, event_id, CAST(floor(value) AS BIGINT) AS trials, event_id % 4 <> 0 AS exact FROM events), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY market, study ORDER BY event_id DESC) = 1)
SELECT market, count(*) AS studies, CAST(sum(trials) AS BIGINT) AS trials, bool_and(exact) AS exact, CASE WHEN bool_and(exact) THEN 'exact' ELSE 'lower_bound' END AS reading, round(0.05 / sum(trials), 10) AS bonferroni FROM l GROUP BY market""")
def trial_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trials of the entries that none supersedes, whether they are exact, and the level that they leave for each."""
    e = table(spark, d, "events").select(F.col("event_type").alias("market"), "user_id", "event_id", F.floor("value").alias("trials"), (F.col("event_id") % 4 != 0).alias("exact"))
    l = e.groupBy("market", "user_id").agg(F.max_by(F.struct("trials", "exact"), "event_id").alias("l")).select("market", "l.*")
    g = l.groupBy("market").agg(F.count("*").alias("studies"), F.sum("trials").alias("trials"), F.bool_and("exact").alias("exact"))
    return g.select("*", F.when(F.col("exact"), "exact").otherwise("lower_bound").alias("reading"), F.round(0.05 / F.col("trials"), 10).alias("bonferroni"))


@query("""WITH e AS (SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click' AND event_id % 3 = 0) AS a, arg_max(value, event_id) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id) SELECT user_id, round(coalesce(a, b, 1.0), 6) AS ratio, CASE WHEN a IS NOT NULL THEN 'own' WHEN b IS NOT NULL THEN 'global' ELSE 'default' END AS source FROM e""")
def latest_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The last value of the best source that has one, else 1."""
    e = table(spark, d, "events")
    of = lambda c: F.max_by(F.when(c, F.col("value")), F.when(c, F.col("event_id")))
    g = e.groupBy("user_id").agg(of((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0)).alias("a"), of(F.col("event_type") == "view").alias("b"))
    return g.select("user_id", R(F.coalesce("a", "b", F.lit(1.0))).alias("ratio"), F.when(F.col("a").isNotNull(), "own").when(F.col("b").isNotNull(), "global").otherwise("default").alias("source"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(min(o_orderdate) AS DATE) END AS listed, min(o_custkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
n AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS notice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1993-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1)
SELECT c_custkey, coalesce(listed, notice) AS published, CASE WHEN listed IS NOT NULL THEN 'listing' WHEN notice IS NOT NULL THEN 'notice' ELSE 'unknown' END AS source FROM c LEFT JOIN n ON n.o_custkey = c.c_custkey""")
def publication_dates(spark: SparkSession, d: str) -> DataFrame:
    """A document's own date, or that of the earliest notice in the window; filled only where there is none."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    inside = (F.col("o_orderstatus") == "F") & (F.col("day") >= "1993-01-01") & (F.col("day") < "1997-01-01")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("day").alias("first"), F.min(F.when(inside, F.col("day"))).alias("notice"))
    x = table(spark, d, "customer").select("c_custkey").join(g, "c_custkey", "left").withColumn("listed", F.when(F.col("c_custkey") % 5 != 0, F.col("first")))
    return x.select("c_custkey", F.coalesce("listed", "notice").alias("published"), F.when(F.col("listed").isNotNull(), "listing").when(F.col("notice").isNotNull(), "notice").otherwise("unknown").alias("source"))


@query("""SELECT o_custkey, o_orderkey, tier, CAST(k AS INTEGER) AS place FROM (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 4""")
def document_targets(spark: SparkSession, d: str) -> DataFrame:
    """The four documents of each owner that come first: by tier, then the newest, then by key."""
    o = table(spark, d, "orders").withColumn("tier", F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3))
    w = Window.partitionBy("o_custkey").orderBy("tier", F.desc("o_orderdate"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 4").select("o_custkey", "o_orderkey", "tier", "place")


@query("""SELECT c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey) = 1""")
def latest_by_revision(spark: SparkSession, d: str) -> DataFrame:
    """Each owner with the document of its highest revision and latest fetch, nulls last."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderpriority")
    x = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    w = Window.partitionBy("c_custkey").orderBy(F.desc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_orderdate"), "o_orderkey")
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("c_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("""WITH i AS (SELECT l_orderkey AS k, round(sum(l_extendedprice) FILTER (l_linenumber = 1), 2) AS a, round(sum(l_extendedprice) FILTER (l_linenumber > 1), 2) AS b, round(sum(l_extendedprice) * (1 + CASE WHEN l_orderkey % 7 = 0 THEN 0.001 WHEN l_orderkey % 11 = 0 THEN 0.1 ELSE 0 END), 2) AS total FROM lineitem GROUP BY l_orderkey)
SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN 'incomplete' WHEN abs(total - (a + b)) < 0.05 THEN 'pass' WHEN abs(total - (a + b)) <= 0.005 * abs(total) THEN 'weak' ELSE 'fail' END AS verdict FROM i""")
def statement_identities(spark: SparkSession, d: str) -> DataFrame:
    """A total against the sum of its terms: within a rounding, within a tolerance, off, or a term is missing."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_extendedprice")
    part = lambda c: F.round(F.sum(F.when(c, F.col("l_extendedprice"))), 2)
    off = F.when(F.col("k") % 7 == 0, 0.001).when(F.col("k") % 11 == 0, 0.1).otherwise(0.0)
    i = l.groupBy("k").agg(part(F.col("l_linenumber") == 1).alias("a"), part(F.col("l_linenumber") > 1).alias("b"), F.sum("l_extendedprice").alias("s")).withColumn("total", F.round(F.col("s") * (1 + off), 2))
    gap = F.abs(F.col("total") - (F.col("a") + F.col("b")))
    return i.select("k", F.when(F.col("a").isNull() | F.col("b").isNull(), "incomplete").when(gap < 0.05, "pass").when(gap <= 0.005 * F.abs("total"), "weak").otherwise("fail").alias("verdict"))


@query("""WITH f AS (SELECT s_suppkey, l_orderkey, sum(l_quantity) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), q AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
c AS (SELECT k, y, q, sum(v) OVER (PARTITION BY k, y ORDER BY q) AS cumulative FROM q)
SELECT k, CAST(y AS INTEGER) AS y, CAST(q AS INTEGER) AS q, cumulative, round(cumulative - coalesce(lag(cumulative) OVER (PARTITION BY k, y ORDER BY q), 0), 4) AS quarter_value FROM c""")
def quarters_from_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """A quarter's value as the difference of cumulative ones of its year."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.sum("l_quantity").alias("v"))
    w = Window.partitionBy("k", "y").orderBy("q")
    c = l.withColumn("cumulative", F.sum("v").over(w))
    return c.select("k", "y", "q", "cumulative", F.round(F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)), 4).alias("quarter_value"))


@query(f"""WITH {DAILY_SQL}, h AS (SELECT * FROM daily WHERE day < DATE '1996-01-01'), l AS (SELECT symbol, day, CASE WHEN day = DATE '1995-12-30' THEN close + 1 ELSE close END AS close FROM daily WHERE day >= DATE '1995-12-01'),
o AS (SELECT h.symbol, count(*) AS overlap, count(*) FILTER (abs(h.close - l.close) > 1e-9) AS differ FROM h JOIN l USING (symbol, day) GROUP BY h.symbol), u AS (SELECT symbol, day FROM h UNION SELECT symbol, day FROM l)
SELECT u.symbol, count(*) AS days, any_value(overlap) AS overlap, any_value(differ) AS differ FROM u JOIN o ON o.symbol = u.symbol GROUP BY u.symbol""")
def splice_with_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """History and a live part as one series, and where both have a day whether they agree (one day differs on purpose)."""
    x = daily_prices(spark, d)
    h = x.where("day < DATE '1996-01-01'").select("symbol", "day", F.col("close").alias("a"))
    l = x.where("day >= DATE '1995-12-01'").select("symbol", "day", F.when(F.col("day") == "1995-12-30", F.col("close") + 1).otherwise(F.col("close")).alias("b"))
    j = h.join(l, ["symbol", "day"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.groupBy("symbol").agg(F.count("*").alias("days"), F.count_if(both).alias("overlap"), F.count_if(both & (F.abs(F.col("a") - F.col("b")) > 1e-9)).alias("differ"))


@query("""WITH p AS (SELECT user_id % 40 AS k, count(*) AS n, avg(value) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id % 40 AS k, event_id, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'view')
SELECT k, CAST(n + (SELECT count(*) FROM b WHERE b.k = p.k AND n < 50 AND r <= 50 - n) AS BIGINT) AS used, n < 50 AS topped_up FROM p""")
def fallback_append(spark: SparkSession, d: str) -> DataFrame:
    """Where a key has under fifty own trades, the newest of another source fill them up."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("k"), "event_id", "event_type")
    own = e.where("event_type = 'purchase'").groupBy("k").agg(F.count("*").alias("n"))
    more = e.where("event_type = 'view'").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("event_id")))).where("r <= 50")
    filled = more.join(own, "k").where("n < 50 AND r <= 50 - n").groupBy("k").agg(F.count("*").alias("m"))
    return own.join(filled, "k", "left").select("k", (F.col("n") + F.coalesce("m", F.lit(0))).cast("long").alias("used"), (F.col("n") < 50).alias("topped_up"))


@query("""SELECT DISTINCT event_type AS undeclared FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def undeclared_identities(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([("view",), ("click",), ("purchase",)], "undeclared string")
    return table(spark, d, "events").select(F.col("event_type").alias("undeclared")).subtract(declared)


@query("""WITH q AS (SELECT c_custkey, CAST(unnest(generate_series(DATE '1995-03-31', DATE '1996-12-31', INTERVAL 3 MONTH)) AS DATE) AS q0 FROM customer WHERE c_custkey % 10 = 0), e AS (SELECT c_custkey, last_day(q0) AS period FROM q),
h AS (SELECT DISTINCT o_custkey AS c_custkey, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period FROM orders) SELECT c_custkey, period, CAST(period + INTERVAL 45 DAY AS DATE) AS due FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.c_custkey = e.c_custkey AND h.period = e.period)""")
def period_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of two years that an owner has no document of, and when it was due."""
    months = F.expr("sequence(DATE '1995-03-01', DATE '1996-12-01', INTERVAL 3 MONTH)")
    e = table(spark, d, "customer").where("c_custkey % 10 = 0").select("c_custkey", F.explode(months).alias("m")).select("c_custkey", F.last_day("m").alias("period"))
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2)).alias("period")).distinct()
    return e.join(h, ["c_custkey", "period"], "left_anti").withColumn("due", F.date_add("period", 45))


_PROBS = """x AS (SELECT doc_id, CAST(n_chars % 3 AS INTEGER) AS y, 1 + n_chars % 7 AS a, 1 + n_chars % 5 AS b, 1 + n_chars % 11 AS c FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT doc_id, y, a / CAST(a + b + c AS DOUBLE) AS p0, b / CAST(a + b + c AS DOUBLE) AS p1, c / CAST(a + b + c AS DOUBLE) AS p2 FROM x)"""


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    a, b, c = 1 + n % 7, 1 + n % 5, 1 + n % 11
    p = F.array(*[(v / (a + b + c)).cast("double") for v in (a, b, c)])
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", (n % 3).cast("int").alias("y"), p.alias("p"))


@query(f"""WITH {_PROBS}, e AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS hat, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS own FROM p),
b AS (SELECT CAST(floor(conf * 10) AS BIGINT) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN hat = y THEN 1.0 ELSE 0.0 END) AS h FROM e GROUP BY 1), l AS (SELECT least(bin, 9) AS bin, sum(n) AS n, sum(n * c) / sum(n) AS c, sum(n * h) / sum(n) AS h FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS n, round((SELECT avg((p0 - CASE WHEN y = 0 THEN 1 ELSE 0 END) * (p0 - CASE WHEN y = 0 THEN 1 ELSE 0 END) + (p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END) * (p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END) + (p2 - CASE WHEN y = 2 THEN 1 ELSE 0 END) * (p2 - CASE WHEN y = 2 THEN 1 ELSE 0 END)) FROM e), 6) AS brier,
  round((SELECT avg(-ln(greatest(own, 1e-12))) FROM e), 6) AS log_loss, round((SELECT sum(n * abs(c - h)) FROM b WHERE bin < 10) / (SELECT count(*) FROM e), 6) AS ece_open, round((SELECT sum(n * abs(c - h)) FROM l) / (SELECT count(*) FROM e), 6) AS ece_closed, (SELECT count(*) FROM p WHERE abs(p0 + p1 + p2 - 1) > 1e-9) AS unsound""")
def multiclass_scores(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and log loss over three classes, both calibration errors (certain forecasts left out, or in the last bin),
    and forecasts that don't sum to one."""
    x = _probabilities(spark, d)
    conf = F.array_max("p")
    x = x.withColumn("conf", conf).withColumn("hit", (F.array_position("p", conf) - 1 == F.col("y")).cast("int")).withColumn("own", F.element_at("p", F.col("y") + 1))
    brier = F.aggregate(F.transform("p", lambda v, k: (v - (k == F.col("y")).cast("int")) * (v - (k == F.col("y")).cast("int"))), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v)
    b = x.withColumn("brier", brier).withColumn("total", total).groupBy(F.floor(F.col("conf") * 10).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("conf").alias("c"), F.sum("hit").alias("h"), F.sum("brier").alias("brier"), F.sum(-F.log(F.greatest("own", F.lit(1e-12)))).alias("loss"), F.count_if(F.abs(F.col("total") - 1) > 1e-9).alias("unsound")
    )
    closed = b.groupBy(F.least("bin", F.lit(9)).alias("bin")).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h")).agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("closed"))
    one = b.agg(F.sum("n").alias("n"), R(F.sum("brier") / F.sum("n")).alias("brier"), R(F.sum("loss") / F.sum("n")).alias("log_loss"), R(F.sum(F.when(F.col("bin") < 10, F.abs(F.col("c") - F.col("h")))) / F.sum("n")).alias("ece_open"), F.sum("unsound").alias("unsound"))
    return one.crossJoin(closed).select("n", "brier", "log_loss", "ece_open", R("closed").alias("ece_closed"), "unsound")


@query(f"""WITH {_PROBS}, e AS (SELECT y, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS hat FROM p), k AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k),
c AS (SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (y = k AND hat = k) AS tp, count(*) FILTER (y <> k AND hat = k) AS fp, count(*) FILTER (y = k AND hat <> k) AS fn FROM e, k GROUP BY k)
SELECT k, support, tp, fp, fn, round(tp / support, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(avg(tp / support) OVER (), 6) AS balanced, round(avg(2 * tp / (2 * tp + fp + fn)) OVER (), 6) AS macro_f1, round(max(support) OVER () / sum(support) OVER (), 6) AS majority FROM c""")
def multiclass_confusion(spark: SparkSession, d: str) -> DataFrame:
    """By class: support, hits, misses, recall and F1; over all: balanced accuracy, macro F1, and the majority's share."""
    x = _probabilities(spark, d).select("y", (F.array_position("p", F.array_max("p")) - 1).alias("hat"))
    cells = x.groupBy("y", "hat").count()
    k = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    mine, said = F.col("y") == F.col("k"), F.col("hat") == F.col("k")
    c = k.groupBy("k").agg(count(mine).alias("support"), count(mine & said).alias("tp"), count(~mine & said).alias("fp"), count(mine & ~said).alias("fn"))
    whole = Window.partitionBy()  # a row a class
    recall, f1 = F.col("tp") / F.col("support"), 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("k", "support", "tp", "fp", "fn", R(recall).alias("recall"), R(f1).alias("f1"), R(F.avg(recall).over(whole)).alias("balanced"), R(F.avg(f1).over(whole)).alias("macro_f1"), R(F.max("support").over(whole) / F.sum("support").over(whole)).alias("majority"))


@query("""WITH x AS (SELECT user_id % 100 AS k, CAST(event_id % 3 AS INTEGER) - 1 AS vote FROM events), c AS (SELECT k, vote, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT k, max(n) AS top FROM c GROUP BY k)
SELECT c.k, CAST(CASE WHEN count(*) FILTER (n = top) = 1 THEN max(vote) FILTER (n = top) ELSE 0 END AS INTEGER) AS vote FROM c JOIN m USING (k) GROUP BY c.k""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """The commonest vote; flat where several are."""
    c = table(spark, d, "events").groupBy((F.col("user_id") % 100).alias("k"), ((F.col("event_id") % 3).cast("int") - 1).alias("vote")).count()
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "vote")))  # three votes
    s = c.groupBy("k").agg(sorted_.alias("s"))
    return s.select("k", F.when((F.size("s") == 1) | (F.col("s")[0]["n"] < F.get("s", F.lit(1))["n"]), F.col("s")[0]["vote"]).otherwise(0).alias("vote"))


@query("""WITH x AS (SELECT quality AS y, least(1.0, greatest(0.0, 0.5 + (n_chars % 997) / 1994.0)) AS p, n_chars % 13 - 6 AS r FROM labels JOIN documents USING (doc_id)), t AS (SELECT CAST(unnest(generate_series(50, 95, 5)) AS BIGINT) AS t)
SELECT t, count(*) FILTER (p >= t / 100.0) AS trades, CAST(coalesce(sum(r) FILTER (p >= t / 100.0), 0) AS BIGINT) AS total, row_number() OVER (ORDER BY coalesce(sum(r) FILTER (p >= t / 100.0), 0) DESC, t) = 1 AS best FROM x, t GROUP BY t""")
def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every declared threshold with what trading above it gives, and the best of them; the forecasts are read once."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("n_chars") % 997) / 1994.0))
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(p.alias("p"), (F.col("n_chars") % 13 - 6).alias("r"))
    g = x.select("p", "r", F.explode(F.sequence(F.lit(50).cast("long"), F.lit(95).cast("long"), F.lit(5).cast("long"))).alias("t"))
    above = F.col("p") >= F.col("t") / 100.0
    s = g.groupBy("t").agg(F.count_if(above).alias("trades"), F.coalesce(F.sum(F.when(above, F.col("r"))), F.lit(0)).cast("long").alias("total"))
    return s.withColumn("best", F.row_number().over(Window.orderBy(F.desc("total"), "t")) == 1)


@query("""WITH s AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER w AS t1, lead(epoch_us(ts) // 1000, 2) OVER w AS t2, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a, b, c, count(*) AS n, round(avg(value), 6) AS mean, CAST(max(t2) AS BIGINT) AS last_seen FROM s WHERE c IS NOT NULL AND t1 - t < 5 * 86400000 AND t2 - t1 < 5 * 86400000 AND t1 > t AND t2 > t1 GROUP BY a, b, c""")
def consecutive_within_gap(spark: SparkSession, d: str) -> DataFrame:
    """Three events in a row, each later than the one before by under five days."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").withColumn("t", millis("ts")).select("value", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c"), "t", F.lead("t").over(w).alias("t1"), F.lead("t", 2).over(w).alias("t2"))
    near = lambda x, y: (F.col(y) > F.col(x)) & (F.col(y) - F.col(x) < 5 * 86400000)
    return s.where(F.col("c").isNotNull() & near("t", "t1") & near("t1", "t2")).groupBy("a", "b", "c").agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"), F.max("t2").alias("last_seen"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:60] AS v FROM embeddings)
SELECT vec_id, CAST(len(list_filter(v, lambda x, i: i % 6 <> 0)) AS INTEGER) AS kept, round(v[55], 6) AS last_bar_first, round(list_sum(list_filter(v, lambda x, i: i % 6 <> 0)), 4) AS total FROM e""")
def flattened_feature_access(spark: SparkSession, d: str) -> DataFrame:
    """A window of ten bars by six features as one array: without the last feature of each bar, and one named element of
    the last bar."""
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 60)
    kept = F.filter(v, lambda x, i: (i + 1) % 6 != 0)
    return table(spark, d, "embeddings").select("vec_id", F.size(kept).alias("kept"), R(F.element_at(v, -6)).alias("last_bar_first"), F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10""")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("""WITH c AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL), o AS (SELECT user_id, avg(value) AS base FROM events GROUP BY 1), d AS (SELECT event_type, m - base AS d FROM c JOIN o USING (user_id)) SELECT event_type, count(*) AS pairs, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, CASE WHEN count(*) >= 20 THEN 'tested' ELSE 'too_few' END AS state FROM d GROUP BY event_type""")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    """Each type's mean less its user's own, as matched pairs."""
    e = table(spark, d, "events")
    c = e.groupBy("event_type", "user_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    own = Window.partitionBy("user_id")
    x = c.select("event_type", (F.col("s") / F.col("n") - F.sum("s").over(own) / F.sum("n").over(own)).alias("d"))
    return x.groupBy("event_type").agg(F.count("*").alias("pairs"), R(F.avg("d")).alias("mean"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*"))), 4).alias("t"), F.when(F.count("*") >= 20, "tested").otherwise("too_few").alias("state"))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem GROUP BY ALL), g AS (SELECT *, lag(day) OVER (PARTITION BY k ORDER BY day) AS before FROM e), r AS (SELECT *, sum(CASE WHEN before IS NULL OR day - before <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY day) AS run FROM g)
SELECT k, CAST(run AS BIGINT) AS run, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r GROUP BY k, run HAVING count(*) >= 3""")
def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of days a step of exactly one apart, from three days on."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day")).distinct()
    w = Window.partitionBy("k").orderBy("day")
    r = e.withColumn("gap", F.datediff("day", F.lag("day").over(w))).withColumn("run", F.sum(F.when(F.col("gap") == 1, 0).otherwise(1)).over(w))
    return r.groupBy("k", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).where("days >= 3")


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT CAST(unnest(['1995-01-02', '1995-05-01', '1995-09-04']) AS DATE) AS day), t AS (SELECT day FROM d WHERE dayofweek(day) BETWEEN 1 AND 5 AND day NOT IN (SELECT day FROM h))
SELECT t.day, count(o_orderkey) AS orders, CAST(dayofweek(t.day) AS INTEGER) AS weekday FROM t LEFT JOIN orders ON CAST(o_orderdate AS DATE) = t.day GROUP BY t.day""")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays of a year that are no holidays, with what happened on each: days without orders stay."""
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE '1995-01-01', DATE '1995-12-31')")).alias("day"))
    holidays = spark.createDataFrame([("1995-01-02",), ("1995-05-01",), ("1995-09-04",)], "day string").select(F.to_date("day").alias("day"))
    t = days.where("dayofweek(day) BETWEEN 2 AND 6").join(F.broadcast(holidays), "day", "left_anti")
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return t.join(o, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("orders"), (F.dayofweek("day") - 1).alias("weekday"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS dist, c.label FROM q JOIN embeddings c ON c.vec_id < q.vec_id - 20),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 20) SELECT query_id, count(*) AS neighbours, round(avg(CASE WHEN label % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, round((count(*) FILTER (label % 2 = 1) + 1) / (count(*) + 2), 6) AS smoothed FROM k GROUP BY query_id""")
def knn_base_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of a label among the twenty nearest earlier rows of each stated query whose outcome was known by then."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    near = joins.nearest_rows(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), v, joins.euclid, F.col("vec_id") < F.col("query_id") - 20, 20)
    odd = F.col("label") % 2 == 1
    return near.groupBy("query_id").agg(F.count("*").alias("neighbours"), R(F.avg(F.when(odd, 1.0).otherwise(0.0))).alias("rate"), R((F.count_if(odd) + 1) / (F.count("*") + 2)).alias("smoothed"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 1 THEN -floor(o_totalprice) ELSE floor(o_totalprice) END AS BIGINT) AS amount, 'E ' || o_orderstatus || ' NANDU' AS folded FROM orders""")
def parsed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with grouped thousands, in parentheses if negative, and labels without accents."""
    o = table(spark, d, "orders")
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    written = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("("), grouped, F.lit(")"))).otherwise(grouped)
    return o.select("o_orderkey", text.amount(written).cast("long").alias("amount"), text.folded(F.concat(F.lit("  é  "), "o_orderstatus", F.lit(" ñandú "))).alias("folded"))


@query(f"""WITH {DAILY_SQL}, r AS (SELECT symbol, day, ln(close / lag(close) OVER {D})) AS r, row_number() OVER {D}) AS i FROM daily), v AS (SELECT symbol, i, list(r) OVER (PARTITION BY symbol ORDER BY i ROWS 7 PRECEDING) AS e FROM r WHERE r IS NOT NULL), w AS (SELECT *, symbol || ':' || i AS id FROM v WHERE len(e) = 8),
s AS (SELECT q.id AS query_id, q.i AS qi, c.symbol, c.i, list_cosine_similarity(q.e, c.e) AS sim FROM w q JOIN w c ON q.i % 100 = 0 AND c.symbol = q.symbol AND c.i + 6 < q.i - 7), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, i) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(i AS BIGINT) AS vec_id, round(sim, 5) AS similarity FROM k WHERE rank <= 10""")
def analog_windows(spark: SparkSession, d: str) -> DataFrame:
    """The ten windows of eight returns most like each stated one, among those of its symbol whose outcome was over before
    it began."""
    w = Window.partitionBy("symbol").orderBy("day")
    r = daily_prices(spark, d).withColumn("r", F.log(F.col("close") / F.lag("close").over(w))).withColumn("i", F.row_number().over(w)).where("r IS NOT NULL")
    f = Window.partitionBy("symbol").orderBy("i").rowsBetween(-7, 0)
    v = r.select("symbol", F.col("i").cast("long").alias("vec_id"), F.collect_list("r").over(f).alias("e")).where("size(e) = 8")
    q = v.where("vec_id % 100 = 0").select(F.concat_ws(":", "symbol", "vec_id").alias("query_id"), F.col("e").alias("q"))
    here, at = F.split("query_id", ":")[0], F.split("query_id", ":")[1].cast("long")
    far = lambda a, b: -joins.dot(a, b) / F.sqrt(joins.dot(a, a) * joins.dot(b, b))
    near = joins.nearest_rows(q, v, far, (F.col("symbol") == here) & (F.col("vec_id") + 6 < at - 7), 10)
    return near.select("query_id", "rank", "vec_id", F.round(-F.col("d"), 5).alias("similarity"))
