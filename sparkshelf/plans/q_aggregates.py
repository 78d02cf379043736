"""Aggregations on events, orders, part, labels and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkshelf.functions import dates
from sparkshelf.operators import aggregates as A
from sparkshelf.plans.registry import Registry, Tables

q = Registry()
def count_all():
    """Rows of a group; built when a query runs, since an expression needs a session."""
    return F.count(F.lit(1))

DAY = "CAST(ts + INTERVAL 8 HOUR AS DATE)"


@q("agg_01", "SELECT count(*) AS total FROM part WHERE p_size > 25")
def _(t: Tables):
    return t.part.where("p_size > 25").agg(count_all().alias("total"))


@q("agg_02", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(count_all().alias("n"))


@q("agg_03", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def _(t: Tables):
    return A.zero_filled(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@q("agg_04", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'purchase' AND value > 50) AS both FROM events")
def _(t: Tables):
    e, v = F.col("event_type"), F.col("value")
    return t.events.agg(count_all().alias("n"), F.count_if(e == "error").alias("errors"), F.count_if(v > 50).alias("high"), F.count_if((e == "purchase") & (v > 50)).alias("both"))


@q("agg_05", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers FROM events")
def _(t: Tables):
    return t.events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


@q("agg_06", "SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@q("agg_07", "SELECT round(coalesce(sum(coalesce(value, 0) + coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 0), 2) AS total FROM events WHERE event_type <> 'nothing'")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.where("event_type <> 'nothing'").agg(F.round(F.coalesce(F.sum(F.coalesce("value", F.lit(0.0)) + F.coalesce(k, F.lit(0.0))), F.lit(0.0)), 2).alias("total"))


@q("agg_08", f"""
WITH e AS (SELECT event_type, CAST({DAY} AS VARCHAR) AS day, coalesce(CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END, 'system') AS who, value FROM events)
SELECT 'total' AS dimension, NULL AS value, count(*) AS calls, round(sum(value), 2) AS amount FROM e
UNION ALL SELECT 'feature', event_type, count(*), round(sum(value), 2) FROM e GROUP BY 2
UNION ALL SELECT 'day', day, count(*), round(sum(value), 2) FROM e GROUP BY 2
UNION ALL SELECT 'user', who, count(*), round(sum(value), 2) FROM e GROUP BY 2""")
def _(t: Tables):
    e = t.events.select("event_type", dates.local_day("ts").alias("day"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("who"), F.col("value").alias("v"))
    dims = {"feature": F.col("event_type"), "day": F.col("day"), "user": F.coalesce("who", F.lit("system"))}
    return A.usage_report(e, dims, {"calls": count_all(), "amount": F.round(F.sum("v"), 2)})


@q("agg_09", f"""WITH b AS (SELECT min({DAY}) AS first, max({DAY}) AS last FROM events), s AS (SELECT CAST(unnest(generate_series(last - INTERVAL 59 DAY, last, INTERVAL 1 DAY)) AS DATE) AS day, first FROM b),
d AS (SELECT {DAY} AS day, count(*) AS n FROM events GROUP BY 1) SELECT s.day, CASE WHEN s.day >= first THEN coalesce(n, 0) END AS n FROM s LEFT JOIN d USING (day)""")
def _(t: Tables):
    return A.daily_series(t.events, dates.local_day("ts"), {"n": count_all()}, F.max("day"), 60)


@q("agg_10", f"SELECT {DAY} AS day, count(*) FILTER (event_type <> 'error') AS clean, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def _(t: Tables):
    return t.events.groupBy(dates.local_day("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("clean"), F.count_if(F.col("event_type") == "error").alias("failed"))


@q("agg_11", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 5 GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def _(t: Tables):
    return t.part.where("p_size > 5").groupBy("p_brand").agg(count_all().alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@q("agg_12", "SELECT CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate, round(avg(value), 6) AS mean_value, count(CASE WHEN value > 10 THEN 1 END) AS metered FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def _(t: Tables):
    last = t.events.select("ts", "event_id", "event_type", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return last.agg((F.count_if(F.col("event_type") == "error").cast("double") / count_all()).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") > 10).alias("metered"))


@q("agg_13", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, w")
def _(t: Tables):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(count_all().alias("n")).orderBy(F.desc("n"), "w")


@q("agg_14", "SELECT CAST(b AS INT) AS bucket, count(v) AS n FROM range(10) r(b) LEFT JOIN (SELECT least(CAST(floor(value / 10) AS INT), 9) AS v FROM events WHERE value IS NOT NULL) ON v = b GROUP BY 1")
def _(t: Tables):
    return A.histogram(t.events, "value")


@q("agg_15", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_discount > 0.09) AS cut FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_discount") > 0.09).alias("cut"))


@q("agg_17", "SELECT p_partkey, round(p_size / sum(p_size) OVER (PARTITION BY p_brand), 6) AS share FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(F.col("p_size") / F.sum("p_size").over(Window.partitionBy("p_brand")), 6).alias("share"))


@q("agg_18", """SELECT c.o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_at) AS tops FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS n FROM orders GROUP BY 1, 2) c WHERE n <= 3 GROUP BY 1""")
def _(t: Tables):
    return A.ordered_distinct(t.orders, ["o_custkey"], "o_orderpriority", ["o_orderkey"], 3).select("o_custkey", F.array_join("first", ",").alias("tops"))


@q("agg_19", "SELECT p_brand, min_by(p_partkey, (length(p_name), p_name, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("p_partkey"))


@q("agg_20", """WITH s(pos, step) AS (VALUES (0, 'signup'), (1, 'view'), (2, 'click'), (3, 'purchase')), n AS (SELECT event_type AS step, count(*) AS here, count(CASE WHEN value > 50 THEN 1 END) AS stuck FROM events GROUP BY 1)
SELECT s.step, CAST(sum(coalesce(here, 0)) OVER (ORDER BY pos DESC) AS BIGINT) AS reached, coalesce(stuck, 0) AS stuck FROM s LEFT JOIN n USING (step)""")
def _(t: Tables):
    e = t.events.select(F.col("event_type").alias("step"), F.when(F.col("value") > 50, F.lit("high")).alias("why"))
    return A.funnel(e, "step", ["signup", "view", "click", "purchase"], "why").select("step", "reached", "stuck")


@q("agg_21", "SELECT lower(p_name) AS k, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return t.part.groupBy(F.lower("p_name").alias("k")).agg(count_all().alias("n")).where("n > 1")


@q("agg_22", "SELECT p_partkey, count(*) OVER (PARTITION BY split_part(p_name, ' ', 1)) - 1 AS siblings FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", (F.count(F.lit(1)).over(Window.partitionBy(F.split_part("p_name", F.lit(" "), F.lit(1)))) - 1).alias("siblings"))


@q("agg_23", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) = 0")
def _(t: Tables):
    o = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(count_all().alias("n"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").where(F.coalesce("n", F.lit(0)) == 0).select("c_custkey")


@q("agg_24", "SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS own, min(min(l_extendedprice / l_quantity)) OVER (PARTITION BY l_partkey) AS lowest FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    own = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("own"))
    return own.withColumn("lowest", F.min("own").over(Window.partitionBy("l_partkey")))


@q("agg_25", "SELECT f, count(v) AS n, min(v) AS low, max(v) AS high FROM (SELECT 'price' AS f, CASE WHEN p_retailprice > 0 THEN p_retailprice END AS v FROM part UNION ALL SELECT 'size', CAST(p_size AS DOUBLE) FROM part) GROUP BY 1")
def _(t: Tables):
    long = t.part.select(F.expr("stack(2, 'price', if(p_retailprice > 0, p_retailprice, null), 'size', cast(p_size as double)) as (f, v)"))
    return long.groupBy("f").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@q("agg_26", "SELECT lang, count(*) AS n, count(quality) AS done, round(100.0 * count(quality) / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables):
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("lang").agg(count_all().alias("n"), F.count("quality").alias("done"))
    return d.withColumn("pct", A.safe_ratio(F.col("done"), F.col("n")))


@q("agg_27", """WITH l(event_type, quota) AS (VALUES ('view', 5), ('click', 100000), ('other', 7)), d AS (SELECT date_trunc('day', max(ts) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC' AS since FROM events)
SELECT event_type, CAST(greatest(0, quota - count(ts)) AS INT) AS remaining FROM l LEFT JOIN (SELECT event_type, ts FROM events, d WHERE ts >= since) USING (event_type) GROUP BY event_type, quota""")
def _(t: Tables):
    limits = t.spark.createDataFrame([("view", 5), ("click", 100000), ("other", 7)], "event_type string, quota int")
    since = t.events.agg(F.max("ts").alias("now")).select(dates.quota_day_start("now").alias("since"))
    used = t.events.join(F.broadcast(since), F.col("ts") >= F.col("since")).groupBy("event_type").agg(count_all().alias("used"))
    return limits.join(used, "event_type", "left").select("event_type", F.greatest(F.lit(0), F.col("quota") - F.coalesce("used", F.lit(0))).cast("int").alias("remaining"))


@q("agg_28", """WITH r AS (SELECT lang, coalesce(quality, 0) AS rel, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS p, row_number() OVER (PARTITION BY lang ORDER BY coalesce(quality, 0) DESC) - 1 AS i FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, CASE WHEN sum(rel / log2(i + 2)) FILTER (i < 10) > 0 THEN sum(rel / log2(p + 2)) FILTER (p < 10) / sum(rel / log2(i + 2)) FILTER (i < 10) ELSE 0 END AS ndcg FROM r GROUP BY 1""")
def _(t: Tables):
    r = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("rel", F.coalesce("quality", F.lit(0)))
    return A.ndcg(r, "lang", "rel", [F.desc("n_chars"), F.asc("doc_id")])


@q("agg_29", "SELECT lang, count(*) FILTER (quality IS NOT NULL) AS scored, count(*) FILTER (quality = 1) AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables):
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("quality").alias("scored"), F.count_if(F.col("quality") == 1).alias("passed"))


@q("agg_30", "SELECT quantile_cont(p_retailprice, 0.1) AS p_low, quantile_cont(p_retailprice, 0.9) AS p_high, quantile_cont(p_retailprice, 0.9) - quantile_cont(p_retailprice, 0.1) AS spread FROM part")
def _(t: Tables):
    return A.percentile_spread(t.part, "p_retailprice")


@q("agg_31", "SELECT count(*) AS overlap FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) JOIN (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 200) USING (p_partkey)")
def _(t: Tables):
    top = lambda c: t.part.orderBy(F.desc(c), "p_partkey").select("p_partkey").limit(200)
    return top("p_retailprice").join(top("p_size"), "p_partkey").agg(count_all().alias("overlap"))


@q("agg_32", "SELECT source, CASE WHEN bool_or(lang = 'en') AND bool_or(lang <> 'en') THEN 'mixed' WHEN bool_or(lang = 'en') THEN 'en' ELSE 'other' END AS label FROM documents GROUP BY 1")
def _(t: Tables):
    en, other = F.bool_or(F.col("lang") == "en"), F.bool_or(F.col("lang") != "en")
    return t.documents.groupBy("source").agg(F.when(en & other, "mixed").when(en, "en").otherwise("other").alias("label"))


@q("agg_33", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, length(html) > 5000 AS long, count(*) AS n FROM pages GROUP BY 1, 2")
def _(t: Tables):
    return t.pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), (F.length("html") > 5000).alias("long")).agg(count_all().alias("n"))


@q("agg_34", """WITH l AS (SELECT o_custkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders), p AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS price FROM l WHERE r = 1 GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' WHEN price > 200000 THEN 'high' ELSE 'set' END AS bucket, c_mktsegment, count(*) AS cnt FROM customer LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t: Tables):
    last = t.orders.withColumn("r", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate")))).where("r = 1")
    p = last.groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("prices"))
    bucket = F.when(F.col("prices").isNull(), "none").when(F.size("prices") > 1, "several").when(F.col("prices")[0] > 200000, "high").otherwise("set")
    return t.customer.join(p, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(bucket.alias("bucket"), "c_mktsegment").agg(count_all().alias("cnt"))
