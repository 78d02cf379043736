"""Scans, filters, predicates, sorting, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.functions import dates
from sparkshelf.operators import listing as L
from sparkshelf.plans.registry import Registry, Tables

q = Registry()
PART = {"brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice", "key": "p_partkey"}
NOW = "2024-06-30 12:00:00"


@q("src_01", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    return t.nation


@q("src_02", "SELECT doc_id, lang, n_chars FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", "lang", "n_chars")


@q("src_03", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 17")
def _(t: Tables):
    return t.customer.where(F.col("c_custkey") == 17).select("c_custkey", "c_name", "c_acctbal").limit(1)


@q("fil_01", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size IN (1, 5, 9, 14, 23)")
def _(t: Tables):
    first = t.part.agg(F.min("p_brand").alias("b")).first()["b"]
    return L.apply_filters(t.part, {"brand": first, "size": [1, 5, 9, 14, 23], "type": [], "price": None}, PART).select("p_partkey", "p_brand", "p_size")


@q("fil_02", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 920 AND p_retailprice <= 960.5")
def _(t: Tables):
    return L.apply_range(t.part, "p_retailprice", 920.0, 960.5).select("p_partkey", "p_retailprice")


@q("fil_03", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t: Tables):
    return L.apply_in(t.orders, "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@q("fil_04", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%re%'")
def _(t: Tables):
    return L.apply_search(t.part, "RE", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@q("fil_05", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def _(t: Tables):
    return L.apply_known(t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "quality", False)


@q("fil_06", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def _(t: Tables):
    return t.orders.where(~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@q("fil_07", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(t: Tables):
    return t.customer.where(F.lower("c_mktsegment") == "building").select("c_custkey")


@q("fil_08", "SELECT p_partkey, w FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS w FROM part) WHERE w <= 20")
def _(t: Tables):
    weight = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return L.apply_range(t.part.select("p_partkey", weight.alias("w")), "w", None, 20)


@q("fil_09", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 OR CAST(json_extract_string(props, '$.k') AS INT) > 90")
def _(t: Tables):
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return t.events.where((k % 2 == 0) | (k > 90)).select("event_id")


@q("fil_10", "SELECT doc_id, len(w) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE string_split(source, '_') END AS w FROM documents) WHERE coalesce(len(w), 0) > 0")
def _(t: Tables):
    w = F.when(F.col("doc_id") % 5 != 0, F.split("source", "_"))
    return t.documents.select("doc_id", w.alias("w")).where(F.coalesce(F.size("w"), F.lit(0)) > 0).select("doc_id", F.size("w").cast("long").alias("n"))


@q("fil_11", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND (o_orderpriority IS NULL OR o_orderpriority NOT LIKE '1%')) OR (o_orderstatus = 'O' AND o_totalprice < 50000 AND o_orderpriority LIKE '5%')")
def _(t: Tables):
    p = F.col("o_orderpriority")
    rejected = (F.col("o_orderstatus") == "F") & (p.isNull() | ~p.like("1%"))
    pending = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 50000) & p.like("5%")
    return t.orders.where(rejected | pending).select("o_orderkey")


@q("fil_12", "SELECT doc_id, topic FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS topic FROM documents) WHERE topic IS NULL OR topic NOT IN ('de', 'fr')")
def _(t: Tables):
    topic = F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("topic")
    return t.documents.select("doc_id", topic).where(L.not_among("topic", ["de", "fr"]))


@q("fil_13", "SELECT page_id FROM pages WHERE url = (SELECT min(url) FROM pages) OR starts_with(url, (SELECT min(url) FROM pages) || '?v=')")
def _(t: Tables):
    first = t.pages.agg(F.min("url").alias("u")).first()["u"] or ""
    return t.pages.where(L.url_or_variant("url", first)).select("page_id")


@q("fil_14", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www.') OR starts_with(url, 'http://m.')")
def _(t: Tables):
    return t.pages.where(L.starts_with_any("url", ["https://www.", "http://m."])).select("page_id", "url")


@q("fil_15", """
WITH c AS (SELECT o_custkey, max(o_orderdate) AS latest, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS done FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN done IS NULL THEN 'new' ELSE 'stale' END AS state FROM c WHERE done IS NULL OR done < latest""")
def _(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("done"))
    state = F.when(F.col("done").isNull(), "new").when(F.col("done") < F.col("latest"), "stale").otherwise("current")
    return c.select("o_custkey", state.alias("state")).where("state <> 'current'")


@q("fil_16", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(t: Tables):
    last = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(last), F.col("ts") >= F.col("now") - F.expr("interval 7 days")).select("event_id")


@q("fil_17", """SELECT event_id, ts FROM events, (SELECT date_trunc('day', max(ts) + INTERVAL 8 HOUR) AS d FROM events)
WHERE ts >= d - INTERVAL 8 HOUR AND ts < d + INTERVAL 16 HOUR""")
def _(t: Tables):
    day = t.events.agg(F.max(dates.local_day("ts")).alias("day"))
    low, high = dates.local_day_bounds("day")
    return t.events.join(F.broadcast(day), (F.col("ts") >= low) & (F.col("ts") < high)).select("event_id", "ts")


@q("fil_18", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT p_retailprice > 1000 THEN 'price' END, CASE WHEN NOT p_size > 10 THEN 'size' END, CASE WHEN NOT p_brand <> '' THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS failed FROM part""")
def _(t: Tables):
    failed = L.failed_conditions({"price": F.col("p_retailprice") > 1000, "size": F.col("p_size") > 10, "brand": F.col("p_brand") != ""})
    return t.part.select("p_partkey", F.array_join(failed, ",").alias("failed"))


@q("fil_19", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR regexp_extract(url, '://([^/?#]*)', 1) LIKE 'www.%'")
def _(t: Tables):
    return t.pages.where((F.col("page_id") % 3 == 0) | F.parse_url("url", F.lit("HOST")).startswith("www.")).select("page_id")


@q("fil_20", """SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR (c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P'))""")
def _(t: Tables):
    linked = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("linked", F.lit(True))
    return t.customer.join(linked, "c_custkey", "left").where((F.col("c_acctbal") < 0) | ((F.col("c_mktsegment") == "BUILDING") & F.col("linked").isNull())).select("c_custkey")


@q("fil_21", "SELECT p_partkey, CASE WHEN coalesce(price, 0) = 0 THEN 'inactive' ELSE 'active' END AS status FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM part)")
def _(t: Tables):
    price = F.when(F.col("p_size") % 10 == 0, 0.0).otherwise(F.col("p_retailprice"))
    return t.part.select("p_partkey", F.when(F.coalesce(price, F.lit(0.0)) == 0, "inactive").otherwise("active").alias("status"))


@q("fil_23", "SELECT p_partkey, p_brand FROM (SELECT *, max(CASE WHEN p_size > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS hit FROM part) WHERE p_size > 48 OR hit = 0")
def _(t: Tables):
    return L.prefer(t.part, F.col("p_size") > 48, ["p_brand"]).select("p_partkey", "p_brand")


@q("fil_24", "SELECT event_id FROM events WHERE dayname(ts + INTERVAL 8 HOUR) = 'Monday'")
def _(t: Tables):
    return t.events.where(F.date_format(dates.local_time("ts"), "EEEE") == "Monday").select("event_id")


@q("fil_26", """SELECT s_suppkey, s_name || CASE WHEN s_acctbal > 0 THEN ' | balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END || ' | nation ' || CAST(s_nationkey AS VARCHAR) AS doc FROM supplier""")
def _(t: Tables):
    balance = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("balance "), F.floor("s_acctbal").cast("string")))
    return t.supplier.select("s_suppkey", F.concat_ws(" | ", "s_name", balance, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("doc"))


@q("fil_27", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_retailprice AS price, p_size AS size_inch FROM part")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size_inch"))


@q("fil_28", "SELECT event_id, CASE WHEN value IS NULL THEN 'no value' WHEN value < 1 THEN 'too small' WHEN event_type = 'error' THEN 'failed' END AS said FROM events")
def _(t: Tables):
    said = F.coalesce(F.when(F.col("value").isNull(), F.lit("no value")), F.when(F.col("value") < 1, F.lit("too small")), F.when(F.col("event_type") == "error", F.lit("failed")))
    return t.events.select("event_id", said.alias("said"))


@q("fil_29", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t: Tables):
    page, _ = L.listing(t.orders, {"status": "F"}, {"status": "o_orderstatus", "date": "o_orderdate"}, "high", ["o_orderpriority"], "date", "date", "o_orderkey", True)
    return page.select("o_orderkey", "o_orderdate")


@q("fil_30", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P', 'O') ORDER BY o_orderkey")
def _(t: Tables):
    return t.orders.where(~F.col("o_orderstatus").isin("P", "O")).select("o_orderkey").orderBy("o_orderkey")


@q("fil_31", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name")
def _(t: Tables):
    return t.nation.where("n_regionkey = 2").select("n_name").orderBy("n_name")


@q("ord_01", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def _(t: Tables):
    return L.paginate(L.apply_sort(t.part, "price", PART, "key", "p_partkey", True)).select("p_partkey", "p_retailprice")


@q("ord_02", "SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 20 OFFSET 40")
def _(t: Tables):
    return L.paginate(L.apply_sort(t.part, "size", PART, "key", "p_partkey"), 40, 20).select("p_partkey")


@q("ord_03", "SELECT p_partkey FROM part ORDER BY p_size > 40, -p_retailprice, p_name, p_partkey LIMIT 25")
def _(t: Tables):
    return t.part.orderBy(F.col("p_size") > 40, -F.col("p_retailprice"), "p_name", "p_partkey").select("p_partkey").limit(25)


@q("ord_04", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(500)


@q("ord_05", "SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR) || '2024-06-30') AS k FROM part ORDER BY k LIMIT 30")
def _(t: Tables):
    return t.part.select("p_partkey", L.daily_shuffle("p_partkey", "2024-06-30").alias("k")).orderBy("k").limit(30)


@q("ord_06", "SELECT event_id, CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS BIGINT) AS place FROM events ORDER BY place, event_id LIMIT 100")
def _(t: Tables):
    return t.events.select("event_id", L.ordinal("event_type", ["signup", "view", "click"]).cast("long").alias("place")).orderBy("place", "event_id").limit(100)


@q("set_01", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), allowMissingColumns=True)


@q("set_02", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("n")).union(t.supplier.select("s_nationkey")).distinct()


@q("set_03", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t: Tables):
    sold = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return t.part.select(F.col("p_partkey").alias("k")).join(sold, "k", "left_anti")


@q("set_04", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables):
    k = F.col("o_custkey").alias("k")
    return t.orders.where("o_orderstatus = 'F'").select(k).intersect(t.orders.where("o_orderstatus = 'O'").select(k))


@q("set_05", "SELECT DISTINCT lang, source FROM documents")
def _(t: Tables):
    return t.documents.select("lang", "source").distinct()
