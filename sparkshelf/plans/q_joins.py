"""Joins over the driver's star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkshelf.functions import vectors
from sparkshelf.functions import text as X
from sparkshelf.operators import joins as J
from sparkshelf.operators import windows as W
from sparkshelf.plans.registry import Registry, Tables

q = Registry()
def count_all():
    """Rows of a group; built when a query runs, since an expression needs a session."""
    return F.count(F.lit(1))



@q("j_01", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@q("j_02", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_acctbal > 5000")
def _(t: Tables):
    c = t.customer.where("c_acctbal > 5000").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@q("j_03", "SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9900")
def _(t: Tables):
    return t.supplier.join(t.customer.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "c_custkey")


@q("j_04", "SELECT doc_id, s_acctbal FROM documents LEFT JOIN supplier ON source = s_name ORDER BY s_acctbal DESC NULLS LAST, doc_id LIMIT 300")
def _(t: Tables):
    d = t.documents.select("doc_id", "source").join(t.supplier, F.col("source") == F.col("s_name"), "left")
    return d.orderBy(F.desc_nulls_last("s_acctbal"), "doc_id").select("doc_id", "s_acctbal").limit(300)


@q("j_05", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@q("j_06", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)")
def _(t: Tables):
    back = t.lineitem.where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(back, "p_partkey", "left_anti")


@q("j_07", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@q("j_08", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9800 AND (c_nationkey = s_nationkey OR c_custkey = s_suppkey))")
def _(t: Tables):
    rich = t.customer.where("c_acctbal > 9800").select("c_nationkey", "c_custkey")
    return J.semi_any(t.supplier.select("s_suppkey", "s_nationkey"), rich, [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")]).select("s_suppkey")


@q("j_09", "SELECT c_custkey, n, total FROM customer JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(count_all().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.select("c_custkey").join(o, "c_custkey")


@q("j_10", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(count_all().alias("n"))
    return t.nation.join(s, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@q("j_11", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def _(t: Tables):
    o = t.orders.join(t.customer.where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@q("j_12", "SELECT doc_id, coalesce(s_name, 'unknown') AS name FROM documents LEFT JOIN supplier ON s_suppkey = doc_id")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.supplier, F.col("s_suppkey") == F.col("doc_id"), "left").select("doc_id", F.coalesce("s_name", F.lit("unknown")).alias("name"))


@q("j_13", "SELECT o_orderkey, previous FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND previous <> o_totalprice")
def _(t: Tables):
    out = J.as_of_previous(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.where("o_orderdate >= timestamp '1996-01-01' and previous <> o_totalprice").select("o_orderkey", "previous")


@q("j_17", """SELECT name, v FROM (SELECT p_name AS name, w AS v, row_number() OVER (PARTITION BY p_name ORDER BY length(w) DESC, w) AS n
FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) WHERE contains(lower(p_name), lower(w))) WHERE n = 1""")
def _(t: Tables):
    names = t.part.select(F.col("p_name").alias("name"))
    keys = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct().select("w", F.col("w").alias("v"))
    return J.longest_contained(names, "name", keys, "w", "v")


@q("j_18", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON regexp_replace(lower(p_brand), '[^0-9]', '', 'g') = CAST(s_nationkey AS VARCHAR)")
def _(t: Tables):
    key = F.regexp_replace(F.lower("p_brand"), "[^0-9]", "")
    return t.part.withColumn("k", key).join(t.supplier.withColumn("k", F.col("s_nationkey").cast("string")), "k").select("p_partkey", "s_suppkey")


@q("j_19", """SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label <> 3
ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), a.vec_id LIMIT 50""")
def _(t: Tables):
    query = t.embeddings.where("vec_id = 0").select("embedding").first()["embedding"]
    return vectors.knn(t.embeddings.where("label <> 3"), "embedding", query, 50, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@q("j_20", """SELECT vec_id, s FROM (SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS s, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS raw FROM embeddings a, embeddings b WHERE b.vec_id = 1) ORDER BY raw DESC, vec_id LIMIT 10""")
def _(t: Tables):
    query = t.embeddings.where("vec_id = 1").select("embedding").first()["embedding"]
    return vectors.knn(t.embeddings, "embedding", query, 10, "vec_id").select("vec_id", F.round(1 - F.col("distance"), 4).alias("s"))


@q("j_21", """WITH d AS (SELECT a.vec_id, CASE WHEN a.label = b.label THEN 0 ELSE 1 END AS tier, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a, embeddings b WHERE b.vec_id = 5)
SELECT vec_id, tier FROM (SELECT *, min(tier) OVER () AS best FROM d WHERE dist <= 0.9) WHERE tier = best ORDER BY dist, vec_id LIMIT 20""")
def _(t: Tables):
    one = t.embeddings.where("vec_id = 5").select("embedding", "label").first()
    tier = F.when(F.col("label") == one["label"], 0).otherwise(1)
    return vectors.tiered_knn(t.embeddings.withColumn("tier", tier), "embedding", one["embedding"], "tier", 0.9, 20, "vec_id").select("vec_id", "tier")


@q("j_23", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(upper(trim(c_name)), '[^0-9]', '', 'g') = regexp_replace(upper(trim(s_name)), '[^0-9]', '', 'g')")
def _(t: Tables):
    k = lambda c: F.regexp_replace(F.upper(F.trim(c)), "[^0-9]", "")
    return t.customer.withColumn("k", k("c_name")).join(t.supplier.withColumn("k", k("s_name")), "k").select("c_custkey", "s_suppkey")


@q("j_24", "SELECT a.p_partkey AS a, min_by(b.p_partkey, (b.p_retailprice, b.p_partkey)) AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1")
def _(t: Tables):
    keys = ["p_brand", "p_type", "p_size"]
    b = t.part.select(*keys, F.col("p_partkey").alias("other"), F.col("p_retailprice").alias("price"))
    met = t.part.select(*keys, F.col("p_partkey").alias("a")).join(b, keys).where("a <> other")
    return met.groupBy("a").agg(F.min_by("other", F.struct("price", "other")).alias("b"))


@q("j_25", """SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > 9900 UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_name = s_name""")
def _(t: Tables):
    c, s = t.customer, t.supplier
    parts = [c.join(s, F.col("c_custkey") == F.col("s_suppkey")), c.where("c_acctbal > 9900").join(s, F.col("c_nationkey") == F.col("s_nationkey")), c.join(s, F.col("c_name") == F.col("s_name"))]
    keys = [p.select("c_custkey", "s_suppkey") for p in parts]
    return keys[0].union(keys[1]).union(keys[2]).distinct()


@q("j_26", """SELECT o_orderkey, CASE WHEN a.c_custkey IS NOT NULL THEN 'first' WHEN b.c_custkey IS NOT NULL THEN 'second' ELSE 'none' END AS outcome FROM orders
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) a ON a.c_custkey = o_custkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) b ON b.c_custkey = o_custkey""")
def _(t: Tables):
    first = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("who"))
    second = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("who"))
    found = J.first_match(t.orders, [(first, ["o_custkey"]), (second, ["o_custkey"])], "o_orderkey", "who")
    outcome = F.when(F.col("stage") == 0, "first").when(F.col("stage") == 1, "second").otherwise("none")
    return t.orders.select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", outcome.alias("outcome"))


@q("j_27", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def _(t: Tables):
    return J.difference_by_key(t.lineitem.select(F.col("l_partkey").alias("k")), t.part.where("p_size > 20").select(F.col("p_partkey").alias("k")), "k")


@q("j_28", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10)")
def _(t: Tables):
    seen = t.lineitem.join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(seen, "o_orderkey", "left_anti").distinct()


@q("j_29", "SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_size = b.p_size THEN 'duplicate' ELSE 'copied' END AS kind FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_retailprice = b.p_retailprice AND a.p_partkey < b.p_partkey")
def _(t: Tables):
    side = lambda n: t.part.select("p_brand", "p_retailprice", F.col("p_partkey").alias(n), F.col("p_size").alias(f"size_{n}"))
    kind = F.when(F.col("size_a") == F.col("size_b"), "duplicate").otherwise("copied")
    return side("a").join(side("b"), ["p_brand", "p_retailprice"]).where("a < b").select("a", "b", kind.alias("kind"))


@q("j_31", """WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM conversations), h AS (SELECT DISTINCT conv_id, 200 AS pos FROM conversations)
SELECT h.conv_id, max(s.turn) AS turn FROM h JOIN s ON s.conv_id = h.conv_id AND s.pos <= h.pos GROUP BY 1""")
def _(t: Tables):
    hits = t.conversations.select("conv_id").distinct().withColumn("pos", F.lit(200).cast("bigint"))
    return J.offset_to_segment(hits, "conv_id", "pos", t.conversations, "text", "turn").select("conv_id", F.col("turn_as_of").alias("turn"))


@q("j_33", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.quality = b.quality THEN 'same' WHEN a.quality > b.quality THEN 'worse' ELSE 'better' END AS change FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, toxic AS quality FROM labels WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id")
def _(t: Tables):
    a = t.labels.where("doc_id % 3 <> 0").select("doc_id", "quality")
    b = t.labels.where("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("quality"))
    return J.set_outcome(a, b, "doc_id", "quality").select("doc_id", "change")


@q("j_34", "SELECT p_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_shipdate DESC, l_orderkey DESC) AS latest FROM (SELECT p_partkey, l_orderkey, l_shipdate, row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS n FROM part JOIN lineitem ON l_partkey = p_partkey) WHERE n <= 5 GROUP BY 1")
def _(t: Tables):
    met = t.lineitem.join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "l_orderkey", "l_shipdate")
    w = Window.partitionBy("p_partkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"))
    five = met.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("n", "l_orderkey"))).alias("l"))
    return five.select("p_partkey", F.array_join(F.transform("l", lambda x: x["l_orderkey"].cast("string")), ",").alias("latest"))


@q("j_35", "SELECT o_orderkey, coalesce(c_nationkey, -1) AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(t: Tables):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return t.orders.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_nationkey", F.lit(-1)).alias("nation"))


@q("j_36", """WITH j AS (SELECT DISTINCT o_orderdate AS a, o_orderdate + INTERVAL 2 DAY AS b FROM orders)
SELECT a AS day, l_orderkey, l_linenumber FROM j JOIN lineitem ON l_shipdate BETWEEN a AND b""")
def _(t: Tables):
    jobs = t.orders.select(F.col("o_orderdate").alias("day")).distinct().select("day", F.col("day").alias("a"), (F.col("day") + F.expr("interval 2 days")).alias("b"))
    return J.interval_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", jobs, "a", "b", 86_400_000_000).select("day", "l_orderkey", "l_linenumber")


@q("j_37", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a, part b WHERE len(list_filter(string_split(lower(a.p_name), ' '), lambda x: NOT list_contains(string_split(lower(b.p_name), ' '), x))) = 0")
def _(t: Tables):
    a = t.part.select(F.col("p_partkey").alias("a"), F.array_distinct(F.split(X.lower_each("p_name"), " ")).alias("tokens"))
    return J.all_tokens_contained(a, "tokens", t.part, "p_name", "p_partkey").select("a", F.col("p_partkey_match").alias("b"))


URL_KEY = "lower(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '[^/]*$'), '\\.[a-z]+$', ''))"


@q("j_38", f"""WITH t AS (SELECT page_id AS target, page_id % 2 AS brand, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://shop.example/old/' || upper({URL_KEY}) || '.html?v=2' END AS url FROM pages WHERE page_id % 3 < 2),
k AS (SELECT target, brand, url, nullif({URL_KEY}, '') AS key FROM t), p AS (SELECT page_id, page_id % 2 AS brand, url, nullif({URL_KEY}, '') AS key FROM pages)
SELECT page_id, coalesce(u, s) AS target, CASE WHEN u IS NOT NULL THEN 'url' WHEN s IS NOT NULL THEN 'slug' ELSE 'none' END AS how FROM (SELECT page_id, (SELECT min(target) FROM k WHERE k.url = p.url AND k.brand = p.brand) AS u, (SELECT min(target) FROM k WHERE k.key = p.key AND k.brand = p.brand) AS s FROM p)""")
def _(t: Tables):
    """Pages against targets of the same brand: a third of these have a page's own URL, a third only its last path segment, in another spelling."""
    pages = t.pages.select("page_id", "url", (F.col("page_id") % 2).alias("brand"))
    moved = F.concat(F.lit("https://shop.example/old/"), F.upper(X.slug("url")), F.lit(".html?v=2"))
    targets = pages.where("page_id % 3 < 2").select(F.col("page_id").alias("target"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(moved).alias("url"), "brand")
    return J.match_urls(pages, targets, "page_id", "target", X.slug, owner="brand")


@q("j_39", "SELECT DISTINCT lower(source) AS name FROM documents WHERE lower(source) NOT IN (SELECT lower(c_mktsegment) FROM customer)")
def _(t: Tables):
    known = t.customer.select(F.lower("c_mktsegment").alias("name")).distinct()
    return t.documents.select(F.lower("source").alias("name")).where("name is not null").distinct().join(known, "name", "left_anti")


@q("j_40", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1")
def _(t: Tables):
    last = W.latest_per_key(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey"))
    return t.customer.join(last, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")
