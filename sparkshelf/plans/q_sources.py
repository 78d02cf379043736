"""Sources, sinks and streaming forms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.sources import page_state as PS
from sparkshelf.sources import readers as R
from sparkshelf.sources import spec_pages as SP
from sparkshelf.sources import writers as W
from sparkshelf.streaming import streams as S
from sparkshelf.plans.registry import Registry, Tables

q = Registry()


@q("src_04", "SELECT p_name || ' ' || p_brand AS name, CAST(p_size * 1000 AS BIGINT) AS mark FROM part WHERE p_size % 3 <> 0")
def _(t: Tables):
    mark = F.when(F.col("p_size") % 3 == 0, "NA").otherwise(F.format_number(F.col("p_size") * 1000, 0))
    page = F.concat(F.lit('<table id="cputable"><tbody><tr><td><a href="x">'), "p_name", F.lit(" </a> "), "p_brand", F.lit("</td><td>"), mark, F.lit("</td></tr><tr><td>alone</td></tr></tbody></table>"))
    return R.benchmark_table(t.part.select(page.alias("html")), "html")


@q("src_05", "SELECT n_nationkey FROM nation")
def _(t: Tables):
    return R.at_least(t.nation.select("n_nationkey"), 20)


@q("src_06", "SELECT page_id, 'Last updated on the ' || CAST(page_id AS VARCHAR) || 'th of May' AS v FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", R.freshness(F.concat(F.lit("<p>Last updated on the "), F.col("page_id").cast("string"), F.lit("th of May.</p>"))).alias("v"))


@q("src_08", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'flat' WHEN 2 THEN 'call' END AS form, CASE WHEN page_id % 4 < 2 THEN page_id END AS id, CASE WHEN page_id % 4 < 2 THEN url END AS url, CASE WHEN page_id % 4 < 2 THEN 'a,' || url END AS tags, page_id % 4 = 2 AS broken FROM pages WHERE url IS NOT NULL""")
def _(t: Tables):
    """Pages with a state of either form, with one that is cut off, and with none: the state's id, url and tags."""
    k, url = F.col("page_id").cast("string"), F.col("url")
    call = F.concat(F.lit("<script>window.__NUXT__=(function(a,b,c){b[1]=a;c.more=void 0;return {data:{id:"), k, F.lit(',url:a,"tags":b,deep:{c}}}}("'), url, F.lit('",["a",null],{}));</script>'))
    flat = F.concat(F.lit('<script type="application/json" id="__NUXT_DATA__">[["Reactive",1],{"data":2},{"id":3,"url":4,"tags":5,"more":-1},'), k, F.lit(',"'), url, F.lit('",["Set",6,4],"a"]</script>'))
    state = F.when(F.col("page_id") % 4 == 0, call).when(F.col("page_id") % 4 == 1, flat).when(F.col("page_id") % 4 == 2, F.concat(F.lit("<script>window.__NUXT__=(function(a){return {id:a}}("), k, F.lit(")</script>"))).otherwise("")
    pages = t.pages.where("url is not null").select("page_id", F.concat(F.coalesce("html", F.lit("")), state).alias("html"))
    s = PS.state_column(F.col("state"), "data struct<id:bigint,url:string,tags:array<string>>")["data"]
    return PS.states(pages).select("page_id", "form", s["id"].alias("id"), s["url"].alias("url"), F.array_join(s["tags"], ",").alias("tags"), F.col("error").isNotNull().alias("broken"))


@q("src_09", """WITH b AS (SELECT *, p_partkey % 5 AS m, p_brand || ' ' || p_name AS name FROM part)
SELECT p_partkey, 1 AS variant, name || ' (' || p_type || ')' AS product, '' AS section, 'Size' AS label, CAST(p_size AS VARCHAR) AS value, CASE WHEN m = 1 THEN printf('%.2f', p_retailprice) END AS price, false AS broken FROM b WHERE m < 2
UNION ALL SELECT p_partkey, 2, name || ' (second)', '', 'Size', '1', NULL, false FROM b WHERE m = 0
UNION ALL SELECT p_partkey, 1, name, 'Body', 'Size', p_size || ' in', printf('%.2f', p_retailprice), false FROM b WHERE m = 2
UNION ALL SELECT p_partkey, 1, name, '', '', CASE n WHEN 1 THEN p_type ELSE 'Size ' || p_size END, NULL, false FROM b, (VALUES (1), (2)) x(n) WHERE m = 3
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, true FROM b WHERE m = 4""")
def _(t: Tables):
    """Specification pages of four makers and pages without specifications, made from parts, read by the layout of each."""
    k, size, price, kind = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice"), F.col("p_type")
    name = F.concat("p_brand", F.lit(" "), "p_name")
    put = lambda text, *values: F.format_string(text, *values)
    flat = put('<script id="__NUXT_DATA__">[{"pinia":1},{"pdPageStore":2},{"productTabList":3,"PDTechSpec":5},{"ModelName":4},"%s",{"TechSpec":6},[7,11],{"Name":8,"SpecList":9},"%s",{"Size":10},%s,{"Name":12,"SpecList":13},"second",{"Size":14},1]</script>', name, kind, size)
    call = put('<script>window.__NUXT__=(function(a){return {state:{Spec:{spec:[{mktName:"%s",skuName:a,price:%s,specContent:[{displayField:"Size",descriptionText:"%s"}]}]}}}}("%s"));</script>', name, price, size, kind)
    groups = put('<title>%s</title><b data-price-type="finalPrice">RM%s</b><div class="product-spec-swapper"><i class="product-spec-group">Body</i><dl class="product-spec-attribute"><dt class="label">Size</dt><dd class="value">%s <u>in</u></dd></dl></div>', name, price, size)
    lines = put('<title>%s - Specs</title><section class="techspecs-section a"><p>%s</p><div>Size<!-- --> %s</div><p hidden>old</p></section>', name, kind, size)
    maker = F.when(k == 0, "flat").when(k == 1, "call").when(k == 2, "groups").otherwise("lines")
    pages = t.part.select("p_partkey", F.when(k == 0, flat).when(k == 1, call).when(k == 2, groups).when(k == 3, lines).otherwise("<p>one moment</p>").alias("html"), maker.alias("maker"))
    out = SP.spec_rows(pages, "p_partkey", "html", "maker")
    return out.select("p_partkey", "variant", "product", "section", "label", "value", "price", F.col("error").isNotNull().alias("broken"))


@q("src_10", "SELECT page_id, url AS v FROM pages")
def _(t: Tables):
    head = F.concat(F.lit("<html><head><meta property='og:url' content='http://other/'><link href='"), "url", F.lit("' rel='canonical'></head>"), "html")
    return t.pages.select("page_id", R.canonical_url(head).alias("v"))


@q("src_12", """SELECT p_partkey AS page, 'UX' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '-A' || p_partkey AS sku, CASE p_partkey % 4 WHEN 0 THEN 1000.0 + p_size WHEN 1 THEN 2000.0 + p_size WHEN 3 THEN 3000.0 + p_size END::DOUBLE AS price FROM part""")
def _(t: Tables):
    """Price lists as positioned words, a page a part: the price in one word, in two, above its SKU (which is none), and the nearer of two below."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    word = lambda text, x0, x1, top: F.struct(text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(top).alias("top"))
    money = lambda more: F.format_number(size + more, 0)
    sku = word(F.concat(F.lit("UX"), F.lpad(size.cast("string"), 4, "0"), F.lit("-A"), F.col("p_partkey").cast("string")), 10.0, 60.0, 100.0)
    one, far, above = word(F.concat(F.lit("RM"), money(1000)), 12.0, 40.0, 120.0), word(F.concat(F.lit("RM"), money(3000)), 14.0, 40.0, 130.0), word(F.concat(F.lit("RM"), money(500)), 10.0, 40.0, 80.0)
    two = [word(F.lit("RM"), 12.0, 25.0, 120.0), word(money(2000), 28.0, 60.0, 121.0)]
    later, aside = word(F.concat(F.lit("RM"), money(9000)), 14.0, 40.0, 150.0), word(F.concat(F.lit("RM"), money(100)), 300.0, 340.0, 110.0)
    words = F.when(k == 0, F.array(sku, one, aside)).when(k == 1, F.array(sku, *two)).when(k == 2, F.array(sku, above)).otherwise(F.array(sku, later, far))
    return R.price_rows(t.part.select(F.col("p_partkey").alias("page"), F.explode(words).alias("w")).select("page", "w.*")).select("page", "sku", "price")


@q("src_14", "SELECT event_id % 500 AS video_id, min_by(event_id, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value > 50, event_id)) AS position FROM events GROUP BY 1")
def _(t: Tables):
    lang = F.when(F.col("event_type") == "view", "en-GB").when(F.col("event_type") == "click", "zh").otherwise("ms")
    tracks = t.events.select((F.col("event_id") % 500).alias("video_id"), lang.alias("language"), (F.col("value") > 50).alias("is_generated"), F.col("event_id").alias("position"))
    return R.caption_track(tracks).select("video_id", "position")


@q("snk_01", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'new' END AS p_name, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_retailprice + 1 END AS p_retailprice FROM part")
def _(t: Tables):
    old = t.part.select("p_partkey", "p_name", "p_retailprice")
    new = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, " ").otherwise("new").alias("p_name"), F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(F.col("p_retailprice") + 1).alias("p_retailprice"))
    return W.merge_known(old, new, ["p_partkey"], positive=("p_retailprice",))


@q("snk_02", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 0.0 FROM customer WHERE c_custkey % 4 = 0")
def _(t: Tables):
    old = t.customer.select("c_custkey", "c_acctbal")
    four = old.where("c_custkey % 4 = 0")
    new = four.select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(four.select((F.col("c_custkey") + 1000000), F.lit(0.0)))
    return W.upsert(old, new, ["c_custkey"])


@q("snk_04", """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model, len(embedding) AS n FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new', len(embedding) FROM embeddings WHERE vec_id % 3 = 0""")
def _(t: Tables):
    """Vectors of a second model over those of a first: a third is replaced, as many are added."""
    old = t.embeddings.select("vec_id", "embedding", F.lit("old").alias("model"))
    some = old.where("vec_id % 3 = 0").withColumn("model", F.lit("new"))
    out = W.upsert(old, some.unionByName(some.withColumn("vec_id", F.col("vec_id") + 1_000_000)), ["vec_id"])
    return out.select("vec_id", "model", F.size("embedding").alias("n"))


@q("snk_08", "SELECT doc_id, left(text, 2000) AS text, lang FROM documents")
def _(t: Tables):
    return W.previews(t.documents.select("doc_id", "text", "lang"))


@q("snk_06", "SELECT l_partkey, l_orderkey FROM (SELECT *, lag(l_discount) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_discount) AS prev FROM (SELECT l_partkey, l_shipdate, max(l_discount) AS l_discount, max(l_orderkey) AS l_orderkey FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2)) WHERE prev IS DISTINCT FROM l_discount")
def _(t: Tables):
    points = t.lineitem.where("l_discount > 0").groupBy("l_partkey", "l_shipdate").agg(F.max("l_discount").alias("l_discount"), F.max("l_orderkey").alias("l_orderkey"))
    return W.changes_only(points.limit(0), points, "l_partkey", "l_discount", "l_shipdate").select("l_partkey", "l_orderkey")


@q("snk_09", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_custkey % 10 = 0")
def _(t: Tables):
    old = t.orders.select("o_custkey", "o_orderkey")
    new = old.where("o_custkey % 10 = 0").select("o_custkey", F.lit(-1).cast("bigint").alias("o_orderkey")).distinct()
    return W.replace_keys(old, new, ["o_custkey"])


@q("snk_12", "SELECT c_custkey, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables):
    return W.references(t.customer, "c_custkey", {"orders": (t.orders, "o_custkey")}).select("c_custkey", "total")


@q("snk_13", "SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t: Tables):
    return W.cascade({"orders": (t.orders, "o_custkey", "nullify")}, t.customer.where("c_nationkey = 3"), "c_custkey")["orders"].select("o_orderkey", "o_custkey")


@q("snk_14", "SELECT p_partkey FROM part WHERE p_size % 6 = 0")
def _(t: Tables):
    new = t.part.withColumn("p_name", F.when(F.col("p_size") % 6 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return W.changed_rows(t.part, new, "p_partkey", ["p_name", "p_retailprice"]).select("p_partkey")


@q("snk_18", "SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) THEN 'seen' END AS last_seen_at FROM supplier")
def _(t: Tables):
    rows = t.supplier.withColumn("last_seen_at", F.lit(None).cast("string"))
    return W.stamp_seen(rows, F.col("s_suppkey"), t.lineitem.where("l_quantity > 49"), "l_suppkey", F.lit("seen")).select("s_suppkey", "last_seen_at")


@q("stm_03", """WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT user_id, ts, i, [t] AS held, CAST(NULL AS DOUBLE) AS retry_after FROM e WHERE i = 1 UNION ALL
SELECT user_id, ts, i, CASE WHEN len(live) >= 3 THEN live ELSE list_append(live, t) END, CASE WHEN len(live) >= 3 THEN 3600 - (t - live[1]) END FROM (SELECT e.*, list_filter(r.held, lambda x: e.t - x < 3600) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, ts, retry_after FROM r""")
def _(t: Tables):
    """Hits of a user beyond three in an hour."""
    return S.rate_limit(t.events.select("user_id", "ts"), "user_id", "ts", 3, 3600.0)


@q("stm_05", "SELECT event_id, round(sum(CAST(value AS DECIMAL(28, 6))) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)::DOUBLE, 4) AS spent FROM events WHERE value IS NOT NULL")
def _(t: Tables):
    spent = S.spent_in_window(t.events.where("value is not null").select("event_id", "ts", "value"), "ts", "value")
    return spent.select("event_id", F.round(F.col("spent").cast("double"), 4).alias("spent"))


@q("stm_05_corrected", """WITH e AS (SELECT event_id, epoch_us(ts) AS us, CAST(value AS DECIMAL(28, 6)) AS n, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + event_id % 5400 * 1000000 END AS at, CAST(event_id % 11 AS DECIMAL(28, 6)) AS real FROM events WHERE value IS NOT NULL)
SELECT a.event_id, sum(CASE WHEN b.at <= a.us THEN b.real ELSE b.n END)::DOUBLE AS spent, sum(CASE WHEN b.at <= a.us THEN b.real ELSE b.n END) <= 600 OR sum(CASE WHEN b.at <= a.us THEN b.real ELSE b.n END) = any_value(a.n) AS fits FROM e a JOIN e b ON b.us <= a.us AND b.us > a.us - 3600000000 GROUP BY 1""")
def _(t: Tables):
    """An hour's spending, with two of three calls corrected up to ninety minutes after they were estimated."""
    rows = t.events.where("value is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    told = rows.where("event_id % 3 <> 0").select("event_id", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id").cast("bigint") % 5400 * 1_000_000).alias("at"), (F.col("event_id") % 11).alias("tokens"))
    out = S.spent_in_window(rows, "ts", "value", 3600, told, "event_id", 600.0)
    return out.select("event_id", F.col("spent").cast("double").alias("spent"), "fits")


@q("stm_08", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _(t: Tables):
    return S.resume(t.events.select("event_id"), t.events.where("event_id % 3 = 0").select("event_id"), ["event_id"])


@q("stm_10", "SELECT event_id FROM events WHERE event_type = 'view' AND (SELECT max(ts) FROM events) - ts > INTERVAL 6 HOUR")
def _(t: Tables):
    jobs = t.events.select("event_id", F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "view", "processing").otherwise("completed").alias("status"))
    now = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return S.dead_jobs(jobs, F.lit(now)).select("event_id")


@q("stm_12", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t: Tables):
    return S.tumbling(t.events, "ts", "1 hour", "1 day", "event_type")
