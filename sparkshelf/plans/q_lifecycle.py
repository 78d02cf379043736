"""Lifecycle, review and audit operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkshelf.operators import lifecycle as L
from sparkshelf.operators import resolution as B
from sparkshelf.plans.registry import Registry, Tables
from sparkshelf.plans.sql_fuzzy import measures

q = Registry()
def count_all():
    """Rows of a group; built when a query runs, since an expression needs a session."""
    return F.count(F.lit(1))

FAMILY = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand || CASE WHEN p_size > 45 THEN '*' ELSE '' END END"


def families(t: Tables):
    """Parts with a key of brand and first word, and a family for three quarters of them."""
    fam = F.when(F.col("p_partkey") % 4 != 0, F.concat("p_brand", F.when(F.col("p_size") > 45, "*").otherwise("")))
    return t.part.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", F.concat_ws("|", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key"), fam.alias("family"))


FAMS = f"(SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, p_brand || '|' || split_part(p_name, ' ', 1) AS key, {FAMILY} AS family FROM part)"


@q("c_01", f"SELECT p_partkey, coalesce(family, f) AS resolved FROM {FAMS} LEFT JOIN (SELECT key, min(family) AS f FROM {FAMS} WHERE family IS NOT NULL GROUP BY 1 HAVING count(DISTINCT family) = 1) USING (key)")
def _(t: Tables):
    return L.resolve_family(families(t), "key", "family").select("p_partkey", "resolved")


@q("c_02", f"""SELECT p_partkey, CASE WHEN family IS NOT NULL THEN 'kept' WHEN coalesce(n, 0) > 1 THEN 'ambiguous' WHEN n = 1 THEN 'joined' ELSE 'created' END AS action, CASE WHEN family IS NOT NULL THEN family WHEN coalesce(n, 0) > 1 THEN NULL WHEN n = 1 THEN f ELSE left(sha256(p_brand || '|' || key), 16) END AS assigned
FROM {FAMS} LEFT JOIN (SELECT key, count(DISTINCT family) AS n, min(family) AS f FROM {FAMS} WHERE family IS NOT NULL GROUP BY 1) USING (key)""")
def _(t: Tables):
    return L.regroup(families(t), "key", "family", "p_brand").select("p_partkey", "action", "assigned")


@q("c_03", f"SELECT p_partkey, CASE WHEN p_partkey % 50 = 3 THEN 'moved' ELSE family END AS family FROM {FAMS}")
def _(t: Tables):
    rows = families(t)
    return L.bulk_move(rows, "p_partkey", "family", rows.where("p_partkey % 50 = 3"), "moved")[0].select("p_partkey", "family")


@q("c_04", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 AND p_retailprice > 1000 AND p_size > 10 THEN 'active' WHEN p_partkey % 3 = 0 THEN 'inactive' ELSE 'active' END AS status FROM part")
def _(t: Tables):
    rows = t.part.withColumn("status", F.when(F.col("p_partkey") % 3 == 0, "inactive").otherwise("active"))
    fails = F.array_compact(F.array(F.when(F.col("p_retailprice") <= 1000, F.lit("price")), F.when(F.col("p_size") <= 10, F.lit("size"))))
    return L.go_live(rows, fails, F.col("p_size") % 2 == 0).select("p_partkey", "status")


@q("c_05", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'fill' WHEN p_size % 3 = 0 THEN 'confirm' WHEN p_partkey % 2 = 0 THEN 'fill' ELSE 'differs' END AS decision FROM part")
def _(t: Tables):
    stored = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_retailprice"))
    listed = F.when(F.col("p_size") % 3 == 0, stored).otherwise(F.col("p_retailprice") + 1)
    source = F.when(F.col("p_partkey") % 2 == 0, "guide").otherwise("page")
    return t.part.select("p_partkey", L.guide_decision(stored, listed, source).alias("decision"))


def guide(t: Tables):
    g = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("guide_id"), F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("k"), F.col("l_partkey").cast("string"), F.lit("wp"))).otherwise("").alias("sku"), F.concat(F.lit("s"), (F.col("l_partkey") % 1500).cast("string")).alias("spec"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("price"))
    c = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("K"), F.col("p_partkey").cast("string"), F.lit("W")).alias("sku"), F.concat(F.lit("s"), (F.col("p_partkey") % 1400).cast("string")).alias("spec"))
    return g, c


GUIDE = """g AS (SELECT l_orderkey AS guide_id, CASE WHEN l_orderkey % 3 <> 0 THEN 'K' || l_partkey || 'W' ELSE '' END AS k, 's' || (l_partkey % 1500) AS spec, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT p_partkey AS id, 'K' || p_partkey || 'W' AS k, 's' || (p_partkey % 1400) AS spec FROM part), b AS (SELECT g.guide_id, id, c.spec AS cs, 'sku' AS how FROM g JOIN c ON g.k = c.k), r AS (SELECT g.guide_id, id, c.spec AS cs, 'spec' AS how FROM g JOIN c ON g.spec = c.spec WHERE g.guide_id NOT IN (SELECT guide_id FROM b)),
m AS (SELECT *, count(*) OVER (PARTITION BY guide_id) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM r)), o AS (SELECT g.guide_id, id, CASE WHEN id IS NULL THEN 'unmatched' WHEN price IS NULL THEN 'unpriced' WHEN how = 'spec' AND n > 1 THEN 'ambiguous' WHEN how = 'sku' AND spec <> cs THEN 'conflict' ELSE 'matched' END AS outcome FROM g LEFT JOIN m USING (guide_id))"""


@q("j_22", f"WITH {GUIDE} SELECT guide_id, id, outcome FROM o")
def _(t: Tables):
    return L.guide_match(*guide(t)).select("guide_id", "id", "outcome")


@q("c_06", f"WITH {GUIDE} SELECT outcome, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'uncovered', count(*) FROM c WHERE id NOT IN (SELECT id FROM o WHERE outcome = 'matched')")
def _(t: Tables):
    g, c = guide(t)
    met = L.guide_match(g, c)
    return met.groupBy("outcome").agg(count_all().alias("n")).union(L.uncovered(c, met).agg(F.lit("uncovered").alias("outcome"), count_all().alias("n")))


@q("c_07", f"WITH {GUIDE} SELECT guide_id, id FROM o WHERE outcome = 'matched' AND guide_id % 2 = 0")
def _(t: Tables):
    g, c = guide(t)
    at = F.lit("2024-01-01").cast("timestamp")
    p = L.guide_match(g, c).withColumnRenamed("price", "listed").withColumns({"price": F.lit(0.0), "guide_at": at, "decision": F.when(F.col("guide_id") % 2 == 0, "fill").otherwise("confirm"), "checked_at": at})
    return L.guide_apply(p).select("guide_id", "id")


@q("c_08", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type, p_size) > 1 THEN 'duplicate' END, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_retailprice) > count(*) OVER (PARTITION BY p_brand, p_retailprice, p_type, p_size) THEN 'copied' END, CASE WHEN abs(p_retailprice - 1500) / 1500.0 >= 0.1 THEN 'wrong_price' END], lambda x: x IS NOT NULL), ',') AS w FROM part""")
def _(t: Tables):
    rows = t.part.withColumn("listed", F.lit(1500.0))
    return L.row_warnings(rows, "p_brand", ["p_type", "p_size"], "p_retailprice", "listed").select("p_partkey", F.array_join("warnings", ",").alias("w"))


def options(t: Tables):
    """A configurator from part: brands are chips, types are option groups, sizes are values."""
    return t.part.groupBy(F.col("p_brand").alias("chip"), F.col("p_type").alias("option_group"), (F.col("p_size") % 5).cast("string").alias("value")).agg(
        F.min("p_retailprice").alias("add_on"), F.bool_or(F.col("p_size") % 10 == 1).alias("is_included"), F.bool_and(F.col("p_size") > 25).alias("is_blocked")
    ).withColumn("kit_price", 1000.0 + F.length("chip"))


OPTIONS = "o AS (SELECT p_brand AS chip, p_type AS option_group, CAST(p_size % 5 AS VARCHAR) AS value, min(p_retailprice) AS add_on, bool_or(p_size % 10 = 1) AS is_included, bool_and(p_size > 25) AS is_blocked, 1000.0 + length(p_brand) AS kit_price FROM part GROUP BY 1, 2, 3)"


@q("c_09", f"WITH {OPTIONS} SELECT chip, CAST(max(kit_price) AS DOUBLE) AS kit_price, CAST(count(*) FILTER (NOT is_blocked) AS INT) AS n FROM o GROUP BY 1")
def _(t: Tables):
    return L.kits(options(t)).select("chip", "kit_price", F.size("choices").alias("n"))


@q("c_10", f"""WITH {OPTIONS}, g AS (SELECT chip, option_group, bool_or(value = '2') AS ok, min(value) FILTER (is_included) AS inc FROM o WHERE NOT is_blocked GROUP BY 1, 2)
SELECT chip, option_group, CASE WHEN option_group = (SELECT min(p_type) FROM part) THEN '4' WHEN ok THEN '2' ELSE inc END AS value FROM g""")
def _(t: Tables):
    given = t.part.agg(F.min("p_type").alias("option_group")).withColumn("value", F.lit("4"))
    standard = t.part.select(F.col("p_type").alias("option_group")).distinct().withColumn("value", F.lit("2"))
    return L.choice_defaults(options(t), given, standard)


CHOICES = "w AS (SELECT DISTINCT p_type AS option_group, '3' AS value FROM part)"


def choices(t: Tables):
    return t.part.select(F.col("p_type").alias("option_group")).distinct().withColumn("value", F.lit("3"))


@q("c_11", f"WITH {OPTIONS}, {CHOICES} SELECT chip, round(max(kit_price) + sum(add_on), 4)::DOUBLE AS price FROM o JOIN w USING (option_group, value) WHERE NOT is_blocked GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)")
def _(t: Tables):
    return L.quote(options(t), choices(t)).select("chip", F.round("price", 4).alias("price"))


@q("c_12", f"WITH {OPTIONS} SELECT chip, count(*) AS n FROM o GROUP BY 1 HAVING bool_and(NOT is_blocked OR chip LIKE '%2' OR chip LIKE '%5')")
def _(t: Tables):
    """Chips whose every option has an education price: blocked ones lack it but for some brands."""
    priced = options(t).withColumn("edu", F.when(~F.col("is_blocked") | F.col("chip").rlike("[25]$"), F.col("add_on")))
    return L.complete_kits(priced, "edu").groupBy("chip").agg(count_all().alias("n"))


@q("c_13", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_size * 40 > 0 AND p_size * 40 < p_retailprice")
def _(t: Tables):
    rows = t.part.withColumns({"status": F.when(F.col("p_partkey") % 3 == 0, "inactive").otherwise("active"), "edu": F.col("p_size") * 40.0})
    return L.visible_discount(rows, "p_retailprice", "edu").select("p_partkey")


@q("c_26", f"WITH {OPTIONS} SELECT a.chip, a.option_group, a.value, round(a.add_on - coalesce(b.add_on, 0), 4) AS difference FROM o a LEFT JOIN o b ON a.chip = b.chip AND a.option_group = b.option_group AND b.value = '3'")
def _(t: Tables):
    return L.price_differences(options(t), choices(t)).select("chip", "option_group", "value", F.round("difference", 4).alias("difference"))


def links(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_returnflag") == "R", "human").otherwise("auto").alias("source"), (F.col("l_partkey") % 5).alias("family_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("config_id"))


LINKS = "l AS (SELECT l_orderkey AS review_id, CASE WHEN l_returnflag = 'R' THEN 'human' ELSE 'auto' END AS source, l_partkey % 5 AS family_id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS config_id FROM lineitem), e AS (SELECT * FROM (SELECT *, bool_or(source = 'human') OVER (PARTITION BY review_id) AS h FROM l) WHERE source = 'human' OR NOT h)"


@q("c_14", f"WITH {LINKS} SELECT review_id, source, family_id, config_id FROM e")
def _(t: Tables):
    return L.effective_links(links(t))


@q("c_15", f"WITH {LINKS} SELECT review_id, CASE WHEN count(DISTINCT family_id) = 1 THEN max(family_id) END AS family_id, CASE WHEN count(DISTINCT config_id) = 1 THEN max(config_id) END AS config_id FROM e GROUP BY 1")
def _(t: Tables):
    return L.single_config(L.effective_links(links(t)))


@q("c_16", """SELECT p_type AS family, CASE WHEN count(*) = 1 THEN 'single_config' WHEN count(DISTINCT p_brand) = 1 AND count(DISTINCT p_size) = 1 THEN 'identical_specs' WHEN count(DISTINCT p_brand) = 1 THEN 'ram_storage_only' ELSE 'separable' END AS code FROM part GROUP BY 1""")
def _(t: Tables):
    rows = t.part.select(F.col("p_type").alias("family"), F.col("p_partkey").alias("config_id"), "p_brand", "p_size")
    return L.separability(rows, "family", ["p_brand", "p_size"], ["p_size"])


@q("c_17", """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'other_laptop' WHEN doc_id % 6 = 2 THEN 'several' WHEN doc_id % 2 = 0 AND p_partkey IS NULL THEN 'config_unknown' END AS reason, CASE WHEN doc_id % 6 NOT IN (1, 2) AND doc_id % 2 = 0 THEN p_partkey END AS config_id FROM documents LEFT JOIN part ON p_partkey = doc_id AND p_size > 20""")
def _(t: Tables):
    about = F.when(F.col("doc_id") % 6 == 1, "other").when(F.col("doc_id") % 6 == 2, "several").otherwise("this")
    claims = t.documents.select("doc_id", about.alias("about"), F.when(F.col("doc_id") % 2 == 0, "config").otherwise("family").alias("scope"), F.lit(1).alias("family_id"), F.col("doc_id").alias("config_no"))
    configs = t.part.where("p_size > 20").select(F.lit(1).alias("family_id"), F.col("p_partkey").alias("config_no"), F.col("p_partkey").alias("config_id"))
    return L.place_claims(claims, configs).select("doc_id", "reason", "config_id")


@q("c_18", "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user')")
def _(t: Tables):
    return L.missing_windows(t.conversations.select("conv_id", "turn"), t.conversations.where("role = 'user'"), ["conv_id", "turn"])


@q("c_19", """SELECT review_id, CASE WHEN shown THEN 'shown' WHEN done THEN 'processed' WHEN linked THEN 'linked' WHEN txt THEN 'transcript' ELSE 'found' END AS step, CASE WHEN shown THEN NULL WHEN done THEN 'hidden' WHEN linked THEN 'not processed' WHEN txt THEN 'no link' ELSE 'no transcript' END AS reason
FROM (SELECT o_orderkey AS review_id, o_orderkey % 2 = 0 AS txt, o_orderkey % 4 = 0 AS linked, o_orderkey % 8 = 0 AS done, o_orderkey % 16 = 0 AS shown FROM orders)""")
def _(t: Tables):
    k = F.col("o_orderkey")
    flags = t.orders.select(k.alias("review_id"), (k % 2 == 0).alias("has_text"), (k % 4 == 0).alias("is_linked"), (k % 8 == 0).alias("is_processed"), (k % 16 == 0).alias("is_shown"), F.lit(None).cast("string").alias("failure"))
    return L.classify(flags)


@q("c_20", """WITH t AS (SELECT doc_id AS claim_id, lang AS sentiment, md5(text) AS text, CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 END AS tier FROM documents), b AS (SELECT *, min(tier) OVER (PARTITION BY sentiment) AS m FROM t WHERE tier IS NOT NULL), d AS (SELECT *, row_number() OVER (PARTITION BY sentiment, text ORDER BY claim_id) AS r FROM b WHERE tier = m)
SELECT claim_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY claim_id) AS p FROM d WHERE r = 1) WHERE p <= 5""")
def _(t: Tables):
    claims = t.documents.select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("sentiment"), F.md5(F.col("text").cast("binary")).alias("text"))
    return L.public_view(claims, F.col("claim_id") % 7 == 0, F.col("claim_id") % 3 == 0).select("claim_id", "place")


@q("c_21", "SELECT DISTINCT l_orderkey AS video_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 OR o_orderstatus <> 'F')")
def _(t: Tables):
    found = t.lineitem.select(F.col("l_orderkey").alias("video_id"))
    stored = t.orders.select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 11 == 0).alias("human_link"), F.lit(False).alias("deferred"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("matched").alias("status"), F.lit(False).alias("terminal"))
    return L.skip_existing(found, stored)


@q("c_22", "SELECT p_brand, min_by(p_partkey, (length(p_name), p_name, p_partkey)) AS representative FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > (SELECT max(p_retailprice) - 1 FROM part)) GROUP BY 1")
def _(t: Tables):
    covered = t.part.join(F.broadcast(t.part.agg(F.max("p_retailprice").alias("m")))).where("p_retailprice > m - 1").select("p_brand")
    return L.worklist(t.part, "p_brand", "p_name", "p_partkey", covered)


def jobs(t: Tables):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    return t.events.select(F.col("user_id").alias("job_id"), F.lit("scan").alias("job_type"), status.alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("processed"), F.lit(20000).alias("total"))


@q("c_24", """SELECT job_id, status, CAST(CASE WHEN status = 'completed' THEN 100 ELSE least(99, floor(processed * 100 / 20000.0)) END AS INT) AS progress FROM (SELECT user_id AS job_id, event_id AS processed,
CASE WHEN event_type = 'error' OR (event_type <> 'purchase' AND (SELECT max(ts) FROM events) - ts > INTERVAL 6 HOUR) THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'processing' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def _(t: Tables):
    now = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return L.job_status(jobs(t), F.lit(now)).select("job_id", "status", "progress")


@q("c_31", """WITH f AS (SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS INT) AS family_no FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, l_returnflag, family_no, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_returnflag) AS INT) AS config_no FROM (SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem GROUP BY 1, 2, 3) JOIN f USING (l_orderkey, l_suppkey)""")
def _(t: Tables):
    m = t.lineitem.withColumn("config_id", F.col("l_partkey"))
    return L.candidate_numbers(m, "l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber").select("l_orderkey", "l_suppkey", "l_returnflag", "family_no", "config_no")


@q("c_33", "SELECT event_id FROM events WHERE event_type = 'view' OR (event_type = 'error' AND value > 50 AND event_id % 2 = 0) ORDER BY event_id LIMIT 40")
def _(t: Tables):
    e = t.events.select("event_id", F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.when(F.col("value") > 50, "Rate limit reached").otherwise("bad input").alias("error"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("attempts"))
    return L.pending_queue(e, 40, F.col("event_id")).select("event_id")


@q("c_34", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS found, count(*) FILTER (page_id % 5 = 0) AS added FROM pages GROUP BY 1")
def _(t: Tables):
    return t.pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(count_all().alias("found"), F.count_if(F.col("page_id") % 5 == 0).alias("added"))


@q("c_35", "SELECT count(*) > 0 AS locked FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type NOT IN ('error', 'purchase') AND (SELECT max(ts) FROM events) - ts <= INTERVAL 6 HOUR")
def _(t: Tables):
    now = t.events.agg(F.max("ts").alias("m")).first()["m"]
    return L.is_locked(jobs(t), ["scan"], F.lit(now))


# -- audits ------------------------------------------------------------------------------------------------------------


@q("aud_01", "SELECT CAST(sum(n - 1) AS BIGINT) AS surplus, max(n) AS most FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1)")
def _(t: Tables):
    g = t.documents.groupBy(F.md5(F.col("text").cast("binary"))).agg(count_all().alias("n")).where("n > 1")
    return g.agg(F.sum(F.col("n") - 1).alias("surplus"), F.max("n").alias("most"))


@q("aud_02", "SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no source' WHEN count(*) FILTER (role <> 'user') >= count(*) FILTER (role = 'user') THEN 'complete' ELSE 'partial' END AS state FROM conversations GROUP BY 1")
def _(t: Tables):
    asked, answered = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") != "user")
    return t.conversations.groupBy("conv_id").agg(F.when(asked == 0, "no source").when(answered >= asked, "complete").otherwise("partial").alias("state"))


@q("aud_03", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN part ON p_partkey = o_orderkey % 2000 WHERE o.o_orderkey = l.l_orderkey AND p_partkey IS NOT DISTINCT FROM (CASE WHEN l_partkey % 3 = 0 THEN l_orderkey % 2000 ELSE l_partkey END))")
def _(t: Tables):
    links_ = t.orders.join(t.part, F.col("p_partkey") == F.col("o_orderkey") % 2000).select(F.col("o_orderkey").alias("a"), F.col("p_partkey").alias("b"))
    own = F.when(F.col("l_partkey") % 3 == 0, F.col("l_orderkey") % 2000).otherwise(F.col("l_partkey"))
    rows = t.lineitem.withColumn("own", own)
    return rows.join(links_, (F.col("l_orderkey") == F.col("a")) & F.col("own").eqNullSafe(F.col("b")), "left_anti").select("l_orderkey", "l_linenumber")


@q("aud_05", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 ORDER BY n DESC, p_type")
def _(t: Tables):
    return t.part.groupBy("p_type").agg(count_all().alias("n"), F.count_distinct("p_brand").alias("brands")).where("brands > 1").orderBy(F.desc("n"), "p_type")


@q("aud_06", f"WITH n AS (SELECT DISTINCT p_name AS name FROM part), {measures('SELECT x.name AS a, y.name AS b FROM n x, n y WHERE x.name < y.name')} SELECT a, b, round(ts, 6)::DOUBLE AS score FROM fz WHERE ts >= 70")
def _(t: Tables):
    """Part names that look alike."""
    return B.similar_pairs(t.part.select("p_name"), "p_name", 70.0).withColumn("score", F.round("score", 6))


@q("aud_07", """WITH x AS (SELECT value / 100 AS c FROM events WHERE value <= 100), t AS (SELECT unnest([0.5, 0.7, 0.9]) AS threshold) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (c < threshold) AS rejected, round(100.0 * count(*) FILTER (c < threshold) / count(*), 4) AS pct FROM x, t GROUP BY 1""")
def _(t: Tables):
    x = t.events.where("value <= 100").select((F.col("value") / 100).alias("c"), F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))).alias("threshold"))
    low = F.count_if(F.col("c") < F.col("threshold"))
    return x.groupBy("threshold").agg(low.alias("rejected"), F.round(100.0 * low / count_all(), 4).alias("pct"))


@q("aud_08", "SELECT p_brand, count(*) AS n, bool_or(s_suppkey IS NOT NULL) AS mapped FROM part LEFT JOIN supplier ON s_suppkey = p_size GROUP BY 1 ORDER BY n DESC, p_brand")
def _(t: Tables):
    j = t.part.join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("p_size"), "left")
    return j.groupBy("p_brand").agg(count_all().alias("n"), F.bool_or(F.col("s_suppkey").isNotNull()).alias("mapped")).orderBy(F.desc("n"), "p_brand")


@q("aud_10", "SELECT p_partkey FROM (SELECT *, lag(p_retailprice) OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS prev FROM part) WHERE prev > p_retailprice")
def _(t: Tables):
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_size", "p_partkey")
    return t.part.withColumn("prev", F.lag("p_retailprice").over(w)).where("prev > p_retailprice").select("p_partkey")


@q("aud_11", "SELECT DISTINCT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_brand FROM part) b WHERE starts_with(b.p_brand, a.p_brand) AND a.p_brand <> b.p_brand")
def _(t: Tables):
    d = t.part.select("p_brand").distinct()
    cut = d.select(F.col("p_brand").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p_brand") - 1, F.lit(1))), lambda n: F.substring(F.col("p_brand"), F.lit(1), n))).alias("a"))
    return cut.where("a <> b").join(d, F.col("a") == F.col("p_brand"), "left_semi").select("a", "b").distinct()


@q("aud_12", """WITH m AS (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_suppkey), c AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS a, count(*) OVER (PARTITION BY s_suppkey) AS b FROM m)
SELECT p_partkey, CASE WHEN max(a) IS NULL THEN 'none' WHEN max(a) > 1 THEN 'several' WHEN max(b) > 1 THEN 'shared' ELSE 'write' END AS action FROM part LEFT JOIN c USING (p_partkey) GROUP BY 1""")
def _(t: Tables):
    m = t.part.join(t.supplier, F.col("p_size") == F.col("s_suppkey")).select("p_partkey", "s_suppkey")
    c = m.withColumn("a", F.count(F.lit(1)).over(Window.partitionBy("p_partkey"))).withColumn("b", F.count(F.lit(1)).over(Window.partitionBy("s_suppkey")))
    g = c.groupBy("p_partkey").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    action = F.when(F.col("a").isNull(), "none").when(F.col("a") > 1, "several").when(F.col("b") > 1, "shared").otherwise("write")
    return t.part.select("p_partkey").join(g, "p_partkey", "left").select("p_partkey", action.alias("action"))


@q("aud_15", "SELECT coalesce(CAST(quality AS VARCHAR), 'unlabelled') AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t: Tables):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    g = d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("status")).agg(count_all().alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("all")))).select("status", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("pct"))


@q("aud_17", "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS samples FROM documents GROUP BY 1")
def _(t: Tables):
    b = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    placed = t.documents.select(b.alias("bucket"), "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")))
    return placed.groupBy("bucket").agg(count_all().alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.col("doc_id")))), lambda x: x.cast("string")), ",").alias("samples"))


@q("aud_18", "SELECT code, count(*) AS n FROM (SELECT split_part(p_name, ' ', 2) || p_size AS code FROM part) GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return t.part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size").cast("string")).alias("code")).groupBy("code").agg(count_all().alias("n")).where("n > 1")


@q("aud_19", "SELECT count(*) FILTER (l_discount = 0) AS zero_discount, count(*) FILTER (l_tax = 0) AS zero_tax, count(DISTINCT l_quantity) AS quantities FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count_if(F.col("l_discount") == 0).alias("zero_discount"), F.count_if(F.col("l_tax") == 0).alias("zero_tax"), F.count_distinct("l_quantity").alias("quantities"))
