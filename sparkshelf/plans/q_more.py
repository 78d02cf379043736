"""Lookups, evidence, ingest, plans and the remaining writers and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.functions import similarity
from sparkshelf.operators import evidence as E
from sparkshelf.operators import probes as PR
from sparkshelf.operators import lifecycle as L
from sparkshelf.operators import resolution as B
from sparkshelf.operators import retrieval as RT
from sparkshelf.operators import scoring as SC
from sparkshelf.plans import q_lifecycle as QL
from sparkshelf.plans import q_scoring as QS
from sparkshelf.plans.registry import Registry, Tables
from sparkshelf.plans.sql_fuzzy import measures
from sparkshelf.sources import readers as R
from sparkshelf.sources import writers as W
from sparkshelf.streaming import streams as S

q = Registry()


@q("src_07", "SELECT 'u' || p_partkey AS url FROM part WHERE p_size % 4 <> 0")
def _(t: Tables):
    kind = F.when(F.col("p_size") % 4 == 0, "desktop").otherwise("laptop")
    item = F.to_json(F.struct(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), kind.alias("kind")))
    pages = t.part.select(F.col("p_partkey").alias("page"), F.concat(F.lit('{"items":['), item, F.lit(","), item, F.lit("]}")).alias("body"))
    return R.paged_items(pages, "body", "page", "url string, kind string", ("desktop",)).select("url")


@q("src_11", "SELECT p_partkey AS kit_price, CAST(5 AS DOUBLE) AS add_on FROM part")
def _(t: Tables):
    opt = '{"body":{"options":{"chip":{"compatibleOptions":{"c":{"isSelected":true,"isBlocked":false,"priceDelta":0}}},"memory":{"compatibleOptions":{"16":{"isSelected":true,"isBlocked":false,"priceDelta":2},"32":{"isSelected":false,"isBlocked":false,"priceDelta":7}}}},"selectedKits":{"priceData":{"amount":'
    body = F.concat(F.lit(opt), F.col("p_partkey").cast("string"), F.lit("}}}}"))
    return R.configurator(t.part.select(body.alias("body")), "body").where("not is_included").select(F.col("kit_price").cast("bigint").alias("kit_price"), "add_on")


@q("src_15", "SELECT p_partkey FROM part WHERE p_retailprice >= 950 AND p_name LIKE 'blue%' AND p_size % 3 <> 0")
def _(t: Tables):
    rows = t.part.where("p_name like 'blue%'").select("p_partkey", "p_retailprice", F.concat(F.lit("ASUS ROG Strix "), "p_name", F.when(F.col("p_size") % 3 == 0, " Keyboard Cover").otherwise("")).alias("title"))
    return R.listings(rows, "title", "p_retailprice", F.lit("ROG Strix"), floor=950.0).select("p_partkey")


@q("fil_22", "SELECT p_partkey FROM part WHERE p_retailprice >= 800 AND p_size % 2 = 0")
def _(t: Tables):
    title = F.concat(F.lit("Zenbook 14 "), F.when(F.col("p_size") % 2 == 0, "laptop").otherwise("sleeve"))
    return R.listings(t.part.withColumn("title", title), "title", "p_retailprice", F.lit("zenbook 14")).select("p_partkey")


@q("fil_25", f"WITH {QL.OPTIONS} SELECT chip, option_group, value FROM o WHERE NOT is_blocked AND value IN ('1', '3')")
def _(t: Tables):
    o = QL.options(t)
    return E.admissible(o, o.where("value in ('1', '3')").select("chip", "option_group", "value"))


@q("j_16", f"WITH {QS.MISSPELT}, {QS.resolved_sql(0.9)} SELECT mark, count(*) AS n FROM res GROUP BY 1")
def _(t: Tables):
    """How many misspelt names each mark gets."""
    return B.resolve(QS.misspelt(t), "name", QS.reference_marks(t)).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


#: Reviews are documents, of families by id; a document of the id describes a review, a conversation of the id is its transcript, 15 seconds a turn.
#: Members are benchmark items, told apart by their second word and their next two.
def spoken(t: Tables):
    description = t.documents.select(F.col("doc_id").alias("key"), F.lit("description").alias("source"), F.lit(0).alias("place"), "text", F.lit(None).cast("bigint").alias("seconds"))
    transcript = t.conversations.select(F.col("conv_id").alias("key"), F.lit("transcript").alias("source"), F.col("turn").cast("int").alias("place"), "text", (F.col("turn") * 15).cast("bigint").alias("seconds"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    members = t.benchmark.select((F.col("item_id").cast("int") % 7).alias("family"), F.col("item_id").cast("bigint").alias("id"), words.alias("w")).where(F.size("w") >= 4)
    members = members.select("family", "id", F.get("w", F.lit(1)).alias("word"), F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("pair"))
    reviews = t.documents.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 7).cast("int").alias("family"))
    return reviews, description.union(transcript), members, {"word": lambda c: F.array(c), "pair": lambda c: F.array(c)}


SIDE = r"[^\p{L}\p{N}_]"
SPOKEN = rf"""seg AS (SELECT doc_id AS key, 'description' AS source, 0 AS place, text, CAST(NULL AS BIGINT) AS seconds FROM documents WHERE text <> '' UNION ALL SELECT conv_id, 'transcript', turn, text, turn * 15 FROM conversations WHERE text <> ''),
st AS (SELECT key, source, seconds, coalesce(sum(length(text) + 1) OVER (PARTITION BY key, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM seg),
t AS (SELECT key, source, string_agg(text, ' ' ORDER BY place) AS text, lower(string_agg(text, ' ' ORDER BY place)) AS low FROM seg GROUP BY 1, 2),
m AS (SELECT CAST(item_id AS INT) % 7 AS family, CAST(item_id AS BIGINT) AS id, ws[2] AS word, ws[3] || ' ' || ws[4] AS pair FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS ws FROM benchmark) WHERE len(ws) >= 4),
p AS (SELECT family, col, value, list_sort(list(DISTINCT id)) AS members FROM (SELECT family, id, 'word' AS col, word AS value FROM m UNION ALL SELECT family, id, 'pair', pair FROM m) GROUP BY 1, 2, 3),
pd AS (SELECT p.* FROM p JOIN (SELECT family, col FROM p GROUP BY 1, 2 HAVING count(*) > 1) USING (family, col)),
h1 AS (SELECT key, family, source, col, value, members, text, low, length(regexp_extract(low, '(?s)^(|.*?{SIDE})' || value || '(?:{SIDE}|$)', 1)) AS at_ FROM t JOIN pd ON family = key % 7 WHERE regexp_matches(low, '(?s)(?:^|{SIDE})' || value || '(?:{SIDE}|$)')),
h2 AS (SELECT * REPLACE (at_ + length(value) + length(regexp_extract(low[at_ + length(value) + 1:], '(?s)^(.*?{SIDE})' || value || '(?:{SIDE}|$)', 1)) AS at_) FROM h1 WHERE regexp_matches(low[at_ + length(value) + 1:], '(?s){SIDE}' || value || '(?:{SIDE}|$)')),
h AS (SELECT *, 1 AS nth FROM h1 UNION ALL SELECT *, 2 FROM h2),
hit AS (SELECT h.key, h.family, h.source, h.col, h.value, h.nth, h.at_, h.members, text[at_ + 1:at_ + length(value)] AS matched, trim(regexp_replace(text[greatest(at_ - 70, 0) + 1:at_ + length(value) + 70], '\s+', ' ', 'g')) AS context, arg_max(st.seconds, st.pos) AS seconds
 FROM h JOIN st ON st.key = h.key AND st.source = h.source AND st.pos <= h.at_ GROUP BY ALL)"""


@q("j_30", f"""WITH {SPOKEN} SELECT key, source, col AS kind, value, nth, at_ AS "at", matched, context, seconds, array_to_string(members, ',') AS members FROM hit""")
def _(t: Tables):
    """Where each review's description and transcript name the words that tell its family's members apart."""
    reviews, segments, members, builders = spoken(t)
    hits = PR.evidence(reviews, segments, members, builders)
    return hits.select("key", "source", F.col("column").alias("kind"), "value", "nth", "at", "matched", "context", "seconds", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@q("j_30_searched", f"""WITH {SPOKEN}, a AS (SELECT family, count(*) AS n FROM pd GROUP BY 1), s AS (SELECT key, count(DISTINCT source) AS n FROM seg GROUP BY 1), x AS (SELECT key, count(*) AS n FROM hit GROUP BY 1)
SELECT doc_id AS key, coalesce(a.n, 0) AS "values", coalesce(a.n, 0) AS probes, coalesce(s.n, 0) AS sources, x.n IS NULL AND s.n > 0 AND a.n > 0 AS found_nothing FROM documents LEFT JOIN a ON a.family = doc_id % 7 LEFT JOIN s ON s.key = doc_id LEFT JOIN x ON x.key = doc_id""")
def _(t: Tables):
    """What was looked for in each review's sources, and whether in vain."""
    reviews, segments, members, builders = spoken(t)
    return PR.searched(reviews, segments, members, PR.evidence(reviews, segments, members, builders), builders)


@q("j_32", "SELECT p_partkey FROM part WHERE p_name = 'blue bolt'")
def _(t: Tables):
    return E.name_lookup(t.part, "p_name", "Blue BOLT", "p_brand", "p_partkey").select("p_partkey")


NEAR = f"WITH {QS.PRODUCTS}, {QS.NEAR}, {QS.RERANK}"


@q("ord_07", f"WITH {QS.PRODUCTS} SELECT id FROM p JOIN embeddings e ON e.vec_id = p.id, embeddings z WHERE z.vec_id = 4 AND status = 'active' ORDER BY 1 - {QS.COS}, id LIMIT 7")
def _(t: Tables):
    return RT.recall(QS.vectors(t), QS.question(t), k=7).select("id")


@q("ord_08", f"{NEAR} SELECT id FROM r ORDER BY -final, id LIMIT 12")
def _(t: Tables):
    return RT.ordered(RT.rerank(RT.recall(QS.vectors(t), QS.question(t), 1200.0), QS.LIMITS)).select("id").limit(12)


@q("ord_09", f"{NEAR} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY -final, id) AS n FROM r) WHERE n = 1 ORDER BY -final, id LIMIT 6")
def _(t: Tables):
    ranked = RT.rerank(RT.recall(QS.vectors(t), QS.question(t), 1200.0), QS.LIMITS)
    return RT.shortlist(ranked, RT.Constraints(), "family", 20).select("id")


@q("b_04", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN CAST(p_size AS BIGINT) END AS mark FROM part WHERE p_size >= 10")
def _(t: Tables):
    """Names that share a part number with a reference, and names whose part number no reference has."""
    part = lambda c: F.concat(F.lit("X1E-"), c.cast("string"), F.lit("-100"))
    marks = t.spark.range(10, 41).select(F.concat(F.lit("Snapdragon X Elite - "), part(F.col("id")), F.lit(" - Qualcomm Oryon")).alias("name"), F.col("id").alias("mark"))
    own = t.part.where("p_size >= 10").select("p_partkey", F.concat(F.lit("Q X1E "), F.col("p_size").cast("string"), F.lit(" 100")).alias("cpu"))
    return own.join(B.resolve(own, "cpu", marks), "cpu").select("p_partkey", "mark")


@q("b_06", f"""WITH {QS.MISSPELT}, {QS.resolved_sql(0.9, out="cpu")}, {QS.resolved_sql(0.85, out="gpu")}
SELECT 'cpu' AS kind, count(mark) AS n FROM cpu UNION ALL SELECT 'gpu', count(mark) FROM gpu""")
def _(t: Tables):
    """How many misspelt names reach each of the two thresholds."""
    both = [B.resolve(QS.misspelt(t), "name", QS.reference_marks(t), least).agg(F.count("mark").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, least in (("cpu", B.CPU_THRESHOLD), ("gpu", B.GPU_THRESHOLD))]
    return both[0].union(both[1])


@q("b_08", f"""WITH {QS.MISSPELT}, x AS (SELECT name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key FROM m UNION ALL SELECT 'Oryon X2P-64-100', 'oryon x2p64100'),
l AS (SELECT ref, ref AS matched, mark FROM refs UNION ALL SELECT 'snapdragon x1e80100', 'Snapdragon X1E-80-100', 5), {measures("SELECT key AS a, ref AS b FROM x, l")},
r AS (SELECT name, key, matched, mark, round(round(wr, 9) / 100, 3) AS confidence, row_number() OVER (PARTITION BY name ORDER BY round(wr, 9) DESC, ref) AS n FROM x JOIN fz ON a = key JOIN l ON ref = b WHERE wr > 0)
SELECT name, CASE WHEN key LIKE '%x2p64100' THEN 'qualcomm_part_missing' ELSE 'fuzzy' END AS kind, CASE WHEN key LIKE '%x2p64100' THEN 'Exact part number X2P64100: no row carries it' END AS message, CAST(n AS INT) AS place, matched, mark, confidence::DOUBLE AS confidence FROM r WHERE n <= 3
UNION ALL SELECT 'Unknown', 'placeholder', 'Placeholder, not a part name', NULL, NULL, NULL, NULL UNION ALL SELECT 'X1E 80 100', 'qualcomm_part', NULL, 1, 'Snapdragon X1E-80-100', 5, 1.0""")
def _(t: Tables):
    """The three nearest references of misspelt names, of a placeholder and of part numbers with and without a reference."""
    names = QS.misspelt(t).union(t.spark.createDataFrame([("Unknown",), ("X1E 80 100",), ("Oryon X2P-64-100",)], "name string"))
    marks = QS.reference_marks(t).union(t.spark.createDataFrame([("Snapdragon X1E-80-100", 5)], "name string, mark bigint"))
    return B.closest(names, "name", marks).select("name", "kind", "message", "place", "matched", "mark", "confidence")


@q("r_13", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Office/Study' WHEN 1 THEN 'Gaming' WHEN 2 THEN 'Programming/Development' WHEN 3 THEN 'Creative Work' END AS label, c_custkey % 6 > 3 AS rejected FROM customer""")
def _(t: Tables):
    """Purposes that customers give, in any spelling, under their canonical labels; market segments and blanks are none."""
    k = F.col("c_custkey") % 6
    given = F.when(k == 0, "  office/STUDY ").when(k == 1, "gaming").when(k == 2, "Programming/development").when(k == 3, "CREATIVE \t  work").when(k == 4, F.col("c_mktsegment")).otherwise(" ")
    label = SC.purpose_of(given)
    return t.customer.select("c_custkey", label.alias("label"), label.isNull().alias("rejected"))


@q("c_25", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no_sku' WHEN p_partkey % 3 = 0 THEN 'unchanged' WHEN p_partkey % 3 = 1 THEN 'sku' ELSE 'insert' END AS plan FROM part")
def _(t: Tables):
    k = F.col("p_partkey")
    stored = t.part.where("p_partkey % 3 <> 2 and p_size % 5 <> 0").select(k.alias("id"), F.concat(F.lit("s"), k).alias("sku"), F.lit("").alias("spec"), F.lit("").alias("slug"), F.concat(F.lit("d"), k).alias("digest"))
    fetched = t.part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("s"), k)).alias("sku"), F.lit("x").alias("spec"), F.lit("y").alias("slug"), F.when(k % 3 == 1, "other").otherwise(F.concat(F.lit("d"), k)).alias("digest"))
    return E.scrape_plan(fetched, stored).select("p_partkey", "plan")


@q("c_27", "SELECT DISTINCT conv_id, 'pending' AS status FROM conversations WHERE conv_id % 3 <> 0")
def _(t: Tables):
    found = t.conversations.groupBy("conv_id").agg(F.max("text").alias("text"))
    return E.ingest(found, found.where("conv_id % 3 = 0"), "conv_id", "text").select("conv_id", "status")


@q("c_28", "SELECT o_orderkey, 1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' ELSE 'rejected' END AS status FROM orders")
def _(t: Tables):
    work = t.orders.select("o_orderkey", F.lit(1).alias("attempts"), F.lit("rejected").alias("status"))
    fetched = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "text").alias("text"))
    return E.retried(work, fetched, "o_orderkey")


@q("c_29", f"{QS.BEST} SELECT CASE WHEN matched IS NULL THEN 'no match' ELSE 'matched' END AS outcome, count(*) AS n FROM bf GROUP BY 1")
def _(t: Tables):
    got = QS.best_titles(t)
    return E.outcome_counts(got.withColumn("outcome", F.when(F.col("matched").isNotNull(), "matched").otherwise("no match")), "outcome")


@q("c_30", "SELECT role AS outcome, count(*) AS n FROM conversations GROUP BY 1")
def _(t: Tables):
    return E.outcome_counts(t.conversations.withColumnRenamed("role", "outcome"), "outcome")


@q("c_32", "SELECT p_partkey FROM part WHERE p_size % 4 = 0")
def _(t: Tables):
    preview = t.part.select("p_partkey", F.lit("matched").alias("outcome"), F.when(F.col("p_size") % 2 == 0, "differs").otherwise("confirm").alias("decision"))
    return E.decide(preview, t.part.where("p_size % 4 = 0").select("p_partkey"), ["p_partkey"])


@q("aud_04", f"{QS.BEST} SELECT title, matched FROM bf WHERE matched IS NOT NULL AND length(title) % 2 = 0")
def _(t: Tables):
    """Titles that a person has linked (here: those of even length) and that a run would link by itself."""
    return QS.best_titles(t).where("matched is not null and length(title) % 2 = 0").select("title", "matched")


@q("aud_09", f"WITH {QS.MISSPELT}, z AS (SELECT name FROM m UNION SELECT ref FROM refs), {QS.resolved_sql(0.9, names='z')} SELECT name, coalesce(matched = name, false) AS itself FROM res")
def _(t: Tables):
    """Targets of a mapping, some of them misspelt: which resolve to themselves."""
    marks = QS.reference_marks(t)
    targets = QS.misspelt(t).union(marks.select("name")).distinct()
    return B.resolve(targets, "name", marks).select("name", F.coalesce(F.col("matched") == F.col("name"), F.lit(False)).alias("itself"))


@q("aud_13", f"""WITH {QS.MISSPELT}, i AS (SELECT p_name AS b, max(p_partkey) AS id FROM part GROUP BY 1), {measures("SELECT name AS a, ref AS b FROM m, refs")}
SELECT a AS name, id, round(s, 6)::DOUBLE AS score FROM (SELECT a, id, round(ts, 9) AS s, row_number() OVER (PARTITION BY a ORDER BY round(ts, 9) DESC, round(r, 9) DESC, id DESC) AS n FROM fz JOIN i USING (b) WHERE ts > 0) WHERE n = 1""")
def _(t: Tables):
    ref = t.part.groupBy(F.col("p_name").alias("b")).agg(F.max("p_partkey").alias("id"))
    return E.nearest_compound(QS.misspelt(t), "name", ref, "b", "id").withColumn("score", F.round("score", 6))


@q("aud_14", f"""WITH {QS.MISSPELT}, w AS (SELECT DISTINCT regexp_replace(name, 'x$', '') AS name FROM m), {QS.resolved_sql(0.9, out="one")}, {QS.resolved_sql(0.9, names="w", out="two")}
SELECT one.name, one.mark AS before, two.mark AS after FROM one JOIN two ON two.name = regexp_replace(one.name, 'x$', '')""")
def _(t: Tables):
    """Marks of misspelt names before and after a rewrite that takes off a last x."""
    marks, names = QS.reference_marks(t), QS.misspelt(t)
    rewritten = F.regexp_replace("name", "x$", "")
    two = B.resolve(names.select(rewritten.alias("to")), "to", marks).select("to", F.col("mark").alias("after"))
    one = B.resolve(names, "name", marks).select("name", F.col("mark").alias("before")).withColumn("to", rewritten)
    return one.join(two, "to").select("name", "before", "after")


@q("aud_16", f"WITH {QL.LINKS} SELECT count(DISTINCT review_id) AS reviews, count(*) AS links, count(*) FILTER (config_id IS NULL) AS open FROM e")
def _(t: Tables):
    e = L.effective_links(QL.links(t))
    return e.agg(F.count_distinct("review_id").alias("reviews"), F.count(F.lit(1)).alias("links"), F.count_if(F.col("config_id").isNull()).alias("open"))


@q("aud_20", f"{QS.BEST} SELECT CASE WHEN tied <= 1 THEN 'single' WHEN tied <= 3 THEN 'few' ELSE 'many' END AS bucket, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM bf GROUP BY 1")
def _(t: Tables):
    return E.tie_profile(QS.best_titles(t)).select("bucket", "n", F.round("mean_gap", 6).alias("mean_gap"))


@q("str_11", "SELECT p_partkey, lower(p_name) AS v FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", B.match_key(F.concat(F.upper("p_name"), F.lit(" (2024) Laptop  SSD"))).alias("v"))


def name_pairs(t: Tables):
    return QS.misspelt(t).select(F.col("name").alias("a")).join(t.part.select(F.col("p_name").alias("b")).distinct(), F.length("a") - 1 == F.length("b"))


PAIRS = f"WITH {QS.MISSPELT}, {measures('SELECT name AS a, ref AS b FROM m, refs WHERE length(name) - 1 = length(ref)')}"


@q("str_25", f"{PAIRS} SELECT a, b, round(ts, 6)::DOUBLE AS v FROM fz")
def _(t: Tables):
    return name_pairs(t).select("a", "b", F.round(similarity.token_set("a", "b"), 6).alias("v"))


@q("str_26", f"{PAIRS} SELECT a, b, round(wr, 6)::DOUBLE AS v FROM fz")
def _(t: Tables):
    return name_pairs(t).select("a", "b", F.round(similarity.w_ratio("a", "b"), 6).alias("v"))


@q("snk_05", "SELECT conv_id, turn, 'new' AS text FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'old' FROM conversations WHERE conv_id % 2 = 1")
def _(t: Tables):
    live = t.conversations.select("conv_id", "turn", F.lit("old").alias("text"))
    staged = t.conversations.where("conv_id % 2 = 0").select("conv_id", "turn", F.lit("new").alias("text"), F.when(F.col("turn") % 2 == 1, "none").alias("reason"))
    return W.swap_staged(live, staged.limit(0), staged, "conv_id")[0]


@q("snk_10", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'html_uploaded' ELSE 'pending' END AS status FROM pages")
def _(t: Tables):
    targets = t.pages.select("page_id", F.lit("pending").alias("status"))
    return S.advance(targets, t.pages.where("page_id % 2 = 0").select("page_id", F.lit("html_uploaded").alias("to_status"), F.lit(1).alias("ts")), "page_id")


@q("snk_11", "SELECT n_name FROM nation WHERE n_regionkey <> 1")
def _(t: Tables):
    header = t.nation.select("n_name", F.sha2("n_name", 256).alias("file_hash"))
    return W.load_once(header.join(t.nation.where("n_regionkey = 1").select("n_name"), "n_name"), header).select("n_name")


@q("snk_16", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return W.replace_keys(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus = 'F'"), ["o_custkey"]).select("o_custkey", "o_orderkey")


@q("snk_17", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN 'human' ELSE 'auto' END AS source FROM lineitem WHERE l_partkey % 2 = 0")
def _(t: Tables):
    old = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("family_id"), (F.col("l_quantity") * 2).alias("confidence"))
    return W.derived_links(old).select("l_orderkey", "l_linenumber", "source")


@q("snk_19", "SELECT l_orderkey AS review_id, 'human' AS source FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 'auto' FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey % 2 = 1 UNION ALL SELECT DISTINCT l_orderkey, 'auto' FROM lineitem WHERE l_orderkey % 2 = 0")
def _(t: Tables):
    links = t.lineitem.select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_returnflag") == "R", "human").otherwise("auto").alias("source"), F.lit(1).alias("family_id"))
    m = t.lineitem.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("review_id"), F.lit(2).alias("family_id")).distinct()
    return W.replace_auto_links(links, m).select("review_id", "source")


@q("stm_11", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'scraped' ELSE 'pending' END AS status FROM orders")
def _(t: Tables):
    targets = t.orders.select("o_orderkey", F.lit("pending").alias("status"))
    ev = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "scraped").otherwise("pending").alias("to_status"), F.lit(1).alias("ts"))
    return S.advance(targets, ev, "o_orderkey")
