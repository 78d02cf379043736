"""Window operators on lineitem, orders, part, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkshelf.operators import windows as W
from sparkshelf.plans.registry import Registry, Tables

q = Registry()
LATEST = "ORDER BY o_orderdate DESC, o_orderkey DESC"
HISTORY = "SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice / l_quantity AS price FROM lineitem"


def history(t: Tables):
    return t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def ranked_parts(t: Tables):
    """Parts by price as a ranked list in which every seventh has no group; ranks are dense because keys are."""
    group = F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", F.lit("/"), "p_type"))
    return t.part.select("p_partkey", "p_retailprice", group.alias("family"), F.struct(-F.col("p_retailprice"), "p_partkey").alias("rank"))


RANKED = "(SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || '/' || p_type END AS family, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)"


@q("win_01", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey {LATEST}) AS n FROM orders) WHERE n = 1")
def _(t: Tables):
    return W.latest_per_key(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@q("win_02", f"SELECT p_partkey, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rank) AS n FROM {RANKED}) WHERE family IS NULL OR n = 1")
def _(t: Tables):
    return W.dedup_first(ranked_parts(t), "family", "rank").select("p_partkey", "family")


@q("win_03", f"""SELECT p_partkey, family, first_key FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(p_retailprice - 1500), rank) AS n,
first_value(p_partkey) OVER (PARTITION BY family ORDER BY rank) AS fk, CASE WHEN family IS NULL THEN p_partkey ELSE first_value(p_partkey) OVER (PARTITION BY family ORDER BY rank) END AS first_key FROM {RANKED}) WHERE family IS NULL OR n = 1""")
def _(t: Tables):
    return W.dedup_closest(ranked_parts(t), "family", "rank", "p_retailprice", 1500.0).select("p_partkey", "family", F.col("place.p_partkey").alias("first_key"))


@q("win_04", "SELECT p_partkey, (rank() OVER (ORDER BY p_retailprice) - 1 + count(*) OVER (PARTITION BY p_retailprice) / 2.0) / count(*) OVER () * 100.0 AS percentile FROM part")
def _(t: Tables):
    return W.midpoint_percentile(t.part, "p_retailprice").select("p_partkey", "percentile")


@q("win_05", f"""SELECT l_partkey, l_orderkey, l_linenumber, coalesce(prev > 0 AND abs(price - prev) / prev >= 0.3, false) AS jump, coalesce(prev <> price AND l_shipdate - pts <= INTERVAL 24 HOUR, false) AS rapid, price = 0 AS zero
FROM (SELECT *, lag(price) OVER w AS prev, lag(l_shipdate) OVER w AS pts FROM ({HISTORY}) WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber))""")
def _(t: Tables):
    out = W.consecutive(history(t), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "price", "l_shipdate")
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "jump", "rapid", "zero")


@q("win_06", "SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS place FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


@q("win_07", "SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY -s_acctbal, s_suppkey) AS n FROM supplier) WHERE n <= 2 ORDER BY -s_acctbal, s_suppkey LIMIT 5")
def _(t: Tables):
    return W.cap_per_group(t.supplier, "s_nationkey", 2, 5, F.desc("s_acctbal"), F.col("s_suppkey")).select("s_suppkey", "s_nationkey")


@q("win_08", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def _(t: Tables):
    return W.surplus(t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), ["h"], F.col("doc_id")).select("doc_id")


@q("win_09", "SELECT d, n, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) + 100 AS total FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)")
def _(t: Tables):
    daily = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return W.running_total(daily, "d", "n", F.lit(100)).select("d", "n", "total")


@q("win_10", """WITH RECURSIVE s AS (SELECT conv_id, text, turn * 1.0::DOUBLE AS start, length(text) / 5.0::DOUBLE AS dur, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, 0 AS n, dur AS total FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, CASE WHEN r.total >= 45 THEN r.n + 1 ELSE r.n END, CASE WHEN r.total >= 45 THEN s.dur ELSE r.total + s.dur END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT r.conv_id, n, string_agg(text, ' ' ORDER BY r.i) AS text, min(start) AS start, arg_max(total, r.i) AS duration FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i GROUP BY r.conv_id, n""")
def _(t: Tables):
    """Turns of a conversation as segments of a second for each five characters, gathered into windows of 45 seconds."""
    seg = F.struct("turn", F.col("text").alias("text"), (F.col("turn") * 1.0).alias("start"), (F.length("text") / 5.0).alias("duration"))
    got = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(seg)).alias("segments"))
    return got.select("conv_id", F.posexplode(W.greedy_windows(F.col("segments"))).alias("n", "w")).select("conv_id", "n", "w.*")


@q("win_11", "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 300), '') AS tail FROM conversations")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", W.previous_tail(["conv_id"], "turn", "text").alias("tail"))


@q("win_12", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size) > 1 AS alike FROM part")
def _(t: Tables):
    return W.indistinguishable(t.part, ["p_brand", "p_type", "p_size"]).select("p_partkey", "alike")


@q("win_13", """SELECT o_custkey, array_to_string(list_filter([CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS differing FROM orders GROUP BY 1""")
def _(t: Tables):
    return W.differing_columns(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"]).select("o_custkey", F.array_join("differing", ",").alias("differing"))


@q("win_14", "SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_totalprice)) FILTER (o_orderstatus = 'F' AND o_totalprice > 0) AS price FROM orders GROUP BY 1")
def _(t: Tables):
    return W.last_official(t.orders, "o_custkey", "o_totalprice", "o_orderdate", F.col("o_orderstatus") == "F").select("o_custkey", "price")


@q("win_15", "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount = 0, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(t: Tables):
    return W.latest_per_key(t.lineitem, ["l_partkey"], (F.col("l_discount") == 0).asc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()).select("l_partkey", "l_orderkey")


@q("win_16", """SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY n DESC, o_orderpriority) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1""")
def _(t: Tables):
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey")
    each = n.agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.col("n").alias("n")))).alias("e"))
    return each.select("o_custkey", F.array_join(F.transform(W.top_entries(F.col("e"), "n", 3), lambda x: x["name"]), ",").alias("top"))


@q("win_17", "SELECT o_orderstatus, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"))


@q("win_18", "SELECT p_partkey FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_type) AS m FROM part) WHERE p_retailprice >= m - 10")
def _(t: Tables):
    return W.within_of_best(t.part, "p_retailprice", 10, ["p_type"]).select("p_partkey")


@q("win_19", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def _(t: Tables):
    got = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("h"))
    return got.select("o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@q("win_20", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def _(t: Tables):
    return W.latest_per_key(t.lineitem, ["l_partkey", "l_suppkey"], F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey")


@q("win_21", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t: Tables):
    return W.latest_per_key(t.orders, ["o_orderpriority"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderpriority", "o_orderkey")
