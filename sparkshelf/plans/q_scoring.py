"""Percentile scoring, rankings and retrieval on a catalog view of part, lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.operators import resolution as B
from sparkshelf.operators import retrieval as R
from sparkshelf.operators import scoring as S
from sparkshelf.operators import search as M
from sparkshelf.plans.registry import Registry, Tables
from sparkshelf.plans.sql_fuzzy import measures

q = Registry()


def scorable(t: Tables):
    """A product catalog from part and its sales. Every kind of gap occurs: unknown prices, weights and marks, stand-in marks."""
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("n"))
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t.part.join(sold, "p_partkey", "left")
    return rows.select(
        k.alias("id"), F.col("p_brand").alias("brand"), F.concat("p_brand", F.lit("/"), "p_type").alias("family"), F.when(k % 19 == 0, "inactive").otherwise("active").alias("status"),
        F.when(k % 17 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"), F.when(k % 11 != 0, F.col("qty")).alias("cpu_mark"), F.when(k % 13 != 0, F.col("n")).alias("gpu_mark"),
        (size > 40).alias("gpu_is_proxy"), (8 * (size % 4 + 1)).alias("ram_gb"), (256 * (k % 4 + 1)).alias("storage_gb"), F.when(k % 7 == 0, "1TB HDD").otherwise("SSD").alias("storage_type"),
        F.when(k % 9 != 0, 1 + size / 20.0).alias("weight_kg"), (13 + k % 5).alias("display_size"), (40.0 + size).alias("battery_wh"), F.when(k % 3 == 0, "Core i7").otherwise("Ryzen 5").alias("cpu_model"),
    )


PRODUCTS = """
p0 AS (SELECT part.*, qty, n FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
p AS (SELECT p_partkey AS id, p_brand AS brand, p_brand || '/' || p_type AS family, CASE WHEN p_partkey % 19 = 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN p_partkey % 17 = 0 THEN 0.0 ELSE p_retailprice END AS price,
CASE WHEN p_partkey % 11 <> 0 THEN qty END AS cpu_mark, CASE WHEN p_partkey % 13 <> 0 THEN n END AS gpu_mark, p_size > 40 AS gpu_is_proxy, 8 * (p_size % 4 + 1) AS ram_gb, 256 * (p_partkey % 4 + 1) AS storage_gb,
p_partkey % 7 = 0 AS hdd, CASE WHEN p_partkey % 9 <> 0 THEN 1 + CAST(p_size AS DOUBLE) / 20.0 END AS weight_kg, 13 + p_partkey % 5 AS display_size, CAST(40 + p_size AS DOUBLE) AS battery_wh, CASE WHEN p_partkey % 3 = 0 THEN 'core i7' ELSE 'ryzen 5' END AS cpu FROM p0)"""


def _rank(c: str, where: str = "true") -> str:
    """SQL of the percentile map of a column among active rows, for all values that occur."""
    return f"r_{c} AS (SELECT v, CAST(lo + eq / CAST(2 AS DOUBLE) AS DOUBLE) / tot * 100 AS pct FROM (SELECT v, eq, coalesce(sum(eq) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(eq) OVER () AS tot FROM (SELECT {c} AS v, count(*) FILTER (status = 'active' AND {where}) AS eq FROM p WHERE {c} IS NOT NULL GROUP BY 1)))"


COLUMNS = ("price", "cpu_mark", "gpu_mark", "ram_gb", "storage_gb", "weight_kg", "battery_wh")
MAPS = ", ".join(_rank(c, "price > 0" if c == "price" else "true") for c in COLUMNS)
PCT = "SELECT p.*, " + ", ".join(f"coalesce(r_{c}.pct, 50) AS p_{c}" for c in COLUMNS) + " FROM p " + " ".join(f"LEFT JOIN r_{c} ON r_{c}.v = p.{c}" for c in COLUMNS)
SCORES = f"""WITH {PRODUCTS}, {MAPS}, x AS ({PCT}), s AS (SELECT *, CASE WHEN price = 0 THEN 50 ELSE 100 - p_price END AS s_price, CASE WHEN cpu_mark IS NULL THEN 50 ELSE p_cpu_mark END AS s_cpu, CASE WHEN gpu_mark IS NULL THEN 50 ELSE p_gpu_mark END AS s_gpu,
p_ram_gb * 0.6::DOUBLE + (CASE WHEN hdd THEN greatest(0, p_storage_gb - 15) ELSE p_storage_gb END) * 0.4::DOUBLE AS s_ram_storage, CASE WHEN weight_kg IS NULL THEN 50 ELSE 100 - p_weight_kg END AS s_portability, p_battery_wh AS s_battery FROM x)"""


FACTORS = "price cpu gpu ram_storage portability battery screen_size brand".split()
#: The profiles once more, so that the SQL does not take them from the code under test.
RAW = {"office_study": (9, 6, 2, 5, 7, 8, 2, 1), "programming": (6, 9, 3, 9, 4, 6, 4, 1), "gaming": (4, 8, 10, 7, 1, 1, 4, 1), "creative_work": (3, 8, 9, 8, 3, 3, 5, 1), "general_use": (9, 7, 2, 7, 6, 6, 4, 2)}
PROFILE_ROWS = ", ".join(f"('{n}', '{f}', {w})" for n, v in RAW.items() for f, w in zip(FACTORS, v))


def _total(profile: str) -> str:
    w = {f: x / sum(RAW[profile]) for f, x in zip(FACTORS, RAW[profile])}
    scored = " + ".join(f"s_{f} * {w[f]!r}::DOUBLE" for f in FACTORS[:6])
    return f"CASE WHEN cpu_mark IS NULL AND gpu_mark IS NULL THEN NULL ELSE CAST(greatest(0, least(100, round_even({scored} + 50 * {w['screen_size']!r}::DOUBLE + 50 * {w['brand']!r}::DOUBLE, 0))) AS INT) END"


ALL_SCORES = SCORES + " " + " UNION ALL ".join(f"SELECT id, '{n}' AS use_case, {_total(n)} AS score FROM s" for n in RAW)


def scored(t: Tables):
    return S.score(S.with_percentiles(scorable(t)), S.PROFILES)


for factor, column in (("01", "price"), ("02", "cpu"), ("03", "gpu"), ("04", "ram_storage"), ("05", "portability"), ("06", "battery")):

    def _factor(t: Tables, column=column):
        x = S.with_percentiles(scorable(t))
        return x.select("id", F.round(S.factor_scores()[column], 6).alias("score"))

    q(f"f_{factor}", f"{SCORES} SELECT id, round(s_{column}, 6) AS score FROM s")(_factor)


@q("f_07", f"WITH {PRODUCTS} SELECT id, CAST(greatest(0, 100 - abs(1 - CASE WHEN display_size <= 14 THEN 0 WHEN display_size <= 16 THEN 1 ELSE 2 END) * 40) AS DOUBLE) AS score FROM p")
def _(t: Tables):
    return scorable(t).select("id", S.screen_score({"screen_size": ["15-16 inch"]}).alias("score"))


@q("f_08", f"WITH {PRODUCTS} SELECT id, CASE WHEN lower(brand) = 'brand#12' THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS score FROM p")
def _(t: Tables):
    return scorable(t).select("id", S.brand_score({"brand_preferences": ["Brand#12"]}).alias("score"))


@q("f_09", """WITH p AS (SELECT c_custkey, c_custkey % 9 + 1 AS cpu, c_nationkey + 1 AS price, c_custkey % 3 AS gaming, c_custkey % 5 = 0 AS office, CASE c_custkey % 4 WHEN 0 THEN 1.4 WHEN 2 THEN 0.5 ELSE 1.0 END AS carry FROM customer),
r AS (SELECT c_custkey, f AS factor, CAST(CASE f WHEN 'cpu' THEN cpu WHEN 'price' THEN price ELSE 1 END AS DOUBLE) * greatest(CASE WHEN gaming = 0 THEN CASE f WHEN 'gpu' THEN 1.3 WHEN 'cpu' THEN 1.2 WHEN 'ram_storage' THEN 1.1 ELSE 1.0 END ELSE 1.0 END, CASE WHEN office THEN CASE f WHEN 'price' THEN 1.3 WHEN 'battery' THEN 1.2 WHEN 'portability' THEN 1.2 WHEN 'cpu' THEN 1.1 ELSE 1.0 END ELSE 1.0 END)::DOUBLE * CASE WHEN f = 'portability' THEN carry ELSE 1.0 END::DOUBLE AS w
 FROM p, (VALUES ('price'), ('cpu'), ('gpu'), ('ram_storage'), ('portability'), ('battery'), ('screen_size'), ('brand')) v(f))
SELECT c_custkey, factor, round(w / sum(w) OVER (PARTITION BY c_custkey), 9) AS weight FROM r""")
def _(t: Tables):
    """Weight vectors of every customer's preference."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    priorities = F.create_map(F.lit("cpu"), (k % 9 + 1).cast("double"), F.lit("price"), (F.col("c_nationkey") + 1).cast("double"))
    purpose = F.concat(F.when(k % 3 == 0, F.array(F.lit("Gaming"))).otherwise(none), F.when(k % 5 == 0, F.array(F.lit("Office/Study"))).otherwise(none), F.when(k % 7 == 0, F.array(F.lit("Other"))).otherwise(none))
    carry = F.when(k % 4 == 0, "Yes, daily").when(k % 4 == 1, "Neutral").when(k % 4 == 2, "No")
    rows = t.customer.select("c_custkey", priorities.alias("priorities"), purpose.alias("purpose"), carry.alias("portability"))
    return S.weight_rows(rows, "c_custkey").withColumn("weight", F.round("weight", 9))


@q("f_10", f"{SCORES} SELECT id, {_total('general_use')} AS score FROM s")
def _(t: Tables):
    return S.score(S.with_percentiles(scorable(t)), {"general_use": S.PROFILES["general_use"]}).select("id", "score")


@q("f_11", f"SELECT id, use_case, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, use_case) AS n FROM ({ALL_SCORES}) WHERE score IS NOT NULL) WHERE n = 1")
def _(t: Tables):
    """The profile that each product scores best under."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "use_case"))
    return scored(t).where("score is not null").groupBy("id").agg(best.alias("b")).select("id", "b.use_case", (-F.col("b.s")).alias("score"))


@q("f_12", ALL_SCORES)
def _(t: Tables):
    return scored(t).select("id", "use_case", "score")


@q("f_13", f"""{SCORES}, g AS (SELECT id, family, gpu_is_proxy OR gpu_mark IS NULL AS late, price, {_total('gaming')} AS score FROM s), d AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY late, -score, price, id) AS n FROM g WHERE score IS NOT NULL)
SELECT id, family, score FROM d WHERE n = 1 ORDER BY late, -score, price, id LIMIT 10""")
def _(t: Tables):
    return S.ranking(scored(t), "gaming", "family").select("id", "family", "score")


@q("f_14", f"{SCORES} SELECT id, {_total('programming')} AS score FROM s WHERE brand = 'Brand#12'")
def _(t: Tables):
    """The products of one brand, scored on demand against the whole catalog."""
    products = scorable(t)
    chosen = S.with_percentiles(products.where("brand = 'Brand#12'"), products)
    return S.score(chosen, {"programming": S.PROFILES["programming"]}).select("id", "score")


OWN = f"""x AS (SELECT o.*, coalesce(pv.pct, 50) AS p_price, 100.0::DOUBLE AS p_ram_gb, {", ".join(f"coalesce(r_{c}.pct, 50) AS p_{c}" for c in COLUMNS if c not in ("price", "ram_gb"))} FROM own o LEFT JOIN pv ON pv.v = o.price {" ".join(f"LEFT JOIN r_{c} ON r_{c}.v = o.{c}" for c in COLUMNS if c not in ("price", "ram_gb"))})"""
MACHINES = SCORES.replace(f"x AS ({PCT})", f"""own AS (SELECT * REPLACE (price + 777.5 AS price, 48 AS ram_gb) FROM p), pv AS (SELECT v, (count(*) FILTER (c.price < v) + count(*) FILTER (c.price = v) / 2.0::DOUBLE) / count(*) * 100 AS pct FROM (SELECT DISTINCT price AS v FROM own) CROSS JOIN (SELECT price FROM p WHERE status = 'active' AND price > 0) c GROUP BY v), {OWN}""")


@q("f_15", f"""{MACHINES} SELECT id, {", ".join(f"{_total(n)} AS {n}" for n in RAW)}, CASE WHEN cpu_mark IS NULL AND gpu_mark IS NULL THEN 'no benchmark for ' || CASE WHEN id % 3 = 0 THEN 'Core i7' ELSE 'Ryzen 5' END || ': no score rather than an invented one' END AS reason FROM s""")
def _(t: Tables):
    """Configured machines: every product at prices and with memory that no catalog row has, ranked against the catalog."""
    products = scorable(t)
    own = S.configured(products, {"price": F.col("price") + 777.5, "ram_gb": F.lit(48)})
    out = S.configured_scores(own, products)
    return out.select("id", *[F.col("scores")[n].alias(n) for n in S.PROFILES], "reason")


@q("f_16", "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo) * 100, 6) AS minmax, round((greatest(p5, least(p95, p_retailprice)) - p5) / (p95 - p5) * 100, 6) AS clamped FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.05) AS p5, quantile_cont(p_retailprice, 0.95) AS p95 FROM part)")
def _(t: Tables):
    return S.curves(t.part.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("minmax", 6).alias("minmax"), F.round("clamped", 6).alias("clamped"))


@q("agg_16", f"WITH {PRODUCTS} SELECT CASE WHEN gpu_mark IS NULL THEN 'unresolved' WHEN gpu_is_proxy THEN 'proxy' ELSE 'direct' END AS how, count(*) AS n FROM p GROUP BY 1")
def _(t: Tables):
    how = F.when(F.col("gpu_mark").isNull(), "unresolved").when(F.col("gpu_is_proxy"), "proxy").otherwise("direct")
    return scorable(t).groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


# -- benchmark resolution ----------------------------------------------------------------------------------------------


def reference_marks(t: Tables):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").cast("bigint").alias("mark"))


def misspelt(t: Tables):
    """Names of parts with a letter too many, one too few, in capitals with wide spaces, or turned round with words added; by brand."""
    k, first, second = F.substring("p_brand", 7, 9).cast("int"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    other = F.concat(second, F.lit(" "), first, F.lit(" gen "), k.cast("string"))
    name = F.when(k % 4 == 0, F.concat("p_name", F.lit("x"))).when(k % 4 == 1, F.expr("substr(p_name, 2)")).when(k % 4 == 2, F.upper(F.replace("p_name", F.lit(" "), F.lit("  ")))).otherwise(other)
    return t.part.select(name.alias("name")).distinct()


MISSPELT = """m AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN p_name || 'x' WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN upper(replace(p_name, ' ', '  ')) ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' gen ' || k END AS name
FROM (SELECT p_name, CAST(substr(p_brand, 7) AS INT) AS k FROM part)), refs AS (SELECT p_name AS ref, CAST(max(p_size) AS BIGINT) AS mark FROM part GROUP BY 1)"""


def resolved_sql(threshold: float, names: str = "m", out: str = "res") -> str:
    """Entries up to ``out`` (name, mark, matched, confidence): every name against every reference."""
    keyed = f"{out}_k AS (SELECT name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key FROM {names})"
    scored = measures(f"SELECT key AS a, ref AS b FROM {out}_k, refs").replace("fz", f"{out}_f")
    return f"""{keyed}, {scored}, {out}_t AS (SELECT name, b, mark, CASE WHEN a = b THEN 1.0 ELSE round(wr, 9) / 100 END AS c, row_number() OVER (PARTITION BY name ORDER BY a = b DESC, round(wr, 9) DESC, b) AS n FROM {out}_k JOIN {out}_f ON a = key JOIN refs ON ref = b),
{out} AS (SELECT name, CASE WHEN c >= {threshold} THEN mark END AS mark, CASE WHEN c >= {threshold} THEN b END AS matched, round(c, 6)::DOUBLE AS confidence FROM {out}_t WHERE n = 1)"""


#: ``bf`` (title, matched, score, gap, tied): the misspelt names against all part names by token-set ratio, threshold 73.
BEST = f"""WITH {MISSPELT}, {measures("SELECT name AS a, ref AS b FROM m, refs")}, s AS (SELECT a, b, round(ts, 9) AS v FROM fz WHERE ts > 0), t AS (SELECT a, max(v) AS top FROM s GROUP BY 1),
bf AS (SELECT name AS title, CASE WHEN max(top) >= 73 THEN min(b) FILTER (v = top) END AS matched, round(coalesce(max(top), 0), 6)::DOUBLE AS score, round(max(top) - max(v) FILTER (v < top), 6)::DOUBLE AS gap, CAST(count(*) FILTER (v = top) AS INT) AS tied
FROM m LEFT JOIN s ON s.a = name LEFT JOIN t ON t.a = name GROUP BY 1)"""


def best_titles(t: Tables):
    names = t.part.select("p_name").distinct()
    got = B.best_fuzzy(misspelt(t).withColumnRenamed("name", "title"), "title", names, "p_name", 73.0)
    return got.withColumns({"score": F.round("score", 6), "gap": F.round("gap", 6), "tied": F.col("tied").cast("int")})


@q("b_01", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN b || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE ' , ' END || n || ' 9' WHEN 1 THEN b || ' ' || n || ' ' || p_size || ' core gpu' WHEN 2 THEN n || ' x1e78' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' ' || b WHEN 3 THEN 'apple ' || n ELSE n || ' fi ' || b END AS name
FROM (SELECT p_partkey, p_size, lower(p_brand) AS b, lower(p_name) AS n FROM part)""")
def _(t: Tables):
    """Names with marks, the word processor, core counts, split part numbers (dashes with and without spaces), a frame, compatibility forms."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    third, even = F.col("p_partkey") % 3, F.col("p_partkey") % 2 == 0
    count = F.when(even, F.concat(F.lit(" ("), size, F.lit("-Core) GPU"))).when(third == 0, F.concat(F.lit(" "), size, F.lit(" \u2013 Core GPU"))).when(third == 1, F.concat(F.lit(" "), size, F.lit("- core GPU"))).otherwise(F.concat(F.lit("  "), size, F.lit(" core GPU")))
    dash = F.when(third == 0, " - ").when(third == 1, " \u2013").otherwise("-")
    part = F.concat(F.lit(" X1E"), dash, F.lit("78"), dash, F.lpad(size, 3, "0"), F.lit(" "))
    name = F.when(k == 0, F.concat("p_brand", F.when(even, "\u00ae Processor  ").otherwise("\u00ae Processor, "), "p_name", F.lit("\u2122 9"))).when(k == 1, F.concat("p_brand", F.lit(" "), F.upper("p_name"), count)).when(k == 2, F.concat("p_name", part, "p_brand"))
    name = name.when(k == 3, F.concat(F.lit("ARM Apple "), "p_name", F.lit(" 0 MHz"))).otherwise(F.concat("p_name", F.lit("  \ufb01 "), "p_brand"))
    return t.part.select("p_partkey", B.normal_name(name).alias("name"))


@q("b_02", "SELECT doc_id, coalesce(lower(trim(lang)) IN ('', 'unknown', 'n/a', 'none', '-'), true) AS p FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", B.is_placeholder(F.col("lang")).alias("p"))


@q("b_03", "SELECT p_partkey, len(list_filter(string_split(replace(lower(p_brand), '-', ' '), ' '), lambda x: length(x) >= 3 AND regexp_matches(x, '[0-9]'))) > 0 AS anchored FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", B.has_anchor(F.col("p_brand")).alias("anchored"))


@q("b_05", f"WITH {MISSPELT}, {resolved_sql(0.85)} SELECT * FROM res")
def _(t: Tables):
    """Misspelt names against the reference list."""
    return B.resolve(misspelt(t), "name", reference_marks(t), B.GPU_THRESHOLD).withColumn("confidence", F.round("confidence", 6))


@q("b_07", """SELECT DISTINCT CASE m WHEN 0 THEN 'GeForce RTX ' || n || ' Laptop GPU' WHEN 1 THEN 'NVIDIA GeForce RTX ' || n WHEN 2 THEN '10-core GPU' WHEN 3 THEN 'AMD Radeon Graphics' ELSE 'Unknown' END AS gpu, CASE m WHEN 0 THEN 'x' WHEN 1 THEN 'Core i7' WHEN 2 THEN 'Apple M5' WHEN 3 THEN 'AMD Ryzen 7 ' || (7000 + s) || 'U' ELSE 'Mystery' END AS cpu,
CASE m WHEN 0 THEN n * 10 WHEN 1 THEN n * 10 WHEN 2 THEN 6000 WHEN 3 THEN s END AS gpu_mark, CASE m WHEN 0 THEN 'direct' WHEN 1 THEN 'laptop_variant' WHEN 2 THEN 'apple_equivalent' WHEN 3 THEN 'integrated' ELSE 'unresolved' END AS gpu_resolution, m > 1 AS gpu_is_proxy FROM (SELECT p_partkey % 5 AS m, CAST(p_size AS BIGINT) AS s, CAST(4000 + p_size AS BIGINT) AS n FROM part)""")
def _(t: Tables):
    """The resolution ladder on names of parts: laptop names, bare ones, core counts, graphics built into a CPU, none."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("bigint")
    model = F.concat(F.lit("GeForce RTX "), (size + 4000).cast("string"))
    gpu = F.when(k == 0, F.concat(model, F.lit(" Laptop GPU"))).when(k == 1, F.concat(F.lit("NVIDIA "), model)).when(k == 2, "10-core GPU").when(k == 3, "AMD Radeon Graphics").otherwise("Unknown")
    ryzen = F.concat(F.lit("AMD Ryzen 7 "), (size + 7000).cast("string"), F.lit("U"))
    cpu = F.when(k == 0, "x").when(k == 1, "Core i7").when(k == 2, "Apple M5").when(k == 3, ryzen).otherwise("Mystery")
    radeon = F.concat(F.lit("Radeon "), (size + 600).cast("string"), F.lit("M"))
    own = t.part.select(F.explode(F.array(F.struct(F.concat(model, F.lit(" Laptop GPU")).alias("name"), ((size + 4000) * 10).alias("mark")), F.struct(model.alias("name"), (size + 90_000).alias("mark")), F.struct(radeon.alias("name"), size.alias("mark")))).alias("m")).select("m.*").distinct()
    marks = own.union(own.sparkSession.range(1).select(F.lit("Qualcomm Adreno X2-90 GPU"), F.lit(6000).cast("bigint")))
    built_in = t.part.select(F.substring(ryzen, 5, 99).alias("cpu"), radeon.alias("gpu")).distinct()
    return B.resolve_gpu(t.part.select(gpu.alias("gpu"), cpu.alias("cpu")), "gpu", "cpu", marks, built_in)


@q("j_14", f"{BEST} SELECT title, matched, score FROM bf")
def _(t: Tables):
    """Misspelt titles against part names by token-set ratio."""
    return best_titles(t).select("title", "matched", "score")


@q("j_15", f"{BEST} SELECT title, score, gap, tied FROM bf")
def _(t: Tables):
    return best_titles(t).select("title", "score", "gap", "tied")


# -- retrieval ---------------------------------------------------------------------------------------------------------

LIMITS = R.Constraints(budget=1200.0, weight_limit=2.0, purpose=("Programming/Development", "Office/Study"), brands=("brand#12", "brand#23"))


def vectors(t: Tables):
    return scorable(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")


def question(t: Tables) -> list[float]:
    return list(t.embeddings.where("vec_id = 4").select("embedding").first()["embedding"])


COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[]))"
NEAR = f"near AS (SELECT p.*, round({COS}, 4) AS similarity FROM p JOIN embeddings e ON e.vec_id = p.id, embeddings z WHERE z.vec_id = 4 AND status = 'active' AND price <= 1200 ORDER BY 1 - {COS}, id LIMIT 50)"
PENALTY = "CASE WHEN price <= 1100 THEN 1.0 WHEN (price - 1100) / 1100 <= 0.10 THEN greatest(0.5, 1 - (price - 1100) / 1100 * 2) WHEN (price - 1100) / 1100 <= 0.30 THEN greatest(0.3, 1 - (price - 1100) / 1100 * 1.5) ELSE 0.1 END"
ON_WEIGHT = "CASE WHEN weight_kg <= 2.0 THEN 1.0 WHEN (weight_kg - 2.0) / 2.0 <= 0.20 THEN 0.7 ELSE 0.2 END"
BRAND = "CASE WHEN lower(brand) IN ('brand#12', 'brand#23') THEN 0.05 ELSE -0.25 END"
RERANK = f"r AS (SELECT *, round(similarity * ({ON_WEIGHT})::DOUBLE + 0.08::DOUBLE + ({BRAND})::DOUBLE, 4) AS final FROM near WHERE weight_kg IS NOT NULL)"


@q("r_01", f"WITH {PRODUCTS}, {NEAR} SELECT id, similarity FROM near")
def _(t: Tables):
    return R.recall(vectors(t), question(t), 1200.0).select("id", "similarity")


@q("r_02", f"WITH {PRODUCTS} SELECT id, 0.58::DOUBLE AS similarity FROM p WHERE status = 'active' AND price <= 1200 AND weight_kg <= 2.0 AND lower(brand) = 'brand#12' ORDER BY price, id LIMIT 50")
def _(t: Tables):
    return R.fallback(scorable(t), LIMITS).select("id", "similarity")


@q("r_03", f"WITH {PRODUCTS} SELECT id, round({PENALTY}, 6) AS penalty FROM p")
def _(t: Tables):
    return scorable(t).select("id", F.round(R.budget_penalty(F.col("price"), 1100.0), 6).alias("penalty"))


@q("r_04", f"WITH {PRODUCTS} SELECT id, CASE WHEN weight_kg IS NULL THEN 1.0 ELSE {ON_WEIGHT} END::DOUBLE AS penalty FROM p")
def _(t: Tables):
    return scorable(t).select("id", R.weight_penalty(F.col("weight_kg"), 2.0).alias("penalty"))


@q("r_05", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 0.04 WHEN 1 THEN 0.08 ELSE 0.0 END::DOUBLE AS bonus FROM part")
def _(t: Tables):
    """A word of one purpose, of both, of none."""
    cpu = F.when(F.col("p_partkey") % 3 == 0, "Apple M3").when(F.col("p_partkey") % 3 == 1, "Core I7").otherwise("Celeron")
    return t.part.select(F.col("p_partkey").alias("id"), R.purpose_bonus(cpu, LIMITS.purpose).alias("bonus"))


@q("r_06", f"WITH {PRODUCTS} SELECT id, ({BRAND})::DOUBLE AS bonus FROM p")
def _(t: Tables):
    return scorable(t).select("id", R.brand_bonus(F.col("brand"), LIMITS.brands).alias("bonus"))


@q("r_07", f"WITH {PRODUCTS}, {NEAR}, {RERANK} SELECT id, final::DOUBLE AS final FROM r")
def _(t: Tables):
    return R.rerank(R.recall(vectors(t), question(t), 1200.0), LIMITS).select("id", "final")


@q("r_08", f"WITH {PRODUCTS}, {NEAR}, {RERANK} SELECT coalesce(max(final) >= 0.33, false) AS viable FROM r")
def _(t: Tables):
    return R.rerank(R.recall(vectors(t), question(t), 1200.0), LIMITS).agg(F.coalesce(F.max("final") >= R.VIABLE, F.lit(False)).alias("viable"))


@q("r_09", f"""WITH {PRODUCTS}, st AS (SELECT * FROM (VALUES (0, NULL, 1000, 1.1::DOUBLE), (1, 'weight_limit', 1000, 1.1 + 0.2::DOUBLE), (2, 'weight_limit', 1000, 1.1 + 0.4::DOUBLE), (3, 'budget', 1500, 1.1), (4, 'budget', 2000, 1.1), (5, 'budget', 2500, 1.1)) v(step, field, b, w)),
nr AS (SELECT st.*, p.id, p.brand, p.weight_kg, round({COS}, 4) AS similarity, row_number() OVER (PARTITION BY step ORDER BY 1 - {COS}, p.id) AS n FROM st JOIN p ON price <= b AND status = 'active' JOIN embeddings e ON e.vec_id = p.id JOIN embeddings z ON z.vec_id = 4),
fin AS (SELECT step, field, id, round(similarity * CASE WHEN weight_kg <= w THEN 1.0 WHEN (weight_kg - w) / w <= 0.20 THEN 0.7 ELSE 0.2 END::DOUBLE + CASE WHEN lower(brand) = 'brand#12' THEN 0.05 ELSE -0.25 END::DOUBLE, 4) AS final FROM nr WHERE n <= 50 AND weight_kg IS NOT NULL)
SELECT id, step, field, final FROM fin WHERE step = (SELECT coalesce(min(step) FILTER (final >= 0.33), 0) FROM fin)""")
def _(t: Tables):
    """The ladder: which step is the first with a viable row, and its rows."""
    return R.relaxed(vectors(t), question(t), R.Constraints(budget=1000.0, weight_limit=1.1, brands=("brand#12",))).select("id", "step", "field", "final")


@q("r_10", f"WITH {PRODUCTS}, {NEAR}, {RERANK} SELECT CASE WHEN max(final) >= 0.53 THEN 'pass' ELSE 'gated' END AS status FROM r")
def _(t: Tables):
    return R.gate(R.rerank(R.recall(vectors(t), question(t), 1200.0), LIMITS)).select("status")


@q("r_11", f"WITH {PRODUCTS}, {NEAR}, {RERANK} SELECT CASE WHEN count(*) FILTER (weight_kg > 2.0) = 0 THEN 'general' ELSE 'weight_limit' END AS bottleneck FROM (SELECT * FROM r ORDER BY final DESC, id LIMIT 10)")
def _(t: Tables):
    return R.bottleneck(R.rerank(R.recall(vectors(t), question(t), 1200.0), LIMITS))


def many(t: Tables):
    """Every twentieth vector as a query, with and without limits, brands and purposes; one in five has no vector."""
    k, none = F.col("vec_id"), F.array().cast("array<string>")
    return t.embeddings.where("vec_id % 20 = 0").select(
        k.cast("bigint").alias("case"), F.when(k % 100 != 60, F.col("embedding")).alias("embedding"), F.when(k % 60 != 0, 500.0 + (k % 7) * 110).alias("budget"), F.when(k % 40 == 0, 1.2).alias("weight_limit"),
        F.when(k % 3 == 0, F.array(F.lit("Programming/Development"))).alias("purposes"), F.when(k % 80 == 0, F.array(F.lit("brand#2"), F.lit("brand#17"))).otherwise(none).alias("brands"),
    )


MANY = f"""{SCORES},
q AS (SELECT CAST(vec_id AS BIGINT) AS c, CASE WHEN vec_id % 100 <> 60 THEN CAST(embedding AS DOUBLE[]) END AS e, CASE WHEN vec_id % 60 <> 0 THEN 500.0::DOUBLE + (vec_id % 7) * 110 END AS b0, CASE WHEN vec_id % 40 = 0 THEN 1.2::DOUBLE END AS w0, vec_id % 3 = 0 AS prog, vec_id % 80 = 0 AS picky FROM embeddings WHERE vec_id % 20 = 0),
st AS (SELECT *, 0 AS step, NULL AS field, CAST(NULL AS DOUBLE) AS original, b0 AS b, w0 AS w, CASE WHEN e IS NULL THEN w0 END AS cap FROM q UNION ALL SELECT q.*, n, 'weight_limit', w0, b0, w0 + 0.2::DOUBLE * n, NULL FROM q, (VALUES (1), (2)) x(n) WHERE w0 IS NOT NULL UNION ALL SELECT q.*, 2 + n, 'budget', b0, b0 + 500.0::DOUBLE * n, w0, NULL FROM q, (VALUES (1), (2), (3)) x(n) WHERE b0 IS NOT NULL),
pe AS (SELECT p.*, CAST(v.embedding AS DOUBLE[]) AS pv FROM p JOIN embeddings v ON v.vec_id = p.id WHERE status = 'active'),
nr AS (SELECT *, row_number() OVER (PARTITION BY c, step ORDER BY CASE WHEN e IS NULL THEN price ELSE d END, id) AS n FROM (SELECT st.*, pe.id, pe.family, lower(pe.brand) AS brand, pe.price, pe.weight_kg, pe.cpu, CASE WHEN e IS NOT NULL THEN round(1 - list_cosine_similarity(pv, e), 9) END AS d FROM st JOIN pe ON (b IS NULL OR price <= b) AND (cap IS NULL OR weight_kg <= cap))),
pen AS (SELECT *, CASE WHEN e IS NULL THEN 0.58::DOUBLE ELSE round(1 - d, 4) END AS similarity, CASE WHEN b IS NULL OR price <= b THEN 1.0 ELSE 0.1 END AS on_price, CASE WHEN w IS NULL OR weight_kg <= w THEN 1.0 WHEN (weight_kg - w) / w <= 0.20 THEN 0.7 ELSE 0.2 END AS on_weight,
 CASE WHEN prog AND (cpu LIKE '%i7%' OR cpu LIKE '%ryzen 5%') THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN NOT picky THEN 0 WHEN brand IN ('brand#2', 'brand#17') THEN 0.05 ELSE -0.25 END::DOUBLE AS bonus FROM nr WHERE n <= 50 AND (w IS NULL OR weight_kg IS NOT NULL)),
fin AS (SELECT *, round(similarity * (on_price::DOUBLE * on_weight::DOUBLE) + bonus, 4) AS final FROM pen),
rk AS (SELECT f.*, row_number() OVER (PARTITION BY f.c ORDER BY final DESC, f.id) AS place FROM fin f JOIN (SELECT c, min(step) AS step FROM fin WHERE final >= 0.33 GROUP BY 1) USING (c, step)),
lg AS (SELECT q.c, q.e IS NULL AS fallback, max(final) AS top_score, coalesce(max(final) >= 0.53, false) AS passed, any_value(field) AS relaxed_field, any_value(original) AS relaxed_from, any_value(CASE field WHEN 'budget' THEN b WHEN 'weight_limit' THEN w END) AS relaxed_to, count(*) FILTER (place <= 10 AND on_weight < 1) AS heavy, count(rk.id) AS n, string_agg(rk.id::VARCHAR, ',' ORDER BY place) AS ids FROM q LEFT JOIN rk USING (c) GROUP BY q.c, q.e IS NULL)"""
SHOWN = ", ".join(f"{{'at': {i}, 'f': '{f}', 'raw': {raw}, 'c': round_even({raw} * {RAW['general_use'][i] / sum(RAW['general_use'])!r}::DOUBLE, 2)}}" for i, (f, raw) in enumerate((f, f"s_{f}" if i < 6 else "50.0::DOUBLE") for i, f in enumerate(FACTORS)))


@q("r_12", f"""{MANY}, sh AS (SELECT rk.*, min(place) OVER (PARTITION BY c, family) AS at_, row_number() OVER (PARTITION BY c, family ORDER BY abs(price - b), place) AS o FROM rk WHERE c IN (SELECT c FROM lg WHERE passed)),
tp AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY at_) AS pos FROM sh WHERE o = 1),
fx AS (SELECT s.id, {_total("general_use")} AS score, [{SHOWN}] AS fs FROM s)
SELECT c AS "case", CAST(pos AS INT) AS place, tp.id, family, similarity, final, step, field, score AS pick_score, CASE WHEN score IS NOT NULL THEN (SELECT string_agg(x.f || ' ' || CAST(round_even(round_even(x.raw, 2), 0) AS INT), ', ' ORDER BY x.c DESC, x.at) FROM (SELECT y AS x FROM (SELECT unnest(fs) AS y) ORDER BY y.c DESC, y.at LIMIT 3)) END AS top_factors, score IS NULL AS no_score
FROM tp JOIN fx ON fx.id = tp.id WHERE pos <= 6""")
def _(t: Tables):
    """The whole search of many queries: shortlists with scores and factors."""
    short, _ = M.search(vectors(t), many(t), scorable(t))
    return short.select("case", "place", "id", "family", "similarity", "final", "step", "field", "pick_score", "top_factors", F.col("unavailable").isNotNull().alias("no_score"))


@q("r_12_log", f"""{MANY} SELECT c AS "case", CASE WHEN passed THEN 'pass' ELSE 'gated' END AS status, top_score, CASE WHEN NOT passed THEN CASE WHEN heavy > 0 THEN 'weight_limit' ELSE 'general' END END AS bottleneck, relaxed_field, relaxed_from, relaxed_to, fallback, CASE WHEN passed THEN n ELSE 0 END AS n_candidates, CASE WHEN passed THEN ids ELSE '' END AS candidates FROM lg""")
def _(t: Tables):
    """The log of the same queries, a row each."""
    _, log = M.search(vectors(t), many(t))
    return log.select("case", "status", "top_score", "bottleneck", "relaxed_field", "relaxed_from", "relaxed_to", "fallback", "n_candidates", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@q("r_14", f"""{MANY}, tr AS (SELECT q.c, v.vec_id AS id, CASE WHEN v.vec_id = q.c THEN 3 WHEN v.label = z.label THEN 1 ELSE 0 END AS rel FROM q JOIN embeddings z ON z.vec_id = q.c JOIN embeddings v ON v.vec_id % 4 = 0),
dc AS (SELECT rk.c, sum(coalesce(rel, 0) / log2(place + 1.0)) AS d FROM rk LEFT JOIN tr ON tr.c = rk.c AND tr.id = rk.id WHERE place <= 10 GROUP BY 1),
im AS (SELECT c, sum(rel / log2(n + 1.0)) AS i FROM (SELECT c, rel, row_number() OVER (PARTITION BY c ORDER BY rel DESC) AS n FROM tr) WHERE n <= 10 GROUP BY 1)
SELECT lg.c AS "case", CASE WHEN passed AND i > 0 THEN round(d / i, 4) ELSE 0.0 END::DOUBLE AS ndcg, CASE WHEN passed THEN 'pass' ELSE 'gated' END AS status, relaxed_field FROM lg LEFT JOIN dc USING (c) LEFT JOIN im USING (c)""")
def _(t: Tables):
    """Ranking quality of the same queries: a query's own product is worth 3, others of its label 1, where a truth is known at all."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").cast("bigint").alias("case"), F.col("label").alias("own"))
    known = t.embeddings.where("vec_id % 4 = 0").select(F.col("vec_id").cast("bigint").alias("id"), "label")
    truth = known.join(F.broadcast(asked)).select("case", "id", F.when(F.col("case") == F.col("id"), 3).when(F.col("own") == F.col("label"), 1).otherwise(0).alias("relevance"))
    return M.evaluate(vectors(t), many(t), truth).select("case", "ndcg", "status", "relaxed_field")
