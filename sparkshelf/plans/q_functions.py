"""Scalar functions applied to the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkshelf.functions import collections as C
from sparkshelf.functions import dates as D
from sparkshelf.functions import text as S
from sparkshelf.functions import vectors as V
from sparkshelf.plans.registry import Registry, Tables

q = Registry()
NAME = "p_name || ' (' || p_brand || ')  ' || CAST(p_size AS VARCHAR) || 'GB'"


def named(t: Tables):
    return t.part.withColumn("s", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")  "), F.col("p_size").cast("string"), F.lit("GB")))



def each(key: str, sql: str, build, source: str, id_col: str) -> None:
    """One expression over one column of a table; the expression is built when the query runs."""

    def run(t: Tables):
        rows = named(t) if source == "part" else getattr(t, source)
        return rows.select(id_col, build().alias("v"))

    q(key, f"SELECT {id_col}, {sql} AS v FROM {source}")(run)


P, EV, PG = ("part", "p_partkey"), ("events", "event_id"), ("pages", "page_id")
each("str_01", f"trim(regexp_replace(lower(split_part({NAME}, '(', 1)), '\\s+', ' ', 'g'))", lambda: S.family_key("s"), *P)


@q("str_02", "SELECT p_partkey, lower(p_name) AS v FROM part")
def _(t: Tables):
    """Product lines of names that go on with a model number, a comma, a dash, a year or a parenthesis; signs outside ASCII vanish."""
    k = F.col("p_partkey") % 6
    rest = F.when(k == 0, " 14abc9 tail").when(k == 1, ", tail 3").when(k == 2, " - tail").when(k == 3, " 2024 tail").when(k == 4, "  (tail)").otherwise("")
    return t.part.select("p_partkey", S.product_line(F.concat(F.upper("p_name"), F.lit("\u00ae \u00e9"), rest)).alias("v"))


each("str_03", "'i7-' || CAST(13000 + p_size AS VARCHAR) || 'h'", lambda: F.concat(F.lit("i7-"), S.cpu_part_key(F.concat(F.lit("Intel Core i7-"), (13000 + F.col("p_size")).cast("string"), F.lit("H")))), *P)
each("str_04", "'rtx ' || CAST(p_size AS VARCHAR)", lambda: S.gpu_key(F.concat(F.lit("NVIDIA GeForce RTX "), F.col("p_size").cast("string"))), *P)
each("str_05", "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) * 2 ELSE CAST(p_size AS BIGINT) * 1024 END", lambda: S.size_gb(F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("GB x 2"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" TB")))), *P)
each("str_06", "regexp_extract(lower(p_brand), '([a-z]+)', 1) || ':' || regexp_extract(p_brand, '([0-9]+)', 1)", lambda: F.concat_ws(":", F.regexp_extract(F.lower("p_brand"), "([a-z]+)", 1), F.regexp_extract("p_brand", "([0-9]+)", 1)), *P)
each("str_07", "regexp_replace(upper(trim(' ' || p_name || 'wp ')), 'WP$', 'W')", lambda: S.sku_key(F.concat(F.lit(" "), "p_name", F.lit("wp "))), *P)
each("str_08", f"list_contains(string_split_regex(lower({NAME}), '[^a-z0-9]'), 'blue')", lambda: S.has_code("s", F.lit("BLUE")), *P)
each("str_09", "CASE WHEN lower(p_type) LIKE '%a%' THEN 'oled' ELSE 'other' END", lambda: S.panel_kind(F.when(F.lower("p_type").contains("a"), F.concat("p_type", F.lit(" OLED"))).otherwise(F.col("p_type"))), *P)
each("str_10", "'AB' || CAST(100 + p_size AS VARCHAR) || ',' || 'X' || CAST(1000 + p_size AS VARCHAR) || 'Z'", lambda: F.array_join(S.base_codes(F.concat(F.lit("ab"), (100 + F.col("p_size")).cast("string"), F.lit(" and X"), (1000 + F.col("p_size")).cast("string"), F.lit("z, ab"), (100 + F.col("p_size")).cast("string"))), ","), *P)
each("str_12", "'https://shop.example/?q=' || replace(trim(p_name), ' ', '+')", lambda: S.search_link("https://shop.example/?q=", S.search_text("p_name")), *P)
each("str_13", "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') || '/' || lower(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '\\.[a-z]+$', ''))", lambda: S.page_key("url"), *PG)
each("str_14", "p_brand", lambda: S.strip_marks(F.concat("p_brand", F.lit("™"))), *P)
each("str_15", "CASE WHEN p_size % 2 = 0 THEN p_name || ' Z9' ELSE p_name END", lambda: S.replace_invented(F.concat("p_name", F.lit(" Z9")), F.lit("Z9"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Z9"))).otherwise(F.array(F.lit("Z8")))), *P)
each("str_16", "p_size * 1000.0::DOUBLE", lambda: S.price_of(F.concat(F.lit("RM "), F.format_number(F.col("p_size") * 1000, 2))), *P)
each("str_17", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END", lambda: F.size(S.ungrounded(S.figures(F.concat(F.lit("it costs RM2,000 or RM"), (F.col("p_size") * 100).cast("string"))), F.array(F.lit(2000.5), F.when(F.col("p_size") > 25, 0.0).otherwise(F.col("p_size") * 100.0)))), *P)
each("str_18", "CAST(len(regexp_extract_all(url || ' ' || url, 'https?://[^\\s]+')) AS INT)", lambda: F.size(S.links(F.concat("url", F.lit(" "), "url"))), *PG)
each("str_19", "CASE WHEN regexp_matches(html, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END", lambda: S.script("html"), *PG)
each("str_20", "CASE WHEN length(html) > 60 THEN left(html, 60) || '…' ELSE html END", lambda: S.truncate("html"), *PG)
each("str_21", "CASE WHEN p_size % 2 = 0 THEN 'a_big' ELSE 'a_s,b_s' END", lambda: F.array_join(S.images_of_size(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a_big"), F.lit("b_s"))).otherwise(F.array(F.lit("a_s"), F.lit("b_s"))), "_big"), ","), *P)
each("str_22", "CASE WHEN p_size % 2 = 0 THEN '/configure?ram=' || CAST(p_size AS VARCHAR) || '&ssd=1' ELSE '/configure?ssd=1' END", lambda: S.config_path("/configure", [("ram", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))), ("ssd", F.lit("1"))]), *P)
each("str_23", "p_name", lambda: S.answer(F.concat(F.lit(" other ("), "p_name", F.lit(")")))[1], *P)
each("str_24", "'x' || CAST(10 + p_size AS VARCHAR)", lambda: F.array_join(S.probe_tokens(F.concat(F.lit("Zen X"), (10 + F.col("p_size")).cast("string"), F.lit(" a1 pro"))), ","), *P)
each("str_27", "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || 'TB' ELSE CAST(p_size AS VARCHAR) || 'GB' END", lambda: S.storage_label(F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1024).otherwise(F.col("p_size"))), *P)
each("str_28", "p_brand", lambda: S.block_under(F.concat(F.lit("Name\nfoo\n\nMemory\n"), "p_brand", F.lit("\n\nPorts\nx")), "memory"), *P)
each("str_29", "CASE WHEN p_size % 2 = 0 THEN p_brand END", lambda: S.only_value(F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand", "p_name")))[0], *P)
each("str_30", "2", lambda: F.size(S.sections(F.concat("p_name", F.lit("\n\n \n\n"), "p_brand"))), *P)
each("str_31", "'up to RM' || CAST(p_size AS VARCHAR) || '; cpu > gpu'", lambda: S.profile_text(F.lit(None).cast("double"), F.col("p_size").cast("double"), F.array(F.lit("cpu"), F.lit("gpu"))), *P)
each("str_32", "CASE p_size % 3 WHEN 0 THEN 'handle' WHEN 1 THEN 'id' END", lambda: S.channel_kind(F.when(F.col("p_size") % 3 == 0, "https://www.youtube.com/@a").when(F.col("p_size") % 3 == 1, "https://youtube.com/channel/UC1").otherwise("https://x.org")), *P)

each("dt_01", "ts", lambda: D.utc("ts"), *EV)
each("dt_02", "CAST(ts + INTERVAL 8 HOUR AS DATE)", lambda: D.local_day("ts"), *EV)
each("dt_03", "date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC'", lambda: D.quota_day_start("ts"), *EV)
each("dt_04", "date_trunc('second', ts)", lambda: D.parse_iso(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), *EV)
each("dt_05", "CAST(ts AS DATE)", lambda: D.utc_date("ts"), *EV)
each("dt_06", "CAST(len(generate_series(date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS INT)", lambda: F.size(D.day_spine(F.to_date("ts"), F.date_add(F.to_date("ts"), 6))), *EV)
each("dt_07", "date_trunc('second', ts) + to_seconds(CAST(event_id * 2 + 5 AS BIGINT))", lambda: D.eta(F.date_trunc("second", "ts"), "event_id", 2.0), *EV)
each("dt_08", "epoch_us(ts) - epoch_us(date_trunc('day', ts)) <= 21600000000", lambda: D.within("ts", F.date_trunc("day", "ts"), 6), *EV)

each("ma_01", "CAST(greatest(10, least(40, p_size)) AS DOUBLE)", lambda: C.clamp(F.col("p_size").cast("double"), 10.0, 40.0), *P)
q("ma_02", "SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS v FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.reverse("embedding")), 6).alias("v")))
each("ma_03", "round(p_size / log2(p_size + 2), 6)", lambda: F.round(F.col("p_size") / F.log2(F.col("p_size") + 2), 6), *P)
each("ma_04", "CASE WHEN p_size % 5 <> 0 THEN round((p_retailprice - p_size % 5) / (p_size % 5) * 100, 4) END", lambda: F.round(C.percent_change(F.col("p_size") % 5, F.col("p_retailprice")), 4), *P)
q("ma_05", "SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS v FROM part GROUP BY 1")(lambda t: t.part.groupBy("p_brand").agg(F.percentile("p_retailprice", F.lit(0.25)).alias("v")))
each("ma_06", "round(ln(1 + p_size), 6)", lambda: F.round(F.log1p("p_size"), 6), *P)
each("ma_07", "(p_size - 1) / 49.0::DOUBLE * 100", lambda: C.minmax(F.col("p_size").cast("double"), F.lit(1.0), F.lit(50.0)), *P)

WORDS = "string_split(p_name || ' ' || p_type || ' ' || p_name, ' ')"


def words_col():
    return F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")


each("ar_01", f"{WORDS}[1]", lambda: C.first_or_null(words_col()), *P)
each("ar_02", f"array_to_string(list_distinct(list_sort({WORDS})), ',') IS NOT NULL", lambda: F.array_join(F.array_distinct(words_col()), ",").isNotNull(), *P)
each("ar_03", f"CAST(least(4, len({WORDS}) + 1) AS INT)", lambda: F.size(C.append_bounded(words_col(), F.lit("x"), 4)), *P)
q("ar_04", f"SELECT p_partkey, unnest({WORDS}) AS v FROM part")(lambda t: t.part.select("p_partkey", F.explode(words_col()).alias("v")))
each("ar_05", f"list_contains({WORDS}, 'blue') OR list_has_any({WORDS}, ['green', 'STEEL'])", lambda: F.array_contains(words_col(), "blue") | F.arrays_overlap(words_col(), F.array(F.lit("green"), F.lit("STEEL"))), *P)
each("ar_06", f"array_to_string(list_sort({WORDS})[1:2], ',')", lambda: F.array_join(F.slice(F.array_sort(words_col()), 1, 2), ","), *P)
q("ar_07", "SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS v FROM part GROUP BY 1")(
    lambda t: t.part.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_size", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("v")))
q("ar_08", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS v FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 5).alias("v")))
each("ar_09", "CAST(len(list_filter([5, 10, 10, 20, 40], lambda x: x <= p_size)) AS INT)", lambda: C.bisect_right(F.array(*map(F.lit, (5, 10, 10, 20, 40))), F.col("p_size")), *P)


def weights_map():
    return F.create_map(F.lit("cpu"), F.col("p_size") * 1.0, F.lit("gpu"), 50.0 - F.col("p_size"), F.lit(" RAM size"), F.lit(25.0))


each("mp_01", "CASE WHEN p_size % 2 = 0 THEN p_size * 1.0::DOUBLE ELSE 1.0::DOUBLE END", lambda: C.get_or(weights_map(), F.when(F.col("p_size") % 2 == 0, "cpu").otherwise("none"), 1.0), *P)
each("mp_02", "CAST(least(30, greatest(p_size, 20)) AS DOUBLE)", lambda: C.max_merge(F.array(weights_map(), F.create_map(F.lit("cpu"), F.lit(20.0))), 30.0)["cpu"], *P)
each("mp_03", "round(p_size / 75.0::DOUBLE, 6)", lambda: F.round(C.normalised(weights_map())["cpu"], 6), *P)
each("mp_04", "CASE WHEN p_size > 25 THEN 'cpu' WHEN p_size < 25 THEN 'gpu' ELSE ' RAM size' END", lambda: C.ranked_keys(weights_map())[0], *P)
each("mp_05", "25.0::DOUBLE", lambda: C.folded_lookup(weights_map(), "memory", "ram Size"), *P)
each("mp_06", "CASE WHEN p_size = 25 THEN ' RAM size,cpu,gpu' ELSE ' RAM size' END", lambda: F.array_join(C.inverted(weights_map())[F.lit(25.0)], ","), *P)

each("js_01", "json_extract_string(props, '$.k')", lambda: C.json_first("props", "$.none", "$.k"), *EV)
each("js_02", "3", lambda: C.json_size(F.lit("[1, 2, 3]")), *EV)
each("js_03", "CAST(json_extract_string(props, '$.k') AS INT) > 50", lambda: F.variant_get(F.parse_json(F.concat(F.lit('{"f": '), (F.get_json_object("props", "$.k").cast("int") > 50).cast("string"), F.lit("}"))), "$.f", "boolean"), *EV)
each("js_04", "left('{\"id\":' || CAST(event_id AS VARCHAR) || ',\"kind\":\"' || event_type || '\"}', 12)", lambda: S.preview(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))), 12), *EV)
each("js_05", "true", lambda: C.json_equal(F.concat(F.lit('{"a": 1, "b": "'), "event_type", F.lit('"}')), F.concat(F.lit('{"b":"'), "event_type", F.lit('","a":1}'))), *EV)
each("js_06", "CAST(event_id AS BIGINT)", lambda: C.json_tolerant(F.concat(F.lit("```json\n{\"id\": "), F.col("event_id").cast("string"), F.lit("}\n```")), "id bigint")["id"], *EV)
each("js_07", "CAST(event_id AS BIGINT)", lambda: C.json_after(F.concat(F.lit("<script>window.x = {\"id\": "), F.col("event_id").cast("string"), F.lit("};</script>")), "window.x =", "id bigint")["id"], *EV)
