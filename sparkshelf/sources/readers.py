"""Readers: tables, HTML benchmark tables, uploaded pages, configurator responses, price-list words, caption tracks, JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_PAGE_BYTES = 8 * 1024 * 1024


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c: Column) -> Column:
    """Text of a piece of markup, with the commonest references decoded and single spaces."""
    s = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(ref), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def benchmark_table(pages: DataFrame, html: str, table_id: str = "cputable") -> DataFrame:
    """(name, mark) of every row of the table with this id in every page; rows with fewer than two cells or a mark that is no number are
    left out."""
    body = F.regexp_extract(_c(html), rf"(?is)<table[^>]*\bid\s*=\s*[\"']?{table_id}[\"']?[^>]*>(.*?)</table>", 1)
    rows = pages.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = rows.select(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)(?=</td>|<td|$)"), F.lit(1)).alias("cells")).where("size(cells) >= 2")
    mark = F.replace(strip_tags(F.col("cells")[1]), F.lit(","), F.lit(""))
    return cells.select(strip_tags(F.col("cells")[0]).alias("name"), mark.alias("m")).where(F.col("m").rlike(r"^\d+$")).select("name", F.col("m").cast("bigint").alias("mark"))


def at_least(df: DataFrame, n: int, what: str = "source") -> DataFrame:
    """df, or an error when it is read if it has fewer than n rows: a page that is no table must not replace one."""
    enough = df.agg(F.count(F.lit(1)).alias("__n")).select(F.assert_true(F.col("__n") >= n, F.lit(f"{what}: fewer than {n} rows")).alias("__ok"))
    return df.join(F.broadcast(enough), F.coalesce(F.col("__ok").isNull(), F.lit(True))).drop("__ok")


def freshness(c: str | Column) -> Column:
    """The sentence that says when a source was last updated, or null."""
    return F.nullif(F.trim(F.regexp_extract(_c(c), r"(Last updated on the [^<.]*)", 1)), F.lit(""))


def paged_items(pages: DataFrame, body: str, page: str, schema: str, dropped: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Items of a paged API's bodies (JSON with ``items``), in page order up to the first short page, of other classes than the dropped ones; each
    URL once. schema: of an item, with url and kind."""
    parsed = pages.select(page, F.from_json(_c(body), f"items array<struct<{schema}>>")["items"].alias("items"))
    if size is not None:
        short = parsed.where(F.coalesce(F.size("items"), F.lit(0)) < size).agg(F.min(page).alias("__last"))
        parsed = parsed.join(F.broadcast(short)).where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")
    rows = parsed.select(page, F.posexplode("items").alias("__i", "item")).where(~F.coalesce(F.col("item.kind").isin(list(dropped)), F.lit(False)))
    first = Window.partitionBy("item.url").orderBy(page, "__i")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("item.*")


def spec_pairs(c: str | Column) -> Column:
    """label -> value of a specification page's definition lists and two-cell rows."""
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(_c(c), F.lit(p), F.lit(1)).alias("k"), F.regexp_extract_all(_c(c), F.lit(p), F.lit(2)).alias("v"))
    found = F.concat(pairs(r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"), pairs(r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>\s*</tr>"))
    clean = F.transform(found, lambda p: F.struct(strip_tags(p["k"]).alias("key"), strip_tags(p["v"]).alias("value")))
    first = F.aggregate(clean, F.array().cast("array<struct<key:string,value:string>>"), lambda a, p: F.when(F.exists(a, lambda x: x["key"] == p["key"]), a).otherwise(F.concat(a, F.array(p))))
    return F.map_from_entries(first)


def uploaded_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, canonical_url) of uploaded files up to 8 MB: UTF-8, else Windows-1252; the URL from link rel=canonical, else og:url."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_PAGE_BYTES)
    utf8 = F.col("content").cast("string")
    high = bytes(range(0x80, 0xA0))
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in high]
    western = F.decode("content", "iso-8859-1")  # and the places where Windows-1252 differs from it
    western = F.translate(western, "".join(a for a, c in pairs if c), "".join(c for _, c in pairs if c))
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(western)
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("html")).withColumn("canonical_url", canonical_url("html"))


def canonical_url(c: str | Column) -> Column:
    tag = lambda p: F.regexp_extract(_c(c), p, 1)
    link = F.regexp_extract(tag(r"(?is)(<link[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>)"), r"(?is)\bhref\s*=\s*[\"']([^\"']*)", 1)
    meta = F.regexp_extract(tag(r"(?is)(<meta[^>]*\bproperty\s*=\s*[\"']?og:url[\"']?[^>]*>)"), r"(?is)\bcontent\s*=\s*[\"']([^\"']*)", 1)
    return F.coalesce(F.nullif(F.trim(link), F.lit("")), F.nullif(F.trim(meta), F.lit("")))


def configurator(responses: DataFrame, body: str) -> DataFrame:
    """Options of configurator responses: (chip, kit_price, option_group, value, add_on, is_included, is_blocked). A group must have exactly one
    selected option, and prices for all of its options or none; anything else is an error."""
    option = "struct<isSelected:boolean,isBlocked:boolean,priceDelta:double>"
    parsed = responses.select(F.from_json(_c(body), f"body struct<options:map<string,struct<compatibleOptions:map<string,{option}>>>,selectedKits:struct<priceData:struct<amount:double>>>")["body"].alias("b"))
    pick = lambda m: F.filter(F.map_entries(m), lambda e: e["value"]["isSelected"])
    chip = pick(F.col("b.options")["chip"]["compatibleOptions"])[0]["key"]
    groups = parsed.select(chip.alias("chip"), F.col("b.selectedKits.priceData.amount").alias("kit_price"), F.explode("b.options").alias("option_group", "o")).where("option_group <> 'chip'")
    v = F.map_entries("o.compatibleOptions")
    chosen = F.filter(v, lambda e: e["value"]["isSelected"])
    priced = F.size(F.filter(v, lambda e: e["value"]["priceDelta"].isNotNull()))
    ok = F.col("chip").isNotNull() & (F.size(chosen) == 1) & ((priced == 0) | (priced == F.size(v)))
    said = F.raise_error(F.concat(F.lit("unexpected options in "), "option_group"))
    one = groups.select("chip", "kit_price", "option_group", F.when(F.coalesce(ok, F.lit(False)), v).otherwise(said.cast(groups.select(v).dtypes[0][1])).alias("v"), chosen.alias("c"))
    each = one.select("chip", "kit_price", "option_group", F.try_element_at("c", F.lit(1)).alias("s"), F.explode("v").alias("e"))
    return each.select(
        "chip", "kit_price", "option_group", F.col("e.key").alias("value"), F.round(F.col("e.value.priceDelta") - F.col("s.value.priceDelta"), 2).alias("add_on"),
        (F.col("e.key") == F.col("s.key")).alias("is_included"), F.coalesce("e.value.isBlocked", F.lit(False)).alias("is_blocked"))


def price_rows(words: DataFrame, reach: float = 60.0, line: float = 3.0) -> DataFrame:
    """(sku, price, page) from positioned words (page, text, x0, x1, top) of a price list: a SKU takes the nearest price below it within ``reach``
    points across; prices are ``RM1,234``, or ``RM`` and a number on one line. The first priced page of a SKU wins. Pages are small, so
    words meet inside their page only."""
    money = r"^(?:RM)?(\d{1,3}(?:,\d{3})+|\d{4,})$"
    after = Window.partitionBy("page", F.floor(F.col("top") / line)).orderBy("x0")
    w = words.withColumn("__prev", F.lag("text").over(after)).withColumn("__gap", F.col("x0") - F.lag("x1").over(after))
    whole = F.col("text").rlike(r"^RM\d[\d,]*$")
    split = F.col("text").rlike(money) & (F.col("__prev") == "RM") & (F.col("__gap") < 8)
    prices = w.where(whole | split).select("page", F.regexp_replace(F.regexp_replace("text", "RM|,", ""), r"\..*", "").cast("double").alias("price"), F.col("x0").alias("px"), F.col("top").alias("ptop"))
    skus = words.where(F.col("text").rlike(r"^[A-Z]{1,3}\d{3,4}[A-Z0-9]*-[A-Z0-9]+$")).select("page", F.col("text").alias("sku"), "x0", "top")
    met = skus.join(prices, "page").where((F.col("ptop") > F.col("top")) & (F.abs(F.col("px") - F.col("x0")) <= reach))
    near = met.groupBy("page", "sku").agg(F.min(F.struct((F.col("ptop") - F.col("top")).alias("d"), F.abs(F.col("px") - F.col("x0")).alias("a"), "price")).alias("b"))
    all_ = skus.select("page", "sku").distinct().join(near.select("page", "sku", "b.price"), ["page", "sku"], "left")
    first = Window.partitionBy("sku").orderBy(F.col("price").isNull(), "page")
    return all_.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("sku", "price", "page")


def caption_track(tracks: DataFrame, video: str = "video_id") -> DataFrame:
    """The best caption track of each video: English, then Chinese, then any; manual before generated; then in listed order."""
    family = F.lower(F.split_part("language", F.lit("-"), F.lit(1)))
    rank = F.when(family == "en", 0).when(family == "zh", 1).otherwise(2)
    w = Window.partitionBy(video).orderBy(rank, "is_generated", "position")
    return tracks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def failure_kind(c: str | Column) -> Column:
    """terminal for what a retry can't cure."""
    return F.when(_c(c).isNull(), None).when(F.lower(_c(c)).rlike("disabled|unavailable|private|removed|no transcript"), "terminal").otherwise("retryable")


#: Terms of accessories, wherever they stand in a title; the least price of a product; the least similarity to the query.
ACCESSORY_TERMS = (
    "skin", "wrap", "cover", "sleeve", "case", "bag", "pouch",
    "battery", "charger", "adapter", "cable", "dock", "stand",
    "protector", "keyboard cover", "hinge", "replacement", "sticker",
)


def listings(df: DataFrame, title: str, price: str, query: Column, floor: float = 800.0, relevance: float = 60.0) -> DataFrame:
    """Live listings that are products: priced at floor or more, no accessory, similar to the query."""
    from sparkshelf.functions.similarity import token_set

    kept = df.where((F.col(price) >= floor) & ~F.lower(title).rlike("|".join(ACCESSORY_TERMS)))
    return kept.withColumn("relevance", token_set(F.lower(title), F.lower(query))).where(F.col("relevance") >= relevance)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def reader_for(registry: dict[str, Callable], brand: str) -> Callable:
    """The reader of a brand; an unknown brand is an error that lists the known ones."""
    if brand not in registry:
        raise ValueError(f"no reader for {brand!r}; there are {sorted(registry)}")
    return registry[brand]
