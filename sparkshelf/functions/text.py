"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def lower_each(c: str | Column) -> Column:
    """Lower case code point by code point, as in DuckDB; ``lower`` makes two of a dotted capital i and looks at a sigma's place in its word."""
    return F.lower(F.translate(_c(c), "\u0130\u03a3", "i\u03c3"))


def family_key(c: str | Column) -> Column:
    """The text before the first parenthesis, lower case, single spaces."""
    return squeeze(F.lower(F.split_part(_c(c), F.lit("("), F.lit(1))))


LINE_ENDS = r"(\(|\b\d{2}[a-z]{2,}\d*|\b(?:20\d\d)\b|,| - )"


def product_line(c: str | Column, ends: str = LINE_ENDS) -> Column:
    """ASCII, lower case, up to the first token that ends a product line's name."""
    s = F.lower(F.regexp_replace(_c(c), r"[^\x00-\x7F]", ""))
    return squeeze(F.regexp_extract(s, rf"^(.*?)(?:{ends}|$)", 1))


def cpu_part_key(c: str | Column) -> Column:
    """The last token with a model number, else the cleaned name."""
    s = squeeze(F.regexp_replace(F.lower(_c(c)), r"[^\x00-\x7F]|\(.*?\)", " "))
    found = F.regexp_extract_all(s, F.lit(r"\b([a-z]*\d{3,}[a-z]*\d*)\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), s)


def gpu_key(c: str | Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(_c(c)), r"\b(nvidia|amd|intel|geforce|radeon|graphics)\b", " "))


def size_gb(c: str | Column) -> Column:
    """``16GB x 2``, ``1 TB``, ``512``: gigabytes; a terabyte is 1024, and a round thousand means a multiple of 1024."""
    s = F.lower(_c(c))
    n = F.try_to_number(F.nullif(F.regexp_extract(s, r"(\d+)\s*(?:tb|gb)?", 1), F.lit("")), F.lit("99999999")).cast("long")
    times = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, r"x\s*(\d+)", 1), F.lit("")), F.lit("9999")).cast("long"), F.lit(1))
    gb = F.when(s.rlike(r"\d\s*tb"), n * 1024).otherwise(F.when((n >= 1000) & (n % 1000 == 0), F.floor(n / 1000) * 1024).otherwise(n))
    return (gb * times).cast("long")


def inches(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(c), r"(\d{2}(?:\.\d)?)\s*(?:\"|inch|in\b)", 1), F.lit("")).cast("double")


def sku_key(c: str | Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(c))), "WP$", "W")


def has_code(text: str | Column, code: str | Column) -> Column:
    """The code stands in the text as a whole token, whatever the case."""
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), _c(code), F.lit(r"\E(?![A-Za-z0-9])"))
    return F.regexp_like(_c(text), pattern)


def panel_kind(c: str | Column) -> Column:
    s = F.lower(_c(c))
    return F.when(s.isNull() | (F.trim(s) == ""), None).when(s.contains("oled"), "oled").otherwise("other")


def base_codes(c: str | Column) -> Column:
    """The distinct letter-digit codes of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(_c(c)), F.lit(r"\b([A-Z]{1,3}\d{3,5}[A-Z]{0,3})\b"), F.lit(1)))


def search_text(*parts: str | Column) -> Column:
    return squeeze(F.regexp_replace(F.concat_ws(" ", *map(_c, parts)), r"\([^)]*\)|[^A-Za-z0-9. ]", " "))


def search_link(base: str, text: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(text))


def host(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(_c(c), r"://([^/?#]*)", 1)), r"^www\.", "")


def slug(c: str | Column) -> Column:
    """The last path segment, without extension, lower case."""
    path = F.regexp_replace(F.regexp_extract(_c(c), r"://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[a-z]+$", ""))


def page_key(c: str | Column) -> Column:
    return F.concat_ws("/", host(c), slug(c))


def strip_marks(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), "[®™©℠]", "")


def has_superscript(c: str | Column) -> Column:
    return _c(c).rlike("[⁰¹²³⁴⁵⁶⁷⁸⁹]")


def replace_invented(text: str | Column, code: str | Column, known: Column) -> Column:
    """Drops a code from a text unless it is among the known ones."""
    return F.when(F.array_contains(known, _c(code)), _c(text)).otherwise(squeeze(F.replace(_c(text), _c(code), F.lit(""))))


def price_of(c: str | Column) -> Column:
    """``RM 4,999.00`` -> 4999.0; null without a number."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(c), r"(\d[\d,]*(?:\.\d+)?)", 1), ",", ""), F.lit("")).cast("double")


def figures(c: str | Column) -> Column:
    """All money figures of a text as doubles, in order."""
    found = F.regexp_extract_all(_c(c), F.lit(r"(?:RM|\$)\s*(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("double"))


def ungrounded(stated: Column, grounded: Column, least: float = 1000.0) -> Column:
    """Stated figures of at least ``least`` that no grounded figure is within 1 of."""
    return F.filter(stated, lambda x: (x >= least) & ~F.exists(grounded, lambda g: F.abs(g - x) <= 1))


def links(c: str | Column) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"(https?://[^\s<>\"')]+)"), F.lit(1))


def script(c: str | Column) -> Column:
    """zh if a text holds any Han letter, else en; null for null."""
    return F.when(_c(c).isNull(), None).when(_c(c).rlike(r"\p{IsHan}"), "zh").otherwise("en")


def truncate(c: str | Column, n: int = 60) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.left(_c(c), F.lit(n)), F.lit("…"))).otherwise(_c(c))


def preview(c: str | Column, n: int = 2000) -> Column:
    return F.left(_c(c), F.lit(n))


def images_of_size(urls: Column, token: str) -> Column:
    """The URLs that hold the token, or all of them if none does."""
    hit = F.filter(urls, lambda u: u.contains(token))
    return F.when(F.size(hit) == 0, urls).otherwise(hit)


def config_path(base: str, params: list[tuple[str, Column]]) -> Column:
    """A path with its parameters in fixed order; null ones vanish."""
    return F.concat_ws("?", F.lit(base), F.nullif(F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params]), F.lit("")))


def answer(c: str | Column) -> tuple[Column, Column]:
    """``OTHER (name)`` -> (OTHER, name); the name is null without parentheses."""
    s = F.trim(_c(c))
    return F.upper(F.regexp_extract(s, r"^([A-Za-z_]+)", 1)), F.nullif(F.regexp_extract(s, r"\(([^)]*)\)", 1), F.lit(""))


def probe_tokens(c: str | Column) -> Column:
    """Tokens with a digit, three characters or longer."""
    return F.filter(F.split(F.lower(_c(c)), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & t.rlike("[0-9]"))


def storage_label(gb: str | Column) -> Column:
    return F.when(_c(gb) % 1024 == 0, F.concat((_c(gb) / 1024).cast("int").cast("string"), F.lit("TB"))).otherwise(F.concat(_c(gb).cast("string"), F.lit("GB")))


def short_label(c: str | Column) -> Column:
    return squeeze(F.regexp_replace(_c(c), r"(?i)\b(intel|amd|nvidia|qualcomm|core|processor)\b|[®™]", " "))


def block_under(text: str | Column, heading: str) -> Column:
    """The lines under a heading up to the next blank line; null if the heading does not occur."""
    found = F.regexp_extract(_c(text), rf"(?im)^\s*\Q{heading}\E\s*\n((?:[^\n]*\S[^\n]*\n?)*)", 1)
    return F.when(_c(text).rlike(rf"(?im)^\s*\Q{heading}\E\s*$"), F.regexp_replace(found, r"^\s+|\s+$", ""))


def only_value(values: Column) -> tuple[Column, Column]:
    """(value, failure): the one distinct value, or why there is none: missing or several."""
    d = F.array_distinct(values)
    return F.when(F.size(d) == 1, d[0]), F.when(F.coalesce(F.size(d), F.lit(0)) == 0, "missing").when(F.size(d) > 1, "several")


def sections(text: str | Column, mark: str = r"\n\s*\n") -> Column:
    return F.filter(F.split(_c(text), mark), lambda s: F.trim(s) != "")


def profile_text(budget_low: Column, budget_high: Column, ranked: Column) -> Column:
    """A budget phrase and ranked priorities."""
    money = lambda c: F.concat(F.lit("RM"), c.cast("long").cast("string"))
    phrase = F.when(budget_low.isNotNull() & budget_high.isNotNull(), F.concat(money(budget_low), F.lit(" to "), money(budget_high)))
    phrase = phrase.when(budget_high.isNotNull(), F.concat(F.lit("up to "), money(budget_high))).when(budget_low.isNotNull(), F.concat(F.lit("from "), money(budget_low)))
    return F.concat_ws("; ", phrase, F.nullif(F.array_join(ranked, " > "), F.lit("")))


def channel_kind(c: str | Column) -> Column:
    """handle, id, user or custom by the form of a channel URL; null if it is none."""
    path = F.regexp_extract(_c(c), r"youtube\.com/([^?#]*)", 1)
    return F.when(path.startswith("@"), "handle").when(path.startswith("channel/"), "id").when(path.startswith("user/"), "user").when(path.startswith("c/"), "custom")
