"""Arrays, maps, JSON and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old.isNotNull() & (old != 0), (new - old) / old * 100.0)


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (x - low) / (high - low) * 100.0).otherwise(50.0)


def first_or_null(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def append_bounded(a: Column, x: Column, most: int = 50) -> Column:
    """The array with x at its end, while it has fewer than ``most`` elements."""
    return F.slice(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.array(x)), 1, most)


def bisect_left(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v < x))


def bisect_right(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x))


def get_or(m: Column, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def max_merge(maps: Column, cap: float) -> Column:
    """One map with the greatest value of each key over an array of maps, at most cap."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    best = lambda k: F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.least(best(k), F.lit(cap))))


def normalised(m: Column) -> Column:
    """Values divided by their sum."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(m, lambda _, v: v / total)


def ranked_keys(m: Column) -> Column:
    """Keys by falling value, equal ones by key."""
    order = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.transform(F.array_sort(order), lambda e: e["k"])


def folded_lookup(m: Column, *names: str) -> Column:
    """The first of the names that the map has, whatever the case and spaces of its keys."""
    folded = F.transform(F.map_entries(m), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), r"\s+", "").alias("k"), e["value"].alias("v")))
    one = lambda n: F.try_element_at(F.filter(folded, lambda e: e["k"] == n), F.lit(1))["v"]
    return F.coalesce(*[one("".join(n.lower().split())) for n in names])


def inverted(m: Column) -> Column:
    """value -> sorted keys."""
    entries = F.map_entries(m)
    values = F.array_sort(F.array_distinct(F.map_values(m)))
    return F.map_from_arrays(values, F.transform(values, lambda v: F.array_sort(F.transform(F.filter(entries, lambda e: e["value"] == v), lambda e: e["key"]))))


def json_first(doc: str | Column, *paths: str) -> Column:
    """The first path with a value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(doc, p)), F.lit("")) for p in paths])


def json_size(doc: Column) -> Column:
    return F.coalesce(F.json_array_length(doc), F.lit(0))


def json_equal(a: Column, b: Column) -> Column:
    """Equal as documents: key order and spacing do not matter."""
    return F.to_json(F.from_json(a, "map<string,string>")).eqNullSafe(F.to_json(F.from_json(b, "map<string,string>"))) | (F.sort_array(F.map_entries(F.from_json(a, "map<string,string>"))) == F.sort_array(F.map_entries(F.from_json(b, "map<string,string>"))))


def json_tolerant(text: Column, schema: str) -> Column:
    """A struct from text that may stand in code fences; null where it is no JSON."""
    return F.from_json(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", ""), schema)


def json_after(page: Column, marker: str, schema: str) -> Column:
    """The object that follows a marker in a page."""
    return F.from_json(F.regexp_extract(page, rf"(?s)\Q{marker}\E\s*(\{{.*?\}})\s*(?:;|</script>|$)", 1), schema)
