"""DuckDB SQL of the similarity measures, written from their definitions: the longest common subsequence bit by bit, all pairs, no bounds."""

from __future__ import annotations


def _lcs(a: str, b: str) -> str:
    one, full = "CAST(1 AS HUGEINT)", f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = f"CAST(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN {one} << i ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT)"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) * length({b}) = 0 THEN 0.0 ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


def _partial(a: str, b: str) -> str:
    """a and b are columns of unequal length."""
    s, l = f"(CASE WHEN length({a}) < length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) < length({b}) THEN {b} ELSE {a} END)"  # noqa: E741
    window = f"substr({l}, greatest(0, w) + 1, w + length({s}) - greatest(0, w))"
    return f"list_max(list_transform(range(1 - length({s}), length({l})), lambda w: {_ratio(s, window)}))"


def measures(pairs: str) -> str:
    """WITH entries up to ``fz`` (a, b, ts, wr, r) for the distinct rows (a, b) of a query: token-set ratio, weighted ratio, ratio."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    join = lambda x: f"array_to_string({x}, ' ')"
    return f"""fz0 AS (SELECT DISTINCT a, b FROM ({pairs})),
fz1 AS (SELECT a, b, list_sort({words('a')}) AS ta, list_sort({words('b')}) AS tb FROM fz0),
fz2 AS (SELECT a, b, {join('ta')} AS sa, {join('tb')} AS sb, list_sort(list_distinct(ta)) AS xa, list_sort(list_distinct(tb)) AS xb FROM fz1),
fz3 AS (SELECT *, list_filter(xa, lambda t: list_contains(xb, t)) AS bo, list_filter(xa, lambda t: NOT list_contains(xb, t)) AS oa, list_filter(xb, lambda t: NOT list_contains(xa, t)) AS ob FROM fz2),
fz4 AS (SELECT *, {join("bo")} AS cm, {join('list_concat(bo, oa)')} AS lf, {join('list_concat(bo, ob)')} AS rt, length(a) AS la, length(b) AS lb, greatest(length(a), length(b))::DOUBLE / greatest(1, least(length(a), length(b))) AS longer FROM fz3),
fz5 AS (SELECT *, {_ratio('a', 'b')} AS r, {_ratio('sa', 'sb')} AS srt, CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0.0 WHEN len(bo) > 0 AND (len(oa) = 0 OR len(ob) = 0) THEN 100.0
ELSE greatest({_ratio('lf', 'rt')}, CASE WHEN len(bo) > 0 THEN 200.0::DOUBLE * length(cm) / (length(cm) + least(length(lf), length(rt))) ELSE 0 END) END AS ts FROM fz4),
fz AS (SELECT a, b, r, ts, CASE WHEN la * lb = 0 THEN 0.0 WHEN longer < 1.5 THEN greatest(r, 0.95::DOUBLE * greatest(srt, ts))
ELSE greatest(r, CASE WHEN longer > 8 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END * greatest({_partial('a', 'b')}, 0.95::DOUBLE * CASE WHEN len(bo) > 0 THEN 100.0 ELSE greatest({_partial('sa', 'sb')}, {_partial('lf', 'rt')}) END)) END AS wr FROM fz5)"""
