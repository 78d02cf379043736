"""Allow-listed listings: filters, search, sorting, paging. All are plain column expressions, so that Catalyst pushes them into
the scan; conditions that a caller leaves out add nothing to the plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 50, 1000


def apply_filters(df: DataFrame, filters: Mapping[str, object], allowed: Mapping[str, str | Column]) -> DataFrame:
    """Equality, or membership for a list. None and an empty list mean that nothing was asked; False and 0 are values. A field that is not
    allowed is an error."""
    for field, value in filters.items():
        if field not in allowed:
            raise ValueError(f"cannot filter by {field}")
        column = allowed[field]
        column = F.col(column) if isinstance(column, str) else column
        if value is None:
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            if value:
                df = df.where(column.isin(list(value)))
        else:
            df = df.where(column == F.lit(value))
    return df


def apply_range(df: DataFrame, column: str | Column, low=None, high=None) -> DataFrame:
    """Both bounds inclusive, either may be missing; nulls fall out of a bounded range."""
    column = F.col(column) if isinstance(column, str) else column
    if low is not None:
        df = df.where(column >= F.lit(low))
    if high is not None:
        df = df.where(column <= F.lit(high))
    return df


def apply_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    values = list(values)
    return df.where(F.col(column).isin(values)) if values else df


def apply_search(df: DataFrame, term: str | None, columns: Iterable[str]) -> DataFrame:
    """Any column contains the term, whatever the case; % and _ in the term stay wildcards."""
    if not term:
        return df
    return df.where(reduce(or_, (F.col(c).ilike(f"%{term}%") for c in columns)))


def apply_known(df: DataFrame, column: str, known: bool | None) -> DataFrame:
    """True: not null; False: null; None: all."""
    if known is None:
        return df
    return df.where(F.col(column).isNotNull() if known else F.col(column).isNull())


def apply_sort(df: DataFrame, by: str | None, allowed: Mapping[str, str | Column], default: str, tiebreak: str, descending: bool = False) -> DataFrame:
    """Orders by an allowed key, ties by an ascending unique column."""
    name = by or default
    if name not in allowed:
        raise ValueError(f"cannot sort by {name}")
    key = allowed[name]
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(key.desc() if descending else key.asc(), F.col(tiebreak).asc())


def paginate(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of a totally ordered frame."""
    limit = DEFAULT_LIMIT if limit is None else limit
    if offset < 0 or not 0 < limit <= MAX_LIMIT:
        raise ValueError("offset or limit out of range")
    return df.offset(offset).limit(limit)


def listing(df: DataFrame, filters: Mapping, allowed: Mapping, search: str | None, search_columns: Iterable[str], sort_by: str | None, default: str, tiebreak: str,
            descending: bool = False, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): filter, search, count, sort, page, in this order."""
    df = apply_search(apply_filters(df, filters, allowed), search, search_columns)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return paginate(apply_sort(df, sort_by, allowed, default, tiebreak, descending), offset, limit), total


def daily_shuffle(id_col: str, day: str) -> Column:
    """An order that is the same all day: md5 of id and day."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(day)))


def ordinal(column: str | Column, order: list[str]) -> Column:
    """Place in a list from 1; what is not in it comes last."""
    column = F.col(column) if isinstance(column, str) else column
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def not_among(column: str, hidden: list) -> Column:
    """NULL or not in the list."""
    return F.col(column).isNull() | ~F.col(column).isin(hidden)


def starts_with_any(column: str, prefixes: list[str]) -> Column:
    return reduce(or_, (F.col(column).startswith(p) for p in prefixes), F.lit(False))


def url_or_variant(column: str, url: str) -> Column:
    """The URL itself or a ?v= variant of it."""
    return (F.col(column) == url) | F.col(column).startswith(url + "?v=")


def failed_conditions(conditions: Mapping[str, Column]) -> Column:
    """Names of the conditions that do not hold (null counts as not), in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items())))


def prefer(df: DataFrame, keep: Column, partition: list[str]) -> DataFrame:
    """Per partition the rows where keep holds, or all of them if it holds for none."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition)
    kept = F.coalesce(keep, F.lit(False))
    return df.withColumn("__k", kept).withColumn("__any", F.bool_or("__k").over(w)).where("__k or not __any").drop("__k", "__any")
