"""A paged list as a data source, for batches and streams: ``spark.read.format("paged")``.

Pages are numbered from 1 and full but for the last. As a batch, the last page is found by doubling and halving, then blocks of pages are read in parallel,
each task its own; a page that has become short since is an error rather than a gap. As a stream, an offset is a page and a place on it,
so items that are added later are read once, on the page that was short and on new ones."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, place int, item string"
SIZE, MOST_PAGES, BLOCK = 20, 10_000, 16


class PageError(ValueError):
    pass


def recorded(page: int, options: dict[str, str]) -> str | None:
    """The body of a page that was stored as ``folder``/number.json, None if there is none: for tests and replays on one machine."""
    at = Path(options["folder"]) / f"{page}.json"
    return at.read_text("utf-8") if at.exists() else None


class Pages:
    """Options: fetcher (``module:function``, called with the page's number and all options), items (path of the list in a body, with dots), size (items of a full
    page), most_pages, block (pages of a task, or of a trigger)."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        option = lambda name, default: int(self.options.get(name, default))
        self.size, self.most, self.block = option("size", SIZE), option("most_pages", MOST_PAGES), option("block", BLOCK)
        self.path = [p for p in self.options.get("items", "items").split(".") if p]

    def fetcher(self) -> Callable[[int, dict[str, str]], str | None]:
        module, _, name = self.options.get("fetcher", "sparkshelf.sources.paged:recorded").partition(":")
        return getattr(importlib.import_module(module), name)

    def items(self, page: int) -> list:
        """The items of a page; a page that does not exist has none. A body without the list is an error: the service has changed."""
        body = self.fetcher()(page, self.options)
        if body is None:
            return []
        found = json.loads(body)
        for key in self.path:
            found = found.get(key) if isinstance(found, dict) else None
        if not isinstance(found, list):
            raise PageError(f"page {page} has no list at {'.'.join(self.path)}")
        if len(found) > self.size:
            raise PageError(f"page {page} has {len(found)} items, more than the size of {self.size}")
        return found

    def last(self) -> int:
        """The number of the last page that has items; the first page must have some."""
        n = len(self.items(1))
        if not n:
            raise PageError("page 1 has no items")
        if n < self.size:
            return 1
        full, after = 1, 2
        while after <= self.most and len(self.items(after)) == self.size:
            full, after = after, after * 2
        if after > self.most:
            after = self.most + 1
            if len(self.items(self.most)) == self.size:
                raise PageError(f"pages are still full after {self.most}")
        while after - full > 1:
            middle = (full + after) // 2
            if len(self.items(middle)) == self.size:
                full = middle
            else:
                after = middle
        return full + bool(self.items(full + 1))


class Block(InputPartition):
    def __init__(self, first: int, to: int, last: int):
        self.first, self.to, self.last = first, to, last


def _rows(page: int, items: list, start: int = 0) -> Iterator[tuple[int, int, str]]:
    return ((page, place, json.dumps(item, ensure_ascii=False)) for place, item in enumerate(items) if place >= start)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def partitions(self) -> list[Block]:
        last, block = self.pages.last(), self.pages.block
        return [Block(a, min(a + block - 1, last), last) for a in range(1, last + 1, block)]

    def read(self, partition: Block) -> Iterator[tuple[int, int, str]]:
        for page in range(partition.first, partition.to + 1):
            items = self.pages.items(page)
            if page < partition.last and len(items) < self.pages.size or not items:
                raise PageError(f"page {page} was full and is short now")
            yield from _rows(page, items)


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"page": 1, "place": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """What lies between start and the end of the list, up to a block of pages."""
        rows: list[tuple] = []
        page, place = start["page"], start["place"]
        for _ in range(self.pages.block):
            items = self.pages.items(page)
            if page == 1 and not items:
                raise PageError("page 1 has no items")
            rows += _rows(page, items, place)
            if len(items) < self.pages.size:
                return iter(rows), {"page": page, "place": max(place, len(items))}
            page, place = page + 1, 0
        return iter(rows), {"page": page, "place": place}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same rows again after a restart."""
        for page in range(start["page"], end["page"] + 1):
            items = self.pages.items(page)[: end["place"] if page == end["page"] else None] if (page, end["place"]) != (end["page"], 0) else []
            yield from _rows(page, items, start["place"] if page == start["page"] else 0)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PagedSource)
