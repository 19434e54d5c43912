"""Landed lists of pages as a data source of Spark, for batches and streams.

Pages lie as ``list=<name>/page=<number>/<files>`` (what ``df.write.partitionBy("list", "page").text(...)`` lands). A list is one partition and is
read page by page until it ends: with an empty page, with one of fewer than ``limit`` rows, or with a page that repeats the one before (sites
answer so beyond the last page); pages behind that are never opened. A filter on ``list`` decides which lists are opened at all.

As a stream, the offset is the next page of each list, so a restarted query goes on where it stopped, page by page, while lists still grow.

Options: ``path`` (any file system that pyarrow opens), ``block`` (JSON pages: the block whose rows count) or ``row`` (a pattern that is found
once a row), ``limit`` (rows of a full page, default 100), ``pages`` (pages a list and micro-batch, default 1000).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "list string, page bigint, payload string"


def rows_of(payload: str, block: str | None, row: str | None) -> int:
    """How many rows a page holds; one that cannot be read holds none."""
    if row:
        return len(re.findall(row, payload))
    try:
        return len(json.loads(payload)[block]["data"])
    except (ValueError, KeyError, TypeError):
        return 0


class Pages:
    """The lists under a path and their pages."""

    def __init__(self, options: dict):
        self.path, self.block, self.row = options["path"].rstrip("/"), options.get("block"), options.get("row")
        self.limit, self.most = int(options.get("limit", 100)), int(options.get("pages", 1000))
        if not self.block and not self.row:
            raise ValueError("name the block or the pattern of rows")

    def _under(self, *parts: str) -> list:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return [(system, x) for x in system.get_file_info(fs.FileSelector("/".join([base, *parts]), allow_not_found=True))]

    def lists(self) -> list[str]:
        return sorted(x.base_name.removeprefix("list=") for _, x in self._under() if x.base_name.startswith("list="))

    def numbers(self, name: str) -> list[int]:
        return sorted(int(x.base_name.removeprefix("page=")) for _, x in self._under(f"list={name}") if x.base_name.startswith("page="))

    def text(self, name: str, page: int) -> str:
        found = sorted(((s, x) for s, x in self._under(f"list={name}", f"page={page}") if not x.base_name.startswith(("_", "."))), key=lambda f: f[1].base_name)
        return "".join(s.open_input_stream(x.path).read().decode("utf-8") for s, x in found).strip()

    def read(self, name: str, numbers: list[int], before: str | None = None) -> Iterator[tuple[str, int, str]]:
        """Pages of a list up to its end."""
        for page in numbers:
            payload = self.text(name, page)
            n = rows_of(payload, self.block, self.row)
            if not n or payload == before:
                return
            yield name, page, payload
            if n < self.limit:
                return
            before = payload


@dataclass
class ListOfPages(InputPartition):
    name: str
    start: int = 0
    end: int | None = None


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.wanted = Pages(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("list",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f

    def partitions(self) -> list[ListOfPages]:
        return [ListOfPages(n) for n in self.pages.lists() if self.wanted is None or n in self.wanted]

    def read(self, partition: ListOfPages) -> Iterator[tuple]:
        if partition is not None:  # no list at all
            yield from self.pages.read(partition.name, self.pages.numbers(partition.name))


class PageStream(DataSourceStreamReader):
    """The offset: list -> the page that comes next."""

    def __init__(self, options: dict):
        self.pages, self.seen = Pages(options), {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for name in self.pages.lists():
            ahead = [n for n in self.pages.numbers(name) if n >= self.seen.get(name, 0)][: self.pages.most]
            if ahead:
                self.seen[name] = ahead[-1] + 1
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[ListOfPages]:
        self.seen = {**self.seen, **end}
        return [ListOfPages(n, start.get(n, 0), upto) for n, upto in sorted(end.items()) if upto > start.get(n, 0)]

    def read(self, partition: ListOfPages) -> Iterator[tuple]:
        numbers = self.pages.numbers(partition.name)
        last = [n for n in numbers if n < partition.start][-1:]
        before = self.pages.text(partition.name, last[0]) if last else None
        if before is not None and rows_of(before, self.pages.block, self.pages.row) < self.pages.limit:
            return  # the list had ended
        yield from self.pages.read(partition.name, [n for n in numbers if partition.start <= n < partition.end], before)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make ``landed_pages`` known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(LandedPages)


class LandedPages(DataSource):
    """:func:`register`, then ``spark.read.format("landed_pages")`` or ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(dict(self.options))
