"""A batch and streaming source over anything that answers in pages: databases by key or offset, listings by token.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema(...).option("client", "package.module:factory").option("mode", "key").option("key", "id")...

`client` names a function that gets all options and returns a client; it is called in every task, so connections are never
shipped. A client has, by mode:

    key     bounds() -> (least, greatest) or None;  after(key, upto, limit, first) -> rows with key < k <= upto (first: k = key too)
    offset  count() -> n;                           at(offset, limit) -> rows in one fixed order
    token   prefixes() -> list;                     listed(prefix, token, limit) -> (rows, next token or None)

A client by offset may also have begin(start, stop), which is told the slice before its pages are asked for.

Rows are dicts. Each range of keys, slice of offsets or prefix is a task of its own, so a lost task asks again for its part
only. What an answer must hold is checked: no page above its limit, keys that grow, no page that is lost in the middle, no token
and no key that comes twice. As a stream (mode key), the last key that was read is the offset, so a query goes on after it
from its checkpoint."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class PageFault(RuntimeError):
    """An answer that cannot be right."""


@dataclass
class KeyRange(InputPartition):
    low: Any
    high: Any
    first: bool


@dataclass
class Slice(InputPartition):
    start: int
    stop: int


@dataclass
class Prefix(InputPartition):
    prefix: str


def client_of(options: dict[str, str]) -> Any:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def keyed_pages(client: Any, key: str, low: Any, high: Any, first: bool, page: int) -> Iterator[dict]:
    """All rows of a range of keys, page by page, each page after the last key of the one before."""
    last = low
    while True:
        rows = client.after(last, high, page, first)
        if len(rows) > page:
            raise PageFault(f"a page of {len(rows)} rows where {page} were asked for")
        for row in rows:
            k = row[key]
            if k is None or k > high or k < last or (k == last and not first):
                raise PageFault(f"key {k!r} after {last!r}")
            last, first = k, False
            yield row
        if len(rows) < page:
            return


def sliced_pages(client: Any, start: int, stop: int, page: int) -> Iterator[dict]:
    """Rows start to stop of a fixed order; a short page before the end is a lost one."""
    at = start
    if at < stop and hasattr(client, "begin"):
        client.begin(start, stop)
    while at < stop:
        asked = min(page, stop - at)
        rows = client.at(at, asked)
        if len(rows) != asked:
            raise PageFault(f"{len(rows)} rows at {at} where {asked} were asked for")
        yield from rows
        at += asked


def token_pages(client: Any, prefix: str, key: str, page: int, most: int) -> Iterator[dict]:
    """All rows below a prefix along the tokens."""
    token, tokens, keys = None, set(), set()
    for _ in range(most):
        answer = client.listed(prefix, token, page)
        if not (isinstance(answer, tuple) and len(answer) == 2 and isinstance(answer[0], list)):
            raise PageFault("an answer without rows and token")
        rows, token = answer
        for row in rows:
            if not isinstance(row.get(key), str) or not row[key].startswith(prefix):
                raise PageFault(f"key {row.get(key)!r} below {prefix!r}")
            if row[key] in keys:
                raise PageFault(f"key {row[key]!r} comes twice")
            keys.add(row[key])
            yield row
        if token is None:
            return
        if token in tokens:
            raise PageFault(f"token {token!r} comes twice")
        tokens.add(token)
    raise PageFault(f"more than {most} pages below {prefix!r}")


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, dict(options)
        self.mode, self.key = options.get("mode", "key"), options.get("key", "id")
        self.parts, self.page = int(options.get("parts", 8)), int(options.get("page", 1000))

    def partitions(self) -> list[InputPartition]:
        client = client_of(self.options)
        if self.mode == "token":
            return [Prefix(p) for p in client.prefixes()]
        if self.mode == "offset":
            n = client.count()
            cuts = [n * i // self.parts for i in range(self.parts + 1)]
            return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [Slice(0, 0)]
        bounds = client.bounds()
        if bounds is None:
            return [Slice(0, 0)]
        low, high = bounds
        if not isinstance(low, int):
            return [KeyRange(low, high, True)]
        cuts = sorted({low + (high - low) * i // self.parts for i in range(self.parts + 1)})
        return [KeyRange(low, cuts[1] if len(cuts) > 1 else high, True), *(KeyRange(a, b, False) for a, b in zip(cuts[1:], cuts[2:], strict=False))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = client_of(self.options)
        if isinstance(partition, Prefix):
            rows = token_pages(client, partition.prefix, self.key, self.page, int(self.options.get("pages", 100_000)))
        elif isinstance(partition, Slice):
            rows = sliced_pages(client, partition.start, partition.stop, self.page)
        else:
            rows = keyed_pages(client, self.key, partition.low, partition.high, partition.first, self.page)
        for row in rows:
            yield tuple(row[n] for n in self.names)


class PagedStream(SimpleDataSourceStreamReader):
    """New rows by growing key: a batch is `pages` pages at most, its offset the last key."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, dict(options)
        self.key, self.most = options.get("key", "id"), int(options.get("page", 1000)) * int(options.get("pages", 10))

    def initialOffset(self) -> dict:
        return {"after": None}

    def _between(self, after: Any, upto: Any, limit: int | None) -> list[dict]:
        client = client_of(self.options)
        bounds = client.bounds()
        if bounds is None:
            return []
        low, high = (bounds[0] if after is None else after), (bounds[1] if upto is None else upto)
        out = []
        for row in keyed_pages(client, self.key, low, high, after is None, int(self.options.get("page", 1000))):
            out.append(row)
            if limit is not None and len(out) >= limit:
                break
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._between(start["after"], None, self.most)
        end = {"after": rows[-1][self.key]} if rows else start
        return iter([tuple(r[n] for n in self.names) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["after"] is None:
            return iter([])
        return iter([tuple(r[n] for n in self.names) for r in self._between(start["after"], end["after"], None)])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStream(schema, self.options)


class SqlPages:
    """Pages of a table through any DB-API module with ? parameters. Options: driver (module), database, table (a name or any
    table expression), columns, key.

    Pages by offset that follow each other are read on from one open cursor: a slice is put in order once, whatever the number of
    its pages. Rows of one key are in order of their other columns, so every slice is cut from the same order."""

    def __init__(self, options: dict[str, str]):
        self.key, self.columns, self.table = options["key"], options["columns"], options["table"]
        self.open = importlib.import_module(options["driver"]).connect(options.get("database", ":memory:"))
        self.names = [c.strip() for c in self.columns.split(",")]
        self.order = ", ".join(dict.fromkeys([self.key, *self.names]))
        self.going: Any = None  # the open cursor, and the offset of its next row
        self.next = 0

    def _dicts(self, rows: list[tuple]) -> list[dict]:
        return [dict(zip(self.names, r, strict=True)) for r in rows]

    def _rows(self, tail: str, *values: Any) -> list[dict]:
        return self._dicts(self.open.execute(f"SELECT {self.columns} FROM {self.table} {tail}", values).fetchall())

    def bounds(self) -> tuple[Any, Any] | None:
        low, high = self.open.execute(f"SELECT min({self.key}), max({self.key}) FROM {self.table}").fetchone()
        return None if low is None else (low, high)

    def count(self) -> int:
        return self.open.execute(f"SELECT count(*) FROM {self.table}").fetchone()[0]

    def after(self, key: Any, upto: Any, limit: int, first: bool) -> list[dict]:
        return self._rows(f"WHERE {self.key} {'>=' if first else '>'} ? AND {self.key} <= ? ORDER BY {self.key} LIMIT ?", key, upto, limit)

    def begin(self, start: int, stop: int) -> None:
        self.going, self.next = self.open.cursor(), start
        self.going.execute(f"SELECT {self.columns} FROM {self.table} ORDER BY {self.order} LIMIT ? OFFSET ?", (stop - start, start))

    def at(self, offset: int, limit: int) -> list[dict]:
        if self.going is None or offset != self.next:
            return self._rows(f"ORDER BY {self.order} LIMIT ? OFFSET ?", limit, offset)
        rows = self._dicts(self.going.fetchmany(limit))
        self.next += len(rows)
        return rows
