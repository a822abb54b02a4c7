"""Pages behind cursors as a source: each key has a chain of pages, and a page says by which cursor the next one is asked for.

    register(spark)
    spark.read.format("cursor_pages").option("path", folder).load().filter("created >= '2024-06-01'")

A batch read has a task for each shard of keys and walks the chains of its keys. Within a key rows come newest first, so a lower
bound on `created`, which is pushed down, or the option `since`, ends a chain at the first older row; `most` ends it at a number of rows. A stream goes on from the cursor where it stopped, key by key.

Pages are what `land` writes: a folder key=.../cursor=... for each, of JSON lines with the fields created, node and next. Another
store is another class with `keys` and `page`, and a source with `pages` of its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from ..operators.ranks import running

START = "start"

#: Attempts at a page, and seconds after the first that failed; each later one waits longer.
ATTEMPTS, WAIT = 5, 0.2

SCHEMA = "key string, cursor string, position bigint, created string, node string"


def land(rows: DataFrame, path: str, key: Column, created: Column, order: list[str], size: int, mode: str = "error") -> None:
    """Write rows as chains of pages of `size`, by key, newest first, ties by falling `order`. A key's rows are dealt into pages by their
    rank, so no task has all rows of a key. A null key is the text `null`."""
    fields = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    some = rows.select(F.coalesce(key.cast("string"), F.lit("null")).alias("key"), created.cast("string").alias("created"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), fields.alias("node"))
    ranked = running(some, ["key"], ["created", *(f"o{i}" for i in range(len(order)))], n=F.lit(1))
    page = F.floor((F.col("n_all") - 1 - F.col("n_before")) / size)
    cursor = lambda p: F.when(p == 0, F.lit(START)).otherwise(F.substring(F.md5(F.concat_ws(":", "key", p.cast("string"))), 1, 12))
    out = ranked.select("key", cursor(page).alias("cursor"), (F.col("n_all") - 1 - F.col("n_before")).alias("position"), "created", "node", cursor(page + 1).alias("next"))
    out.repartition("key", "cursor").sortWithinPartitions("key", "cursor", "position").write.mode(mode).partitionBy("key", "cursor").json(path)


@dataclass
class LandedPages:
    path: str

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path:
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path.removeprefix("file:")

    def keys(self) -> list[str]:
        store, top = self._store()
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return sorted(unquote(f.base_name.removeprefix("key=")) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("key="))

    def page(self, key: str, cursor: str) -> tuple[list[dict], str | None] | None:
        """Rows and next cursor; None where there is no such page (yet)."""
        store, top = self._store()
        folder = f"{top}/key={_escaped(key)}/cursor={cursor}"
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.startswith("part-"))
        if not files:
            return None
        rows = []
        for f in files:
            with store.open_input_stream(f) as s:
                rows += [json.loads(line) for line in s.read().decode().splitlines() if line]
        rows.sort(key=lambda r: r["position"])
        return rows, rows[-1]["next"]


#: Characters that Spark escapes in names of folders.
_ESCAPED = {*(chr(i) for i in range(1, 32)), *"\"#%'*/:=?\\{[]^", "\x7f"}


def _escaped(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


def _asked(pages: LandedPages, key: str, cursor: str) -> tuple[list[dict], str | None] | None:
    for attempt in range(ATTEMPTS):
        try:
            return pages.page(key, cursor)
        except (OSError, ValueError):  # a store that fails, or a page that is half written
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(WAIT * (attempt + 1))
    return None


def _chain(pages: LandedPages, key: str, cursor: str | None, until: str | None = None) -> Iterator[tuple[str, list[dict], str | None]]:
    """(cursor, rows, next) of a key's pages from a cursor on, up to another one or the last page."""
    while cursor is not None and cursor != until:
        found = _asked(pages, key, cursor)
        if found is None:
            return
        yield cursor, *found
        cursor = found[1]


@dataclass
class Shard(InputPartition):
    #: (key, first cursor, cursor to stop before).
    spans: list[tuple[str, str, str | None]]


def _dealt(spans: list[tuple[str, str, str | None]], shards: int) -> list[Shard]:
    return [Shard(spans[k::shards]) for k in range(min(shards, len(spans)))] or [Shard([])]


class PagesReader(DataSourceReader):
    def __init__(self, pages: LandedPages, shards: int, since: str | None, most: int | None):
        self.pages, self.shards, self.since, self.most = pages, shards, since, most

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A lower bound of `created` ends the chains; Spark applies it to the rows of the last page as well."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo) and f.attribute == ("created",) and isinstance(f.value, str):
                self.since = max(self.since or "", f.value)
            yield f

    def partitions(self) -> list[Shard]:
        return _dealt([(k, START, None) for k in self.pages.keys()], self.shards)

    def read(self, partition: Shard) -> Iterator[tuple]:
        for key, first, until in partition.spans:
            taken = 0
            for row in self._rows(key, first, until):
                if taken == self.most or (self.since is not None and (row[3] is None or row[3] < self.since)):
                    break
                taken += 1
                yield row

    def _rows(self, key: str, first: str, until: str | None) -> Iterator[tuple]:
        for cursor, rows, _ in _chain(self.pages, key, first, until):
            for r in rows:
                yield key, cursor, r["position"], r.get("created"), r.get("node")


class PagesStream(DataSourceStreamReader):
    """Offsets are the cursor that each key goes on at. A new session finds it by walking the chains once."""

    def __init__(self, pages: LandedPages, shards: int):
        self.pages, self.shards, self.at = pages, shards, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for key in self.pages.keys():
            for *_, after in _chain(self.pages, key, self.at.get(key, START)):
                self.at[key] = after
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return _dealt([(k, start.get(k, START), until) for k, until in sorted(end.items()) if start.get(k) != until], self.shards)

    def read(self, partition: Shard) -> Iterator[tuple]:
        yield from PagesReader(self.pages, self.shards, None, None).read(partition)


class CursorPages(DataSource):
    """Options: path; shards, tasks of a read (8); since and most, for batches."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def pages(self) -> LandedPages:
        return LandedPages(self.options["path"])

    def reader(self, schema) -> PagesReader:
        most = self.options.get("most")
        return PagesReader(self.pages(), int(self.options.get("shards", 8)), self.options.get("since"), int(most) if most else None)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.pages(), int(self.options.get("shards", 8)))


def register(spark: SparkSession, source: type[DataSource] = CursorPages) -> None:
    """Make the source known, and let Spark push filters down to sources of its kind, without which it can't be read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
