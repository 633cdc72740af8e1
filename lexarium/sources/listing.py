"""A paged listing as a Python data source, for tables and for streams.

A table's partition reads one scope's pages through a fetcher named by its import path; filters on ``scope`` can be pushed into the source, so other scopes aren't asked for.  A stream's offset is each scope's next
token: a run that starts again goes on at that page.  Calls that fail are repeated, later and later."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from ..facade import backoff

#: Spark asks Python sources for their filters only if this is set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def registered(spark: SparkSession) -> None:
    """Make ``format("listing")`` known to a session."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ListingSource)


class _Pages(InputPartition):
    def __init__(self, scope: str):
        self.scope = scope


class _Listing:
    """How the options say that pages are fetched."""

    def __init__(self, options):
        self.fetch = options.get("fetch")
        self.scopes = [s for s in (options.get("scopes") or "").split(",") if s] or [""]
        self.most = int(options.get("most_pages") or 200)
        self.batch = int(options.get("pages_per_batch") or 10)
        self.retries = int(options.get("retries") or 3)
        self.wait = float(options.get("wait") or 1.0)

    def page(self, scope: str, token: str | None) -> tuple[list, str | None]:
        """A page, asked for again after a failure: after what the failure's ``retry_after`` says, else doubling waits."""
        module, _, name = self.fetch.partition(":")
        fetch: Callable = getattr(importlib.import_module(module), name)
        for attempt in range(1, self.retries + 2):
            try:
                return fetch(scope, token)
            except Exception as error:  # whatever a caller's fetcher raises
                if attempt > self.retries:
                    raise
                time.sleep(backoff(attempt, self.wait, told=getattr(error, "retry_after", None)))
        raise AssertionError("unreachable")

    def pages(self, scope: str, token: str | None, first: int, until: int | None = None) -> Iterator[tuple[int, list, str | None]]:
        """``page, members, next token`` from a token on, up to a page; a token left after ``most_pages`` is an error: nothing is cut silently."""
        page = first
        while until is None or page < until:
            if page >= self.most:
                raise ValueError(f"{scope or 'listing'}: a token is left after {self.most} pages")
            members, token = self.page(scope, token)
            yield page, members, token
            if not token:
                return
            page += 1


def _rows(scope: str, page: int, members: list) -> list[tuple]:
    return [(scope, page, json.dumps(m, sort_keys=True)) for m in members]


class ListingSource(DataSource):
    """``format("listing")`` with options ``fetch`` (``module:function``), ``scopes`` (comma list; one partition each), ``most_pages``, ``retries`` and ``wait`` (seconds, doubling), and for streams
    ``pages_per_batch`` (of each scope).

    ``fetch(scope, token)`` returns ``(members, next_token)``.

    With option ``pushdown`` filters on ``scope`` are pushed into the source. Spark keeps what one query pushed for the loaded DataFrame, and another query of it would miss rows: with this option, load anew for
    every query.  Without it one DataFrame serves any number."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "scope string, page int, member string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushedReader if (self.options.get("pushdown") or "").lower() == "true" else _Reader)(_Listing(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(_Listing(self.options))


class _Reader(DataSourceReader):
    def __init__(self, listing: _Listing):
        self.listing, self.scopes = listing, listing.scopes

    def partitions(self) -> list[InputPartition]:
        return [_Pages(s) for s in self.scopes]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page, members, _ in self.listing.pages(partition.scope, None, 0):
            yield from _rows(partition.scope, page, members)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Scopes that equality and membership leave; other filters stay Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("scope",):
                self.scopes = [s for s in self.scopes if s == f.value]
            elif isinstance(f, In) and f.attribute == ("scope",):
                self.scopes = [s for s in self.scopes if s in f.value]
            else:
                yield f


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets: by scope its next ``token`` and ``page``, and whether it is ``done``. A batch is ``pages_per_batch`` pages of each scope, so what the driver passes on is bounded."""

    def __init__(self, listing: _Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {s: {"token": None, "page": 0, "done": False} for s in self.listing.scopes}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = [], {}
        for scope in self.listing.scopes:
            at = dict(start.get(scope) or {"token": None, "page": 0, "done": False})
            if not at["done"]:
                for page, members, token in self.listing.pages(scope, at["token"], at["page"], at["page"] + self.listing.batch):
                    rows += _rows(scope, page, members)
                    at = {"token": token, "page": page + 1, "done": not token}
            after[scope] = at
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that is made again."""
        for scope, to in end.items():
            at = start.get(scope) or {"token": None, "page": 0, "done": False}
            if not at["done"]:
                for page, members, _ in self.listing.pages(scope, at["token"], at["page"], to["page"]):
                    yield from _rows(scope, page, members)

    def commit(self, end: dict) -> None:
        pass
