"""Remote services as data sources that replay stored responses; live transports plug in behind the same interface.

``replay_http``: ``url -> status, content_type, body, error`` from a store of JSON lines; ``replay_pages``: a paged search
whose pages are read one after another by their continuation token.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


class Provider(Protocol):
    """What a transport has to offer. Raised errors become rows with ``error``."""

    def fetch(self, url: str) -> dict: ...


class StoredResponses:
    """Responses from JSON lines ``{"url", "status", "content_type", "body"}``; anything else isn't in the store.

    Only the responses to the ``wanted`` addresses are held: those of one partition.
    """

    def __init__(self, path: str, wanted: set[str] | None = None):
        self.rows = {}
        for file in sorted(Path(path).rglob("*.jsonl")) if Path(path).is_dir() else [Path(path)]:
            with file.open(encoding="utf-8") as lines:
                for line in lines:
                    if line.strip():
                        row = json.loads(line)
                        if wanted is None or row["url"] in wanted:
                            self.rows.setdefault(row["url"], row)

    def fetch(self, url: str) -> dict:
        if url not in self.rows:
            raise KeyError("not in the cache")
        return self.rows[url]


def provider_of(options: dict, wanted: list[str]) -> Provider:
    """The transport that the option ``provider`` names as ``module:factory`` (called with the options), or the stored responses."""
    name = options.get("provider")
    if not name:
        return StoredResponses(options["store"], set(wanted))
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.only = options, None

    def pushFilters(self, filters: list[Filter]):
        """An equality on ``url`` limits what is fetched; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("url",):
                self.only = f.value
            yield f  # Spark checks the rows as well

    def partitions(self):
        urls = [u.strip() for u in Path(self.options["urls"]).read_text(encoding="utf-8").splitlines() if u.strip()]
        if self.only is not None:
            urls = [u for u in urls if u == self.only]
        # one partition per host: a host's requests follow each other
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(urls):
            hosts.setdefault(u.split("/")[2] if "//" in u else "", []).append(u)
        return [_Part(v) for v in hosts.values()] or [_Part([])]

    def read(self, partition) -> Iterator[tuple]:
        provider = provider_of(self.options, partition.urls)
        for url in partition.urls:
            try:
                r = provider.fetch(url)
                yield url, r.get("status"), r.get("content_type"), (r.get("body") or "").encode(), None
            except Exception as error:  # noqa: BLE001 - a failed fetch is a row
                yield url, None, None, None, str(error).strip("'\"")


class ReplayHttp(DataSource):
    """``format("replay_http")`` with the options ``urls`` (a text file) and ``store`` (JSON lines, file or folder), or ``provider``.

    ``provider`` is ``module:factory`` of any :class:`Provider`, a live transport for instance; it is made once a partition.
    """

    @classmethod
    def name(cls):
        return "replay_http"

    def schema(self):
        return "url string, status int, content_type string, body binary, error string"

    def reader(self, schema):
        return _HttpReader(self.options)


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        pages = json.loads(Path(self.options["store"]).read_text(encoding="utf-8"))
        token, most = "", int(self.options.get("max_pages", "200"))
        for number in range(most):
            page = pages.get(token)
            if not page or not page.get("notices"):
                return
            for notice in page["notices"]:
                yield number, json.dumps(notice, ensure_ascii=False)
            token = page.get("iterationNextToken")
            if not token:
                return


class ReplayPages(DataSource):
    """``format("replay_pages")``: rows of a paged search, ``page INT, notice STRING`` (JSON).

    Option ``store``: a JSON file of pages by continuation token, the first under the empty one. Ends at an empty page, a
    missing token or ``max_pages``.
    """

    @classmethod
    def name(cls):
        return "replay_pages"

    def schema(self):
        return "page int, notice string"

    def reader(self, schema):
        return _PagesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filters handed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReplayHttp)
    spark.dataSource.register(ReplayPages)
