"""A paged HTTP source as a Python data source: one partition per page, with retries and a pause, in
batches and as a stream."""

from __future__ import annotations

import http.client
import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class PagedHttp(DataSource):
    """``format("paged_http")`` with options url, per_page, rows_key, order, pause and wait (seconds before each
    request, and more of them after each failure); ``pages`` says how many a batch reads. A stream reads full
    pages, each once: a page that is not full may still grow, and comes when it is."""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FullPages(self.options)


class _Asked:
    """Requests with a source's options."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def rows(self, page: int) -> list:
        asked = self.options
        body = fetch(asked["url"], page, int(asked.get("per_page", "1000")), asked.get("order", ""), pause=float(asked.get("pause", "2")), wait=float(asked.get("wait", "3")))
        return json.loads(body)[asked.get("rows_key", "rows")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for row in self.rows(partition.value):
            yield (json.dumps(row, ensure_ascii=False),)


class _Pages(_Asked, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1, int(self.options.get("pages", "1")) + 1)]


class _FullPages(_Asked, DataSourceStreamReader):
    """Offsets are numbers of pages read. The last full page is found by doubling and halving."""

    last = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        full = lambda page: len(self.rows(page)) >= int(self.options.get("per_page", "1000"))
        low, step = self.last, 1
        while full(low + step):
            low, step = low + step, 2 * step
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if full(middle) else (low, middle)
        self.last = low
        return {"page": low}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def commit(self, end: dict) -> None:
        self.last = max(self.last, end["page"])


def fetch(url: str, page: int, per_page: int, order: str = "", attempts: int = 4, pause: float = 2.0, wait: float = 3.0, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes:
    """One page by POST; a short body counts as a failure; waits 3 s, 6 s, ... between attempts."""
    sent = json.dumps({"page": page, "perPage": per_page, "sort": order, "desc": True}).encode()
    for attempt in range(1, attempts + 1):
        try:
            sleep(pause)
            with opener(urllib.request.Request(url, sent, {"Content-Type": "application/json"}), timeout=60) as answer:
                body, stated = answer.read(), answer.headers.get("Content-Length")
            if stated is not None and int(stated) != len(body):
                raise OSError(f"page {page}: {len(body)} of {stated} bytes")
            return body
        except (OSError, http.client.HTTPException):  # urllib raises the latter for a short body
            if attempt == attempts:
                raise
            sleep(wait * attempt)
    raise AssertionError
