"""Spark data source `page_http`: pages by HTTP, one partition for each batch of urls."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "Mozilla/5.0 (compatible; tablewright)"


class Batch(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageReader(DataSourceReader):
    """Reads (url, final_url, status, content_type, body, error); server errors are tried again with a doubled wait."""

    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.size = int(options.get("batch", "20"))
        self.timeout, self.retries = float(options.get("timeout", "15")), int(options.get("retries", "2"))
        self.wait = float(options.get("wait", "0.3"))

    def partitions(self) -> list[InputPartition]:
        return [Batch(self.urls[a : a + self.size]) for a in range(0, len(self.urls), self.size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for url in partition.urls:
            yield self.fetch(url)

    def fetch(self, url: str) -> tuple:
        row = (url, url, 0, "", b"", "no attempt")
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(url, headers={"User-Agent": AGENT})
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return (url, r.geturl(), r.status, r.headers.get("Content-Type", ""), r.read(), None)
            except urllib.error.HTTPError as e:
                row = (url, url, e.code, e.headers.get("Content-Type", ""), e.read(), str(e))
                if e.code < 500:
                    return row
            except (OSError, ValueError) as e:
                row = (url, url, 0, "", b"", str(e))
            if attempt < self.retries:
                time.sleep(self.wait * 2**attempt)
        return row


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("page_http").option("urls", lines).load()"""

    @classmethod
    def name(cls) -> str:
        return "page_http"

    def schema(self) -> str:
        return "url string, final_url string, status int, content_type string, body binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return PageReader(self.options)
