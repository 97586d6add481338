"""A Python data source that fetches pages: spark.read.format("pagelode_web").option("urls", ...).load()."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page_id bigint, url string, status_code int, content_type string, etag string, last_modified string, html string"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout = float(options.get("timeout", "10"))
        self.most = int(options.get("max_bytes", str(10 * 1024 * 1024)))
        self.agent = options.get("agent", "pagelode")
        self.parts = max(1, int(options.get("partitions", "8")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, self.urls[k :: self.parts])) for k in range(min(self.parts, len(self.urls)))]

    def _response(self, number: int, url: str) -> tuple:
        try:
            request = urllib.request.Request(url, headers={"User-Agent": self.agent})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                h = r.headers
                kind, size = h.get("Content-Type"), int(h.get("Content-Length") or 0)
                row = number, r.geturl(), r.status, kind, h.get("ETag"), h.get("Last-Modified")
                # The body is read only if it can become a page.
                if size > self.most or not any(x in (kind or "") for x in ("text/html", "text/plain")):
                    return *row, None
                body = r.read(self.most + 1)
                return *row, body.decode(h.get_content_charset() or "utf-8", "replace") if len(body) <= self.most else None
        except urllib.error.HTTPError as e:
            return number, url, e.code, e.headers.get("Content-Type"), None, None, None
        except (OSError, ValueError, LookupError, http.client.HTTPException):
            return number, url, 0, None, None, None, None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, urls = partition.value
        for k, url in enumerate(urls):
            yield self._response(first + k * self.parts, url)


class WebSource(DataSource):
    """A response for each of the given urls: without html if it is no text or too large, with status 0 if there was none."""

    @classmethod
    def name(cls) -> str:
        return "pagelode_web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
