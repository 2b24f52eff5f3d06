"""Sites' pages as a data source, in batch and as a stream.

``spark.dataSource.register(PageSource)`` makes ``format("site_pages")`` known.
A site offers an index of its pages that only grows: ``GET index?start=A&end=B``
gives the paths from number A up to B, a line each, and ``GET count`` how many
there are. Its offset is that number, so a stream that goes on reads what is new
and nothing twice; neither the driver nor a task holds more of an index than one
request gives.

Options: ``sites`` (roots by commas, such as ``http://a.example/``), ``count`` and
``index`` (paths of the two), ``delay`` and ``timeout`` in seconds, ``request``
(pages of the index for each request), ``agent``. A site's pages are fetched by
one task, ``delay`` apart. A page that can't be had is a row with its error; one
that the site's robots file forbids is no row; a site whose count can't be had has
no new pages for now.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "site string, position long, url string, html string, error string"


@dataclass
class SitePart(InputPartition):
    """Pages of a site's index from ``start`` up to ``end``."""

    site: str
    start: int
    end: int


class _Site:
    def __init__(self, options: dict[str, str]):
        self.sites = [s.strip().rstrip("/") + "/" for s in options.get("sites", "").split(",") if s.strip()]
        if not self.sites:
            raise ValueError("the option sites names no site")
        self.count_path, self.index_path = options.get("count", "count"), options.get("index", "index")
        self.delay, self.timeout = float(options.get("delay", "1")), float(options.get("timeout", "5"))
        self.request, self.agent = int(options.get("request", "1000")), options.get("agent", "*")

    def get(self, url: str) -> str:
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    def count(self, site: str) -> int:
        try:
            return int(self.get(urljoin(site, self.count_path)))
        except (OSError, ValueError):
            return 0

    def robots(self, site: str) -> RobotFileParser:
        rules = RobotFileParser()
        try:
            rules.parse(self.get(urljoin(site, "robots.txt")).splitlines())
        except urllib.error.HTTPError as e:
            rules.parse([] if e.code in (404, 410) else ["User-agent: *", "Disallow: /"])
        except OSError:
            rules.parse(["User-agent: *", "Disallow: /"])
        return rules

    def pages(self, part: SitePart) -> Iterator[tuple]:
        rules = self.robots(part.site)
        for start in range(part.start, part.end, self.request):
            end = min(part.end, start + self.request)
            paths = self.get(f"{urljoin(part.site, self.index_path)}?start={start}&end={end}").splitlines()
            for position, path in enumerate(paths[: end - start], start):
                url = urljoin(part.site, path)
                if not rules.can_fetch(self.agent, url):
                    continue
                try:
                    row = (part.site, position, url, self.get(url), None)
                except (OSError, ValueError) as e:
                    row = (part.site, position, url, None, f"{type(e).__name__}: {e}")
                yield row
                time.sleep(self.delay)


class PageReader(DataSourceReader):
    """All pages that the sites have when it is planned."""

    def __init__(self, options: dict[str, str]):
        self.site = _Site(options)

    def partitions(self):
        return [SitePart(s, 0, self.site.count(s)) for s in self.site.sites]

    def read(self, partition):
        yield from self.site.pages(partition)


class PageStream(DataSourceStreamReader):
    """The pages that come to the sites' indexes; an offset has each site's number."""

    def __init__(self, options: dict[str, str]):
        self.site = _Site(options)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {s: 0 for s in self.site.sites}

    def latestOffset(self) -> dict:
        for s in self.site.sites:  # an index never shrinks, whatever a site says for a while
            self.last[s] = max(self.last.get(s, 0), self.site.count(s))
        return dict(self.last)

    def partitions(self, start: dict, end: dict):
        return [SitePart(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition):
        yield from self.site.pages(partition)

    def commit(self, end: dict) -> None:
        """Spark keeps the offsets; nothing is held for pages already read."""


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(dict(self.options))
