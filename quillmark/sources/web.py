"""Pages of the web as a Spark data source, in batches and as a stream: spark.read.format("web").option("urls", ...).load()."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "position bigint, url string, host string, filename string, status int, content binary, fetched_at timestamp, error string"
AGENT = "quillmark-web/1.0"


@dataclass(frozen=True)
class Settings:
    """What to fetch and how: at most max_pages of the urls, so many requests a second to one host, and whether robots.txt is obeyed."""

    urls: tuple[str, ...]
    obey_robots: bool = True
    rate_limit_rps: float = 1.0
    max_pages: int = 50
    timeout: float = 30.0
    max_bytes: int = 100 << 20
    headers: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(options: dict) -> Settings:
        """From a reader's options, which are text: urls and headers as JSON, or urls one to a line."""
        o = {k.lower(): v for k, v in options.items()}
        said = o.get("urls", "").strip()
        urls = json.loads(said) if said.startswith("[") else [u.strip() for u in said.splitlines() if u.strip()]
        headers = {"User-Agent": AGENT} | json.loads(o.get("headers", "{}"))
        s = Settings(tuple(urls), o.get("obey_robots", "true").lower() == "true", float(o.get("rate_limit_rps", 1.0)), int(o.get("max_pages", 50)), float(o.get("timeout", 30)), int(o.get("max_bytes", 100 << 20)), tuple(headers.items()))
        if wrong := s.wrong():
            raise ValueError("; ".join(wrong))
        return s

    def wrong(self) -> list[str]:
        """What is wrong with the settings."""
        bad = [u for u in self.urls if not (isinstance(u, str) and urlsplit(u).scheme in ("http", "https") and urlsplit(u).netloc)]
        tests = ((not self.urls, "no urls"), (bool(bad), f"not urls: {bad[:5]}"), (self.rate_limit_rps <= 0, "rate_limit_rps must be positive"), (self.max_pages <= 0, "max_pages must be positive"), (self.timeout <= 0, "timeout must be positive"))
        return [m for no, m in tests if no]

    def taken(self) -> tuple[str, ...]:
        return self.urls[: self.max_pages]


class Host(InputPartition):
    """All pages of one host, so that one task keeps to its rate. Pages are (position, url)."""

    def __init__(self, host: str, pages: tuple[tuple[int, str], ...]) -> None:
        self.host, self.pages = host, pages


def hosts(pages: list[tuple[int, str]]) -> list[Host]:
    by: dict[str, list[tuple[int, str]]] = {}
    for i, u in pages:
        by.setdefault(urlsplit(u).netloc.lower(), []).append((i, u))
    return [Host(h, tuple(p)) for h, p in by.items()]


def filename(url: str) -> str:
    """Host and path with _ for /, and .html behind it."""
    u = urlsplit(url)
    name = u.netloc + u.path.replace("/", "_")
    return name if name.endswith(".html") else f"{name}.html"


def _get(s: Settings, url: str) -> tuple[int | None, bytes | None, str | None]:
    """Status, body and error of one request; redirects are followed. Only a 200 has a body."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(s.headers)), timeout=s.timeout) as r:
            body = r.read(s.max_bytes + 1)
            if r.status != 200:
                return r.status, None, f"HTTP {r.status}"
            return (r.status, None, "too large") if len(body) > s.max_bytes else (r.status, body, None)
    except urllib.error.HTTPError as e:
        return e.code, None, f"HTTP {e.code}"
    except TimeoutError:
        return None, None, "timeout"
    except OSError as e:  # no connection, or a broken one
        return None, None, "timeout" if "timed out" in str(e) else str(e)[:300]


def _rules(s: Settings, url: str) -> urllib.robotparser.RobotFileParser:
    """The host's robots.txt: none allows all, one that is forbidden or can't be had allows nothing."""
    u, rules = urlsplit(url), urllib.robotparser.RobotFileParser()
    status, body, _ = _get(s, f"{u.scheme}://{u.netloc}/robots.txt")
    if body is not None:
        rules.parse(body.decode("utf-8", "replace").splitlines())
    elif status is not None and 400 <= status < 500 and status not in (401, 403):
        rules.allow_all = True
    else:
        rules.disallow_all = True
    return rules


def fetched(s: Settings, part: Host) -> Iterator[tuple]:
    """A row for each page of a host: requests start at least 1 / rate_limit_rps apart, robots.txt among them. A page that robots.txt forbids has no status."""
    agent, rules, last = dict(s.headers).get("User-Agent", AGENT), {}, None

    def wait() -> None:
        nonlocal last
        if last is not None:
            time.sleep(max(0.0, last + 1.0 / s.rate_limit_rps - time.monotonic()))
        last = time.monotonic()

    for position, url in part.pages:
        status, body, error = None, None, "forbidden by robots.txt"
        scheme = urlsplit(url).scheme
        if s.obey_robots and scheme not in rules:
            wait()
            rules[scheme] = _rules(s, url)
        if not s.obey_robots or rules[scheme].can_fetch(agent, url):
            wait()
            status, body, error = _get(s, url)
        yield position, url, part.host, filename(url), status, body, dt.datetime.now(dt.UTC), error


class _Reader(DataSourceReader):
    def __init__(self, s: Settings) -> None:
        self.s = s

    def partitions(self) -> list[Host]:
        return hosts(list(enumerate(self.s.taken())))

    def read(self, partition: Host) -> Iterator[tuple]:
        return fetched(self.s, partition)


class _Stream(DataSourceStreamReader):
    """The offset is how many urls were read; a list that grew at its end goes on from there."""

    def __init__(self, s: Settings) -> None:
        self.s = s

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"read": 0}

    def latestOffset(self, *_) -> dict:  # noqa: N802, ANN002
        return {"read": len(self.s.taken())}

    def partitions(self, start: dict, end: dict) -> list[Host]:
        return hosts(list(enumerate(self.s.taken()))[start["read"] : end["read"]])

    def read(self, partition: Host) -> Iterator[tuple]:
        return fetched(self.s, partition)


class WebSource(DataSource):
    """Rows of SCHEMA, one for each url, errors included; filter on status for pages that were found.

    A task has the pages of one host, so hosts are read side by side and none faster than its rate. A task that is lost reads its host's pages again, and Spark takes one attempt's rows; a stream goes on from
    the offset in its checkpoint. Urls that repeat are fetched for each place. No url or a wrong one is an error before anything is fetched.
    """

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(Settings.of(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(Settings.of(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Makes the format `web` known to a session."""
    spark.dataSource.register(WebSource)


def answers(options: dict) -> tuple[bool, str]:
    """Whether the first url answers with a 200."""
    s = Settings.of(options)
    status, _, error = _get(s, s.urls[0])
    return status == 200, error or "ok"


def sync(spark: SparkSession, to: str, **options: str) -> dict:
    """Fetches pages into a Parquet folder, written over as a whole, and returns files, bytes and errors as they were written."""
    register(spark)
    x = spark.read.format("web").options(**options).load()
    x.write.mode("overwrite").parquet(to)
    r = spark.read.parquet(to).agg(F.count_if(F.col("error").isNull()).alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b"), F.count("error").alias("e")).first()
    return {"files": r.n, "bytes": r.b, "errors": r.e}
