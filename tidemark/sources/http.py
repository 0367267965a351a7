"""Requests with a rate limit, retries and a cache, through a transport that can be swapped."""

from __future__ import annotations

import functools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class HttpError(Exception):
    """An answer with an error status."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


#: method, url, parameters or body -> parsed JSON, or bytes of other content.
Transport = Callable[[str, str, dict], object]


def urllib_transport(method: str, url: str, data: dict) -> object:
    """The transport of the standard library."""
    if method == "GET":
        request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(data, doseq=True)}" if data else url)
    else:
        request = urllib.request.Request(url, json.dumps(data).encode(), {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            body = answer.read()
            return json.loads(body) if "json" in answer.headers.get("Content-Type", "") else body
    except urllib.error.HTTPError as e:
        raise HttpError(e.code) from e


class TokenBucket:
    """At most ``capacity`` calls at once and ``rate`` a second on average; a full bucket doesn't wait."""

    def __init__(self, rate: float, capacity: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.tokens, self.at = capacity, clock()

    def acquire(self, tokens: float = 1.0) -> None:
        """Wait until so many tokens are there, and take them."""
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= tokens:
                self.tokens -= tokens
                return
            self.sleep((tokens - self.tokens) / self.rate)


@dataclass(frozen=True)
class Retry:
    """How often and how long apart a call is tried again, and after what."""

    tries: int = 5
    least_wait: float = 2.0
    most_wait: float = 60.0
    statuses: tuple[int, ...] = (429,)
    on_connection: bool = False

    def call(self, what: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
        """``what()``; the last error is raised as it is."""
        for n in range(self.tries):
            try:
                return what()
            except (HttpError, OSError) as e:
                again = e.status in self.statuses if isinstance(e, HttpError) else self.on_connection
                if not again or n + 1 == self.tries:
                    raise
                sleep(min(self.most_wait, max(self.least_wait, self.least_wait * 2**n)))


@dataclass
class Client:
    """A transport behind a rate limit and retries. Each reader task has its own, at its share of the rate."""

    transport: Transport = urllib_transport
    rate: float = 1.0
    burst: float = 60.0
    retry: Retry = field(default_factory=Retry)
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.bucket = TokenBucket(self.rate, self.burst, sleep=self.sleep)

    def __call__(self, method: str, url: str, data: dict) -> object:
        def once() -> object:
            self.bucket.acquire()
            return self.transport(method, url, data)

        return self.retry.call(once, self.sleep)


#: Parts that recorded answers are dealt to, and bytes of a row group in them: what a request reads.
_PARTS, _GROUP = 64, 1 << 20


def record(answers: DataFrame, path: str) -> None:
    """Write answers ``(key, body)``, keyed by ``cache_key`` of method, url and data, as ``Recorded`` reads them."""
    rows = answers.select("key", "body", (F.crc32(F.col("key").cast("binary")) % _PARTS).cast("int").alias("part"))
    writer = rows.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part")
    # a body may be large: a group's size is looked at after each row, not after the first hundred
    writer.option("parquet.block.size", _GROUP).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 10).parquet(path)


@functools.lru_cache(maxsize=_PARTS)
def _part(path: str, part: int):
    """A part of the recorded answers, with the footers of its files kept; null if there is none."""
    from pyarrow import dataset, fs

    where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    place = f"{root}/part={part}"
    return dataset.dataset(place, filesystem=where, format="parquet") if where.get_file_info(place).type == fs.FileType.Directory else None


class Recorded:
    """A transport that answers from what was recorded under a path that all executors reach; nothing goes over the network.

    Each request reads the row group of its key only. A request without an answer gets ``otherwise``: an error status, or a body.
    """

    def __init__(self, path: str, otherwise: object = 404) -> None:
        self.path, self.otherwise = path, otherwise

    def __call__(self, method: str, url: str, data: dict) -> object:
        from pyarrow import dataset

        key = cache_key(method, url, data)
        part = _part(self.path, zlib.crc32(key.encode()) % _PARTS)
        found = part.to_table(columns=["body"], filter=dataset.field("key") == key, use_threads=False)["body"].to_pylist() if part else []
        if not found:
            if isinstance(self.otherwise, int):
                raise HttpError(self.otherwise)
            return self.otherwise
        return json.loads(found[0]) if found[0][:1] in "[{" else found[0].encode()


CACHE = "key string, body string, fetched_at timestamp"


def cache_key(*parts: object) -> str:
    """The key of a request; parameters are sorted, so their order doesn't count."""
    return json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str)


class ResponseCache:
    """Responses as a Parquet table keyed by request, the landing zone of the sources; it lives where all executors reach it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        from tidemark.sources.lake import has_files

        return self.spark.read.schema(CACHE).parquet(self.path) if has_files(self.spark, self.path) else self.spark.createDataFrame([], CACHE)

    def table(self, keys: DataFrame | None = None) -> DataFrame:
        """Responses of the keys ``(key, ...)``, or all; of those with one key the first fetched. Bodies of other keys aren't read any further than the look at the key."""
        from tidemark.operators.trades import first_of_each

        rows = self._rows()
        if keys is not None:
            rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
        return first_of_each(rows, ["key"], ["fetched_at", "body"])

    def get(self, key: str) -> str | None:
        """The response of one key."""
        found = self._rows().where(F.col("key") == F.lit(key)).orderBy("fetched_at", "body").select("body").first()
        return found["body"] if found else None

    def missing(self, keys: DataFrame) -> DataFrame:
        """The keys ``(key, ...)`` that have no response yet: what a run still has to fetch. Reads no bodies."""
        return keys.join(self._rows().select("key"), "key", "left_anti")

    def put(self, rows: Iterable[tuple[str, str]] | DataFrame) -> None:
        """Append responses."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), "key string, body string")
        df.select("key", "body", F.current_timestamp().alias("fetched_at")).write.mode("append").parquet(self.path)
