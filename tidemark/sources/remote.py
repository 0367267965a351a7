"""Readers of remote services by the Python Data Source API: partitions are fetched by tasks, in parallel.

Every reader takes its transport from ``client_for``, so that tests run it on recorded answers. A partition
that fails gives a row with ``error`` under ``failures=keep`` and fails the query otherwise; nothing is lost silently.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.http import Client, HttpError, ResponseCache, Retry, urllib_transport
from tidemark.sources.http import cache_key as http_key

#: Page sizes, the news and game services' addresses, and the kinds of a season's games. Other addresses are options.
MARKETS_PAGE, FILLS_PAGE, NEWS_PAGE = 100, 1000, 100
NEWS_URL, GAMES_URL = "https://site.api.espn.com/apis/site/v2/sports", "https://stats.nba.com/stats/leaguegamelog"
SEASON_TYPES = ("Regular Season", "Playoffs")
#: Fixed value: the status of an offset behind the last market.
PAST_THE_END = 422
#: Statuses that may be others the next time.
PASSING = frozenset((408, 425, 429, 500, 502, 503, 504))
#: Markets that one task looks up.
LOOKUPS = 50
#: The fields of a fill.
FILL_FIELDS = "transactionHash logIndex blockNumber timestamp maker taker makerAssetId takerAssetId makerAmountFilled takerAmountFilled"


@dataclass
class Slice(InputPartition):
    """What one task fetches."""

    value: dict


def fill_query(side: str) -> str:
    """The query of one side's fills behind a cursor of time and log index, in their order."""
    own = f'{side}AssetId: $token, timestamp_lt: $end'
    behind = f"{{{own}, timestamp_gt: $ts}}, {{{own}, timestamp: $ts, logIndex_gt: $li}}"
    return f"query($token: String!, $ts: BigInt!, $li: BigInt!, $end: BigInt!, $first: Int!) {{ orderFilledEvents(first: $first, orderBy: timestamp, orderDirection: asc, where: {{or: [{behind}]}}) {{ {FILL_FIELDS} }} }}"


def market_pages(client: Callable, url: str, tag: str, closed: bool, start_after: str | None, end_before: str | None) -> Iterator[dict]:
    """A tag's markets, page by page until a short one. ``start_after`` bounds end dates, as the service takes it.

    The service answers ``PAST_THE_END`` to an offset behind its results, which ends the scan; any other error status is raised.
    """
    offset = 0
    while True:
        data = {"tag": tag, "closed": str(closed).lower(), "limit": MARKETS_PAGE, "offset": offset}
        data |= {k: v for k, v in (("end_date_min", start_after), ("end_date_max", end_before)) if v}
        try:
            page = client("GET", f"{url}/markets", data)
        except HttpError as e:
            if e.status != PAST_THE_END:
                raise
            return
        yield from page
        if len(page) < MARKETS_PAGE:
            return
        offset += MARKETS_PAGE


def market(client: Callable, url: str, condition_id: str) -> dict:
    """One market."""
    return client("GET", f"{url}/markets/{condition_id}", {})


def fill_pages(client: Callable, url: str, token: str, side: str, start: int, end: int, page: int = FILLS_PAGE) -> Iterator[dict]:
    """A token's fills on one side from ``start`` to before ``end``.

    The cursor is the pair of time and log index: fills of the last page's last second come again and are told apart by it, so none is lost.
    """
    ts, li = start - 1, 2**62
    seen: set[tuple[str, str]] = set()
    while True:
        got = client("POST", url, {"query": fill_query(side), "variables": {"token": token, "ts": str(ts), "li": str(li), "end": str(end), "first": page}})
        found = (got.get("data") or {}).get("orderFilledEvents") or []
        for fill in found:
            if (key := (fill["transactionHash"], str(fill["logIndex"]))) not in seen:
                seen.add(key)
                yield fill
        if len(found) < page:
            return
        ts, li = max((int(f["timestamp"]), int(f["logIndex"])) for f in found)
        last = ts
        seen = {(f["transactionHash"], str(f["logIndex"])) for f in found if int(f["timestamp"]) == last}


def news_pages(client: Callable, sport: str, start: str, lane: int = 0, lanes: int = 1) -> Iterator[tuple[int, int, dict | None]]:
    """``(page, place, item)`` of a sport's news, newest first, until an item older than the start date.

    Of several lanes each reads every ``lanes``-th page and ends in ``(page, place, None)`` at the first such item that it meets; the first of these over all
    lanes is where the news end.
    """
    ask = lambda page: client("GET", f"{NEWS_URL}/{sport}/news", {"limit": NEWS_PAGE, "page": page})
    page = 1 + lane
    pages = ask(1).get("pageCount", 1) if lane else 1  # there may be fewer pages than lanes
    while page <= pages:
        data = ask(page)
        pages = data.get("pageCount", 1)
        for place, item in enumerate(data.get("articles", [])):
            if (item.get("published") or start) < start:
                if lanes > 1:
                    yield page, place, None
                return
            yield page, place, item
        page += lanes


def game_log(client: Callable, season: str, season_type: str, start: str | None = None, end: str | None = None, days: int = 1) -> Iterator[dict]:
    """The log of a season's games of one kind: column names and rows, as text.

    With ``start`` and ``end`` (yyyy-mm-dd, both included) the log of these days is asked for, ``days`` at a time, so no more is held at once.
    """
    at, last = (dt.date.fromisoformat(x) if x else None for x in (start, end))
    while True:
        data = {"LeagueID": "00", "Season": season, "SeasonType": season_type, "PlayerOrTeam": "T", "Sorter": "DATE", "Direction": "ASC", "Counter": 0}
        if at:
            until = min(last, at + dt.timedelta(days - 1))
            data |= {"DateFrom": f"{at:%m/%d/%Y}", "DateTo": f"{until:%m/%d/%Y}"}
        found = client("GET", GAMES_URL, data)["resultSets"][0]
        yield {"headers": found["headers"], "rowSet": [[None if x is None else str(x) for x in row] for row in found["rowSet"]]}
        if not at or until >= last:
            return
        at = until + dt.timedelta(1)


def slice_key(value: dict) -> str:
    """A slice as text; keys are sorted."""
    return json.dumps(value, sort_keys=True)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, slices: list[dict], fetch: Callable, client_for: Callable) -> None:
        self.options, self.slices, self.fetch, self.client_for = options, slices, fetch, client_for

    def partitions(self) -> list[Slice]:
        only = json.loads(self.options["only"]) if "only" in self.options else None
        return [Slice(s) for s in self.slices if only is None or slice_key(s) in only]

    def read(self, partition: Slice) -> Iterator[tuple]:
        client = self.client_for(len(self.slices))
        key = slice_key(partition.value)
        try:
            for payload in self.fetch(client, partition.value):
                yield key, json.dumps(payload), None
        except Exception as e:
            if self.options.get("failures") != "keep":
                raise
            yield key, None, f"{type(e).__name__}: {e}"


def _source(title: str, slices_of: Callable[[dict], list[dict]], fetch: Callable, client_for: Callable) -> type[DataSource]:
    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return "slice string, payload string, error string"

        def reader(self, schema) -> DataSourceReader:
            options = dict(self.options)
            return _Reader(options, slices_of(options), fetch, client_for)

    return Remote


def _listed(options: dict, name: str) -> list[str]:
    return [x for x in options.get(name, "").split(",") if x]


def _market_slices(options: dict) -> list[dict]:
    return [{"url": options["url"], "tag": t, "closed": options.get("closed", "true") == "true", "start": options.get("start_after"), "end": options.get("end_before")} for t in _listed(options, "tags")]


def _fill_slices(options: dict) -> list[dict]:
    """A slice for each token, side and stretch of ``slice_seconds``; slices are ranked token first, then maker before taker."""
    start, end = int(options["start"]), int(options["end"])
    width = int(options.get("slice_seconds", 30 * 86_400))
    return [
        {"url": options["url"], "token": t, "token_rank": rank, "side": side, "side_rank": s, "start": at, "end": min(at + width, end)}
        for rank, t in enumerate(_listed(options, "tokens")) for s, side in enumerate(("maker", "taker")) for at in range(start, end, width)
    ]


def _feed_fetch(client: Callable, s: dict) -> Iterator[dict]:
    body = client("GET", s["url"], {})
    yield {"feed_url": s["url"], "source": s["name"], "xml": body.decode("utf-8", "replace") if isinstance(body, bytes) else str(body)}


def markets_client(slices: int, transport=urllib_transport) -> Client:
    """The markets' client: one request a second over all tasks, bursts of 60, again after 429."""
    return Client(transport, rate=1 / max(1, slices), burst=max(1, 60 / max(1, slices)), retry=Retry(5, 2, 60, (429,)))


def fills_client(slices: int, transport=urllib_transport) -> Client:
    """The fills' client: again after connection errors and timeouts."""
    return Client(transport, rate=10 / max(1, slices), burst=10, retry=Retry(5, 2, 30, (), on_connection=True))


def news_client(slices: int, transport=urllib_transport) -> Client:
    """The news client: one request a second, no bursts."""
    return Client(transport, rate=1 / max(1, slices), burst=1, retry=Retry(1))


def pages_client(slices: int, transport=urllib_transport) -> Client:
    """The article pages' client: again after connection errors."""
    return Client(transport, rate=50 / max(1, slices), burst=5, retry=Retry(2, 1, 5, (429, 503), on_connection=True))


def feeds_client(slices: int, transport=urllib_transport) -> Client:
    """The feeds' client: five requests at once."""
    return Client(transport, rate=5, burst=5, retry=Retry(1))


def _lookup_slices(options: dict) -> list[dict]:
    ids = _listed(options, "ids")
    return [{"url": options["url"], "ids": ids[at : at + LOOKUPS]} for at in range(0, len(ids), LOOKUPS)]


def _news_slices(options: dict) -> list[dict]:
    """A slice for each sport, or for each sport's lane."""
    lanes = int(options.get("lanes", 1))
    told = [{}] if lanes == 1 else [{"lane": n, "lanes": lanes} for n in range(lanes)]
    return [{"sport": x, "start": options["start"]} | lane for x in _listed(options, "sports") for lane in told]


def _game_slices(options: dict) -> list[dict]:
    """A slice for each season and kind; with ``days``, one for each month of the two years that a season lies in."""
    whole = [{"season": x, "season_type": t} for x in _listed(options, "seasons") for t in SEASON_TYPES]
    if "days" not in options:
        return whole
    found = []
    for s in whole:
        first = int(s["season"][:4])
        months = [dt.date(first + n // 12, 1 + n % 12, 1) for n in range(25)]
        found += [s | {"start": a.isoformat(), "end": (b - dt.timedelta(1)).isoformat(), "days": int(options["days"])} for a, b in zip(months, months[1:])]
    return found


#: Format to the slices of its options.
_SLICES: dict[str, Callable[[dict], list[dict]]] = {
    "remote_markets": _market_slices,
    "remote_market": _lookup_slices,
    "remote_fills": _fill_slices,
    "remote_news": _news_slices,
    "remote_games": _game_slices,
    "remote_feeds": lambda o: json.loads(o["feeds"]),
}


def register(spark: SparkSession, markets=markets_client, fills=fills_client, news=news_client, feeds=feeds_client) -> None:
    """Register the formats ``remote_markets``, ``remote_market``, ``remote_fills``, ``remote_news``, ``remote_games`` and ``remote_feeds``; each reads JSON payloads by slice.

    Options: ``url``, ``tags``, ``closed``, ``start_after``, ``end_before``; ``url``, ``ids``; ``url``, ``tokens``, ``start``, ``end``, ``slice_seconds``;
    ``sports``, ``start``, ``lanes`` (tasks of a sport, whose rows ``news.before_the_end`` cuts); ``seasons``, ``days`` (of a request); ``feeds`` as JSON list of url and name. ``failures=keep`` turns a failed slice into a row.
    """
    sources = (
        ("remote_markets", lambda c, s: market_pages(c, s["url"], s["tag"], s["closed"], s["start"], s["end"]), markets),
        ("remote_market", lambda c, s: (market(c, s["url"], x) for x in s["ids"]), markets),
        ("remote_fills", lambda c, s: fill_pages(c, s["url"], s["token"], s["side"], s["start"], s["end"]), fills),
        ("remote_news", lambda c, s: ({"page": p, "pos": n, "sport": s["sport"], "item": i} for p, n, i in news_pages(c, s["sport"], s["start"], s.get("lane", 0), s.get("lanes", 1))), news),
        ("remote_games", lambda c, s: game_log(c, s["season"], s["season_type"], s.get("start"), s.get("end"), s.get("days", 1)), news),
        ("remote_feeds", _feed_fetch, feeds),
    )
    for title, fetch, client_for in sources:
        spark.dataSource.register(_source(title, _SLICES[title], fetch, client_for))


def through_cache(spark: SparkSession, title: str, options: dict[str, str], cache: ResponseCache) -> DataFrame:
    """``(slice, payload, error)`` of a registered format, with slices that the cache holds taken from there and new ones appended.

    The driver lists the slices that its options name. A slice that failed (under ``failures=keep``) gives its error and isn't
    kept, so the next run fetches it again.
    """
    keys = [slice_key(s) for s in _SLICES[title](options)]
    wanted = spark.createDataFrame([(http_key(title, k), k) for k in keys], "key string, slice string")
    missing = [r["slice"] for r in cache.missing(wanted).collect()]
    failed = None
    if missing:
        landed = f"{cache.path}-landing/{uuid.uuid4().hex}"
        spark.read.format(title).options(**options, only=json.dumps(missing)).load().write.parquet(landed)
        fetched = spark.read.schema("slice string, payload string, error string").parquet(landed)
        failed = fetched.where("error is not null")
        good = wanted.where(F.col("slice").isin(missing)).join(failed.select("slice"), "slice", "left_anti")
        bodies = good.join(fetched, "slice", "left").groupBy("key").agg(F.to_json(F.collect_list("payload")).alias("body"))  # one slice is what one task fetched
        cache.put(bodies)
    kept = cache.table(wanted).join(wanted, "key").select("slice", F.explode(F.from_json("body", "array<string>")).alias("payload"), F.lit(None).cast("string").alias("error"))
    return kept if failed is None else kept.unionByName(failed)


def fetched_pages(articles: DataFrame, cache: ResponseCache, client_for: Callable[[int], Client] | None = None, tasks: int = 10) -> DataFrame:
    """``(url, html)`` of the distinct urls of ``articles``; pages come from the cache, missing ones are fetched once and kept.

    ``tasks`` requests run at once. A page that can't be had by its nature (a status that trying again doesn't change) is kept as an empty text, as one that
    was looked at, and is null here; one that failed for now (``PASSING``, a connection, a timeout) isn't kept, and is fetched again by the next run.
    """
    make = client_for or pages_client
    urls = articles.select("url").where(F.coalesce("url", F.lit("")) != "").distinct()
    keyed = urls.select("url", F.concat(F.lit("page:"), "url").alias("key"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make(tasks)
        for batch in batches:
            bodies = []
            for url in batch["url"]:
                try:
                    body = client("GET", url, {})
                    bodies.append(body.decode("utf-8", "replace") if isinstance(body, bytes) else str(body))
                except HttpError as e:
                    bodies.append(None if e.status in PASSING else "")
                except OSError:
                    bodies.append(None)
                except ValueError:
                    bodies.append("")
            yield pd.DataFrame({"key": batch["key"], "body": bodies}).dropna()

    cache.put(cache.missing(keyed).repartition(tasks, "key").mapInPandas(fetch, "key string, body string"))
    return keyed.join(cache.table(keyed), "key", "left").select("url", F.nullif("body", F.lit("")).alias("html"))
