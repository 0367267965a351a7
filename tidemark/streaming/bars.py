"""Bars of log odds over a stream of trades; an extension, with the batch operator as its oracle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.bars import MINUTE, ORDER


def streamed(trades: DataFrame, width: int = MINUTE, late: str = "10 minutes") -> DataFrame:
    """Bars of buckets that have trades, from a stream with ``ts_s``; a bar is final once the watermark has passed its bucket.

    Carrying closes into empty buckets is left to a batch over the bars, which are few.
    """
    place = F.struct(*ORDER)
    timed = trades.withColumn("at", F.timestamp_seconds("ts_s")).withWatermark("at", late)
    out = timed.groupBy("market_id", F.window("at", f"{width} seconds").alias("w")).agg(
        F.min_by("log_odds", place).alias("open_lo"),
        F.max("log_odds").alias("high_lo"),
        F.min("log_odds").alias("low_lo"),
        F.max_by("log_odds", place).alias("close_lo"),
        F.sum("size_usdc").alias("volume_usdc"),
        F.count("*").alias("trade_count"),
    )
    return out.withColumn("ts_min", F.unix_seconds("w.start")).drop("w")


#: A trade, or the life of a market where ``open_ts`` is there; ``ts_s`` is when the row counts as having come about.
ROWS = "market_id string, ts_s long, log_index long, tx_hash string, log_odds double, size_usdc double, open_ts long, close_ts long"
#: A bar, and which telling of the market's bars it belongs to.
BARS = "market_id string, ts_min long, open_lo double, high_lo double, low_lo double, close_lo double, volume_usdc double, trade_count long, revision long"


class Market:
    """What a market's stream has told so far: its life, first trade, the bars that may still change, and what goes on behind them.

    ``closed`` is the end of the buckets that the watermark has passed, ``close`` their last price in the grid; ``told`` is the end of the buckets whose bars were sent.
    """

    def __init__(self, width: int, kept: str | None = None) -> None:
        self.width = width
        held = json.loads(kept) if kept else {}
        self.life, self.first = held.get("life"), held.get("first")
        self.bars = {int(b): x for b, x in held.get("bars", {}).items()}
        self.closed, self.close, self.told, self.revision, self.headed = (held.get(x) for x in ("closed", "close", "told", "revision", "headed"))
        self.changed: set[int] = set()
        self.new_first = False

    def kept(self) -> str:
        return json.dumps({"life": self.life, "first": self.first, "bars": self.bars, "closed": self.closed, "close": self.close, "told": self.told, "revision": self.revision, "headed": self.headed})

    def live(self, start: int, end: int) -> None:
        """The market's life; the first one counts."""
        if self.life is None:
            first = start // self.width * self.width
            self.life = [first, first + max(1, -((first - end) // self.width)) * self.width]
            self.told = self.closed = first

    def trade(self, rows: pd.DataFrame) -> None:
        """Merge trades into the bars of their buckets."""
        rows = rows.sort_values(list(ORDER), kind="stable")
        head = rows.iloc[0]
        first = [[int(head["ts_s"]), int(head["log_index"]), head["tx_hash"]], float(head["log_odds"])]
        if self.first is None or first[0] < self.first[0]:
            self.first, self.new_first = first, True
        for bucket, own in rows.groupby(rows["ts_s"] // self.width * self.width):
            place = lambda r: [int(r["ts_s"]), int(r["log_index"]), r["tx_hash"]]
            odds = own["log_odds"]
            bar = [place(own.iloc[0]), float(odds.iloc[0]), float(odds.max()), float(odds.min()), place(own.iloc[-1]), float(odds.iloc[-1]), float(own["size_usdc"].sum()), len(own)]
            if (old := self.bars.get(int(bucket))) is not None:
                (a, b), (y, z) = sorted((old, bar), key=lambda x: x[0])[:1] * 2, sorted((old, bar), key=lambda x: x[4])[-1:] * 2
                bar = [a[0], b[1], max(old[2], bar[2]), min(old[3], bar[3]), y[4], z[5], old[6] + bar[6], old[7] + bar[7]]
            self.bars[int(bucket)] = bar
            self.changed.add(int(bucket))

    def tell(self, until: int, passed: int, early: bool) -> list[tuple]:
        """The bars of buckets that end by ``until``, and those told before that have changed; buckets that end by ``passed`` change no more.

        Unless ``early``, heads wait until nothing can come before the first trade.
        """
        if self.life is None:
            return []
        start, end = self.life
        last = min(end, max(self.told, until // self.width * self.width))
        inside = sorted(b for b in self.bars if start <= b < end)
        ahead = self.close is None and not any(b < last for b in inside)
        if ahead and (self.first is None or not early and self.first[0][0] >= passed) and passed < end:
            last = self.told  # a head isn't known before the first trade, or the close
        changed = [b for b in self.changed if start <= b < self.told]
        if self.new_first and self.told > start and self.headed != 0:
            changed.append(start)
        at, price = self.closed, self.close
        if changed and min(changed) < at:
            at, price = min(changed), None  # only heads lie before what is closed
        out, again = [], min([*changed, self.told])
        head = self.first[1] if self.first else 0.0
        while at < last:
            bar = self.bars.get(at)
            if at >= again:
                own = [*bar[1:4], bar[5], bar[6], bar[7]] if bar else [head if price is None else price] * 4 + [0.0, 0]
                out.append((at, *own))
            if bar:
                price = bar[5]
            elif price is None and self.close is not None and at + self.width == self.closed:
                price = self.close
            at += self.width
        self.headed = 1 if self.close is None and (not inside or inside[0] > start) or self.headed else 0
        self.told = max(self.told, last)
        shut = min(self.told, passed // self.width * self.width)
        for b in sorted(self.bars):
            if b + self.width <= max(shut, min(passed, start)) or b >= end:
                if start <= b < end:
                    self.close = self.bars[b][5]
                if b < end or b + self.width <= passed:
                    del self.bars[b]
        self.closed = max(self.closed, shut)
        self.revision = (self.revision or 0) + 1
        return [(*x, self.revision) for x in out]


class _Fill(StatefulProcessor):
    """One market's bars: rows go to ``Market``, timers tell it how far the watermark has come."""

    def __init__(self, width: int, early: int | None) -> None:
        self.width, self.early = width, early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("market", "kept string")

    def _market(self) -> Market:
        return Market(self.width, self.state.get()[0] if self.state.exists() else None)

    def _told(self, key: tuple, market: Market, passed: int, seen: int | None = None) -> Iterator[pd.DataFrame]:
        until = passed if self.early is None or seen is None else max(passed, seen - self.early)
        rows = market.tell(until, passed, self.early is not None)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if market.life and market.told < market.life[1]:
            self.handle.registerTimer(max(market.told + self.width, passed + 1) * 1000)
        elif market.life and market.closed < market.life[1]:
            self.handle.registerTimer(max(market.life[1], passed + 1) * 1000)
        self.state.update((market.kept(),))
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in BARS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        market, given = self._market(), pd.concat(list(rows))
        for life in given[given["open_ts"].notna()].itertuples():
            market.live(int(life.open_ts), int(life.close_ts))
        own = given[given["open_ts"].isna() & given["ts_s"].notna() & given["log_index"].notna() & given["log_odds"].notna()].fillna({"tx_hash": "", "size_usdc": 0.0})
        if len(own):
            market.trade(own)
        passed = max(timerValues.getCurrentWatermarkInMs() // 1000, -(1 << 40))
        yield from self._told(key, market, passed, int(own["ts_s"].max()) if len(own) else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, self._market(), timerValues.getCurrentWatermarkInMs() // 1000)

    def close(self) -> None:
        pass


def filled(rows: DataFrame, width: int = MINUTE, late: str = "10 minutes", early: int | None = None) -> DataFrame:
    """Bars of every bucket of every market's life, gaps and heads filled, from a stream of ``ROWS``; ``newest`` of them are the batch operator's.

    A bar is told when the watermark has passed its bucket; with ``early``, as soon as a trade of the market comes from so many seconds beyond it, and told again
    when later rows change it or what it repeats. A bucket without trades repeats the last close; those before the first trade wait for it, as the
    batch operator gives them its log odds, and are 0 if the market closes without one. Timers tell bars of markets in which nothing
    happens. A market's state holds what the watermark hasn't passed, never its history; trades that the watermark has passed are
    dropped by Spark. A market without a life is never told; trades without a time, log index or log odds aren't trades. The session needs the RocksDB state store (``state_store``).
    """
    timed = state_store(rows).withColumn("at", F.timestamp_seconds("ts_s")).withWatermark("at", late)
    return timed.groupBy("market_id").transformWithStateInPandas(_Fill(width, early), BARS, "Append", "EventTime")


def state_store(rows: DataFrame) -> DataFrame:
    """``rows``, after its session has been told to keep state in RocksDB, which timers need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows


def newest(bars: DataFrame) -> DataFrame:
    """The last telling of each bar."""
    rest = [c for c in bars.columns if c not in ("market_id", "ts_min", "revision")]
    return bars.groupBy("market_id", "ts_min").agg(F.max_by(F.struct(*rest), "revision").alias("_bar")).select("market_id", "ts_min", "_bar.*")
