"""Stateful processors with timers and expiring state: request limits that block and free, and alerts told once a session.

State is kept for each key by Spark's state store (RocksDB), so it moves with its partition and outlives a lost
executor. Limits run by the time of the events: a block ends by a timer, and what a key has stored goes by one too.
Alerts run by the clock: a word that was told expires.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds, requests allowed within them, and seconds of the block beyond.
LIMITS = ((60, 30, 60), (3600, 300, 3600), (86400, 1000, 86400))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_of(spark: SparkSession, by_clock: bool = False) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, which stateful processors need.

    Processors that run by the clock always ask for another batch without data, so that a bounded run wouldn't end.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not by_clock).lower())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


class RequestLimits(StatefulProcessor):
    """Verdicts of the requests of one user: allowed, `limit N` (over the limit of N seconds; a block begins), blocked; and freed where a block ends.

    State: the milliseconds of allowed requests within the longest limit, so no more of them than its limit; the end of the
    running block; the ends of blocks whose timer hasn't come. Requests of a batch are judged in the order of their time.
    """

    def __init__(self, limits=LIMITS):
        self.limits = sorted(limits)
        self.longest = max(w for w, _, _ in limits) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.allowed = handle.getMapState("allowed", "at long", "n int")
        self.until = handle.getValueState("until", "at long")
        self.ends = handle.getMapState("ends", "at long", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.allowed.iterator()}
        until = self.until.get()[0] if self.until.exists() else 0
        last = 0
        for now in sorted(r["at"] for r in rows):
            last = now
            if now < until:
                yield Row(user_id=key[0], at=now, verdict="blocked")
                continue
            for old in [t for t in held if t <= now - self.longest]:
                held.pop(old)
                self.allowed.removeKey((old,))
            for window, most, block in self.limits:
                if sum(n for t, n in held.items() if now - t < window * 1000) >= most:
                    until = now + block * 1000
                    self.until.update((until,))
                    self.ends.updateValue((until,), (1,))
                    self.handle.registerTimer(until)
                    yield Row(user_id=key[0], at=now, verdict=f"limit {window}")
                    break
            else:
                held[now] = held.get(now, 0) + 1
                self.allowed.updateValue((now,), (held[now],))
                yield Row(user_id=key[0], at=now, verdict="allowed")
        self.handle.registerTimer(max(last, until) + self.longest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.ends.containsKey((now,)):
            self.ends.removeKey((now,))
            if self.until.exists() and self.until.get()[0] == now:
                self.until.clear()
            yield Row(user_id=key[0], at=now, verdict="freed")
        for at in [k[0] for k in self.allowed.keys() if k[0] <= now - self.longest]:
            self.allowed.removeKey((at,))

    def close(self) -> None:
        pass


def limited(events: DataFrame, limits=LIMITS, late: str = "1 hour") -> DataFrame:
    """user_id, at (milliseconds), verdict of each request, and a row `freed` for each block that ended by the watermark."""
    requests = events.select("user_id", "ts", F.unix_millis("ts").alias("at")).withWatermark("ts", late)
    return requests.groupBy("user_id").transformWithState(RequestLimits(limits), "user_id long, at long, verdict string", "append", "EventTime")


class WordAlerts(StatefulProcessor):
    """New words of a session, each told once; what was told is forgotten after `kept` milliseconds of the clock."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "word string", "n long", ttlDurationMs=self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        words = {r["word"] for r in rows}
        for word in sorted(w for w in words if w is not None):
            if not self.told.containsKey((word,)):
                self.told.updateValue((word,), (1,))
                yield Row(session=key[0], word=word)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def session_alerts(words: DataFrame, known: DataFrame, kept: int = 86_400_000) -> DataFrame:
    """session and word for each word (session, word) that the vocabulary doesn't hold, once a session."""
    new = words.select("session", "word").join(known.select(F.col(known.columns[0]).alias("word")), "word", "left_anti")
    return new.groupBy("session").transformWithState(WordAlerts(kept), "session long, word string", "append", "ProcessingTime")
