"""Request limits and idempotent acceptance on a live stream, with keyed state that event-time timers clear.

An answer is given when the watermark has passed it, so that no row still to come could change it: files in any order of
time give the same rows as the batch operators, as long as none is later than the watermark allows. Rows that are later are
dropped by Spark and counted by settle().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rulewright.operators.stream import LIMITS
from rulewright.sources.files import scratch

from . import jobs

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_PARTITIONS = "spark.sql.shuffle.partitions"
LIMITED = "policy string, subject long, window_start timestamp, event_id long, place int, n long"
#: Shards of the (policy, subject) of request limits, how many windows one value of the state is of, and how many requests of
#: a shard are merged into it at once.
SHARDS, STRETCH, WAITING = 128, 24, 100_000
ACCEPTED = "tenant long, request_key long, event_id long"


def _frame(rows: list[tuple], columns: list[str], texts: tuple[str, ...] = ()) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(texts, object))


class _Limiter(StatefulProcessor):
    """For each window of a (policy, subject) how many requests came and the first `limit` of them; all go when it closes.

    A key is a shard of the (policy, subject). What it knows of STRETCH windows in a row is one value, and it has one timer,
    for the first of its windows to close: each access to the state and each timer is a call between Spark and Python.
    """

    def __init__(self, limits: dict[str, int], window: int):
        self.limits, self.size = limits, window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "stretch long", "held array<struct<start: long, policy: string, subject: long, n: long, first: array<struct<at: long, event_id: long>>>>")
        self.next = handle.getValueState("next", "start long")

    def _closes(self, start: int) -> int:
        return (start + self.size) // 1000

    def _wait_for(self, start: int) -> None:
        self.next.update((start,))
        self.handle.registerTimer(self._closes(start))

    def _settle(self, came: dict[int, dict[tuple, list[tuple]]]) -> None:
        """Bring the state to what came: requests by stretch and (start, policy, subject)."""
        for stretch, asked in came.items():
            known = {}
            if self.held.containsKey((stretch,)):
                known = {tuple(h[:3]): (h[3], [tuple(f) for f in h[4]]) for h in self.held.getValue((stretch,))[0]}
            for key, requests in asked.items():
                n, first = known.get(key, (0, []))
                known[key] = (n + len(requests), sorted(first + requests)[: self.limits.get(key[1], 0)])
            self.held.updateValue((stretch,), ([(*key, n, first) for key, (n, first) in known.items()],))
        starts = [key[0] for asked in came.values() for key in asked]
        waits = self.next.get()[0] if self.next.exists() else None
        if starts and (waits is None or min(starts) < waits):
            if waits is not None:
                self.handle.deleteTimer(self._closes(waits))
            self._wait_for(min(starts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size, came, waiting = self.size, {}, 0
        for part in rows:
            for at, policy, subject, event_id in zip(part["at"].tolist(), part["policy"].tolist(), part["subject"].tolist(), part["event_id"].tolist(), strict=True):
                came.setdefault(at // (size * STRETCH), {}).setdefault((at // size * size, policy, subject), []).append((at, event_id))
            waiting += len(part)
            if waiting >= WAITING:
                self._settle(came)
                came, waiting = {}, 0
        self._settle(came)
        yield _frame([], ["policy", "subject", "window_start", "event_id", "place", "n"], ("policy",))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, still = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        for stretch in sorted(k[0] for k in self.held.keys()):  # noqa: SIM118
            if self._closes(stretch * self.size * STRETCH) > passed:
                still.append(stretch * self.size * STRETCH)  # no window of it starts earlier
                break
            found = self.held.getValue((stretch,))[0]
            rows = [(h[1], h[2], pd.Timestamp(h[0], unit="us"), f[1], i, h[3]) for h in found if self._closes(h[0]) <= passed for i, f in enumerate(h[4], 1)]
            if left := [(*h[:4], [tuple(f) for f in h[4]]) for h in found if self._closes(h[0]) > passed]:
                still.append(min(h[0] for h in left))
                self.held.updateValue((stretch,), (left,))
            else:
                self.held.removeKey((stretch,))
            yield _frame(rows, ["policy", "subject", "window_start", "event_id", "place", "n"], ("policy",))
        self.next.clear()
        if still:
            self._wait_for(min(still))

    def close(self) -> None:
        pass


class _Firsts(StatefulProcessor):
    """The earliest request of a key, until the watermark passes it; then a mark that it is taken, for `keep` seconds."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at long, event_id long, taken boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.best.get() if self.best.exists() else None
        if had is None or not had[2]:
            best = had and (had[0], had[1])
            for part in rows:
                if len(part):
                    first = min(zip(part["at"].tolist(), part["event_id"].tolist(), strict=True))
                    best = min(best, first) if best else first
            if best and (had is None or best != (had[0], had[1])):
                if had is not None:
                    self.handle.deleteTimer(had[0] // 1000 + 1)
                self.best.update((*best, False))
                self.handle.registerTimer(best[0] // 1000 + 1)
        yield _frame([], ["tenant", "request_key", "event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, event_id, taken = self.best.get()
        if taken:
            self.best.clear()
            yield _frame([], ["tenant", "request_key", "event_id"])
        else:
            self.best.update((at, event_id, True))
            self.handle.registerTimer(at // 1000 + 1 + self.keep * 1000)
            yield _frame([(key[0], key[1], event_id)], ["tenant", "request_key", "event_id"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, limits: dict[str, int] = LIMITS, window: int = 3600, late: str = "1 hour") -> DataFrame:
    """LIMITED for the requests that are accepted: the first `limit` of each (policy, subject) and fixed window of `window`
    seconds by time, then event_id; n are all that came in the window. stream: policy, subject, ts, event_id.

    A policy without a limit accepts nothing. Rows without a time or a key are no requests. State is a count and at most
    `limit` rows for each open window, kept by shard of the (policy, subject); it goes when the watermark passes the window's end.
    """
    rows = stream.where("policy is not null and subject is not null and ts is not null").withWatermark("ts", late).select("policy", F.col("subject").cast("long").alias("subject"), "event_id", "ts", F.unix_micros("ts").alias("at"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("policy", "subject"), F.lit(SHARDS)).cast("int")).groupBy("shard").transformWithStateInPandas(_Limiter(dict(limits), window), LIMITED, "Append", "EventTime")


def accepted(stream: DataFrame, keep: int = 86_400, late: str = "1 hour") -> DataFrame:
    """ACCEPTED: the earliest request of each (tenant, request_key) by time, then event_id. stream: tenant, request_key, ts,
    event_id. A key is taken for `keep` seconds after its request, then it is forgotten and may be used again."""
    rows = stream.where("tenant is not null and request_key is not null and ts is not null").withWatermark("ts", late).select("tenant", "request_key", "event_id", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("tenant", "request_key").transformWithStateInPandas(_Firsts(keep), ACCEPTED, "Append", "EventTime")


def settle(spark: SparkSession, folder: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> tuple[DataFrame, int]:
    """All that step() answers for the events files of a folder, and how many rows came too late.

    After the last file a row far in the future moves the watermark past all windows; it is left out of no answer, as its own
    never comes. A batch that is run again replaces its own part.
    """
    flush, path, at = (scratch(spark, t) for t in ("flush", "settled", "stream"))
    events = jobs.events(spark, folder, files_per_batch)
    empty = spark.createDataFrame([], events.schema)
    empty.write.parquet(flush)
    ends = spark.readStream.schema(events.schema).parquet(flush)
    result, dropped = step(events.unionByName(ends)), 0
    # each task of a batch starts a Python worker and opens its state, whether rows come or not: as many as run at once
    parts = min(int(spark.conf.get(_PARTITIONS)), max(8, spark.sparkContext.defaultParallelism))
    during = {_PROVIDER[0]: _PROVIDER[1], _PARTITIONS: str(parts)}
    before = {name: spark.conf.get(name, None) for name in during}
    for name, value in during.items():
        spark.conf.set(name, value)
    try:
        for last in (False, True, True):
            if last:
                marks = {"event_id": -1, "ts": "2200-01-01", "user_id": -1, "event_type": "end"}
                spark.range(1).select(*(F.lit(marks.get(f.name)).cast(f.dataType).alias(f.name) for f in events.schema)).write.mode("append").parquet(flush)
            query = result.writeStream.outputMode("append").option("checkpointLocation", at).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(availableNow=True).start()
            query.awaitTermination()
            dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"])
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(result.schema).parquet(path).drop("batch"), dropped


_POLICY = "CASE event_type WHEN 'view' THEN 'feedback' WHEN 'click' THEN 'reviews' WHEN 'purchase' THEN 'rules' ELSE 'batch' END"
#: How late a row of a backlog may come: its files are read in any order of time.
BACKLOG = "3650 days"


def str_01_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted requests by live state."""
    ends = F.col("event_type") == "end"
    step = lambda s: limited(s.select(F.when(ends, "end").otherwise(F.expr(_POLICY)).alias("policy"), F.col("user_id").alias("subject"), "ts", "event_id"), late=BACKLOG)
    return settle(spark, sf_dir, step)[0]


def str_02_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted idempotency keys by live state."""
    step = lambda s: accepted(s.select((F.col("user_id") % 5).alias("tenant"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.when(F.col("event_type") == "end", -1)).alias("request_key"), "ts", "event_id"), keep=10 * 365 * 86_400, late=BACKLOG)
    return settle(spark, sf_dir, step)[0]


QUERIES = {"str_01_live": str_01_live, "str_02_live": str_02_live}
ORACLES = {
    "str_01_live": "SELECT policy, subject, date_trunc('hour', ts) AS window_start, event_id, CAST(place AS INTEGER) AS place, n FROM (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY policy, subject, date_trunc('hour', ts)) AS n FROM (SELECT event_id, ts, user_id AS subject, CASE event_type WHEN 'view' THEN 'feedback' WHEN 'click' THEN 'reviews' WHEN 'purchase' THEN 'rules' ELSE 'batch' END AS policy FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) e WINDOW w AS (PARTITION BY policy, subject, date_trunc('hour', ts) ORDER BY ts, event_id)) x WHERE place <= CASE policy " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in LIMITS.items()) + " ELSE 0 END",
    "str_02_live": "SELECT tenant, request_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant, request_key ORDER BY ts, event_id) AS rn FROM (SELECT event_id, ts, user_id % 5 AS tenant, CAST(json_extract_string(props, '$.k') AS BIGINT) AS request_key FROM events) e WHERE ts IS NOT NULL AND tenant IS NOT NULL AND request_key IS NOT NULL) x WHERE rn = 1",
}
