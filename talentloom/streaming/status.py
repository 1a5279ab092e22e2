"""Status streams: current state, quota audit, batch progress, stuck records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talentloom import rules
from talentloom.operators import progress, records


def read_status(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of status events landed as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_status(events: DataFrame, key: str = "resume_id") -> DataFrame:
    """Running current status per record; an event that comes late never replaces a newer one."""
    return records.latest_status(events, key)


def stream_quota_audit(events: DataFrame, key: str = "user_id", limit: int = rules.REQUESTS_PER_HOUR,
                       delay: str = "10 minutes") -> DataFrame:
    """Hours over the limit; state of an hour is dropped once the watermark has passed it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return progress.quota_audit(stamped, key, limit)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(events: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """A stream of keyed state with timers; its store must be RocksDB, which streams that started with another store do not notice."""
    events.sparkSession.conf.set(_STORE, _ROCKS)
    return events.groupBy(key).transformWithStateInPandas(processor, out, "Update", "EventTime")


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


class _Ending(StatefulProcessor):
    """State of a key that goes once the watermark has passed its latest event by some time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def end_after(self, latest_micros: int, timers) -> None:
        """One timer per key: the old one goes."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(latest_micros // 1000 + self.keep_ms, timers.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


class _Current(_Ending):
    """The newest status of a record, told whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ts bigint, event_id bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best = held
        for part in rows:
            for ts, event, status in zip(part["ts"], part["event_id"], part["status"]):
                place = (_micros(ts), int(event), status)
                if best is None or place[:2] > best[:2]:
                    best = place
        if best != held:
            self.newest.update(best)
            self.end_after(best[0], timerValues)
            yield pd.DataFrame({"resume_id": [key[0]], "status": [best[2]], "ts": [pd.Timestamp(best[0], unit="us")], "event_id": [best[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())


def stream_status_changes(events: DataFrame, keep: str = "30 days", delay: str = "1 day") -> DataFrame:
    """(resume_id, status, ts, event_id) whenever the current status of a record changes (update mode), for streams without an end.

    ``events``: resume_id, ts, event_id, status. A record's state is one status; it goes ``keep`` after its latest event, when the watermark, which runs
    ``delay`` behind, has passed that. An event that comes late never replaces a newer one. ``stream_status`` keeps all records for ever instead.
    """
    stamped = events.select("resume_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status").withWatermark("ts", delay)
    keep_ms = pd.Timedelta(keep) // pd.Timedelta("1ms")
    return _keyed(stamped, "resume_id", _Current(keep_ms), "resume_id bigint, status string, ts timestamp, event_id bigint")


_PROGRESS_OUT = "batch bigint, total bigint, completed bigint, failed bigint, processing bigint, progress int, status string, n_events bigint"


class _Progress(_Ending):
    """Files of a batch by their latest status, in a map, and the counts over them; only files with new events are touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "ts bigint, event_id bigint, status string")
        self.counts = handle.getValueState("counts", "total bigint, completed bigint, failed bigint, seen bigint, latest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, completed, failed, seen, latest = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        newest: dict[str, tuple] = {}
        for part in rows:
            seen += len(part)
            for file, ts, event, status in zip(part["resume_id"], part["ts"], part["event_id"], part["status"]):
                place = (_micros(ts), int(event), status)
                if str(file) not in newest or place[:2] >= newest[str(file)][:2]:
                    newest[str(file)] = place
        for file, place in newest.items():
            latest = max(latest, place[0])
            old = self.files.getValue((file,)) if self.files.containsKey((file,)) else None
            if old is not None and tuple(old[:2]) > place[:2]:
                continue
            self.files.updateValue((file,), place)
            total += old is None
            completed += (place[2] == rules.COMPLETED) - (old is not None and old[2] == rules.COMPLETED)
            failed += (place[2] in rules.FAILURE_STATUSES) - (old is not None and old[2] in rules.FAILURE_STATUSES)
        self.counts.update((total, completed, failed, seen, latest))
        self.end_after(latest, timerValues)
        waiting = total - completed - failed
        label = "processing" if waiting else "completed" if completed else "failed"
        yield pd.DataFrame({"batch": [key[0]], "total": [total], "completed": [completed], "failed": [failed], "processing": [waiting],
                            "progress": [100 * (completed + failed) // total], "status": [label], "n_events": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.files.clear()
        self.counts.clear()
        return iter(())


def stream_bulk_progress(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running progress per batch by the latest status of each file (update mode); ``n_events`` tells newer rows from older ones.

    ``events``: batch, resume_id, ts, event_id, status. The state of a batch is a map of one status per file and the counts; a trigger reads and writes
    only the files it has events of. All of it goes when the watermark has passed the latest event by ``delay``.
    """
    stamped = events.select("batch", "resume_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status").withWatermark("ts", delay)
    return _keyed(stamped, "batch", _Progress(0), _PROGRESS_OUT)


_STUCK_OUT = "resume_id bigint, status string, waiting_seconds bigint"
_STUCK_STATE = "status string, started timestamp, latest timestamp, told boolean"
_KEEP_MS = 24 * 3600 * 1000  # an alert is remembered so long


def stream_stuck(events: DataFrame, seconds: int = rules.STUCK_AFTER_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """Alert once when a record has no final status ``seconds`` after its start, by an event-time timer.

    ``events``: resume_id, ts (timestamp), status. State per record is one status, two times and a mark. A final status, and an alert, stay
    in the state until the watermark has passed them, so an older event that comes late does not start the record anew; what comes
    later than the watermark is dropped by Spark.
    """
    def track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, started, latest, told = state.get if state.exists else (None, None, None, False)
        if state.hasTimedOut:
            if told or status in rules.TERMINAL_STATUSES:
                state.remove()
                return
            state.update((status, started, latest, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + _KEEP_MS)
            yield pd.DataFrame({"resume_id": [key[0]], "status": [status], "waiting_seconds": [seconds]})
            return
        for batch in batches:
            for ts, new in sorted(zip(batch["ts"], batch["status"])):
                if latest is None or ts >= latest:
                    latest, status = ts, new
                if new == rules.PROCESSING and (started is None or ts > started):
                    started = ts
        started = started if started is not None else latest
        state.update((status, started, latest, told))
        now = state.getCurrentWatermarkMs() + 1
        if status in rules.TERMINAL_STATUSES:
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000) + 1, now))
        elif told:
            state.setTimeoutTimestamp(now + _KEEP_MS)
        else:
            state.setTimeoutTimestamp(max(int(started.timestamp() * 1000) + seconds * 1000, now))

    return (
        events.withWatermark("ts", delay).groupBy("resume_id")
        .applyInPandasWithState(track, _STUCK_OUT, _STUCK_STATE, "append", "EventTimeTimeout")
    )
