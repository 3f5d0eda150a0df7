"""The job life cycle as streams: states per job, idempotent creation, stuck jobs, hourly counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import stories
from .stories import Story

STATE = "job_id string, status string, progress int, updated_at timestamp, was string, changed_at timestamp, change int"
#: The buckets' states are kept by RocksDB: what a batch does not touch is not in memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MICROS, MINUTE = 1_000, 60_000_000
#: Times that pandas can hold; for the watermark alone, what is before or after counts as these.
FIRST, LAST = "1678-01-01", "2262-01-01"
TOLD = ["job_id", "status", "progress", "micros", "was", "since", "change"]


class JobStates(StatefulProcessor):
    """One value state and one timer a bucket of jobs: what each job's events tell, and the earliest time at which the watermark decides a job's end or its keeping ends.

    Each call of the state store is a message to the JVM and back, and each answer a table of its own, so they are made once a bucket and not once a job.
    """

    def __init__(self, stuck: int, keep: int):
        self.stuck, self.keep = stuck, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stories", f"jobs array<struct<job_id string, {stories.STATE}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, kept = self._watermark(timerValues), self._kept()
        timer, heard, final = self._timer(kept), {}, set()
        for frame in rows:
            for job, micros, status, progress in zip(*(frame[c].tolist() for c in ("job_id", "micros", "status", "progress"))):
                if job not in heard:
                    story = heard[job] = kept.setdefault(job, Story())
                    if story.last_at is not None and story.now(watermark, self.stuck)[3]:
                        final.add(job)
                if job not in final:
                    heard[job].add(micros, status, None if progress is None or progress != progress else int(progress), self.stuck)
        told = [row for job, story in heard.items() for row in self._told(job, story, watermark)]
        return self._answer(kept, timer, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, kept, told = self._watermark(timerValues), self._kept(), []
        for job, story in [(j, s) for j, s in kept.items() if s.timer is not None and s.timer * MICROS <= watermark]:
            told += self._told(job, story, watermark)
            if story.timer is not None and story.timer * MICROS <= watermark:
                del kept[job]
        return self._answer(kept, None, told)

    @staticmethod
    def _watermark(timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() * MICROS

    @staticmethod
    def _timer(kept: dict[str, Story]) -> int | None:
        return min((s.timer for s in kept.values() if s.timer is not None), default=None)

    def _kept(self) -> dict[str, Story]:
        found = self.state.get()
        return {job: Story.of(rest) for job, *rest in found[0]} if found else {}

    def _told(self, job: str, story: Story, watermark: int) -> Iterator[tuple]:
        """The job's change of state, if there is one; the story's timer is set."""
        status, progress, at, final = story.now(watermark, self.stuck)
        due = at + self.keep if final else story.deadline(self.stuck)
        story.timer = None if due is None else due // MICROS + 1
        told, now = story.told, f"{status} {progress} {at}"
        was, since = (told.split(" ")[0], int(told.split(" ")[2])) if told else (None, None)
        if now != told:
            story.told, story.changes = now, story.changes + 1
            yield job, status, progress, at, was, since, story.changes

    def _answer(self, kept: dict[str, Story], registered: int | None, told: list[tuple]) -> Iterator[pd.DataFrame]:
        """The bucket's state and timer written; a timer that has fired is deleted by Spark."""
        timer = self._timer(kept)
        if timer != registered:
            if registered is not None:
                self.handle.deleteTimer(registered)
            if timer is not None:
                self.handle.registerTimer(timer)
        if kept:
            self.state.update(([(job, *story.row()) for job, story in kept.items()],))
        else:
            self.state.clear()
        return iter([pd.DataFrame(told, columns=TOLD, dtype=object)] if told else [])

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = "1 hour", stuck_minutes: int = 5, keep_minutes: int = 1440, buckets: int = 4096) -> DataFrame:
    """Stream of job events (job_id, at, status, progress) to the jobs' changes of state, numbered, with the state before and its time.

    A job that has ended, by the earliest report of it or by silence, stays as it ended:
    reports of a later time change nothing, nor do repeats, and the order in which events
    come does not matter as long as they come within ``late``. A running job that is
    silent for ``stuck_minutes`` of event time fails at the end of that time, once the
    watermark has passed it; a pending one may wait. Progress never falls, is the greatest
    told up to the end, and 100 when done. The state of an ended job is kept for
    ``keep_minutes`` after its end. Events without a job, a time or a status tell
    nothing. The session's state store must be ``STORE``. Jobs are kept in ``buckets`` by
    their hash, each read and written at once; a stream that starts again from its
    checkpoint needs the same number.
    """
    rows = events.filter("job_id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL").select("job_id", F.greatest(F.least(F.col("at").cast("timestamp"), F.lit(LAST).cast("timestamp")), F.lit(FIRST).cast("timestamp")).alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "status", F.col("progress").cast("int").alias("progress"))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")).withWatermark("at", late).groupBy("bucket")
    processor = JobStates(stuck_minutes * MINUTE, keep_minutes * MINUTE)
    told = bucketed.transformWithStateInPandas(processor, "job_id string, status string, progress int, micros long, was string, since long, change int", "Update", "EventTime")
    return told.select("job_id", "status", "progress", F.timestamp_micros("micros").alias("updated_at"), "was", F.timestamp_micros("since").alias("changed_at"), "change")


def created_once(uploads: DataFrame, within: str = "1 day") -> DataFrame:
    """The first upload of each content, type and context within a time."""
    return uploads.withWatermark("at", within).dropDuplicatesWithinWatermark(["file_hash", "type", "context"])


def counts_by_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type, closed when the watermark has passed."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("hour"), "type").agg(F.count("*").alias("events"))


def into_parquet(stream: DataFrame, path: str, checkpoint: str, key: list[str], mode: str = "update"):
    """A stream's batches appended once each: a batch that comes again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
