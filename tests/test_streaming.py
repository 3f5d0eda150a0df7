import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidloom.operators.dashboard import latest
from bidloom.streaming import jobs, queue
from bidloom.streaming.stories import ENDED, Story

MIN = 60_000_000
START = 1_704_067_200_000_000  # 2024-01-01
EVENT = "job_id string, micros long, status string, progress int"


def fold(events, watermark, stuck):
    """Events in the order of their times, one after the other."""
    running, last = None, None
    told = lambda to: max(p for at, _, p in events if at <= to)
    for at, status, _ in sorted(events):
        if running is not None and at > running + stuck and running + stuck < watermark:
            return "failed", told(running + stuck), running + stuck
        last = at
        if status in ENDED:
            return status, 100 if status == "done" else told(at), at
        running = at if status == "running" else running
    if running is not None and running + stuck < watermark:
        return "failed", told(running + stuck), running + stuck
    return "pending" if running is None else "running", told(last), last


def stories(seed, n_jobs=40):
    """Events of jobs over ten hours, as they arrive: up to an hour late, some of them twice."""
    rng, rows = random.Random(seed), []
    for j in range(n_jobs):
        at = START + rng.randint(0, 300 * MIN)
        for k in range(rng.randint(1, 9)):
            at += rng.randint(1, rng.choice([4, 30]) * MIN)
            status = "pending" if k == 0 else rng.choice(["running"] * 6 + ["done", "failed", "pending"])
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((f"j{j}", at, status, rng.randint(0, 100), at + rng.randint(0, 60 * MIN)))
    rows.append(("end", START + 700 * MIN, "pending", 0, START + 760 * MIN))
    return [r[:4] for r in sorted(rows, key=lambda r: r[4])]


@pytest.mark.parametrize("seed", range(60))
def test_a_story_is_the_same_in_any_order(seed):
    rng = random.Random(seed)
    events = [e[1:] for e in stories(seed, 1) if e[0] == "j0"]
    for watermark in (0, START + 100 * MIN, START + 10_000 * MIN):
        want = fold(events, watermark, 5 * MIN)
        for _ in range(5):
            rng.shuffle(events)
            story = Story()
            for at, status, p in events:
                story.add(at, status, p, 5 * MIN)
                story = Story.of(story.row())
            assert story.now(watermark, 5 * MIN)[:3] == want
        assert len(story.progress) <= 101


def stream_of(spark, tmp_path, rows, files=6, **how):
    """Rows written as files one after the other, each a batch."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], EVENT).withColumn("at", F.timestamp_micros("micros")).drop("micros")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set(*jobs.STORE)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return jobs.states(stream, **how)


def final(spark, path):
    return {r.job_id: r for r in latest(spark.read.schema(jobs.STATE).parquet(path), ["job_id"], "change").withColumn("micros", F.unix_micros("updated_at")).collect()}


def test_stream_equals_the_fold(spark, tmp_path):
    rows = stories(7)
    query = jobs.into_parquet(stream_of(spark, tmp_path, rows, late="2 hours"), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start()
    query.awaitTermination()
    watermark = max(r[1] for r in rows) // 1000 * 1000 - 120 * MIN
    got = {j: (r.status, r.progress, r.micros) for j, r in final(spark, f"{tmp_path}/out").items()}
    assert got == {j: fold([r[1:] for r in rows if r[0] == j], watermark, 5 * MIN) for j in {r[0] for r in rows}}
    assert len({s for s, _, _ in got.values()}) >= 3
    changes = spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/out").collect()
    assert Counter((r.job_id, r.change) for r in changes).most_common(1)[0][1] == 1


def test_ended_jobs_stay_ended(spark, tmp_path):
    """Late, repeated and further events of a job that is done, also when the watermark has passed its end."""
    at = lambda m: START + m * MIN
    first = [("a", at(0), "pending", 0), ("a", at(1), "running", 30), ("a", at(2), "done", 100), ("b", at(0), "running", 10), ("c", at(2), "pending", 0)]
    second = [("a", at(1) + 1, "running", 50), ("a", at(2), "done", 100), ("d", at(200), "pending", 0)]
    third = [("a", at(201), "running", 60), ("b", at(201), "done", 100), ("a", at(202), "failed", 1)]
    rows = first + second + third
    size = max(len(first), len(second), len(third))
    padded = [part + [("x", at(200), "pending", 0)] * (size - len(part)) for part in (first, second, third)]
    query = jobs.into_parquet(stream_of(spark, tmp_path, sum(padded, []), files=3, late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start()
    query.awaitTermination()
    changes = spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/out").collect()
    of = lambda j: [(r.status, r.progress) for r in sorted(changes, key=lambda r: r.change) if r.job_id == j]
    assert of("a") == [("done", 100)]
    assert of("b") == [("running", 10), ("failed", 10)] and final(spark, f"{tmp_path}/out")["b"].micros == at(5)
    assert of("c") == [("pending", 0)] and len(rows) == 11


def test_state_of_ended_jobs_goes_after_its_time(spark, tmp_path):
    rows = [(f"j{k}", START + k, "done", 100) for k in range(20)] + [("late", START + 3000 * MIN, "pending", 0)] * 2 + [("later", START + 3100 * MIN, "pending", 0)] * 20
    query = jobs.into_parquet(stream_of(spark, tmp_path, rows, files=3, late="1 hour", keep_minutes=60), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start()
    query.awaitTermination()
    assert {r.job_id for r in spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/out").collect()} == {f"j{k}" for k in range(20)} | {"late", "later"}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # two states and their timers


@pytest.mark.parametrize("buckets", [1, 7])
def test_jobs_of_one_bucket_keep_apart(spark, tmp_path, buckets):
    """Among events without progress."""
    rows = [(*r[:3], None if k % 3 == 0 else r[3]) for k, r in enumerate(stories(11))]
    jobs.into_parquet(stream_of(spark, tmp_path, rows, late="2 hours", buckets=buckets), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start().awaitTermination()
    watermark = max(r[1] for r in rows) // 1000 * 1000 - 120 * MIN
    got = {j: (r.status, r.progress, r.micros) for j, r in final(spark, f"{tmp_path}/out").items()}
    assert got == {j: fold([(*r[1:3], r[3] or 0) for r in rows if r[0] == j], watermark, 5 * MIN) for j in {r[0] for r in rows}}


def test_times_beyond_those_of_pandas(spark, tmp_path):
    year_3000 = 32_503_680_000_000_000
    rows = [("a", START, "running", 10), ("a", START + MIN, "running", 20), ("b", year_3000, "pending", 5), ("c", START + MIN, "pending", 0)]
    jobs.into_parquet(stream_of(spark, tmp_path, rows, files=1), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start().awaitTermination()
    got = {j: (r.status, r.progress, r.micros) for j, r in final(spark, f"{tmp_path}/out").items()}
    assert got == {"a": ("failed", 20, START + 6 * MIN), "b": ("pending", 5, year_3000), "c": ("pending", 0, START + MIN)}


def test_state_is_kept_by_buckets(spark, tmp_path):
    """The calls of the state store are as many as the buckets, however many jobs there are."""
    rows = [(f"j{k}", START + k, "running", 1) for k in range(14_000)]
    query = jobs.into_parquet(stream_of(spark, tmp_path, rows, files=1), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start()
    query.awaitTermination()
    assert len(final(spark, f"{tmp_path}/out")) == 14_000
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4096  # a state, a timer and its place in the order of timers


def test_an_end_is_told_when_the_watermark_passes_its_keeping_too(spark, tmp_path):
    rows = [("a", START, "running", 10), ("b", START + 3000 * MIN, "pending", 0)]
    jobs.into_parquet(stream_of(spark, tmp_path, rows, files=2, late="1 hour", keep_minutes=60), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start().awaitTermination()
    assert [(r.status, r.progress, r.micros) for j, r in final(spark, f"{tmp_path}/out").items() if j == "a"] == [("failed", 10, START + 5 * MIN)]


def test_queue_depth_and_waits_by_batch(spark, tmp_path):
    at = lambda m: START + m * MIN
    rows = [("a", at(0), "pending", 0), ("b", at(0), "pending", 0), ("c", at(1), "running", 0), ("a", at(3), "running", 1), ("c", at(4), "done", 1), ("d", at(4), "pending", 0), ("b", at(5), "running", 1), ("a", at(5), "done", 1), ("d", at(6), "failed", 1)]
    listener = queue.QueueDepth()
    spark.streams.addListener(listener)
    try:
        jobs.into_parquet(queue.observed(stream_of(spark, tmp_path, rows, files=3, late="1 hour")), f"{tmp_path}/out", f"{tmp_path}/cp", ["job_id", "change"]).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert [(d.waiting, d.running) for d in listener.depths[:3]] == [(2, 1), (2, 1), (0, 1)]
    assert listener.depths[1].longest_wait == 180 and (listener.depths[2].longest_wait, listener.depths[2].mean_wait) == (300, 210)
    table = latest(spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/out"), ["job_id"], "change")
    assert queue.depth(table) == {"pending": 0, "running": 1}


def test_uploads_are_created_once_and_failed_ones_again(spark, tmp_path):
    """Within the stream by its state, against the table of jobs by a batch."""
    from bidloom.operators.extract import retried

    rows = [("h1", "quote", "", 0), ("h1", "quote", "", 1), ("h1", "tender", "", 1), ("h2", "quote", "x", 2), ("h3", "quote", "", 3)]
    ups = spark.createDataFrame(rows, "file_hash string, type string, context string, m int").withColumn("at", F.timestamp_micros(START + F.col("m") * MIN)).drop("m")
    ups.coalesce(1).write.parquet(f"{tmp_path}/u/0")
    stream = spark.readStream.schema(ups.schema).parquet(f"{tmp_path}/u/*")
    known = spark.createDataFrame([("h2", "quote", "x", "done"), ("h3", "quote", "", "failed")], "file_hash string, type string, context string, status string")
    made = []
    jobs.created_once(stream).writeStream.foreachBatch(lambda batch, n: made.extend(map(tuple, retried(batch, known).select("file_hash", "type").collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(made) == [("h1", "quote"), ("h1", "tender"), ("h3", "quote")]
    hours = jobs.counts_by_hour(stream)
    assert hours.isStreaming
