"""How many jobs wait and how long: metrics of the stream of job states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "job_queue"
WAITING, RUNNING = "pending", "running"


def observed(changes: DataFrame) -> DataFrame:
    """Changes of job states (job_id, status, was, changed_at, updated_at), with each batch's balance observed as ``NAME``.

    ``was`` is null for a job's first change. The balance has what came to and went from
    the queue and the workers, and how long what went had been there, in seconds.
    """
    status, was = F.col("status"), F.coalesce("was", F.lit(""))
    moved = status != was
    waited = (F.unix_micros("updated_at") - F.unix_micros("changed_at")) / 1_000_000
    balance = [F.count_if(moved & (status == s)).alias(f"to_{s}") for s in (WAITING, RUNNING)]
    balance += [F.count_if(moved & (was == s)).alias(f"from_{s}") for s in (WAITING, RUNNING)]
    balance += [f(F.when(moved & (was == WAITING), waited)).alias(f"{n}_wait") for n, f in (("longest", F.max), ("mean", F.avg))]
    return changes.observe(NAME, *balance)


def depth(states: DataFrame) -> dict[str, int]:
    """Waiting and running jobs in a table of the latest states: where a query that starts anew begins to count."""
    found = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (WAITING, RUNNING)]).first()
    return found.asDict()


@dataclass(frozen=True)
class Depth:
    batch: int
    waiting: int
    running: int
    longest_wait: float | None
    mean_wait: float | None


class QueueDepth(StreamingQueryListener):
    """Adds the balances of a query's batches up; a batch that is told twice counts once.

    ``spark.streams.addListener`` takes it; ``depths`` has a row a batch.
    """

    def __init__(self, waiting: int = 0, running: int = 0):
        self.waiting, self.running, self.depths = waiting, running, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and all(d.batch != event.progress.batchId for d in self.depths):
            self.waiting += row.to_pending - row.from_pending
            self.running += row.to_running - row.from_running
            self.depths.append(Depth(event.progress.batchId, self.waiting, self.running, row.longest_wait, row.mean_wait))
