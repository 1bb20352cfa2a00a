"""The job state machine over a stream, with the timer that ends jobs nobody reports on, and a listener of progress."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators.jobs import STALE_AFTER, TRANSITIONS
from docweave.sources.versions import TableStore

OUT = "job_id bigint, status string, moves bigint, timed_out boolean"


def job_machine(actions: DataFrame, delay: str = "1 minute", stale_after: int = STALE_AFTER, keep_ended: int = 3600) -> DataFrame:
    """job_id, status, moves, timed_out after each batch of a stream of (job_id, seq, action, ts).

    A job that is processing fails when the watermark has passed its last action by ``stale_after`` seconds.  One that has
    ended, or was never started, is forgotten when the watermark has passed its last action by ``keep_ended`` seconds, so state
    follows the jobs that are open.  Until then a failed or cancelled job can be queued again.  An action on a forgotten job is
    one on a job that nobody knows: it begins as pending, so a late ``complete`` or ``requeue`` changes nothing.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, moves, last = state.get if state.exists else ("pending", 0, 0)
        late = state.hasTimedOut
        if late and status != "processing":
            state.remove()
            return
        if late:
            status, moves = "failed", moves + 1
        for b in batches:
            for action, ts in b.sort_values("seq")[["action", "ts"]].itertuples(index=False):
                status, moves = (TRANSITIONS[status, action], moves + 1) if (status, action) in TRANSITIONS else (status, moves)
                last = max(last, int(ts.timestamp() * 1000))
        state.update((status, moves, last))
        wait = stale_after if status == "processing" else keep_ended
        state.setTimeoutTimestamp(max(last + wait * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "moves": [moves], "timed_out": [late and status == "failed"]})

    rows = actions.withWatermark("ts", delay)
    return rows.groupBy("job_id").applyInPandasWithState(work, OUT, "status string, moves bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


PROGRESS = "name string, batch bigint, input_rows bigint, rows_a_second double, stages string"


class ProgressLog(StreamingQueryListener):
    """Appends what every batch of every query reports to files below ``path``, one file a ``every`` batches, so that the driver
    never holds more than these; ``progress`` reads them.  Files are written by the file system alone, as a listener must not
    start jobs."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100) -> None:
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.held: list[str] = []
        self.ended = 0

    def flush(self) -> None:
        if self.held:
            rows, self.held = self.held, []
            TableStore(self.spark, self.path).files.publish(f"{self.path}/{uuid.uuid4().hex}.json", "\n".join(rows) + "\n")

    def progress(self) -> DataFrame:
        """name, batch, input_rows, rows_a_second, stages (durations as JSON) of every batch so far."""
        self.flush()
        return self.spark.read.schema(PROGRESS).json(self.path)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.held.append(json.dumps({"name": p.name or str(p.id), "batch": p.batchId, "input_rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "stages": json.dumps(p.durationMs)}))
        if len(self.held) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended += 1
        self.flush()
