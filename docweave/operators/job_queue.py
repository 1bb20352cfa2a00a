"""Jobs that several workers take from one table: claims with leases, priorities, pausing, and results that count once.

A claim is a commit: of two workers that want the same jobs one gets a conflict and looks again.  What a job did and that it
is done are one commit too.  So the jobs of a worker that died are taken over when their lease has ended, and nothing of the
dead worker's half-done batch was ever seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import ingest
from docweave.operators.ingest import Library, Steps
from docweave.sources.versions import Conflict, Snapshot, TableStore, Transaction

JOBS = "job_id bigint, doc_id bigint, job_type string, priority bigint, created_at double, updated_at double, started_at double, completed_at double, status string, retry_count bigint, max_retries bigint, worker_id string, lease_until double, error_message string"
_NAMES = [c.split()[0] for c in JOBS.split(", ")]
#: Statuses that nothing follows by itself.
ENDED = ("completed", "failed", "cancelled")


@dataclass(frozen=True)
class JobQueue:
    """The jobs of a store, beside the tables of the library that they change.

    job_type: add and update bring a document in, remove takes it out.  Priority 1 goes first, then the oldest.
    """

    store: TableStore
    lease: float = 300.0
    tries: int = 20

    def jobs(self, snapshot: Snapshot | None = None) -> DataFrame:
        now = snapshot or self.store.snapshot()
        return now.table("jobs") if "jobs" in now.tables else self.store.spark.createDataFrame([], JOBS)

    def _commit(self, change: Callable[[Transaction], bool]) -> bool:
        """Applies a change to the newest version, again if another commit came first; whether there was anything to change."""
        for _ in range(self.tries):
            tx = self.store.begin()
            try:
                if not change(tx):
                    tx.abandon()
                    return False
                tx.commit()
                return True
            except Conflict:
                continue
            except Exception:
                tx.abandon()
                raise
        raise Conflict(f"no commit in {self.tries} tries")

    def _put(self, tx: Transaction, rows: DataFrame) -> DataFrame:
        """Rows in place of those of the same jobs; they are worked out once, and read back from what was written."""
        segment = tx.append("jobs", rows.select(*_NAMES), "job_id")
        written = Snapshot(self.store, tx.version, tx.tables).read("jobs", [segment])
        if segment["rows"]:
            tx.delete("jobs", written.select("job_id"))
        return written

    def add(self, jobs: DataFrame, now: float, max_retries: int = 3) -> None:
        """Queues jobs (job_id, doc_id, job_type, priority); one whose id is there already is left as it is."""
        new = {"created_at": F.lit(now), "updated_at": F.lit(now), "status": F.lit("pending"), "retry_count": F.lit(0).cast("bigint"), "max_retries": F.lit(max_retries).cast("bigint")}
        rows = jobs.select("job_id", "doc_id", "job_type", F.col("priority").cast("bigint").alias("priority"), *[v.alias(k) for k, v in new.items() if k not in jobs.columns], *[c for c in new if c in jobs.columns])
        none = [F.lit(None).cast("double").alias(c) for c in ("started_at", "completed_at", "lease_until")] + [F.lit(None).cast("string").alias(c) for c in ("worker_id", "error_message")]
        rows = rows.dropDuplicates(["job_id"]).select("*", *none)
        self._commit(lambda tx: self._put(tx, rows.join(self.jobs(tx.base).select("job_id"), "job_id", "left_anti")) is not None)

    # ---- pausing and cancelling

    def paused(self, snapshot: Snapshot | None = None) -> bool:
        now = snapshot or self.store.snapshot()
        return "queue" in now.tables and bool(now.table("queue").first()["paused"])

    def pause(self, paused: bool = True) -> None:
        """No new claims from now on; batches that were claimed go on."""
        self._commit(lambda tx: tx.overwrite("queue", self.store.spark.createDataFrame([(paused,)], "paused boolean")) is not None)

    def cancel(self, now: float, ids: DataFrame | None = None) -> None:
        """Pending jobs (job_id; all, if none are named) end as cancelled; others stay as they are."""

        def change(tx: Transaction) -> bool:
            rows = self.jobs(tx.base).where("status = 'pending'")
            rows = rows if ids is None else rows.join(ids.select("job_id").distinct(), "job_id", "left_semi")
            return self._put(tx, rows.withColumns({"status": F.lit("cancelled"), "completed_at": F.lit(now), "updated_at": F.lit(now)})) is not None

        self._commit(change)

    # ---- work

    def claim(self, worker: str, now: float, limit: int) -> bool:
        """Gives a worker the first ``limit`` jobs that wait, or whose lease has ended, until ``now`` and the lease; whether there are any.

        Taking a job over counts as a try; one that has no tries left fails instead.
        """

        def change(tx: Transaction) -> bool:
            if self.paused(tx.base):
                return False
            late = (F.col("status") == "processing") & (F.col("lease_until") < now)
            waiting = self.jobs(tx.base).where((F.col("status") == "pending") | late).orderBy("priority", "created_at", "job_id").limit(limit)
            over = late & (F.col("retry_count") >= F.col("max_retries"))
            rows = waiting.withColumns(
                {
                    "status": F.when(over, "failed").otherwise("processing"),
                    "retry_count": F.col("retry_count") + F.when(late & ~over, 1).otherwise(0),
                    "error_message": F.when(over, "no worker ended it").otherwise(F.col("error_message")),
                    "completed_at": F.when(over, now),
                    "started_at": F.when(over, F.col("started_at")).otherwise(now),
                    "worker_id": F.when(over, F.col("worker_id")).otherwise(worker),
                    "lease_until": F.when(over, F.lit(None).cast("double")).otherwise(now + self.lease),
                    "updated_at": F.lit(now),
                }
            )
            return self._put(tx, rows).limit(1).count() > 0

        return self._commit(change)

    def work(self, worker: str, documents: DataFrame, now: float, steps: Steps | None = None) -> Library:
        """Does the worker's claimed jobs on documents (doc_id, source, text) and ends them, in one commit.

        A job whose document isn't there, or comes out corrupted, is pending again while it has tries, else failed.  Jobs that
        another worker took over meanwhile are none of this one's, whatever was worked out for them.
        """

        def change(tx: Transaction) -> bool:
            mine = self.jobs(tx.base).where((F.col("status") == "processing") & (F.col("worker_id") == worker))
            if not mine.limit(1).count():
                return False
            out = mine.where("job_type = 'remove'").select("doc_id")
            docs = documents.join(mine.where("job_type <> 'remove'").select("doc_id").distinct(), "doc_id", "left_semi")
            ingest.ingest_into(tx, docs, steps or Steps(), out)
            states = ingest.Library(Snapshot(self.store, tx.version, tx.tables)).registry.select("doc_id", "state", F.col("last_error").alias("why"))
            rows = mine.join(states, "doc_id", "left")
            gone = F.col("job_type") == "remove"
            fine = gone | F.coalesce(F.col("state") == "indexed", F.lit(False))
            again = ~fine & (F.col("retry_count") < F.col("max_retries"))
            rows = rows.withColumns(
                {
                    "error_message": F.when(~fine, F.coalesce("why", F.lit("no such document"))),
                    "completed_at": F.when(~again, now),
                    "retry_count": F.col("retry_count") + F.when(again, 1).otherwise(0),
                    "lease_until": F.lit(None).cast("double"),
                    "updated_at": F.lit(now),
                    "status": F.when(fine, "completed").when(again, "pending").otherwise("failed"),
                }
            )
            self._put(tx, rows)
            return True

        self._commit(change)
        return Library(self.store.snapshot())

    def run(self, worker: str, documents: DataFrame, now: float, limit: int = 1000, steps: Steps | None = None) -> int:
        """Claims and does batches until nothing waits; how many batches."""
        batches = 0
        while self.claim(worker, now, limit):
            self.work(worker, documents, now, steps)
            batches += 1
        return batches

    def status(self) -> DataFrame:
        """One row: jobs by status, tries, mean seconds of completed ones, success rate, and whether claims are paused."""
        now = self.store.snapshot()
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        took = F.when(F.col("status") == "completed", F.col("completed_at") - F.col("created_at"))
        row = self.jobs(now).agg(*[count(s) for s in ("pending", "processing", *ENDED)], F.sum("retry_count").alias("retries"), F.avg(took).alias("average_seconds"), F.count("*").alias("submitted"))
        return row.select("*", (F.col("completed") / F.greatest(F.lit(1), F.col("submitted")) * 100).alias("success_rate"), F.lit(self.paused(now)).alias("paused"))
