"""The job queue: order, leases, pausing, and results that count once."""

import pytest
from pyspark.sql import functions as F

from docweave.operators.ingest import Library, Steps
from docweave.operators.job_queue import JobQueue
from docweave.sources.versions import TableStore


@pytest.fixture
def queue(spark, tmp_path):
    return JobQueue(TableStore(spark, str(tmp_path / "q")))


def add(queue, *jobs, **more):
    queue.add(queue.store.spark.createDataFrame(list(jobs), "job_id bigint, doc_id bigint, job_type string, priority bigint"), 0.0, **more)


def state(queue):
    return {r["job_id"]: (r["status"], r["worker_id"], r["retry_count"]) for r in queue.jobs().collect()}


def docs(queue, n=6):
    return queue.store.spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), "id").alias("text"))


def test_order_pausing_and_cancelling(queue):
    add(queue, (1, 1, "add", 3), (2, 2, "add", 1), (3, 3, "add", 2), (4, 4, "add", 1))
    add(queue, (2, 9, "remove", 3))  # is there already
    queue.pause()
    assert not queue.claim("a", 1.0, 2) and queue.status().first()["paused"]
    queue.pause(False)
    assert queue.claim("a", 1.0, 2)
    assert state(queue) == {1: ("pending", None, 0), 2: ("processing", "a", 0), 3: ("pending", None, 0), 4: ("processing", "a", 0)}
    queue.cancel(2.0, queue.store.spark.createDataFrame([(3,), (4,)], "job_id bigint"))
    assert state(queue)[3][0] == "cancelled" and state(queue)[4][0] == "processing"
    queue.cancel(3.0)
    assert state(queue)[1][0] == "cancelled" and not queue.claim("b", 4.0, 5)


class Died(Exception):
    pass


def test_a_dead_workers_jobs_are_done_once_by_others(queue, monkeypatch):
    add(queue, *[(i, i, "add", 1) for i in range(6)])
    queue.claim("a", 0.0, 4)
    put = JobQueue._put

    def dies(self, tx, rows):
        raise Died  # behind the ingest, before the commit

    monkeypatch.setattr(JobQueue, "_put", dies)
    with pytest.raises(Died):
        queue.work("a", docs(queue), 10.0)
    monkeypatch.setattr(JobQueue, "_put", put)
    assert Library(queue.store.snapshot()).registry.count() == 0  # nothing of it was seen
    assert queue.run("b", docs(queue), 20.0) == 1  # a's lease runs on
    assert {k for k, v in state(queue).items() if v[0] == "completed"} == {4, 5}
    assert queue.run("b", docs(queue), 400.0) == 1
    assert state(queue) == {i: ("completed", "b", int(i < 4)) for i in range(6)}
    library = queue.work("a", docs(queue), 500.0)  # wakes up: nothing is its own any more
    assert library.registry.count() == 6 and library.nodes.count() == 6
    row = queue.status().first()
    assert (row["completed"], row["retries"], row["success_rate"]) == (6, 4, 100.0)


def test_failures_are_tried_again_and_end(queue):
    add(queue, (1, 1, "add", 1), (2, 77, "add", 1), (3, 3, "add", 2), (4, 1, "remove", 3), max_retries=2)
    broken = Steps(embedder=lambda texts: [None if "3" in t else [1.0] for t in texts])
    assert queue.run("a", docs(queue), 1.0, limit=3, steps=broken) >= 3
    assert state(queue) == {1: ("completed", "a", 0), 2: ("failed", "a", 2), 3: ("failed", "a", 2), 4: ("completed", "a", 0)}
    errors = {r["job_id"]: r["error_message"] for r in queue.jobs().collect()}
    assert errors[2] == "no such document" and errors[3] == "no vector" and errors[1] is None
    registry = {r["doc_id"]: (r["state"], r["error_count"]) for r in Library(queue.store.snapshot()).registry.collect()}
    assert registry == {3: ("corrupted", 1)}  # unchanged text is not tried anew; document 1 was removed


def test_workers_that_never_end_use_up_the_tries(queue):
    add(queue, (1, 1, "add", 1), max_retries=1)
    for i, now in enumerate((0.0, 400.0)):
        assert queue.claim(f"w{i}", now, 5)
    assert state(queue)[1] == ("processing", "w1", 1)
    queue.claim("w2", 900.0, 5)
    assert state(queue)[1] == ("failed", "w1", 1) and not queue.claim("w3", 2000.0, 5)
