"""Job records: order, statistics, staleness, retries and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds after which a running job counts as interrupted.
STALE_AFTER = 300


def stale(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.where((F.col("status") == "processing") & (F.col("updated_at") < now - STALE_AFTER))


def retention(jobs: DataFrame, now: float, days: int) -> DataFrame:
    """Keeps all but finished jobs completed before the limit; a job without completion time stays."""
    old = F.col("status").isin("completed", "failed", "cancelled") & (F.col("completed_at") < now - days * 86400)
    return jobs.where(~F.coalesce(old, F.lit(False)))


def retry(jobs: DataFrame, now: float) -> DataFrame:
    """Failed and stale jobs: one try more, pending again up to max_retries, else failed; others as they are."""
    again = (F.col("status") == "failed") | ((F.col("status") == "processing") & (F.col("updated_at") < now - STALE_AFTER))
    tries = F.col("retry_count") + F.when(again, 1).otherwise(0)
    status = F.when(again, F.when(tries <= F.col("max_retries"), "pending").otherwise("failed")).otherwise(F.col("status"))
    return jobs.select("job_id", status.alias("status"), tries.alias("retry_count"))


def stats_by_status(jobs: DataFrame) -> DataFrame:
    took = F.when(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(), F.col("completed_at") - F.col("started_at"))
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.avg(took).alias("avg_seconds"), F.sum("retry_count").alias("retries"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def queue_counters(jobs: DataFrame) -> DataFrame:
    took = F.when(F.col("status") == "completed", F.col("completed_at") - F.col("started_at"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    c = jobs.agg(*[count(s) for s in ("pending", "processing", "completed", "failed")], F.count("*").alias("submitted"), F.avg(took).alias("average_processing_time"))
    return c.withColumn("success_rate", F.col("completed") / F.greatest(F.lit(1), F.col("submitted")) * 100)


def progress(jobs: DataFrame, elapsed: float) -> DataFrame:
    """processed, total, failed, percentage, rate a minute, seconds to go (null before the first)."""
    c = jobs.agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    p, t = F.col("processed"), F.col("total")
    return c.select("processed", "total", "failed", F.when(t > 0, p / t * 100).otherwise(0.0).alias("percentage"), F.lit(p / elapsed * 60 if elapsed > 0 else 0.0).alias("rate_per_minute"), F.when(p > 0, elapsed / p * (t - p)).alias("eta_seconds"))


def fold_states(changes: DataFrame) -> DataFrame:
    """Per job the state that its changes (job_id, seq, status) leave: the latest, first start and the number of changes."""
    last = F.max_by("status", "seq")
    return changes.groupBy("job_id").agg(last.alias("status"), F.min(F.when(F.col("status") == "processing", F.col("seq"))).alias("first_started"), F.count("*").alias("changes"))


def requeue(jobs: DataFrame, ids: DataFrame, now: float, reset_retries: bool = False) -> DataFrame:
    """The named jobs (job_id) are pending again, without progress, error and worker; others stay as they are."""
    named = F.col("_named").isNotNull()
    rows = jobs.join(ids.select("job_id", F.lit(True).alias("_named")), "job_id", "left")
    new = {"status": F.lit("pending"), "progress": F.lit(0.0), "error_message": F.lit(None), "worker_id": F.lit(None), "updated_at": F.lit(now)}
    if reset_retries:
        new["retry_count"] = F.lit(0)
    return rows.select(*[F.when(named, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def cancel(jobs: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """The named jobs end as cancelled unless they have ended before."""
    rows = jobs.join(ids.select("job_id", F.lit(True).alias("_named")), "job_id", "left")
    named = F.col("_named").isNotNull() & ~F.col("status").isin("completed", "failed", "cancelled")
    new = {"status": F.lit("cancelled"), "completed_at": F.lit(now), "updated_at": F.lit(now)}
    return rows.select(*[F.when(named, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


#: What each action does to a job, by the status it is in; any other action is ignored.
TRANSITIONS = {("pending", "start"): "processing", ("processing", "complete"): "completed", ("processing", "fail"): "failed", ("pending", "cancel"): "cancelled", ("processing", "cancel"): "cancelled", ("failed", "requeue"): "pending", ("cancelled", "requeue"): "pending"}


#: The statuses that an action can find a job in, in the order of a run's results.
STATES = tuple(dict.fromkeys([*(was for was, _ in TRANSITIONS), *TRANSITIONS.values()]))
_RUN = T.ArrayType(T.StructType([T.StructField("to", T.IntegerType()), T.StructField("moves", T.LongType())]))


def run_machine(actions: DataFrame, key: str = "job_id") -> DataFrame:
    """Per job what its actions (key, seq, action) leave, in order of seq, then action: status and how many actions took effect.

    What a run of actions does is a map from each status to a status and a number of moves, whatever came before, and maps can be
    joined.  So actions are dealt by job and seq, a task folds the runs that it holds, and a job's runs, of which there are no
    more than tasks that hold some of it, are joined: a job with very many actions is many tasks' work.  Jobs without id are one.
    """
    moves = {a: [STATES.index(TRANSITIONS[s, a]) if (s, a) in TRANSITIONS else -1 for s in STATES] for a in {a for _, a in TRANSITIONS}}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        job, to, n = nothing, [], []
        for b in batches:
            out = []
            for j, action in zip(b["job"].tolist(), b["action"].tolist()):
                if j != job:
                    if job is not nothing:
                        out.append((job, [{"to": t, "moves": m} for t, m in zip(to, n)]))
                    job, to, n = j, [*range(len(STATES))], [0] * len(STATES)
                if action in moves:
                    step = moves[action]
                    for i, t in enumerate(to):
                        if step[t] >= 0:
                            to[i] = step[t]
                            n[i] += 1
            yield pd.DataFrame(out, columns=["job", "run"])
        if job is not nothing:
            yield pd.DataFrame([(job, [{"to": t, "moves": m} for t, m in zip(to, n)])], columns=["job", "run"])

    kind = actions.schema[key].dataType
    ordered = actions.select(F.col(key).cast("string").alias("job"), "seq", "action").repartitionByRange("job", "seq", "action").sortWithinPartitions("job", "seq", "action")
    runs = ordered.mapInPandas(work, T.StructType([T.StructField("job", T.StringType()), T.StructField("run", _RUN)]))
    runs = runs.withColumn("part", F.spark_partition_id())  # of a job's runs the order of their ranges
    start = F.struct(F.lit(STATES.index("pending")).alias("at"), F.lit(0).cast("bigint").alias("moves"))
    join = lambda s, r: F.struct(F.get(r["run"], s["at"])["to"].alias("at"), (s["moves"] + F.get(r["run"], s["at"])["moves"]).alias("moves"))
    joined = runs.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("part", "run"))).alias("runs")).select("job", F.aggregate("runs", start, join).alias("s"))
    return joined.select(F.col("job").cast(kind).alias(key), F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("s.at") + 1).alias("status"), "s.moves")
