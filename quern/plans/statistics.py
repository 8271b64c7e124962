"""What a query cost: wall time, tasks and time of all its tasks, bytes read, shuffled and spilled."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


@dataclass(frozen=True)
class Statistics:
    runtime_ms: int
    jobs: int
    stages: int
    tasks: int
    #: Of all tasks together.
    accumulated_ms: int
    cpu_ms: int
    input_bytes: int
    output_bytes: int
    shuffle_bytes: int
    spilled_bytes: int

    def cost(self, per_core_hour: float) -> float:
        """Price of the task time at a rate that the caller knows."""
        return self.accumulated_ms / 3.6e6 * per_core_hour


def measured(spark: SparkSession, action: Callable[[], T]) -> tuple[T, Statistics]:
    """The result of an action (a count, a collect, a write) and the statistics of the jobs it ran."""
    sc, group = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    tag_before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(group, "measured")
    start = time.time()
    try:
        result = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", tag_before)
    took = int((time.time() - start) * 1000)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
    done = [d for d in (store.lastStageAttempt(s) for s in sorted(stages)) if d.numCompleteTasks()]
    return result, Statistics(
        took, len(jobs), len(done), sum(d.numCompleteTasks() for d in done), sum(d.executorRunTime() for d in done), sum(d.executorCpuTime() for d in done) // 1_000_000,
        sum(d.inputBytes() for d in done), sum(d.outputBytes() for d in done), sum(d.shuffleWriteBytes() for d in done), sum(d.diskBytesSpilled() for d in done),
    )
