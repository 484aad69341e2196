"""Counts taken while rows pass by in a job that writes them anyway."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from riskloom.sources.staging import stage

Watch = Callable[..., DataFrame]


def unwatched(name: str, df: DataFrame, *counts: Column) -> DataFrame:
    """The frame as it is: for plans whose counts nobody wants."""
    return df


class Counts:
    """Named points of a plan and the aggregates observed there.

    ``watch`` puts a point into a plan, ``stage`` writes the plan once and reads what was
    observed.  Observed sums go through accumulators, which take a task's rows again if its
    stage is run again.  So if any task of the job failed, or a point has been optimized away (as
    for empty tables), the numbers are counted anew from the frames themselves.
    """

    def __init__(self):
        self.points: dict[str, tuple[DataFrame, tuple[Column, ...], Observation]] = {}
        self.values: dict[str, dict] = {}
        self.recounted = False

    def watch(self, name: str, df: DataFrame, *counts: Column) -> DataFrame:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self.points[name] = (df, counts, seen)
        return df.observe(seen, *counts)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        context = df.sparkSession.sparkContext
        group, before = f"counts-{uuid.uuid4().hex}", context.getLocalProperty("spark.jobGroup.id")
        context.setLocalProperty("spark.jobGroup.id", group)
        try:
            out = stage(df, name)
        finally:
            context.setLocalProperty("spark.jobGroup.id", before)
        found = {point: _observed(seen) for point, (_, _, seen) in self.points.items()}
        self.recounted = None in found.values() or _run_again(df.sparkSession, group)
        if self.recounted:
            found = {p: frame.agg(*counts).first().asDict() for p, (frame, counts, _) in self.points.items()}
        self.values.update(found)
        return out


def _observed(seen: Observation) -> dict | None:
    """The numbers of a finished job; None if the point was not in the plan that ran."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return None


def _run_again(spark: SparkSession, group: str) -> bool:
    """Whether a task of the group's jobs failed or a stage was tried again."""
    tracker = spark.sparkContext.statusTracker()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage_id in info.stageIds if info else []:
            found = tracker.getStageInfo(stage_id)
            if found and (found.currentAttemptId > 0 or found.numFailedTasks > 0):
                return True
    return False
