"""Named jobs: started in the background under an id, with progress, result, and cancellation.

A job is a function of a session. It runs in a thread and a job group of its own, so :meth:`Jobs.cancel` ends
its Spark tasks and no other job's. Progress is the share of finished tasks among those of the stages seen so far, and never
falls; it is 1 only when the job has ended well. Ids in use are refused, ended ones may be used again.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

RUNNING, DONE, FAILED, CANCELLED = "running", "done", "failed", "cancelled"
NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")


class JobExists(ValueError):
    """A job with this id is running."""


@dataclass
class Job:
    name: str
    state: str = RUNNING
    result: Any = None
    error: BaseException | None = None
    reached: float = 0.0
    ended: threading.Event = field(default_factory=threading.Event)
    asked: bool = False


@dataclass(frozen=True)
class Progress:
    """State, share of tasks that have finished, and counts of these and of all tasks of the stages seen so far."""

    state: str
    share: float
    tasks_done: int
    tasks: int


class Jobs:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def start(self, name: str, work: Callable[[SparkSession], Any]) -> Job:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no id: letters, digits, dot, dash and underscore are")
        with self.lock:
            if name in self.jobs and not self.jobs[name].ended.is_set():
                raise JobExists(f"{name} is running")
            job = self.jobs[name] = Job(name)
        InheritableThread(target=self._work, args=(job, work), daemon=True).start()
        return job

    def _work(self, job: Job, work: Callable[[SparkSession], Any]) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self._group(job), job.name, interruptOnCancel=True)
        try:
            result = work(self.spark)
            job.result, job.state = (None, CANCELLED) if job.asked else (result, DONE)
        except BaseException as e:  # of the caller's function; shown by the job
            job.error, job.state = e, CANCELLED if job.asked else FAILED
        finally:
            job.ended.set()

    @staticmethod
    def _group(job: Job) -> str:
        return f"lodestrata-{job.name}-{id(job)}"

    def _job(self, name: str) -> Job:
        if name not in self.jobs:
            raise KeyError(f"no job {name}")
        return self.jobs[name]

    def cancel(self, name: str) -> bool:
        """Whether the job was running; its further Spark jobs are cancelled as they come, until it ends."""
        job = self._job(name)
        if job.ended.is_set():
            return False
        job.asked = True
        while not job.ended.wait(0.2):
            self.spark.sparkContext.cancelJobGroup(self._group(job))
        return True

    def progress(self, name: str) -> Progress:
        job, tracker = self._job(name), self.spark.sparkContext.statusTracker()
        tasks = done = 0
        for number in tracker.getJobIdsForGroup(self._group(job)):
            found = tracker.getJobInfo(number)
            infos = [info for s in (found.stageIds if found else ()) if (info := tracker.getStageInfo(s))]
            ended = sum(i.numCompletedTasks for i in infos)
            done += ended
            tasks += ended if found and found.status == "SUCCEEDED" else sum(i.numTasks for i in infos)  # skipped stages run no tasks
        job.reached = 1.0 if job.state == DONE else max(job.reached, min(0.99, done / tasks) if tasks else 0.0)
        return Progress(job.state, job.reached, done, tasks)

    def wait(self, name: str, seconds: float | None = None) -> Any:
        """The job's result, or its error."""
        job = self._job(name)
        if not job.ended.wait(seconds):
            raise TimeoutError(f"{name} is still running")
        if job.error is not None:
            raise job.error
        return job.result
