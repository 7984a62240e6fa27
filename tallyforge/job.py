"""Jobs: a plan that runs under a tag, is iterated row by row, and can be killed."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, ErrorCode, engine_error
from .plans.compile import compile_plan
from .plans.spec import Plan


class Job:
    """Runs a plan or DataFrame. Rows come from iteration (a partition at a time, the next one prefetched) or rows().

    Errors are EngineError. kill(), from any thread, cancels what runs; the iteration then raises KILLED. metrics has
    the state and the number of rows delivered. on_event, if given, is told of each event: EXEC_START, PUSH_START,
    PUSH (rows so far and their bytes, as Python holds them, every `PUSH_ROWS` rows and at the end), EXEC_END with the
    state that the job ended in.
    """

    PUSH_ROWS = 10_000

    def __init__(self, plan: Plan | DataFrame, spark: SparkSession, job_id: str | None = None, on_event: Callable[[dict], None] | None = None):
        self.spark, self.id = spark, job_id or f"job-{uuid.uuid4().hex}"
        self._killed = threading.Event()
        self._on_event = on_event
        self.metrics = {"state": "NONE", "rows": 0}
        self.frame = plan if isinstance(plan, DataFrame) else self._guarded(lambda: compile_plan(plan, spark))

    def _tell(self, event: str, **more) -> None:
        if self._on_event is not None:
            self._on_event({"job": self.id, "event": event, "time": time.time(), **more})

    def progress(self) -> dict[str, int]:
        """Tasks of the stages that run for this job now: all, running, done and failed."""
        out = {"tasks": 0, "running": 0, "done": 0, "failed": 0}
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        for j in tracker.getJobIdsForTag(self.id):
            info = tracker.getJobInfo(j)
            for k in info.get().stageIds() if info.isDefined() else ():
                stage = tracker.getStageInfo(k)
                if stage.isDefined():
                    x = stage.get()
                    for key, n in zip(out, (x.numTasks(), x.numActiveTasks(), x.numCompletedTasks(), x.numFailedTasks())):
                        out[key] += n
        return out

    def _guarded(self, f):
        try:
            return f()
        except Exception as e:
            raise self._failed(e) from e

    def _failed(self, e: BaseException) -> EngineError:
        error = engine_error(e, self._killed.is_set())
        self.metrics["state"] = "KILLED" if error.code == ErrorCode.KILLED else "FAILED"
        self._tell("EXEC_END", state=self.metrics["state"], code=int(error.code))
        return error

    def _ended(self, rows: int, size: int, state: str = "COMPLETE") -> None:
        self.metrics["state"] = state
        self._tell("PUSH", rows=rows, bytes=size)
        self._tell("EXEC_END", state=state, code=0)

    def _tag(self, on: bool) -> None:
        """Tags what this thread runs, for the session and, as iteration's jobs run outside of its executions, for the context."""
        sc = self.spark.sparkContext
        if on:
            self.spark.addTag(self.id)
            sc.addJobTag(self.id)
            sc.setInterruptOnCancel(True)
        else:
            self.spark.removeTag(self.id)
            sc.removeJobTag(self.id)
            sc.setInterruptOnCancel(False)

    def __enter__(self) -> Job:
        return self

    def __exit__(self, *_) -> None:
        if self.metrics["state"] == "RUNNING":
            self.kill()

    def __iter__(self) -> Iterator[Row]:
        self._tag(True)
        try:
            if self._killed.is_set():
                raise EngineError(ErrorCode.KILLED, self.id)
            self.metrics["state"] = "RUNNING"
            self._tell("EXEC_START")
            size = 0
            for row in self.frame.toLocalIterator(prefetchPartitions=True):
                if self._killed.is_set():
                    raise EngineError(ErrorCode.KILLED, self.id)
                self.metrics["rows"] += 1
                if self._on_event is not None:
                    if self.metrics["rows"] == 1:
                        self._tell("PUSH_START")
                    size += sum(map(sys.getsizeof, row))
                    if self.metrics["rows"] % self.PUSH_ROWS == 0:
                        self._tell("PUSH", rows=self.metrics["rows"], bytes=size)
                yield row
            self._ended(self.metrics["rows"], size)
        except GeneratorExit:
            self._ended(self.metrics["rows"], size, "CLOSED")
            raise
        except Exception as e:
            raise self._failed(e) from e
        finally:
            self._tag(False)

    def rows(self) -> list[Row]:
        """All rows at once; what the plan observes of them is in metrics."""
        seen = Observation()
        self._tag(True)
        try:
            if self._killed.is_set():
                raise EngineError(ErrorCode.KILLED, self.id)
            self.metrics["state"] = "RUNNING"
            self._tell("EXEC_START")
            out = self.frame.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
            self.metrics |= seen.get
            self._ended(len(out), sum(sum(map(sys.getsizeof, r)) for r in out) if self._on_event else 0)
            return out
        except Exception as e:
            raise self._failed(e) from e
        finally:
            self._tag(False)

    def kill(self) -> None:
        self._killed.set()
        self.metrics["state"] = "KILLED"
        self.spark.interruptTag(self.id)
        self.spark.sparkContext.cancelJobsWithTag(self.id)
