"""Jobs: rows, errors, killing."""

import threading
import time

import pytest

from tallyforge.errors import EngineError, ErrorCode, engine_error
from tallyforge.job import Job
from tallyforge.plans.spec import Agg, Plan, Scan, Stage


def test_rows_and_metrics(spark):
    plan = Plan([Scan(frame=spark.range(100).selectExpr("id % 3 as k"))], [Stage(["k"], [Agg("count", None, "n")])])
    job = Job(plan, spark)
    assert sorted(tuple(r) for r in job) == [(0, 34), (1, 33), (2, 33)]
    assert job.metrics == {"state": "COMPLETE", "rows": 3}
    job = Job(plan, spark)
    assert len(job.rows()) == 3 and job.metrics == {"state": "COMPLETE", "rows": 3}


def test_bad_sql(spark):
    with pytest.raises(EngineError) as e:
        Job(Plan([Scan(sql="select * from nowhere_at_all")]), spark)
    assert e.value.code == ErrorCode.SOURCE


def test_division(spark):
    with pytest.raises(EngineError) as e:
        Job(Plan([Scan(sql="select 1 / id as x from range(3)")]), spark).rows()
    assert e.value.code == ErrorCode.DIVISION


def test_kill(spark):
    slow = spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L) as x", "id")
    job = Job(slow, spark)
    t = threading.Timer(2, job.kill)
    t.start()
    began = time.time()
    with pytest.raises(EngineError) as e:
        list(job)
    assert e.value.code == ErrorCode.KILLED and job.metrics["state"] == "KILLED" and time.time() - began < 15
    with pytest.raises(EngineError):
        list(job)


def test_events(spark):
    told = []
    plan = Plan([Scan(frame=spark.range(25_000))])
    job = Job(plan, spark, on_event=told.append)
    assert sum(1 for _ in job) == 25_000
    assert [e["event"] for e in told] == ["EXEC_START", "PUSH_START", "PUSH", "PUSH", "PUSH", "EXEC_END"]
    assert [e["rows"] for e in told if e["event"] == "PUSH"] == [10_000, 20_000, 25_000] and told[-2]["bytes"] > 25_000 and told[-1]["state"] == "COMPLETE"
    told.clear()
    assert len(Job(plan, spark, on_event=told.append).rows()) == 25_000 and [e["event"] for e in told] == ["EXEC_START", "PUSH", "EXEC_END"]
    told.clear()
    with pytest.raises(EngineError):
        Job(Plan([Scan(sql="select 1 / id as x from range(3)")]), spark, on_event=told.append).rows()
    assert (told[-1]["event"], told[-1]["state"], told[-1]["code"]) == ("EXEC_END", "FAILED", int(ErrorCode.DIVISION))
    told.clear()
    for _ in (it := iter(Job(plan, spark, on_event=told.append))):
        it.close()
    assert told[-1]["state"] == "CLOSED"


def test_progress(spark):
    slow = spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', 3000L) as x", "id")
    job = Job(slow, spark)
    assert job.progress()["tasks"] == 0
    seen, over = [], threading.Event()

    def watch():
        while not over.wait(0.2):
            seen.append(job.progress())

    t = threading.Thread(target=watch)
    t.start()
    job.rows()
    over.set()
    t.join()
    assert any(x["tasks"] == 4 and x["running"] > 0 for x in seen) and all(x["failed"] == 0 for x in seen)


def test_codes_have_messages():
    assert [c.value for c in ErrorCode] == list(range(11)) and all(c.message for c in ErrorCode)
    assert engine_error(ValueError("x")).code == ErrorCode.SYSTEM
