"""The log of documents against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import replay
from lectern.operators.lifecycle import TRANSITIONS


def fold(rows, begin):
    out, status = [], dict(begin)
    for d, seq, event in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        s = status.get(d)
        result = error = None
        if s is None:
            error = "document_not_found"
        elif event in TRANSITIONS:
            valid, to, said, errors = TRANSITIONS[event]
            if (s not in errors) if valid is None else (s in valid):
                status[d], result = to, said
            else:
                error = errors.get(s, "invalid_status")
        out.append((d, seq, event, status.get(d), result, error))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_any_number_of_ranges_gives_the_same(spark, ranges):
    rnd = random.Random(ranges)
    names = ["hot"] * 6 + ["a", "b", "c", "lost", None]
    rows = [(rnd.choice(names), seq, rnd.choice([*TRANSITIONS, "other", None])) for seq in range(900)] + [("a", 5, "start"), ("a", 5, "fail")]
    begin = [("hot", "extracting"), ("a", "queued"), ("b", "completed"), ("c", "error"), ("unused", "queued"), ("null", None)]
    events = spark.createDataFrame(rows, "document_id string, seq long, event string").withColumn("result_", F.lit(1))
    found = replay.replayed(events, spark.createDataFrame(begin, "document_id string, status string"), ranges=ranges)
    assert found.columns == [*events.columns, "status", "result", "error"]
    got = sorted((tuple(r) for r in found.select("document_id", "seq", "event", "status", "result", "error").collect()), key=repr)
    assert got == fold(rows, begin)


def test_a_hot_document_runs_in_many_tasks(spark):
    events = spark.range(4000).selectExpr("'hot' document_id", "id seq", "if(id % 2 = 0, 'start', 'reset') event")
    found = replay.replayed(events, spark.createDataFrame([("hot", "queued")], "document_id string, status string"), ranges=8)
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) < 1000
    assert found.filter("event = 'start' AND status <> 'processing' OR event = 'reset' AND status <> 'queued'").count() == 0


def test_an_empty_log(spark):
    none = spark.createDataFrame([], "document_id string, seq long, event string")
    assert replay.replayed(none, spark.createDataFrame([], "document_id string, status string")).collect() == []


def test_windows_and_edges_do_not_depend_on_cells(spark):
    from pyspark.sql.window import Window

    from lectern.operators import lifecycle

    checks = spark.range(3000).selectExpr("id", "IF(id % 3 > 0, 'hot', 'f' || id % 4) fuse", "IF(id % 500 = 7, NULL, timestamp_micros(id * id * 7919 % 4000000007)) ts", "id * 31 % 7 > 3 good", "'x' n", "1 cell").dropDuplicates(["fuse", "ts"])
    for seconds in (1, 40, 5000):
        w = Window.partitionBy("fuse").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
        want = {r.id: r.m for r in checks.withColumn("m", F.count("*").over(w)).collect()}
        found = lifecycle.failures_in_window(checks.drop("n"), seconds)
        assert {r.id: r.n for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(fuse" in plan and "_cell" in plan.split("hashpartitioning(fuse")[1][:40]
    want = {r.id: r.m for r in checks.withColumn("m", F.coalesce(F.col("good") & ~F.lag("good").over(Window.partitionBy("fuse").orderBy("ts")), F.lit(False))).collect()}
    for seconds in (1, 60, 86_400):
        assert {r.id: r.reset for r in lifecycle.recovery_edges(checks, "fuse", "ts", F.col("good"), seconds).collect()} == want
