"""Health checks as rows, and the schedule of periodic work."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds between runs and before the first one, and jobs at once in each queue; an external scheduler reads them.
SCHEDULE = {"health": (60, 10), "sweep": (6 * 3600, 60)}
QUEUES = {"pdf_extraction": 1, "llm_processing": 1, "embedding_generation": 5, "health_check": 1}
MAX_ATTEMPTS = 3


def check_session(spark: SparkSession) -> str | None:
    return None if spark.sql("SELECT 1").first()[0] == 1 else "wrong answer"


def check_writable(spark: SparkSession, root: str) -> str | None:
    """Whether a file can be made and removed below root, on any file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return f"Uploads directory does not exist: {root}"
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f".health_{time.time_ns()}")
    fs.create(probe).close()
    fs.delete(probe, False)
    return None


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], str | None]], blown: frozenset[str] = frozenset()) -> DataFrame:
    """(check, result, error, duration_ms): each check returns null or an error; one whose circuit is blown is not tried."""
    rows = []
    for name, check in checks.items():
        began = time.monotonic()
        try:
            error = "circuit_open" if name in blown else check()
        except Exception as e:  # noqa: BLE001  a failing check is a result
            error = str(e)
        rows.append((name, "error" if error else "ok", error, int((time.monotonic() - began) * 1000)))
    return spark.createDataFrame(rows, "check string, result string, error string, duration_ms long")


def due(last: float | None, now: float, started: float, name: str) -> bool:
    """Whether periodic work is due: the first time after its delay, then once in each period."""
    period, first = SCHEDULE[name]
    return now >= (started + first if last is None else last + period)


#: When jobs run by the clock: minute, hour, day of month, month, day of week (0 is Sunday).
CRON = {"health_check": "* * * * *"}


def cron_field(field: str, least: int, most: int) -> list[int]:
    """The values of a field of numbers, ranges, steps and lists of them."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        low = least if span == "*" else int(first)
        high = most if span == "*" or step and not last else int(last or first)
        if not least <= low <= high <= most or step and int(step) < 1:
            raise ValueError(f"bad field: {field}")
        out.update(range(low, high + 1, int(step or 1)))
    return sorted(out)


def cron_matches(ts: Column, expression: str) -> Column:
    """Whether the minute of a time is one at which the expression runs a job. If both days are restricted, either will do."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"bad expression: {expression}")
    values = [cron_field(f, *bounds) for f, bounds in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True)]
    of = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1]
    minute, hour, day, month, weekday = (c.isin(*(v if k < 4 else sorted({x % 7 for x in v}))) for k, (c, v) in enumerate(zip(of, values, strict=True)))
    either = fields[2] != "*" and fields[4] != "*"
    return minute & hour & month & (day | weekday if either else day & weekday)


def assigned(jobs: DataFrame, queues: dict[str, int] | None = None, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """jobs (id, queue, state, attempt, priority) with decision: what a scheduler does with each now.

    executing jobs go on; a waiting one (available or retryable) that has used its attempts is discarded; of the others those run, by priority and id, that
    the queue's places allow, less the executing ones; queues that are not known run none. Other states are left alone. A queue's places are few, so Spark keeps that many rows of it.
    """
    queues = QUEUES if queues is None else queues
    waiting = F.col("state").isin("available", "retryable")
    spent = waiting & (F.col("attempt") >= max_attempts)
    busy = jobs.filter("state = 'executing'").groupBy("queue").agg(F.count("*").alias("_busy"))
    places = F.lit(0)
    for name, n in queues.items():
        places = F.when(F.col("queue") == name, n).otherwise(places)
    most = max(queues.values(), default=0)
    order = F.row_number().over(Window.partitionBy("queue").orderBy("priority", "id"))
    first = jobs.filter(waiting & ~spent).select("queue", "priority", "id").withColumn("_n", order).filter(F.col("_n") <= most)
    run = first.join(F.broadcast(busy), "queue", "left").filter(F.col("_n") <= places - F.coalesce("_busy", F.lit(0))).select("id", F.lit(True).alias("_run"))  # a few rows for each queue
    decision = F.when(F.col("state") == "executing", "goes_on").when(spent, "discard").when(F.coalesce("_run", F.lit(False)), "run").when(waiting, "wait").otherwise("none")
    return jobs.join(F.broadcast(run), "id", "left").withColumn("decision", decision).drop("_run")


def sweep_status(sweeps: DataFrame, period_hours: int = 6) -> DataFrame:
    """(last_sweep, sweep_count, last_result, next_sweep) of sweeps (ts, n, error): counters of all that ran, failed ones too."""
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(F.concat(F.lit("ok: "), F.col("n").cast("string")))
    return sweeps.agg(F.max("ts").alias("last_sweep"), F.count("*").alias("sweep_count"), F.max_by(said, F.col("ts")).alias("last_result"), (F.max("ts") + F.expr(f"INTERVAL {period_hours} HOURS")).alias("next_sweep"))
