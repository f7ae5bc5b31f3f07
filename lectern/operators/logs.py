"""State machines over logs: what each row of a log does, given the rows of its key before it.

Rows of a key go through their machine in order, one by one, by definition. A key's log is one sorted run in one task, which streams through in batches; only the state stays.
Rows without a key take no part.
"""

from __future__ import annotations

from collections import deque, namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(log: DataFrame, key: str, order: tuple[str, ...], machine: Callable[[], Callable], schema: str) -> DataFrame:
    """(key, *order, and what schema adds) for each row of log. machine makes a machine for a key; it takes a row and returns the values that schema adds."""
    kept = [key, *order]
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in log.select(*kept).dtypes) + ", " + schema
    names = [*kept, *(x.split()[0] for x in schema.split(", "))]
    row_of = namedtuple("Row", log.columns)

    def run(batches):
        here, step = object(), None
        for batch in batches:
            out = []
            for row in map(row_of, *(c.to_pylist() for c in batch.columns)):
                own = getattr(row, key)
                if own != here:
                    here, step = own, machine()
                out.append((*(getattr(row, c) for c in kept), *step(row)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    rows = log.filter(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *order)
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    return rows.mapInArrow(run, ddl)


def breaker_calls(calls: DataFrame, tolerated: int, seconds: int, refresh: int, key: str = "fuse") -> DataFrame:
    """(fuse, at, id, outcome, opened) of calls (fuse, at, id, failed), at in microseconds: rejected while the breaker is open, else failed or ok, and whether this failure opens it.

    A breaker opens when more than tolerated failures lie within the seconds up to one of them, and is closed again, without failures, refresh seconds later. Rejected calls do not count.
    """
    window, pause = seconds * 1_000_000, refresh * 1_000_000

    def machine():
        failures: deque[int] = deque(maxlen=tolerated + 1)
        opened = None

        def step(row):
            nonlocal opened
            if opened is not None:
                if row.at < opened + pause:
                    return "rejected", False
                opened = None
                failures.clear()
            if not row.failed:
                return "ok", False
            failures.append(row.at)
            if len(failures) > tolerated and failures[0] >= row.at - window:
                opened = row.at
            return "failed", opened is not None

        return step

    return folded(calls, key, ("at", "id"), machine, "outcome string, opened boolean")


def queue_log(log: DataFrame, cap: int = 10, key: str = "queue") -> DataFrame:
    """(queue, seq, result, pending, completed, failed) of operations (queue, seq, op, id, high).

    add: ok or queue_full; high jobs go to the front. next: the first job or empty. remove takes an id out of the queue, complete and timeout put an id on the
    completed or failed list, clear empties the completed list.
    """

    def machine():
        queue: deque = deque()
        completed = failed = 0

        def step(row):
            nonlocal completed, failed
            result = "ok"
            if row.op == "add":
                if len(queue) >= cap:
                    result = "queue_full"
                elif row.high:
                    queue.appendleft(row.id)
                else:
                    queue.append(row.id)
            elif row.op == "next":
                result = str(queue.popleft()) if queue else "empty"
            elif row.op == "remove":
                left = [x for x in queue if x != row.id]
                queue.clear()
                queue.extend(left)
            elif row.op == "complete":
                completed += 1
            elif row.op == "timeout":
                failed += 1
            elif row.op == "clear":
                completed = 0
            return result, len(queue), completed, failed

        return step

    return folded(log, key, ("seq",), machine, "result string, pending long, completed long, failed long")


def chat_log(log: DataFrame, session: int = 16, key: str = "conversation") -> DataFrame:
    """(conversation, seq, outcome, history) of messages (conversation, seq, kind, ref, text).

    ask: ignored if it is blank or another question waits, else it waits under its ref. reply and error: answered or failed if their ref is the waiting one, else stale. The
    history grows by question and answer up to session messages.
    """

    def machine():
        waiting, history = None, 0

        def step(row):
            nonlocal waiting, history
            if row.kind == "ask":
                if waiting is not None or not (row.text or "").strip():
                    return "ignored", history
                waiting = row.ref
                return "asked", history
            if waiting is None or row.ref != waiting:
                return "stale", history
            waiting = None
            if row.kind == "error":
                return "failed", history
            history = min(session, history + 2)
            return "answered", history

        return step

    return folded(log, key, ("seq",), machine, "outcome string, history long")
