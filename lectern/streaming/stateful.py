"""Circuit breakers and document life cycles as keyed state, and refreshes by micro-batch.

State is small and bounded for each key: a breaker keeps at most tolerated + 1 failure times, a document its status. Late rows beyond the
watermark are dropped by Spark; within a micro-batch rows are put in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import TRANSITIONS, topics

BREAKER_OUT = "fuse string, ts timestamp, state string"
BREAKER_STATE = "failures array<long>, opened long"


def breakers(events: DataFrame, tolerated: int, seconds: int, refresh: int, watermark: str = "10 minutes") -> DataFrame:
    """State changes (fuse, ts, state) of breakers fed by events (fuse, ts, failed).

    A breaker opens when more than tolerated failures lie within the seconds up to one of them, and closes refresh seconds later; failures while it is open do not count.
    """

    window, pause = seconds * 1_000_000, refresh * 1_000_000  # times are whole microseconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []

        def say(at: int, what: str) -> None:
            out.append((key[0], pd.Timestamp(at, unit="us"), what))

        times, fails = [], []
        for batch in batches if not state.hasTimedOut else ():  # nine bytes a row stay, not the batches
            times.append(batch["ts"].to_numpy("datetime64[us]").astype("int64"))
            fails.append(batch["failed"].fillna(False).to_numpy(bool))
        at_, failed_ = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((times, "int64"), (fails, bool)))
        for k in np.argsort(at_, kind="stable"):
            at, failed = int(at_[k]), bool(failed_[k])
            if opened is not None and at >= opened + pause:
                say(opened + pause, "ok")
                opened, failures = None, []
            if failed and opened is None:
                failures = [f for f in failures if f >= at - window][-tolerated:] + [at]
                if len(failures) > tolerated:
                    opened = at
                    say(at, "blown")
        if state.hasTimedOut:
            if opened is not None:
                say(opened + pause, "ok")
            state.remove()  # nothing in it matters after its time
        else:
            state.update((failures, opened))
            if opened is not None or failures:
                due = opened + pause if opened is not None else failures[-1] + window
                state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fuse", "ts", "state"])

    return events.withWatermark("ts", watermark).groupBy("fuse").applyInPandasWithState(step, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def breaker_changes(rows: list[tuple[float, bool]], tolerated: int, seconds: int, refresh: int) -> list[tuple[float, str]]:
    """The same for one breaker's (time, failed) rows in order, in plain Python: what tests hold the stream against."""
    failures: list[float] = []
    opened, out = None, []
    for at, failed in rows:
        if opened is not None and at >= opened + refresh:
            out.append((opened + refresh, "ok"))
            opened, failures = None, []
        if failed and opened is None:
            failures = [f for f in failures if f >= at - seconds] + [at]
            if len(failures) > tolerated:
                opened = at
                out.append((at, "blown"))
    return out


FSM_OUT = "document_id string, seq long, event string, status string, result string, error string"


def life_cycles(events: DataFrame) -> DataFrame:
    """What each event (document_id, seq, event) does to its document; the first event of a document may be `create` with its status in `status`."""

    events_of = ["create", *TRANSITIONS]
    codes = {e: k for k, e in enumerate(events_of)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        seqs, names, first = [], [], {}
        for batch in batches:  # a number and a code a row stay, not the batches
            seqs.append(batch["seq"].to_numpy("int64"))
            names.append(batch["event"].map(codes.__getitem__).to_numpy("int8"))
            first |= {int(s): v for s, v, e in zip(batch["seq"], batch["status"], batch["event"], strict=True) if e == "create"}
        seq, name = np.concatenate(seqs), np.concatenate(names)
        order = np.argsort(seq, kind="stable")
        for at in range(0, len(order), 10_000):
            out = []
            for k in order[at : at + 10_000]:
                event, result, error = events_of[name[k]], None, None
                if event == "create":
                    status, result = first[int(seq[k])], "created"
                elif status is None:
                    error = "document_not_found"
                else:
                    valid, to, said, errors = TRANSITIONS[event]
                    if (status not in errors) if valid is None else (status in valid):
                        status, result = to, said
                    else:
                        error = errors.get(status, "invalid_status")
                out.append((key[0], int(seq[k]), event, status, result, error))
            yield pd.DataFrame(out, columns=["document_id", "seq", "event", "status", "result", "error"])
        if status is not None:
            state.update((status,))

    return events.groupBy("document_id").applyInPandasWithState(step, FSM_OUT, "status string", "append", GroupStateTimeout.NoTimeout)


def broadcasts(updates: DataFrame) -> DataFrame:
    """Each update of a stream once for its document's topic and once for the topic of all."""
    return topics(updates)


def refreshed(updates: DataFrame, recompute: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A stream writer that recomputes a whole view once for each micro-batch that has updates, not once for each update."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(recompute(), epoch)

    return updates.writeStream.foreachBatch(each)


def viewed(updates: DataFrame, page_id: int) -> DataFrame:
    """The updates that a viewer of one page shows: those of the page itself."""
    return updates.filter(F.col("page_id") == page_id)
