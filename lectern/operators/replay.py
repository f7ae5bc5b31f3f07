"""Logs of document events folded into the status after each, in many tasks whatever document the events are of.

An event is a map from status to status, and maps compose in any grouping. So the log is cut into ranges of (document, order), and a document with half of all events spans
many. A first pass composes, in each range, the maps of its last document; these few maps, one a range, give the status in which each range begins; a second
pass goes through the ranges, each from its own beginning. Both keep one status, or one map, in memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.keep import kept
from .lifecycle import TRANSITIONS

STATUSES = ["uploading", "extracting", "queued", "processing", "completed", "error"]
UNKNOWN = len(STATUSES)  # a document that does not exist


def outcomes() -> dict[str | None, list[tuple[int, str | None, str | None]]]:
    """By event, for each status and UNKNOWN: the status after it, its result and its error. Under None: an event of another name."""
    out = {None: [(s, None, None) for s in range(UNKNOWN)]}
    for event, (valid, to, said, errors) in TRANSITIONS.items():
        may = lambda s: (s not in errors) if valid is None else (s in valid)  # noqa: B023, E731
        out[event] = [(STATUSES.index(to), said, None) if may(s) else (k, None, errors.get(s, "invalid_status")) for k, s in enumerate(STATUSES)]
    return {event: [*of, (UNKNOWN, None, "document_not_found")] for event, of in out.items()}


def replayed(events: DataFrame, documents: DataFrame, order: str = "seq", ranges: int | None = None) -> DataFrame:
    """events (document_id, `order`, event) with status, result and error after each, beginning from the status in documents.

    Events of one document are in the order of `order`, equal ones by their name. Unknown documents stay not found; events of other names and null ones change nothing.
    """
    spark = events.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    begun = events.join(documents.select("document_id", F.col("status").alias("_begin")), "document_id", "left")
    by = [F.asc("document_id"), F.asc(order), F.asc("event")]
    # written once, so that a range holds the same rows in both passes
    cut = kept(begun.repartitionByRange(n, *by).sortWithinPartitions(*by)).withColumn("_range", F.spark_partition_id())
    table = outcomes()
    number = {s: k for k, s in enumerate(STATUSES)}
    same = list(range(UNKNOWN + 1))

    def compose(batches):
        first = last = begin = no = None
        passed = same
        for batch in batches:
            for document, event, start, no in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first is None:
                    first = (document,)
                if last != (document,):
                    last, begin, passed = (document,), start, same
                step = table.get(event, table[None])
                passed = [step[s][0] for s in passed]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([first == last]), pa.array([first[0]], pa.string()), pa.array([last[0]], pa.string()), pa.array([begin], pa.string()), pa.array([passed], pa.list_(pa.int32()))], ["no", "whole", "first", "last", "begin", "passed"])

    narrow = cut.select(F.col("document_id").cast("string"), "event", "_begin", "_range")
    summaries = sorted(narrow.mapInArrow(compose, "no int, whole boolean, first string, last string, begin string, passed array<int>").collect())  # one row a range
    enters: dict[int, int] = {}
    before: tuple | None = None  # the last document so far, and its status
    for r in summaries:
        if before is not None and before[0] == r.first:
            enters[r.no] = before[1]
        start = enters[r.no] if r.whole and r.no in enters else number.get(r.begin, UNKNOWN)
        before = (r.last, r.passed[start])
    kinds = cut.drop("_begin", "_range").schema.add("status", "string").add("result", "string").add("error", "string")
    names = [f.name for f in kinds]

    def follow(batches):
        last, status = None, UNKNOWN
        for batch in batches:
            out = []
            for document, event, start, no in zip(*(batch.column(c).to_pylist() for c in ("document_id", "event", "_begin", "_range")), strict=True):
                if last != (document,):
                    status = enters.get(no) if last is None else None
                    last, status = (document,), number.get(start, UNKNOWN) if status is None else status
                status, result, error = table.get(event, table[None])[status]
                out.append((STATUSES[status] if status < UNKNOWN else None, result, error))
            columns = [pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-3]), *columns], names=names)

    return cut.mapInArrow(follow, kinds)
