"""Processing life cycle: guarded transitions, page steps, retries, queues and circuit breakers, as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: By event: the statuses it may leave, the status it leads to, its result, and the errors of other statuses.
TRANSITIONS = {
    "start": ({"queued", "extracting"}, "processing", "processing_started", {"processing": "already_processing", "completed": "already_completed"}),
    "complete": ({"processing"}, "completed", "completed", {"completed": "already_completed"}),
    "fail": ({"processing"}, "error", "failed", {}),
    "reset": (None, "queued", "reset", {"completed": "cannot_reset_completed"}),
}

#: Silent transitions: what a page's work does to its document.
SILENT = {"processing": ("uploading", "extracting", "queued"), "queued": ("extracting",)}


def transition(status: Column, event: Column) -> Column:
    """struct(status, result, error) after an event; a null status is a document that does not exist."""
    new, result, error = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (valid, to, said, errors) in TRANSITIONS.items():
        on = event == name
        may = ~status.isin(*errors) if valid is None else status.isin(*valid)
        why = F.lit("invalid_status")
        for at, text in errors.items():
            why = F.when(status == at, text).otherwise(why)
        new = F.when(on & may, to).otherwise(new)
        result = F.when(on & may, said).otherwise(result)
        error = F.when(on & ~may, why).otherwise(error)
    error = F.when(status.isNull(), "document_not_found").otherwise(error)
    return F.struct(F.coalesce(new, status).alias("status"), result.alias("result"), error.alias("error"))


def silently(status: Column, to: str) -> Column:
    return F.when(status.isin(*SILENT[to]), to).otherwise(status)


def page_action(extraction: Column, translation: Column, markdown: Column) -> Column:
    """What processing a page does next: extract, translate, complete it without text, or nothing."""
    ready = (extraction == "completed") & (translation == "pending")
    return F.when(extraction == "pending", "extract").when(ready & (F.coalesce(markdown, F.lit("")) != ""), "translate").when(ready, "complete_empty").otherwise("skip")


def completed_documents(documents: DataFrame, completion: DataFrame) -> DataFrame:
    """documents with those whose pages are all done completed."""
    return documents.join(completion, "document_id", "left").withColumn("status", F.when(F.col("all_completed") & (F.col("status") == "processing"), "completed").otherwise(F.col("status"))).drop("all_completed")


# --- breakers ---


def failures_in_window(events: DataFrame, seconds: int, key: str = "fuse", ts: str = "ts") -> DataFrame:
    """events (failures) with n: failures of the same fuse within the seconds up to each, itself included.

    Time is cut into cells as long as the window, and each event also goes, as a halo, to its fuse's next cell, so that a cell has all that its own events look back to.
    Tasks get cells, however few the fuses; events without a time count each other.
    """
    length = max(1, seconds) * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cell = F.floor(at / length)
    placed = events.withColumn("_at", at).withColumn("_own", F.explode(F.when(at.isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))).withColumn("_cell", F.when(F.col("_own"), cell).otherwise(cell + 1))
    w = Window.partitionBy(key, "_cell").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return placed.withColumn("n", F.count("*").over(w)).filter("_own").select(*events.columns, "n")


def breaker_opens(events: DataFrame, tolerated: int, seconds: int, key: str = "fuse", ts: str = "ts") -> DataFrame:
    """events with open: whether the failures in the window are more than tolerated."""
    return failures_in_window(events, seconds, key, ts).withColumn("open", F.col("n") > tolerated)


def breaker_status(changes: DataFrame, known: DataFrame, key: str = "fuse") -> DataFrame:
    """(fuse, state) of each known fuse by its last change (fuse, ts, state); not_found if it never changed."""
    last = changes.groupBy(key).agg(F.max_by("state", "ts").alias("state"))
    return known.select(key).join(last, key, "left").select(key, F.coalesce("state", F.lit("not_found")).alias("state"))


#: Seconds of a cell of time in which checks are put in order.
CHECK_CELL = 86_400


def recovery_edges(checks: DataFrame, key: str, ts: str, ok: Column, cell_seconds: int = CHECK_CELL) -> DataFrame:
    """checks with reset: whether a check is good right after a bad one.

    Checks are put in order within cells of time; the first of a cell follows the last of the key's cell before, of which there is one row a cell. Checks without a time come first.
    """
    cell = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (cell_seconds * 1_000_000)), F.lit(-(1 << 62)))
    placed = checks.withColumn("_ok", ok).withColumn("_cell", cell)
    last = placed.groupBy(key, "_cell").agg(F.max_by("_ok", F.struct(F.col(ts).isNotNull(), F.col(ts))).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_cell"))).select(F.col(key).alias("_key"), F.col("_cell").alias("_in"), "_before")
    w = Window.partitionBy(key, "_cell").orderBy(ts)
    ordered = placed.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag("_ok").over(w))
    joined = ordered.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_in")), "left")
    earlier = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    return joined.withColumn("reset", F.coalesce(F.col("_ok") & ~earlier, F.lit(False))).select(*checks.columns, "reset")


# --- queues ---


def queued(jobs: DataFrame, cap: int = 10, key: str | None = None) -> DataFrame:
    """jobs (seq, priority) with place and accepted: a job that comes while cap jobs are queued is refused, whatever its priority, and has no place. High priority goes to the
    front, the newest first; the rest stays first in, first out.

    With key there is a queue for each value of it. Without, there is one: its first cap jobs are all that is put in order.
    """
    high = F.col("priority") == "high"
    order = [F.desc(high.cast("int")), F.when(high, -F.col("seq")).otherwise(F.col("seq"))]
    if key is None:
        first = jobs.orderBy("seq").limit(cap).withColumn("_q", F.lit(0))
        places = first.withColumn("place", F.row_number().over(Window.partitionBy("_q").orderBy(*order))).select("seq", "place")  # cap rows
        return jobs.join(F.broadcast(places), "seq", "left").select(*jobs.columns, "place", F.col("place").isNotNull().alias("accepted"))
    came = jobs.withColumn("accepted", F.row_number().over(Window.partitionBy(key).orderBy("seq")) <= cap)
    place = F.row_number().over(Window.partitionBy(key, "accepted").orderBy(*order))
    return came.select(*jobs.columns, F.when(F.col("accepted"), place).alias("place"), "accepted")


def cancelled(jobs: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """jobs with those of the documents, or of their pages, cancelled while they have not begun."""
    owned = documents.select(F.col("document_id").alias("id")).unionByName(pages.join(documents.select("document_id"), "document_id", "left_semi").select(F.col("page_id").cast("string").alias("id"))).distinct()
    named = jobs.withColumn("_id", F.coalesce(F.get_json_object("args", "$.page_id"), F.get_json_object("args", "$.document_id")))
    hit = named.join(owned.select(F.col("id").alias("_own"), F.lit(True).alias("_hit")), F.col("_id") == F.col("_own"), "left")
    return hit.withColumn("state", F.when(F.col("_hit") & F.col("state").isin("available", "scheduled", "retryable"), "cancelled").otherwise(F.col("state"))).select(*jobs.columns)


def reprocess_args(page: Column, extraction_model: Column, translation_model: Column) -> Column:
    """JSON arguments of a job; models appear only where they are set."""
    return F.to_json(F.struct(page.cast("string").alias("page_id"), extraction_model.alias("extraction_model"), translation_model.alias("translation_model")))


def topics(updates: DataFrame, doc: str = "document_id") -> DataFrame:
    """Each update once for its document's topic and once for all."""
    return updates.withColumn("topic", F.explode(F.array(F.concat(F.lit("document:"), F.col(doc)), F.lit("documents"))))


def stale(started: Column, now: Column, seconds: int = 360) -> Column:
    """Whether a page's task has run out of time."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp")) > seconds * 1_000_000, F.lit(False))


def recovered(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, document_id) to work on after a start: the pending pages of documents that are queued or in work."""
    begun = documents.filter(F.col("status").isin("processing", "queued")).select("document_id")
    return pages.filter("extraction_status = 'pending'").join(begun, "document_id").select("page_id", "document_id")
