"""Operations: telemetry, health, queues, sweeping, translation catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counter(events: DataFrame, *tags: str) -> DataFrame:
    return events.groupBy(*tags).agg(F.count("*").alias("n"))


#: Median and 95th percentile are values whose share of rows is off by at most one part in so many; with fewer rows they are exact.
ACCURACY = 10_000


def summary(events: DataFrame, value: str, *tags: str) -> DataFrame:
    """Statistics of a value by tags; percentiles from a sketch of bounded size, so that no task holds all values of a tag."""
    v = F.col(value)
    return events.groupBy(*tags).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.percentile_approx(v, 0.5, ACCURACY).alias("median"), F.percentile_approx(v, 0.95, ACCURACY).alias("p95"))


def total(events: DataFrame, value: str, *tags: str) -> DataFrame:
    return events.groupBy(*tags).agg(F.sum(value).alias("total"))


def queue_counts(jobs: DataFrame, queues: tuple[str, ...]) -> DataFrame:
    """One row with the number of jobs in each queue, zeros included: a single conditional aggregate."""
    return jobs.agg(*(F.sum(F.when(F.col("queue") == q, 1).otherwise(0)).alias(q) for q in queues))


def queue_stats(jobs: DataFrame) -> DataFrame:
    n = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, 1).otherwise(0)), F.lit(0))
    return jobs.agg((n("pending") + n("completed") + n("failed")).alias("total"), n("pending").alias("pending"), F.lit(0).cast("long").alias("processing"), n("completed").alias("completed"), n("failed").alias("failed"))


def health_rollup(checks: DataFrame, ok: Column, *by: str) -> DataFrame:
    good = F.coalesce(ok, F.lit(False))
    return checks.groupBy(*by).agg(F.count("*").alias("total"), F.sum(good.cast("long")).alias("healthy"), F.sum((~good).cast("long")).alias("unhealthy"), F.bool_and(good).alias("all_healthy"))


def orphans(directories: DataFrame, documents: DataFrame, now: Column, grace_hours: int = 24) -> DataFrame:
    """Directories (name, is_dir, mtime) that belong to no document and are older than the grace period; without mtime they stay."""
    old = F.col("mtime") < now - F.expr(f"INTERVAL {grace_hours} HOURS")
    return directories.filter(F.col("is_dir") & old).join(documents.select(F.col("document_id").alias("name")), "name", "left_anti")


def missing_translations(templates: DataFrame, catalogues: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, domain, msgid) of the templates (domain, msgid) that a language's catalogue (lang, domain, msgid, msgstr) lacks or leaves blank.

    Every template meets every language: languages are a short list, exploded onto the templates rather than cross joined.
    """
    known = languages.agg(F.collect_set("lang").alias("langs")).first()[0]  # bounded: languages of an interface
    wanted = templates.filter("msgid <> ''").select(F.explode(F.array(*(F.lit(x) for x in sorted(known)))).alias("lang"), "domain", "msgid") if known else templates.select(F.lit("").alias("lang"), "domain", "msgid").filter("false")
    done = catalogues.filter("msgstr <> ''").select("lang", "domain", "msgid").distinct()
    return wanted.filter("lang <> 'en'").join(done, ["lang", "domain", "msgid"], "left_anti")


def missing_counts(missing: DataFrame) -> DataFrame:
    """Counts by language and domain, by language, and in all (null where a level is summed)."""
    return missing.rollup("lang", "domain").agg(F.count("*").alias("n"))


def oversized(lines: DataFrame, most: int = 500) -> DataFrame:
    """(file, n_lines, over) of the files (file, n_lines) that are longer than most."""
    return lines.groupBy("file").agg(F.sum("n_lines").alias("n_lines")).filter(F.col("n_lines") > most).withColumn("over", F.col("n_lines") - most)
