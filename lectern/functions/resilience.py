"""Retry delays and the classification of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_MS, MAX_MS, MULTIPLIER, JITTER = 2_000, 30_000, 2, 0.25

# Parts of messages and error names by class.
RETRYABLE_PARTS = ("timeout", "timed out", "connection refused", "connection reset", "503", "502", "500", "429", "rate limit")
PERMANENT_PARTS = ("not found", "404", "400", "invalid")
RETRYABLE_NAMES = ("timeout", "econnrefused", "econnreset", "closed", "nxdomain")
PERMANENT_NAMES = ("enoent", "eacces", "enotdir")


def backoff(attempt: Column, base: int = BASE_MS, most: int = MAX_MS, multiplier: int = MULTIPLIER, jitter: float = JITTER, seed: Column | None = None) -> Column:
    """Milliseconds before the attempt after this one. The jitter follows a hash of seed, so that a retried task sees the same delay."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(float(multiplier)), attempt), F.lit(float(most))).cast("long")
    if not jitter:
        return delay
    width = F.round(delay * jitter).cast("long")
    offset = F.pmod(F.xxhash64(seed if seed is not None else attempt), width * 2 + 1) - width
    return F.greatest(F.lit(0).cast("long"), delay + offset)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def error_class(message: Column) -> Column:
    """Of an error's text."""
    return F.when(_any(message, RETRYABLE_PARTS), "retryable").when(_any(message, PERMANENT_PARTS) | (message.contains("model") & message.contains("not")), "permanent").otherwise("unknown")


def status_class(code: Column) -> Column:
    """Of an HTTP status."""
    return F.when((code == 429) | code.between(500, 599), "retryable").when(code.between(400, 499), "permanent").otherwise("unknown")


def name_class(name: Column) -> Column:
    """Of a system error's name."""
    return F.when(name.isin(*RETRYABLE_NAMES), "retryable").when(name.isin(*PERMANENT_NAMES), "permanent").otherwise("unknown")


def retryable(kind: Column) -> Column:
    """Unknown errors are retried."""
    return kind != "permanent"


def retry_decision(kind: Column, attempts: Column, most: int = 3, circuit_open: Column | None = None) -> Column:
    """What follows a failed attempt: fail at once if the circuit is open or the error permanent, back off while attempts are left."""
    stop = F.lit(False) if circuit_open is None else circuit_open
    return F.when(stop, "fail").when(~retryable(kind), "fail").when(attempts < most, "retry").otherwise("fail")
