"""External models as injected callables: they run in batches inside mapInPandas, retry, and have one breaker for each service in a worker."""

from __future__ import annotations

import base64
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.arrow import short_batches


class ModelError(Exception):
    """A failure of a model: permanent ones are not retried."""

    def __init__(self, text: str, permanent: bool = False):
        super().__init__(text)
        self.permanent = permanent


@dataclass
class Breaker:
    """Open after more than tolerated failures within window seconds, for refresh seconds."""

    tolerated: int = 5
    window: float = 60.0
    refresh: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failures: list = field(default_factory=list)
    opened: float | None = None

    def is_open(self) -> bool:
        if self.opened is not None and self.clock() >= self.opened + self.refresh:
            self.opened, self.failures = None, []
        return self.opened is not None

    def melt(self) -> None:
        now = self.clock()
        self.failures = [t for t in self.failures if t >= now - self.window] + [now]
        if len(self.failures) > self.tolerated:
            self.opened = now


#: By service: failures that are tolerated, within so many seconds, and seconds for which the breaker stays open.
SERVICES = {"model_api": (5, 60.0, 30.0), "embedding_api": (3, 30.0, 15.0)}
_BREAKERS: dict[str, Breaker] = {}


def breaker_of(service: str) -> Breaker:
    """The breaker of a service in this worker: all partitions that the worker runs share it. Workers do not see each other's failures."""
    if service not in _BREAKERS:
        _BREAKERS[service] = Breaker(*SERVICES.get(service, (5, 60.0, 30.0)))
    return _BREAKERS[service]


def cleaned(text: str | None) -> str:
    """A model's reply, trimmed and without fences around it; an empty reply is an error."""
    out = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```[^\n]*\n", "", (text or "").strip())).strip()
    if not out:
        raise ModelError("empty response")
    return out


def called(call: Callable, *args, attempts: int = 3, delay: Callable[[int], float] = lambda attempt: min(2.0 * 2**attempt, 30.0), breaker: Breaker | None = None, sleep: Callable[[float], None] = time.sleep):
    """call(*args), tried again after retryable failures; an open breaker fails at once."""
    for attempt in range(attempts):
        if breaker is not None and breaker.is_open():
            raise ModelError("circuit_open", True)
        try:
            return call(*args)
        except Exception as e:
            if breaker is not None:
                breaker.melt()
            if getattr(e, "permanent", False) or attempt + 1 == attempts:
                raise
            sleep(delay(attempt))
    return None


def _applied(df: DataFrame, key: str, column: str, kind: str, one: Callable, service: str = "model_api", **how) -> DataFrame:
    short_batches(df.sparkSession)

    def run(batches):
        breaker = breaker_of(service)
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[column], strict=True):
                try:
                    rows.append((k, called(one, value, breaker=breaker, **how), None))
                except Exception as e:  # noqa: BLE001  the model is foreign code
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "value", "error"])

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, value {kind}, error string")


def generated(df: DataFrame, key: str, prompt: str, model: Callable[[str], str], **how) -> DataFrame:
    """(key, value, error): a text for each prompt."""
    return _applied(df, key, prompt, "string", lambda p: cleaned(model(p)), **how)


def read_images(df: DataFrame, key: str, content: str, model: Callable[[str], str], **how) -> DataFrame:
    """(key, value, error): the Markdown of each image; the model gets it in base64."""
    return _applied(df, key, content, "string", lambda raw: cleaned(model(base64.b64encode(bytes(raw)).decode())), **how)


def embedded(df: DataFrame, key: str, column: str, model: Callable[[str], list[float]], **how) -> DataFrame:
    """(key, value, error): a vector for each text; null and empty texts have none, and that is no error."""
    return _applied(df, key, column, "array<float>", lambda t: [float(x) for x in model(t)] if t else None, **{"service": "embedding_api", **how})


def chat(messages: list[dict], model: Callable[[list[dict]], str], **how) -> str:
    return cleaned(called(model, messages, **how))


def model_names(tags: dict) -> list[str]:
    """The names that a model server lists."""
    return [m["name"] for m in (tags or {}).get("models") or []]


def allowed(wanted: list[str | None], available: list[str]) -> bool:
    return all(w in available for w in wanted if w)


def embedded_pages(pages: DataFrame, model: Callable[[str], list[float]], **how) -> DataFrame:
    """(page_id, embedding, embedding_status) of the extracted pages: vectors of their original texts. A page without text is completed without a vector."""
    done = pages.filter("extraction_status = 'completed'")
    return embedded(done, "page_id", "original_markdown", model, **how).selectExpr("page_id", "value AS embedding", "CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS embedding_status")
