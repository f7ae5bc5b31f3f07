"""Similarity of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarities are rounded before they are ranked or returned, so that the last bits of a sum decide nothing.
DIGITS = 9


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a query bound as a literal, in doubles; null for zero vectors and vectors of another length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    if not norm:
        return F.lit(None).cast("double")
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    length = F.sqrt(F.aggregate(vector, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (length > 0), F.round(dot / (length * norm), DIGITS))


def cosine_batches(query: Sequence[float]):
    """The same by matrix products over Arrow batches: a pandas UDF, several times as fast on long vectors."""
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def similarity(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        ok = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        if ok.any() and norm:
            m = np.stack([np.asarray(v, np.float64) for v in vectors[ok]])
            length = np.linalg.norm(m, axis=1)
            out[ok] = np.where(length > 0, (m @ q) / np.where(length > 0, length * norm, 1.0), np.nan)
        return pd.Series(np.round(out, DIGITS)).where(~np.isnan(out), None)

    return similarity
