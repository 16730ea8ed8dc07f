"""Sentence vectors by a model that the caller plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors under a mask, as unit vectors: (texts, tokens, dims) -> (texts, dims)."""
    m = mask[:, :, None].astype(np.float64)
    mean = (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


def encoded(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Column:
    """Unit vectors of texts. load() makes the model once a worker; the model maps a list of texts to a matrix."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = texts.fillna("").tolist()
            out = [v.astype(np.float32) for a in range(0, len(rows), batch) for v in model(rows[a : a + batch])]
            yield pd.Series(out)

    return run(text)
