"""Scoring by a model that is set up once in each Python worker (CLS1), and a small numpy model that needs no weights file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from ..config import DEFAULT_BATCH_SIZE, LABEL2ID
from ..shipping import ship

PREDICTED = 8  # batches whose scores are returned together

_LOADED: dict = {}  # models of this Python worker


def loaded(name: str, load: Callable):
    """The model ``name``, from ``load()`` the first time in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def model_scorer(spark: SparkSession, name: str, load: Callable, predict: Callable, batch_size: int = DEFAULT_BATCH_SIZE) -> Callable[[Column], Column]:
    """A column function ``ARRAY<STRING> -> ARRAY<ARRAY<FLOAT>>``: scores of padded token lists.

    ``load()`` runs once in each Python worker (workers live on from task to task), under ``name``. ``predict(model, lists)`` gets at most
    ``batch_size`` token lists at a time, of whatever documents come next, and returns a (tokens x labels) array for each. A null list gives null.
    Lists leave Arrow, and scores go back, a few batches at a time: a worker never holds the scores of a whole Arrow batch (10,000 windows of
    512 slots and 11 labels are 56 million numbers).
    """
    import pyarrow as pa
    ship(spark)

    def score(batches):
        import pyarrow as pa
        from shroud.operators.models import loaded as once
        model = once(name, load)
        rows = PREDICTED * batch_size
        for lists in batches:
            for begin in range(0, len(lists), rows):
                own = lists.slice(begin, rows).to_pylist()
                there = [j for j, x in enumerate(own) if x is not None]
                out = [None] * len(own)
                for i in range(0, len(there), batch_size):
                    now = there[i:i + batch_size]
                    for j, scores in zip(now, predict(model, [own[j] for j in now])):
                        out[j] = [row.tolist() for row in np.asarray(scores, np.float32)]
                yield pa.array(out, pa.list_(pa.list_(pa.float32())), from_pandas=True)
    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(score, "array<array<float>>")


# --- a linear model over three features of a token ----------------------------------------
def linear_weights() -> list[tuple[int, int, int, int]]:
    """For each label: weights of a token's length, of a first letter A-Z, of a first digit, and the bias. Whole numbers from a rule."""
    return [((k * 7) % 11 - 5, (k * 5) % 11 * 3, (k * 3) % 11 * 4, (k * k) % 11 * 2) for k in range(len(LABEL2ID))]


def load_linear() -> np.ndarray:
    return np.array(linear_weights(), np.float32).T


def predict_linear(weights: np.ndarray, lists: list[list[str]]) -> list[np.ndarray]:
    flat = [t for tokens in lists for t in tokens]
    features = np.array([(len(t), "A" <= t[:1] <= "Z", "0" <= t[:1] <= "9", 1) for t in flat], np.float32).reshape(-1, 4)
    return np.split(features @ weights, np.cumsum([len(x) for x in lists])[:-1])
