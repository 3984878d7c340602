"""UX-7, RET-13: a pair model as a reranker, run in batches on the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scores as S

#: Pairs that a model gets at once, of like length so that little is padded.
PAIRS = 32

Model = Callable[[list[tuple[str, str]]], list[float]]
_loaded: dict[str, Model | None] = {}  # of this worker process


def overlap_model() -> Model:
    """A model that needs no weights, for tests and as an offline stand-in: logits from -4 to 4 by the share of the
    query's words in the text."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, d in pairs:
            own = set(re.findall("[a-z0-9]+", q.lower()))
            out.append(8.0 * len(own & set(re.findall("[a-z0-9]+", d.lower()))) / max(len(own), 1) - 4.0)
        return out

    return score


def model_logits(load: Callable[[], Model], pairs: int = PAIRS) -> Callable[[Column, Column], Column]:
    """A column function (query, text) -> the model's logit.

    ``load`` runs once a worker process, not once a batch.  The pairs of an
    Arrow batch are sorted by length and go to the model ``pairs`` at a time.
    Null where the model cannot be loaded or fails on a pair, so that a
    heuristic can answer there (``blended``)."""

    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if key not in _loaded:
            try:
                _loaded[key] = load()
            except Exception:  # noqa: BLE001  a model that is absent must not end the job
                _loaded[key] = None
        model = _loaded[key]
        for queries, texts in batches:
            both = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
            out = np.full(len(both), np.nan)
            order = sorted(range(len(both)), key=lambda i: len(both[i][0]) + len(both[i][1]))
            for a in range(0, len(order), pairs) if model else ():
                part = order[a : a + pairs]
                try:
                    out[part] = model([both[i] for i in part])
                except Exception:  # noqa: BLE001
                    continue
            yield pd.Series(out)

    return score


def blended(score: Column, logit: Column, heuristic: Column) -> Column:
    """RET-13 where the model has answered, RET-12's heuristic in RET-11's blend where not."""
    return F.when(logit.isNotNull() & ~F.isnan(logit), S.model_blend(score, logit)).otherwise(S.rerank_blend(score, heuristic))
