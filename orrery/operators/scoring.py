"""Scores from outside, in batches that fail by themselves."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: rows that one request carries.
BATCH = 15

log = logging.getLogger(__name__)


def batched(score: Callable[[list[dict]], list[float | None]], size: int = BATCH, attempts: int = 2) -> Callable[[DataFrame], DataFrame]:
    """A scorer of tables from a scorer of a few rows: it adds ``score`` to every row.

    Rows go to ``score`` as dicts, ``size`` at a time, from within the tasks. A request that raises, or gives back another
    number of scores than it got rows, is tried ``attempts`` times; then its rows, and no others, have a null score. A score
    that is no finite number is null. What a task loses with its executor is asked again.
    """

    def asked(rows: list[dict]) -> list[float | None]:
        for attempt in range(attempts):
            try:
                found = list(score(rows))
                if len(found) == len(rows):
                    return [float(x) if x is not None and math.isfinite(float(x)) else None for x in found]
                log.warning("a scorer gave %d scores for %d rows", len(found), len(rows))
            except Exception as e:  # whatever the caller's scorer raises costs its own rows only
                log.warning("a scorer failed (attempt %d of %d): %s", attempt + 1, attempts, e)
        return [None] * len(rows)

    def table(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), size):
                    part = batch.iloc[at : at + size]
                    yield part.assign(score=pd.array(asked(part.to_dict("records")), "Float64"))

        given = rows.drop("score")
        return given.mapInPandas(run, given.select("*", F.lit(None).cast("double").alias("score")).schema)

    return table


def or_none(scorer: Callable[[DataFrame], DataFrame], rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``path, score`` as ``keep`` materialises them, or None if the scorer of whole tables fails."""
    try:
        return keep(scorer(rows).select("path", F.col("score").cast("double").alias("score")))
    except Exception as e:
        log.warning("a scorer failed, its scores are left out: %s", e)
        return None
