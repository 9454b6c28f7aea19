"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The pattern of a run of ASCII white space, as the operators on words define it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z in lower case, divided at ASCII white space. Null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def by_batch(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapInPandas function from a function of one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield f(batch)

    return run
