"""How many rows a run has made, and how fast: counted as they pass, without a second look at the data."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Counts the rows of an action, and those that meet conditions, and times it:

    with Progress(failed=F.col("error").isNotNull()) as p:
        p.counted(df).write.parquet(path)
    p.rows, p.counts["failed"], p.rate, p.remaining(total)
    """

    def __init__(self, **conditions: Column):
        self.conditions, self.observation, self.seconds = conditions, Observation(), 0.0

    def __enter__(self) -> Progress:
        self.began = time.monotonic()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.monotonic() - self.began

    def counted(self, df: DataFrame) -> DataFrame:
        """df, its rows counted when they are made. For one action over one frame."""
        whether = [F.count_if(c).alias(n) for n, c in self.conditions.items()]
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *whether)

    @property
    def counts(self) -> dict[str, int]:
        return self.observation.get

    @property
    def rows(self) -> int:
        return self.counts["rows"]

    @property
    def rate(self) -> float:
        """Rows a second."""
        return self.rows / self.seconds if self.seconds else 0.0

    def remaining(self, total: int) -> float | None:
        """Seconds that the rest of so many rows takes at this rate; None where there is no rate yet."""
        return (total - self.rows) / self.rate if self.rate else None
