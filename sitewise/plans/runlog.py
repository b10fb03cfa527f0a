"""A log of a workflow's sections: what ran, with which settings, how it ended, how long it took."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class RunLog:
    """Sections as rows (ord, section, key, value); each ends with status (OK or FAIL) and elapsed seconds."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, str, str]] = []

    def note(self, section: str, **values) -> None:
        self.rows += [(len(self.rows) + i, section, k, str(v)) for i, (k, v) in enumerate(values.items())]

    @contextmanager
    def section(self, name: str, **settings):
        self.note(name, **settings)
        began, status = time.time(), "FAIL"
        try:
            yield self
            status = "OK"
        finally:
            self.note(name, status=status, elapsed=f"{time.time() - began:.3f}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "ord int, section string, key string, value string")
