"""Seconds by stage of a driver program."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class StageTimers:
    """Adds up what each named stage took; jobs that start inside carry its name in the engine's own views."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.seconds = spark, {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        if self.spark:
            self.spark.sparkContext.setJobDescription(name)
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            if self.spark:
                self.spark.sparkContext.setJobDescription(None)

    def report(self) -> str:
        return "\n".join(f"{name}: {took:.3f} s" for name, took in self.seconds.items())
