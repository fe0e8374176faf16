"""Objects that tasks need, sent as plain data: a broadcast names classes by module, and executors may lack the package."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def carried(spark: SparkSession, plain: Any, build: Callable[[Any], Any]) -> Callable[[], Any]:
    """A function for tasks that gives ``build(plain)``, built once in each worker.

    ``plain`` holds nothing but built-in types and arrays; ``build`` travels with the functions that call it.
    """
    shared = spark.sparkContext.broadcast({"plain": plain})

    def get() -> Any:
        held = shared.value
        if "built" not in held:
            held["built"] = build(held["plain"])
        return held["built"]

    return get
