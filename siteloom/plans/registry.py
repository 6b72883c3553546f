"""Registered queries: one Spark callable and, where SQL can say it, one oracle each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    oracle: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, covers: str = "") -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, oracle, covers)
        return run

    return add
