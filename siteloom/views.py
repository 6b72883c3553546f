"""SQL surface: results of registered queries as temporary views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from siteloom.plans import REGISTRY


def register_views(spark: SparkSession, folder: str, names: Iterable[str] | None = None, prefix: str = "") -> list[str]:
    """Create a temporary view per query (all of them where no names are given) over the tables in ``folder``.

    Most views are evaluated when they are read; queries that store an intermediate result do
    so here. Returns the view names.
    """
    made = []
    for name in REGISTRY if names is None else names:
        REGISTRY[name].run(spark, folder).createOrReplaceTempView(prefix + name)
        made.append(prefix + name)
    return made
