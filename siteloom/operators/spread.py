"""Joins of a site's few rows with its many, and places among a site's many rows, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.session import cut_lineage

SALTS = 32


def join_per_site(
    rows: DataFrame, per_site: DataFrame, by: str, how: str = "inner", salts: int = SALTS, on: tuple[str, ...] = ("site",)
) -> DataFrame:
    """``rows`` joined with ``per_site`` on site (or the columns ``on``).

    A site with a third of all rows would be one task of the join; its rows are dealt by a hash of
    ``by`` and the few rows of ``per_site`` are repeated once a salt.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = per_site.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def placed_within(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Adds ``name``: the place, from 1, of each row among those of its ``keys`` (not null), by ``order``.

    Rows are range-partitioned and numbered inside each range; a key's ranges are shifted by those before, so a
    key with a third of all rows is many ranges and no window over its rows. The ranges are checkpointed.
    """
    sort = [*keys, *order]
    kept = cut_lineage(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id()))
    kept = kept.withColumn("_range", F.shiftright("_id", 33))
    pieces = kept.groupBy("_range", *keys).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("_range", *keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return kept.join(pieces, ["_range", *keys]).withColumn(name, place.cast("int")).drop("_id", "_range", "_first", "_before")
