"""Table maintenance: sync by id, drafts, versions, manifests. ``site_table`` replaces sites and applies changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_by_id(
    planned: DataFrame,
    existing: DataFrame,
    keep: dict[str, Column],
    deletable: Column,
    id_cols: list[str],
) -> DataFrame:
    """Full outer join of a plan with what is stored → rows with ``change`` upsert/delete/keep.

    ``keep`` maps a column to a condition on the stored row (prefix ``old_``) under which the
    stored value survives; ``deletable`` says which stored rows may go when no longer planned.
    """
    value_cols = [c for c in planned.columns if c not in id_cols]
    old = existing.select(*id_cols, *[F.col(c).alias(f"old_{c}") for c in value_cols], F.lit(True).alias("_old"))
    new = planned.select(*id_cols, *value_cols, F.lit(True).alias("_new"))
    both = new.join(old, id_cols, "full_outer")
    change = (
        F.when(F.col("_new"), "upsert").when(F.coalesce(deletable, F.lit(False)), "delete").otherwise("keep")
    )

    def merged(c: str) -> Column:
        stored = F.col(f"old_{c}")
        if c in keep:
            wins = F.col("_old") & F.coalesce(keep[c], F.lit(False))
            return F.when(F.col("_new").isNull() | wins, stored).otherwise(F.col(c))
        return F.when(F.col("_new").isNull(), stored).otherwise(F.col(c))

    return both.select(*id_cols, *[merged(c).alias(c) for c in value_cols], change.alias("change"))


def after_sync(synced: DataFrame) -> DataFrame:
    """The table as it stands when the changes are applied."""
    return synced.filter("change <> 'delete'").drop("change")


def prefer_drafts(df: DataFrame, id_col: str = "doc_id", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row per published id; the draft overlays the published document."""
    is_draft = F.col(id_col).startswith("drafts.")
    plain = F.regexp_replace(id_col, r"^drafts\.", "")
    rest = [c for c in df.columns if c not in (id_col, *keys)]
    return (
        df.select(*keys, plain.alias(id_col), is_draft.alias("is_draft"), *rest)
        .groupBy(*keys, id_col)
        .agg(F.max_by(F.struct("is_draft", *rest), F.col("is_draft").cast("int")).alias("r"))
        .select(*keys, id_col, "r.*")
    )


def latest_version(types: DataFrame) -> DataFrame:
    """Rows of the highest version of every site."""
    top = types.groupBy("site").agg(F.max("version").alias("version"))
    return types.join(top, ["site", "version"], "left_semi")


def next_version(sites: DataFrame, types: DataFrame) -> DataFrame:
    """Version number the next proposal of each site gets."""
    top = types.groupBy("site").agg(F.max("version").alias("v"))
    return sites.select("site").distinct().join(top, "site", "left").select(
        "site", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version")
    )


def append_version(types: DataFrame, path: str) -> None:
    """Append-only proposal history, partitioned by site."""
    types.write.mode("append").partitionBy("site").parquet(path)


def release_id(site: Column) -> Column:
    return F.concat(F.lit("r"), F.substring(F.sha1(F.concat_ws("\u0000", F.lit("release"), site)), 1, 9))


def site_manifest(settings: DataFrame, collections: DataFrame, types: DataFrame) -> DataFrame:
    """One publishable row per site: title, release, collections, JSON list of type definitions.

    Collections and types are the content model of a site (tens of rows by construction).
    """
    cols = collections.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("type", "route"))).alias("collections")
    )
    defs = types.groupBy("site").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "kind")))).alias("manifest"))
    return (
        settings.select("site", "site_title", release_id(F.col("site")).alias("release_id"))
        .join(cols, "site", "left")
        .join(defs, "site", "left")
        .select("site", "site_title", "release_id", F.to_json("collections").alias("collections"), "manifest")
    )
