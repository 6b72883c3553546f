"""Readers: the supplied parquet tables as the site-content model, one row source each.

Columns the supplied tables lack (status codes, paths of documents) are derived by fixed,
visible rules, so the SQL oracles can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls as U


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Deal a table too small for a piece a core out to all cores.

    A scan makes no piece below ``spark.sql.files.openCostInBytes`` and cannot cut a row group, so a small table of large
    texts is one or two tasks. Below that size a core the rows are dealt by ``key``; larger tables are left as they are scanned.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    smallest = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores, key) if size < cores * smallest else df


def synthetic_status(page_id: Column) -> Column:
    return F.when(page_id % 17 == 0, 404).otherwise(200)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages: site, page_id, url, path, http_status, html (kept for re-extraction)."""
    return spread_small(table(spark, folder, "pages"), "page_id").select(
        U.site_key("url").alias("site"),
        "page_id",
        "url",
        U.path_of("url").alias("path"),
        synthetic_status(F.col("page_id")).alias("http_status"),
        "html",
    )


def read_document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of the site named by ``source``; every 7th one is a contact page."""
    doc = spread_small(table(spark, folder, "documents"), "doc_id")
    path = F.when(F.col("doc_id") % 7 == 0, F.lit("/contact")).otherwise(
        F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"))
    )
    return doc.select(
        F.col("source").alias("site"),
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example"), path).alias("url"),
        path.alias("path"),
        synthetic_status(F.col("doc_id")).alias("http_status"),
        "text",
        "lang",
    )


# Lifecycle stages in order, the last one being the failure off-ramp.
STAGES = ["start", "crawl", "model", "review", "build", "apply", "publish", "live", "failed"]
# Effects of the lifecycle by stage.
STAGE_EFFECT = {
    "crawl": "extract",
    "model": "infer",
    "review": "ask",
    "build": "plan",
    "apply": "cast",
    "publish": "release",
}


def stage_of(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), (n % len(STAGES)).cast("int") + 1)


def effect_of(n: Column) -> Column:
    names = list(STAGE_EFFECT.values())
    return F.element_at(F.array(*[F.lit(s) for s in names]), (n % len(names)).cast("int") + 1)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """Event log of the lifecycle, one instance per user of the events table."""
    return as_history(table(spark, folder, "events"))


def as_history(events: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "stageEntered")
        .when(F.col("event_type") == "view", "actionFired")
        .when(F.col("event_type") == "click", "effectQueued")
        .otherwise("effectCompleted")
    )
    n = F.col("event_id")
    stage = F.when(kind == "stageEntered", stage_of(n))
    return events.select(
        F.col("user_id").alias("instance"),
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        kind.alias("kind"),
        F.when(n % 4 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("actor"),
        stage.alias("stage"),
        F.when(kind == "actionFired", F.concat(F.lit("action-"), (n % 3).cast("string"))).alias("action"),
        F.when(kind == "actionFired", F.concat(F.lit("activity-"), (n % 5).cast("string"))).alias("activity"),
        F.when(kind.startswith("effect"), effect_of(n)).alias("effect"),
        F.when(F.col("event_type") == "purchase", "done")
        .when(F.col("event_type") == "error", "failed")
        .alias("status"),
        "value",
    )
