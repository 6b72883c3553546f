"""Streams run to completion over the supplied files, compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.plans import duck as D
from siteloom.plans.registry import query
from siteloom.sources import tables as T
from siteloom.streaming import runner as R
from siteloom.streaming import streams as ST


def question_changes(events):
    """Every event changes one variant, published or draft, of a question of its user: asked, answered, or deleted."""
    n = F.col("event_id")
    return events.select(
        (F.col("user_id") % 20).alias("site"), F.col("user_id").alias("question_id"), (n % 3 == 1).alias("draft"), "event_id",
        F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 3 != 0).alias("required"),
        F.when(n % 4 == 0, "yes").when(n % 4 == 1, " ").alias("answer"), F.col("event_type").isin("error", "purchase").alias("deleted"),
    )


OPEN = """WITH l AS (SELECT user_id, event_id % 3 = 1 AS draft, last(event_id ORDER BY ts, event_id) AS n, last(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY ALL),
    s AS (SELECT user_id, last(n ORDER BY draft) AS n FROM l WHERE t NOT IN ('error', 'purchase') GROUP BY user_id)
    SELECT user_id % 20 AS site, count(*)::BIGINT AS open_required FROM s WHERE user_id % 3 <> 0 AND n % 4 <> 0 GROUP BY 1"""


@query("stream_open_questions", OPEN, covers="J1")
def _(spark, d):
    changes = question_changes(R.read_stream(spark, d, "events.parquet"))
    deltas = R.run_to_table(ST.open_question_deltas(changes), "open-questions", "update", on_batch=lambda b, i: b)
    return ST.open_questions(deltas.drop("batch")).filter("open_required > 0")


@query("open_required_questions", OPEN, covers="J1")
def _(spark, d):
    return ST.open_required(question_changes(T.table(spark, d, "events")))


@query(
    "stream_overdue",
    f"""WITH {D.HI}, sv AS (SELECT instance, event_id, tm, stage, lead(tm) OVER (PARTITION BY instance ORDER BY tm, event_id) AS left_at FROM hi WHERE kind = 'stageEntered'),
    w AS (SELECT max(tm) - INTERVAL 10 MINUTE AS wm FROM hi WHERE kind = 'stageEntered')
    SELECT instance, event_id, epoch_us(tm) // 1000 + 172800000 AS due_ms FROM sv, w WHERE stage = 'review' AND coalesce(left_at > tm + INTERVAL 48 HOUR, tm + INTERVAL 48 HOUR <= wm)""",
    covers="J2",
)
def _(spark, d):
    history = T.as_history(R.read_stream(spark, d, "events.parquet"))
    return R.run_to_table(ST.overdue_visits(history), "overdue")


def progress(events):
    return events.select(
        F.col("user_id").alias("instance"), T.effect_of(F.col("event_id")).alias("effect"), "event_id",
        (F.timestamp_micros(F.col("event_id") * 1000 * 40)).alias("at"), ((F.col("value") * 3) % 104).alias("percent"),
    )


_THROTTLE = f"""p0 AS (SELECT user_id AS instance, {D.EFFECT}[(event_id % 6)::INT + 1] AS effect, event_id, event_id * 40 AS ms,
   greatest(0, least(100, floor((value * 3) % 104 + 0.5)))::BIGINT AS pct FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY instance, effect ORDER BY ms, event_id) AS rn FROM p0),
r AS (SELECT instance, effect, event_id, rn, pct, pct AS last_pct, ms AS last_ms, true AS emit FROM p WHERE rn = 1
  UNION ALL SELECT p.instance, p.effect, p.event_id, p.rn, p.pct,
    CASE WHEN p.pct IN (0, 100) OR p.pct - last_pct >= 10 OR p.ms - last_ms >= 3000 THEN p.pct ELSE last_pct END,
    CASE WHEN p.pct IN (0, 100) OR p.pct - last_pct >= 10 OR p.ms - last_ms >= 3000 THEN p.ms ELSE last_ms END,
    p.pct IN (0, 100) OR p.pct - last_pct >= 10 OR p.ms - last_ms >= 3000
  FROM r JOIN p ON p.instance = r.instance AND p.effect = r.effect AND p.rn = r.rn + 1)"""
_THROTTLED = f"WITH RECURSIVE {_THROTTLE} SELECT instance, effect, event_id, pct AS percent FROM r WHERE emit"


@query("throttled_progress", _THROTTLED, covers="J3")
def _(spark, d):
    return ST.throttle_progress(progress(T.table(spark, d, "events")))


@query("stream_progress", _THROTTLED, covers="J3")
def _(spark, d):
    p = progress(R.read_stream(spark, d, "events.parquet"))
    return R.run_to_table(ST.throttle_progress_stream(p), "progress", "update", on_batch=lambda b, i: b).drop("batch")


@query(
    "stream_pending_work",
    """WITH c AS (SELECT user_id AS instance, event_id, ts, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' ELSE 'a*' END AS pending,
      CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS unclaimed FROM events),
    l AS (SELECT *, lag(pending) OVER (PARTITION BY instance ORDER BY ts, event_id) AS before FROM c)
    SELECT instance, event_id, unclaimed FROM l WHERE pending IS DISTINCT FROM before AND unclaimed > 0""",
    covers="J4",
)
def _(spark, d):
    n = F.col("event_id") % 4
    changes = R.read_stream(spark, d, "events.parquet").select(
        F.col("user_id").alias("instance"), "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.when(n == 0, "").when(n == 1, "a").when(n == 2, "a,b").otherwise("a*").alias("pending"),
        F.when(n == 1, 1).when(n == 2, 2).otherwise(0).cast("long").alias("unclaimed"),
    )
    return R.run_to_table(ST.pending_work_signals(changes), "signals", "update", on_batch=lambda b, i: b).drop("batch")


@query(
    "stream_pages",
    f"WITH {D.DP} SELECT DISTINCT site, substr(sha256(text), 1, 32) AS content_hash FROM dp",
    covers="J5",
)
def _(spark, d):
    def seen(docs):
        return docs.select(
            F.col("source").alias("site"), F.col("doc_id").alias("page_id"), F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"),
            F.timestamp_micros((F.col("doc_id") + 1) * 60_000_000).alias("seen_at"),
        )

    out = R.run_to_table(ST.deduped_page_stream(seen(R.read_stream(spark, d, "documents.parquet")), "2 hours"), "pages", partition_by=["site"])
    return ST.all_contents(seen(T.table(spark, d, "documents")), out)


@query(
    "stream_redirects",
    f"""WITH {D.PG}, m AS (SELECT site, page_id, {D.esc('path')} AS path FROM pg)
    SELECT site, page_id, path, CASE WHEN length(path) > 1 AND path LIKE '%/' THEN 308 WHEN path LIKE '%.html' THEN 301 ELSE 200 END::INT AS status,
      CASE WHEN length(path) > 1 AND path LIKE '%/' THEN {D.norm_path('path')} ELSE regexp_replace(path, '[.]html$', '') END AS location FROM m""",
    covers="J6",
)
def _(spark, d):
    site, path = U.site_key("url"), U.path_of("url")
    requests = R.read_stream(spark, d, "pages.parquet").select(site.alias("site"), "page_id", path.alias("path"))

    def load():
        """Pages whose path ends in .html have moved to the path without it."""
        moved = T.table(spark, d, "pages").select(site.alias("site"), path.alias("from_path")).filter(F.col("from_path").endswith(".html")).distinct()
        return moved.withColumn("to_path", F.regexp_replace("from_path", "[.]html$", ""))

    return R.run_to_table(requests, "redirected", on_batch=ST.redirect_batches(load)).drop("batch")


@query(
    "stream_hourly_sweep",
    f"""WITH {D.HI}, w AS (SELECT max(tm) - INTERVAL 10 MINUTE AS wm FROM hi)
    SELECT epoch_ms(date_trunc('hour', tm)) AS hour_ms, count(*) AS events, count(*) FILTER (kind = 'effectQueued') AS queued, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed
    FROM hi, w GROUP BY date_trunc('hour', tm), wm HAVING date_trunc('hour', tm) + INTERVAL 1 HOUR <= wm""",
    covers="J7",
)
def _(spark, d):
    history = T.as_history(R.read_stream(spark, d, "events.parquet"))
    return R.run_to_table(ST.hourly_sweep(history), "sweep")
