"""Queries over the lifecycle log."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import lifecycle as L
from siteloom.operators import migrate as M  # noqa: F401
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans import migrate_queries as MQ
from siteloom.plans import model_queries as MO
from siteloom.plans import status_fixture as SF
from siteloom.plans.registry import query
from siteloom.sources import tables as T

NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.expr("timestamp '2024-02-01 00:00:00'")


def fmt(ms: str) -> str:
    s = f"({ms} // 1000)"
    return (
        f"CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm ' || lpad(({s} % 60)::VARCHAR, 2, '0') || 's' "
        f"WHEN {s} < 172800 THEN ({s} // 3600) || 'h ' || lpad((({s} // 60) % 60)::VARCHAR, 2, '0') || 'm' ELSE ({s} // 86400) || 'd' END"
    )


@query(
    "current_stages",
    f"""WITH {D.HI}, l AS (SELECT instance, last(stage ORDER BY tm, event_id) AS stage, max(tm) AS tm FROM hi WHERE kind = 'stageEntered' GROUP BY instance),
    m AS (SELECT instance, stage, (epoch_us({NOW_SQL}) // 1000 - epoch_us(tm) // 1000)::BIGINT AS stage_ms FROM l)
    SELECT instance, stage, stage_ms, {fmt('stage_ms')} AS stage_for FROM m""",
    covers="I1 I16",
)
def _(spark, d):
    return L.current_stage(T.read_history(spark, d), now()).select("instance", "stage", "stage_ms", "stage_for")


@query(
    "event_durations",
    f"WITH m AS (SELECT event_id, (floor(value * 100) * event_id)::BIGINT AS ms FROM events) SELECT event_id, {fmt('ms')} AS shown FROM m",
    covers="I16",
)
def _(spark, d):
    ms = (F.floor(F.col("value") * 100) * F.col("event_id")).cast("long")
    return T.table(spark, d, "events").select("event_id", L.format_duration(ms).alias("shown"))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in SF.EDGE_ROWS)


@query(
    "invalid_transitions",
    f"""WITH {D.HI}, s AS (SELECT instance, event_id, lag(stage) OVER (PARTITION BY instance ORDER BY tm, event_id) AS from_stage, stage AS to_stage FROM hi WHERE kind = 'stageEntered')
    SELECT instance, event_id, from_stage, to_stage FROM s WHERE from_stage IS NOT NULL AND (from_stage, to_stage) NOT IN ({_ALLOWED})""",
    covers="I2",
)
def _(spark, d):
    return L.invalid_transitions(T.read_history(spark, d), SF.edges(spark)).select("instance", "event_id", "from_stage", "to_stage")


# an effect is pending while its instance has no later completion of it; every third is claimed a minute later
PENDING = f"""{D.HI}, pe AS (SELECT instance, effect, event_id, tm AS queued_at, CASE WHEN event_id % 3 = 0 THEN tm + INTERVAL 1 MINUTE END AS claimed_at
  FROM hi LEFT JOIN (SELECT instance, effect, max(tm) AS done FROM hi WHERE kind = 'effectCompleted' GROUP BY ALL) z USING (instance, effect)
  WHERE kind = 'effectQueued' AND (done IS NULL OR tm > done))"""


def pending(spark, d):
    log = T.read_history(spark, d)
    done = log.filter("kind = 'effectCompleted'").groupBy("instance", "effect").agg(F.max("at").alias("done"))
    h = log.filter("kind = 'effectQueued'").join(done, ["instance", "effect"], "left").filter("done is null or at > done")
    return h.select(
        "instance", "effect", "event_id", F.col("at").alias("queued_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("at") + F.expr("INTERVAL 1 MINUTE")).alias("claimed_at"),
    )


@query(
    "effect_runs",
    f"""WITH {PENDING}, d AS (SELECT instance, effect, last(status ORDER BY tm, event_id) AS status FROM hi WHERE kind = 'effectCompleted' GROUP BY ALL),
    l AS (SELECT instance, effect, bool_or(claimed_at IS NOT NULL) AS claimed FROM pe GROUP BY ALL)
    SELECT instance, effect, CASE WHEN claimed THEN 'running' WHEN NOT claimed THEN 'queued' ELSE status END AS run FROM l FULL JOIN d USING (instance, effect)""",
    covers="I3",
)
def _(spark, d):
    return L.effect_runs(T.read_history(spark, d), pending(spark, d))


_STEP = f"""cp(effect, at_percent, label) AS ({SF.values(SF.CHECKPOINT_ROWS)}),
pr AS (SELECT event_id, user_id AS instance, {D.EFFECT}[(event_id % 6)::INT + 1] AS effect, (floor(value * 7)::BIGINT % 101)::INT AS percent FROM events)"""


def progress(spark, d):
    e = T.table(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("instance"), T.effect_of(F.col("event_id")).alias("effect"),
        (F.floor(F.col("value") * 7) % 101).cast("int").alias("percent"),
    )


@query(
    "step_labels",
    f"""WITH {_STEP} SELECT event_id, pr.effect, percent, arg_max(label, at_percent) AS step FROM pr JOIN cp ON cp.effect = pr.effect AND at_percent <= percent GROUP BY ALL""",
    covers="I4",
)
def _(spark, d):
    return L.as_of_labels(progress(spark, d), SF.checkpoints(spark)).select("event_id", "effect", "percent", "step")


@query(
    "as_of_labels",
    f"""WITH {_STEP}, ck AS (SELECT {D.EFFECT}[(page_id % 6)::INT + 1] AS effect, (page_id * 7 % 101)::INT AS at_percent, max('c' || page_id) AS label FROM pages GROUP BY ALL)
    SELECT event_id, pr.effect, percent, arg_max(label, at_percent) AS step FROM pr LEFT JOIN ck ON ck.effect = pr.effect AND at_percent <= percent GROUP BY ALL""",
    covers="I4",
)
def _(spark, d):
    n = F.col("page_id")
    cks = T.table(spark, d, "pages").groupBy(T.effect_of(n).alias("effect"), (n * 7 % 101).cast("int").alias("at_percent")).agg(
        F.max(F.concat(F.lit("c"), n.cast("string"))).alias("label")
    )
    return L.as_of_labels(progress(spark, d), cks).select("event_id", "effect", "percent", "step")


# facts of a status line, one row per event
FACTS = f"""fa AS (SELECT event_id AS instance, CASE WHEN event_id % 29 <> 0 THEN {D.STAGE}[(event_id % 9)::INT + 1] END AS stage,
  CASE WHEN event_id % 4 = 0 THEN {D.EFFECT}[(event_id % 6)::INT + 1] END AS effect, ts AS queued_at, CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 5 SECOND END AS claimed_at,
  value AS progress, ts + to_seconds(user_id * 10) AS now, CASE WHEN user_id % 5 = 0 THEN 'crawl' WHEN user_id % 5 = 1 THEN 'oddity' END AS failed_from, event_id % 2 = 0 AS model_accepted,
  CASE WHEN user_id % 3 <> 0 THEN user_id % 3 - 1 END AS required_left, user_id % 2 AS open_required, user_id % 4 AS pages, user_id % 4 // 2 AS applying,
  user_id % 3 AS reviewing, user_id % 2 AS human_open, event_id % 3 = 0 AS publish_failed, 'e' || event_id AS error_message, ts AS error_at,
  CASE WHEN user_id % 7 = 0 THEN ts + INTERVAL 1 SECOND WHEN user_id % 7 < 4 THEN ts END AS stage_entered_at FROM events)"""


def facts(spark, d):
    e = T.table(spark, d, "events")
    n, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        n.alias("instance"), F.when(n % 29 != 0, T.stage_of(n)).alias("stage"), F.when(n % 4 == 0, T.effect_of(n)).alias("effect"),
        ts.alias("queued_at"), F.when(n % 8 == 0, ts + F.expr("INTERVAL 5 SECOND")).alias("claimed_at"), F.col("value").alias("progress"),
        F.timestamp_add("SECOND", (u * 10).cast("int"), ts).alias("now"),
        F.when(u % 5 == 0, "crawl").when(u % 5 == 1, "oddity").alias("failed_from"), (n % 2 == 0).alias("model_accepted"),
        F.when(u % 3 != 0, u % 3 - 1).alias("required_left"), (u % 2).alias("open_required"), (u % 4).alias("pages"),
        F.floor(u % 4 / 2).alias("applying"), (u % 3).alias("reviewing"), (u % 2).alias("human_open"), (n % 3 == 0).alias("publish_failed"),
        F.concat(F.lit("e"), n.cast("string")).alias("error_message"), ts.alias("error_at"),
        F.when(u % 7 == 0, ts + F.expr("INTERVAL 1 SECOND")).when(u % 7 < 4, ts).alias("stage_entered_at"),
    )


_PCT = "greatest(0, least(100, floor(CASE WHEN progress > 0 AND progress <= 1 THEN progress * 100 ELSE progress END + 0.5)))::INT"


@query(
    "stage_status",
    f"""WITH {FACTS}, cp(ce, at_percent, label) AS ({SF.values(SF.CHECKPOINT_ROWS)}), st(sn, title) AS ({SF.values(SF.STAGE_ROWS)}), ef(en, lab) AS ({SF.values(SF.EFFECT_ROWS)}), wo(wc, text) AS ({SF.values(SF.WORDING_ROWS)}),
    p AS (SELECT *, {_PCT} AS pct, coalesce(required_left, open_required, 0) AS req, coalesce(claimed_at, queued_at) AS since FROM fa),
    q AS (SELECT *, (SELECT arg_max(label, at_percent) FROM cp WHERE ce = effect AND at_percent <= pct) AS step,
      CASE WHEN effect IS NOT NULL AND stage <> 'failed' THEN greatest(0, epoch_ms(now) - epoch_ms(since))::BIGINT END AS el,
      CASE WHEN stage IS NULL THEN 'unknown' WHEN stage = 'failed' THEN CASE WHEN failed_from IS NULL THEN 'failed' ELSE 'failed.during' END
        WHEN effect IS NOT NULL THEN CASE WHEN claimed_at IS NULL THEN 'queued' ELSE 'running' END WHEN stage = 'start' THEN 'start.confirm' WHEN stage = 'crawl' THEN 'crawl.finishing'
        WHEN stage = 'model' THEN CASE WHEN model_accepted THEN 'model.accepted' ELSE 'model.review' END WHEN stage = 'review' THEN CASE WHEN req > 0 THEN 'review.open' ELSE 'review.answered' END
        WHEN stage = 'build' THEN 'build.done' WHEN stage = 'apply' THEN CASE WHEN pages = 0 THEN 'apply.none' WHEN applying > 0 THEN 'apply.working' WHEN reviewing > 0 AND human_open > 0 THEN 'apply.both'
          WHEN reviewing > 0 THEN 'apply.approve' WHEN human_open > 0 THEN 'apply.tasks' ELSE 'apply.done' END
        WHEN stage = 'publish' THEN CASE WHEN publish_failed THEN 'publish.failed' ELSE 'publish.ready' END ELSE 'live' END AS cs FROM p)
    SELECT instance, st.title, cs AS "case", CASE WHEN cs IN ('failed', 'failed.during', 'publish.failed') THEN 'failed' WHEN cs = 'queued' THEN 'queued' WHEN cs IN ('running', 'apply.working') THEN 'working'
        WHEN cs IN ('start.confirm', 'model.review', 'review.open', 'apply.both', 'apply.approve', 'apply.tasks', 'publish.ready') THEN 'needs-you' WHEN cs = 'live' THEN 'done' ELSE 'waiting' END AS tone,
      replace(replace(text, '{{n}}', coalesce(CASE cs WHEN 'running' THEN pct WHEN 'review.open' THEN req WHEN 'apply.working' THEN applying WHEN 'apply.both' THEN reviewing + human_open WHEN 'apply.approve' THEN reviewing WHEN 'apply.tasks' THEN human_open END::VARCHAR, '')),
        '{{name}}', coalesce(CASE cs WHEN 'failed.during' THEN coalesce(sf.title, failed_from) WHEN 'queued' THEN lab WHEN 'running' THEN step END, '')) AS headline,
      CASE WHEN stage = 'failed' OR stage IS NULL THEN NULL WHEN effect IS NOT NULL THEN CASE WHEN claimed_at IS NOT NULL THEN pct END
        WHEN stage = 'apply' AND pages > 0 AND applying > 0 THEN floor(100.0 * (pages - applying) / pages + 0.5)::INT END AS percent,
      el AS elapsed_ms, CASE WHEN stage = 'failed' THEN NULL WHEN claimed_at IS NULL AND el > 90000 THEN 'unclaimed' WHEN claimed_at IS NOT NULL AND el > 480000 THEN 'slow' END AS late,
      CASE WHEN (stage = 'failed' OR (stage = 'publish' AND publish_failed)) AND (stage_entered_at IS NULL OR error_at >= stage_entered_at) THEN error_message END AS error
    FROM q LEFT JOIN st ON st.sn = stage LEFT JOIN st sf ON sf.sn = failed_from LEFT JOIN ef ON en = effect LEFT JOIN wo ON wc = cs""",
    covers="I5",
)
def _(spark, d):
    return L.stage_status(facts(spark, d), SF.stages(spark), SF.effects(spark), SF.checkpoints(spark), SF.wording(spark))


@query(
    "pending_work",
    f"WITH {PENDING} SELECT instance, count_if(claimed_at IS NULL)::BIGINT AS unclaimed, count(*) AS effects FROM pe GROUP BY instance HAVING count_if(claimed_at IS NULL) > 0",
    covers="I6",
)
def _(spark, d):
    return L.pending_work(pending(spark, d))


_AT = "TIMESTAMP '2024-01-30 12:00:00'"


@query(
    "stale_claims",
    f"""WITH {PENDING}, x AS (SELECT instance, event_id, effect, epoch_ms({_AT}) - epoch_ms(claimed_at) AS c, epoch_ms({_AT}) - epoch_ms(queued_at) AS w, claimed_at FROM pe),
    y AS (SELECT instance, event_id, effect, CASE WHEN c > 720000 THEN 'lease lapsed' WHEN c > 480000 THEN 'slow' WHEN claimed_at IS NULL AND w > 90000 THEN 'not picked up' END AS state FROM x)
    SELECT * FROM y WHERE state IS NOT NULL""",
    covers="I7",
)
def _(spark, d):
    at = F.expr("timestamp '2024-01-30 12:00:00'")
    return L.stale_claims(pending(spark, d), at).select("instance", "event_id", "effect", "state")


OVERDUE = f"""{D.HI}, sv AS (SELECT instance, event_id, tm, stage, lead(tm) OVER (PARTITION BY instance ORDER BY tm, event_id) AS left_at FROM hi WHERE kind = 'stageEntered')
    SELECT instance, event_id, epoch_us(tm) // 1000 + 172800000 AS due_ms, epoch_us(left_at) // 1000 AS left_ms FROM sv
    WHERE stage = 'review' AND coalesce(left_at, {NOW_SQL}) > tm + INTERVAL 48 HOUR"""


@query("overdue_reviews", f"WITH {OVERDUE}", covers="I8")
def _(spark, d):
    o = L.overdue(T.read_history(spark, d), now())
    return o.select("instance", "event_id", L.millis(F.col("due_at")).alias("due_ms"), L.millis(F.col("left_at")).alias("left_ms"))


@query(
    "settled_fanouts",
    """WITH c AS (SELECT user_id % 40 AS parent, count(*) AS children, bool_and(event_type = 'purchase' OR user_id % 40 < 10) AS ok, count_if(user_id % 40 = 3) AS active FROM events WHERE user_id % 40 < 30 GROUP BY ALL)
    SELECT p.parent, coalesce(children, 0) AS children, children IS NULL OR (ok AND active = 0) AS settled FROM (SELECT DISTINCT user_id % 40 AS parent FROM events) p LEFT JOIN c USING (parent)""",
    covers="I9",
)
def _(spark, d):
    parent = F.col("user_id") % 40
    e = T.table(spark, d, "events")
    stage = F.when((F.col("event_type") == "purchase") | (parent < 10), "approved").otherwise("reviewing")
    children = e.filter(parent < 30).select(parent.alias("parent"), stage.alias("stage"), (parent == 3).alias("active"))
    return L.fanout_settled(e.select(parent.alias("parent")).distinct(), children)


@query(
    "duplicate_open_runs",
    f"""WITH o AS (SELECT user_id AS subject, event_id AS instance FROM events WHERE event_type = 'signup' AND event_id % 2 = 0 AND {D.STAGE}[(event_id % 9)::INT + 1] <> 'live'),
    m AS (SELECT subject, count(*) AS open_runs FROM o GROUP BY subject HAVING count(*) > 1) SELECT subject, instance, open_runs FROM o JOIN m USING (subject)""",
    covers="I10",
)
def _(spark, d):
    n = F.col("event_id")
    inst = T.table(spark, d, "events").filter("event_type = 'signup'").select(
        F.col("user_id").alias("subject"), n.alias("instance"), (n % 2 == 0).alias("is_root"), T.stage_of(n).alias("stage")
    )
    return L.open_run_violations(inst)


@query(
    "audit_lines",
    f"""WITH {D.HI} SELECT event_id, CASE kind WHEN 'actionFired' THEN coalesce(actor, 'system') || ' fired ' || action || ' · ' || activity WHEN 'stageEntered' THEN coalesce(actor, 'system') || ' entered ' || stage
      WHEN 'effectQueued' THEN 'queued ' || effect ELSE coalesce(actor, 'system') || ' completed ' || effect || ' (' || status || ')' END AS line FROM hi""",
    covers="I11",
)
def _(spark, d):
    return L.audit_lines(T.read_history(spark, d)).select("event_id", "line")


@query(
    "visited_screens",
    f"""WITH {D.HI}, sc(stage, screen) AS ({SF.values(SF.SCREEN_ROWS)}) SELECT DISTINCT instance, screen FROM hi JOIN sc USING (stage)""",
    covers="I12",
)
def _(spark, d):
    return L.visited_screens(T.read_history(spark, d), SF.screens(spark))


@query(
    "live_board",
    f"""WITH {D.PG}, {D.HI}, st(stage, title) AS ({SF.values(SF.STAGE_ROWS)}), s AS (SELECT site, min(page_id) AS created_at, count(*) AS pages FROM pg GROUP BY site),
    l AS (SELECT instance, last(stage ORDER BY tm, event_id) AS stage FROM hi WHERE kind = 'stageEntered' GROUP BY instance),
    b AS (SELECT site, created_at, CASE created_at % 4 WHEN 0 THEN 'overdue' WHEN 1 THEN 'alive' END AS status, CASE WHEN created_at % 3 = 0 THEN 'static' END AS platform, pages FROM s)
    SELECT site, created_at, coalesce(title, status, 'start') AS shown, coalesce(status = 'overdue', false) AS overdue_badge, coalesce(platform, 'unknown') || ' · ' || pages || ' pages' AS subtitle
    FROM b LEFT JOIN l ON l.instance = created_at LEFT JOIN st USING (stage)""",
    covers="I13",
)
def _(spark, d):
    pages = T.read_pages(spark, d)
    c = F.col("created_at")
    sites = pages.groupBy("site").agg(F.min("page_id").alias("created_at"), F.count("*").alias("pages")).withColumns(
        {"status": F.when(c % 4 == 0, "overdue").when(c % 4 == 1, "alive"), "platform": F.when(c % 3 == 0, "static")}
    )
    entered = T.read_history(spark, d).filter("kind = 'stageEntered'")
    inst = entered.join(sites.select("site", F.col("created_at").alias("instance")), "instance").select(
        F.col("site").alias("subject"), "stage", F.struct("at", "event_id").alias("started_at")
    )
    return L.live_board(sites, inst, SF.stages(spark))


@query(
    "drain_summary",
    """WITH p AS (SELECT event_id // 50 AS run, event_id % 4 AS pass, event_id AS instance, (event_id % 3)::BIGINT AS drained, (event_id % 2)::BIGINT AS lost, CASE WHEN event_type = 'error' THEN 'x' END AS error, (user_id % 9) AS pending FROM events)
    SELECT run, count(*) AS instances, sum(drained)::BIGINT AS drained, sum(lost)::BIGINT AS lost, count(error) AS errors, count(DISTINCT pass) AS passes, last(pending ORDER BY pass, instance) AS pending_after FROM p GROUP BY run""",
    covers="I14",
)
def _(spark, d):
    n = F.col("event_id")
    passes = T.table(spark, d, "events").select(
        F.floor(n / 50).alias("run"), (n % 4).alias("pass"), n.alias("instance"), (n % 3).alias("drained"), (n % 2).alias("lost"),
        F.when(F.col("event_type") == "error", "x").alias("error"), (F.col("user_id") % 9).alias("pending"),
    )
    return L.drain_summary(passes)


@query(
    "target_occupancy",
    f"""WITH {D.PG}, c AS (SELECT site, count(*) FILTER (page_id % 3 <> 0) AS content, min(page_id) AS m FROM pg GROUP BY site)
    SELECT site AS target, CASE WHEN m % 2 = 0 THEN 'o' || (m % 3) END AS owner, content, CASE WHEN content > 0 OR coalesce('o' || (m % 3) <> 'o1' AND m % 2 = 0, false) THEN 'occupied' ELSE 'free' END AS state FROM c""",
    covers="I15",
)
def _(spark, d):
    p = T.read_pages(spark, d)
    docs = p.select(F.col("site").alias("target"), F.concat(F.when(F.col("page_id") % 3 == 0, "_.").otherwise(""), F.col("page_id").cast("string")).alias("doc_id"))
    m = F.col("m")
    owners = p.groupBy(F.col("site").alias("target")).agg(F.min("page_id").alias("m")).select(
        "target", F.when(m % 2 == 0, F.concat(F.lit("o"), (m % 3).cast("string"))).alias("owner"), F.lit("o1").alias("wants")
    )
    return L.target_occupancy(docs, owners)


@query(
    "crawl_percent",
    f"""WITH {FACTS} SELECT instance, CASE WHEN NOT coalesce(stage IS NULL OR stage IN ('start', 'crawl') OR (stage = 'failed' AND failed_from = 'crawl'), false) THEN 100
      WHEN instance % 3 = 0 THEN {_PCT} ELSE floor(least(100.0, 100.0 * pages / (1 + instance % 4)) + 0.5) END::INT AS percent FROM fa""",
    covers="I17",
)
def _(spark, d):
    f = facts(spark, d)
    n = F.col("instance")
    pct = L.crawl_percent(F.when(n % 3 == 0, F.col("progress")), F.col("pages"), 1 + n % 4, F.col("stage"), F.col("failed_from"))
    return f.select("instance", pct.cast("int").alias("percent"))


def published(spark, d):
    """Documents of the planned target, their collections and field values."""
    t = MQ.targets(spark, d).filter("state = 'mapped'")
    pages = V.titled_pages(spark, d).select("site", "page_id", "title")
    docs = t.join(pages, ["site", "page_id"]).groupBy("site", "doc_id", "type", "slug").agg(F.min_by("title", "page_id").alias("title"))
    colls = docs.filter("type <> 'page'").select("site", "type").distinct().withColumns(
        {"title": F.lit(None).cast("string"), "route": U.kebab("type")}
    )
    return docs, colls


@query(
    "site_navigation",
    f"""WITH {MQ.TARGETS}, tl AS (SELECT site, page_id, title || CASE WHEN page_id % 4 <> 0 THEN ' | Site ' || site ELSE '' END AS title FROM px),
    dd AS (SELECT tg.site, doc_id, type, trim(old_path, '/') AS slug, first(tl.title ORDER BY tg.page_id) AS title FROM tg JOIN tl USING (page_id) WHERE state = 'mapped' GROUP BY ALL)
    SELECT site, 1::INT AS "group", title, '/' || slug AS path FROM dd WHERE type = 'page' AND NOT contains(slug, '/') AND slug <> '' AND slug <> 'home'
    UNION ALL SELECT DISTINCT site, 2, type, '/' || lower(regexp_replace(type, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) FROM dd WHERE type <> 'page'""",
    covers="I18",
)
def _(spark, d):
    return L.navigation(*published(spark, d))


_VAL = f"""{MQ.TARGETS}, {MO.PF[MO.PF.index('pf AS'):]},
dd AS (SELECT tg.site, doc_id, type, min(page_id) AS page_id FROM tg WHERE state = 'mapped' AND type <> 'page' GROUP BY ALL),
ff AS (SELECT DISTINCT site, type_name AS type, field_name, field_type, ord FROM pf),
vv AS (SELECT dd.site, doc_id, type, ff.field_name, field_type, ord, CASE field_type WHEN 'number' THEN (page_id * 10 + 0.5)::VARCHAR ELSE field_name || ' of ' || doc_id END AS value FROM dd JOIN ff USING (site, type))"""


def published_values(spark, d):
    t = MQ.targets(spark, d).filter("state = 'mapped' and type <> 'page'")
    docs = t.groupBy("site", "doc_id", "type", "slug").agg(F.min("page_id").alias("page_id"))
    fields = V.proposal_fields(V.proposal_types(spark, d))
    f = fields.select("site", F.col("type_name").alias("type"), "field_name", "field_type").distinct()
    text = F.when(F.col("field_type") == "number", (F.col("page_id") * 10 + F.lit(0.5)).cast("string")).otherwise(
        F.concat("field_name", F.lit(" of "), "doc_id")
    )
    values = docs.join(f, ["site", "type"]).select("site", "doc_id", "field_name", text.alias("value"))
    return docs, values, fields


@query(
    "display_rows",
    f"""WITH {_VAL} SELECT site, doc_id, ord::INT AS ord, field_name, CASE field_type WHEN 'number' THEN format('{{:,.2f}}', value::DOUBLE) ELSE value END AS shown FROM vv
    WHERE field_type NOT IN ('slug', 'reference') AND field_name <> 'title'""",
    covers="I18",
)
def _(spark, d):
    docs, values, fields = published_values(spark, d)
    return L.display_rows(docs, values, fields)


@query(
    "collection_cards",
    f"""WITH {_VAL}, aa AS (SELECT site, type, doc_id, arg_min(value, ord) FILTER (field_type = 'string' AND regexp_matches(lower(field_name), '^(title|name|heading|label)$')) AS t,
      arg_min(value, ord) FILTER (field_type IN ('text', 'portableText')) AS summary, arg_min(value, ord) FILTER (regexp_matches(lower(field_name), 'price|cost')) AS p FROM vv GROUP BY ALL)
    SELECT site, type, doc_id, coalesce(nullif(t, ''), doc_id) AS title, CASE WHEN try_cast(p AS DOUBLE) IS NOT NULL THEN format('{{:,.2f}}', p::DOUBLE) ELSE p END AS price, summary,
      '/' || lower(regexp_replace(type, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) || '/' || substr(doc_id, length(type) + 2) AS href FROM aa""",
    covers="I18",
)
def _(spark, d):
    docs, values, fields = published_values(spark, d)
    colls = docs.select("site", "type").distinct().withColumn("route", U.kebab("type"))
    return L.collection_cards(docs, values, fields, colls)


@query(
    "internal_links",
    f"""WITH {MQ.TARGETS}, dd AS (SELECT DISTINCT site, doc_id, trim(old_path, '/') AS slug FROM tg WHERE state = 'mapped' AND type = 'page'),
    lk AS (SELECT site, page_id, 'page-' || regexp_replace(trim(old_path, '/'), '[^a-zA-Z0-9_-]+', '-', 'g') AS ref FROM tg)
    SELECT lk.site, page_id, ref, '/' || slug AS path FROM lk LEFT JOIN dd ON dd.site = lk.site AND dd.doc_id = ref""",
    covers="I18",
)
def _(spark, d):
    t = MQ.targets(spark, d)
    docs = t.filter("state = 'mapped'").select("site", "doc_id", "type", "slug").distinct()
    links = t.select("site", "page_id", F.concat(F.lit("page-"), U.id_safe(U.trim_slashes("old_path"))).alias("ref"))
    return L.resolve_internal_links(links, docs)
