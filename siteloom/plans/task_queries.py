"""Queries over clean-up tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import extract as X
from siteloom.operators import findings as Q
from siteloom.operators import tasks as TK
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans import finding_queries as FQ
from siteloom.plans import migrate_queries as MQ
from siteloom.plans import status_fixture as SF
from siteloom.plans.registry import query
from siteloom.session import scratch_path, stored
from siteloom.sources import sync as S
from siteloom.sources import tables as T
from siteloom.sources.site_table import SiteTable

# contact values that the enriched pages show
PAGE_ENT = f"""xe AS (SELECT page_id, 'phones' AS kind, unnest(regexp_extract_all(corpus, '{D.PHONE}')) AS value FROM rc
  UNION ALL SELECT page_id, 'emails', unnest(regexp_extract_all(corpus, '{D.EMAIL}')) FROM rc UNION ALL SELECT page_id, 'addresses', unnest(regexp_extract_all(corpus, '{D.ADDRESS}')) FROM rc
  UNION ALL SELECT page_id, 'emails', unnest(CASE page_id % 4 WHEN 1 THEN ['info@site.example'] WHEN 2 THEN ['sales@site.example', 'hello@site.example'] ELSE [] END) FROM rc),
en AS (SELECT DISTINCT rc.site, rc.page_id, rc.path, rc.url, kind, trim(value) AS value FROM xe JOIN rc USING (page_id) WHERE trim(value) <> '' AND rc.http_status < 400)"""


def page_contacts(extract):
    """Phones, e-mails and addresses of the live pages of an extraction."""
    live = extract.filter("http_status < 400")
    found = X.page_entities(live).filter("kind <> 'prices'")
    return found.join(live.select("site", "page_id", "path", "url"), ["site", "page_id"])


def blank_alts(extract):
    """Number of images without alt text on each page that has some."""
    images = X.page_images(extract)
    return images.filter(F.trim(F.coalesce("alt", F.lit(""))) == "").groupBy("site", "page_id").agg(F.count("*").alias("blank_alt_images"))


# answered questions of pages: rule findings plus contact contradictions, with evidence
ASKED = f"""{MQ.TARGETS}, {FQ.contradictions_sql(FQ.values_sql(PAGE_ENT))},
a0 AS (SELECT * FROM cq UNION ALL BY NAME SELECT * FROM pq),
a1 AS (SELECT *, ('0x' || substr(fingerprint, 1, 1))::BIGINT AS g, string_split(options, '|') AS opts FROM a0),
aa AS (SELECT *, CASE WHEN g < 12 THEN opts[(g // 4 + 1)::INT] END AS answer, CASE WHEN g % 2 = 0 THEN 'as agreed on the phone' END AS answer_note FROM a1),
ce AS (SELECT h.site, 'contradiction-' || h.kind AS finding, '' AS key, page_id, url FROM h JOIN cv USING (site, kind, key)),
ae AS (SELECT a0.site, a0.fingerprint, x.page_id, x.url FROM a0 JOIN
        (SELECT site, finding, key, page_id, url FROM sm UNION ALL SELECT * FROM ce) x USING (site, finding, key)),
ap2 AS (SELECT aa.*, coalesce(n, 0) AS evidence_pages FROM aa LEFT JOIN
        (SELECT site, fingerprint, count(DISTINCT url) AS n FROM ae GROUP BY ALL) USING (site, fingerprint)),
tk AS (
  SELECT *, CASE
      WHEN regexp_matches(answer, '(?i)none of these|clarify|not sure') THEN ['human', 'custom', 'Clarify with the client']
      WHEN kind = 'contradiction' THEN ['auto', 'fix-contact', 'Use “' || answer || '” everywhere']
      WHEN kind = 'authenticity' THEN CASE WHEN regexp_matches(answer, '(?i)rewrite|placeholder|boilerplate|remove|fake') THEN ['auto', 'rewrite-placeholder', 'Rewrite placeholder copy'] END
      WHEN kind = 'keep-or-kill' THEN CASE WHEN regexp_matches(answer, '(?i)merge') THEN ['auto', 'custom', 'Merge into one page, 301 the rest']
        WHEN regexp_matches(answer, '(?i)kill|drop') THEN ['auto', 'custom', 'Drop page, 301 to its survivor']
        WHEN regexp_matches(answer, '(?i)keep') THEN NULL ELSE ['human', 'custom', 'Follow up: ' || answer] END
      WHEN regexp_matches(answer, '^No') THEN NULL
      WHEN finding = 'missing-alt' AND answer LIKE 'Only %' THEN ['auto', 'generate-alt', 'Generate alt text (' || substr(answer, 6) || ')']
      WHEN finding = 'missing-alt' THEN ['auto', 'generate-alt', 'Generate alt text']
      WHEN answer LIKE 'Only %' THEN ['auto', 'generate-meta', 'Write meta descriptions (' || substr(answer, 6) || ')']
      ELSE ['auto', 'generate-meta', 'Write meta descriptions'] END AS t
  FROM ap2 WHERE answer IS NOT NULL),
tt AS (SELECT *, t[1] AS mode, t[2] AS action, t[3] AS title,
   CASE WHEN t[2] LIKE 'generate-%' THEN greatest(pages, evidence_pages) ELSE evidence_pages END AS page_count FROM tk WHERE t IS NOT NULL)"""


def review_inputs(spark, d):
    """One extraction, and what is stored of it for questions and tasks: extraction, signal rows, contacts."""
    extract = V.stored_extract(spark, d)
    rows = stored(Q.signal_rows(Q.page_signals(extract, FQ.PHRASES)), "signals")
    return extract, rows, stored(page_contacts(extract), "contacts")


def asked(rows, contacts):
    """Answered questions with evidence page counts, and the evidence rows."""
    found = Q.page_questions(rows).unionByName(Q.contradictions(contacts))
    found = stored(V.answered(found), "questions")
    cols = ["site", "finding", "page_id", "url"]
    ev = Q.page_evidence(rows).select(*cols, "key").unionByName(
        Q.contradiction_evidence(contacts).select(*cols, F.lit("").alias("key"))
    )
    ev = stored(Q.with_fingerprint(ev, found).select("site", "fingerprint", "page_id", "url"), "evidence")
    n = ev.groupBy("site", "fingerprint").agg(F.countDistinct("url").alias("evidence_pages"))
    found = found.join(n, ["site", "fingerprint"], "left").withColumn("evidence_pages", F.coalesce("evidence_pages", F.lit(0)))
    return found, ev


@query(
    "answer_tasks",
    f"WITH {ASKED} SELECT site, fingerprint, mode, action, title, page_count FROM tt",
    covers="H1",
)
def _(spark, d):
    found, _ = asked(*review_inputs(spark, d)[1:])
    return TK.tasks_for_answer(found).select("site", "fingerprint", "mode", "action", "title", "page_count")


@query(
    "task_page_labels",
    f"""WITH {ASKED}, u AS (SELECT site, fingerprint, min(url) AS url FROM ae GROUP BY ALL)
    SELECT tt.site, fingerprint, CASE WHEN page_count = 1 AND url IS NOT NULL THEN {D.path('url')} WHEN page_count = 1 THEN '1 page' ELSE page_count || ' pages' END AS label
    FROM tt LEFT JOIN u USING (site, fingerprint)""",
    covers="H5",
)
def _(spark, d):
    found, ev = asked(*review_inputs(spark, d)[1:])
    first = ev.groupBy("site", "fingerprint").agg(F.min("url").alias("url"))
    rows = TK.tasks_for_answer(found).join(first, ["site", "fingerprint"], "left")
    return rows.select("site", "fingerprint", TK.pages_label(F.col("page_count"), F.col("url")).alias("label"))


def _short(t: str, n: int) -> str:
    return f"CASE WHEN length({D.squash(t)}) > {n} THEN substr({D.squash(t)}, 1, {n - 1}) || '…' ELSE {D.squash(t)} END"


PLANNED = f"""{ASKED},
wp AS (SELECT tg.site, tg.page_id, tg.doc_id, tg.type AS doc_type, tg.new_path AS target_path, tg.old_path AS path, rx.description, tg.page_id % 2 AS bad
       FROM tg JOIN rx ON rx.page_id = tg.page_id WHERE state = 'mapped'),
bd AS (SELECT * FROM wp QUALIFY row_number() OVER (PARTITION BY site, doc_id ORDER BY page_id) = 1),
bp AS (SELECT * FROM wp QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY page_id) = 1),
pv AS (SELECT DISTINCT tt.site, tt.fingerprint, bp.* EXCLUDE (site) FROM tt JOIN ae USING (site, fingerprint)
       JOIN bp ON bp.site = tt.site AND bp.path = {D.norm_path(D.path('ae.url'))}),
ft AS (SELECT tt.*, answer LIKE 'Only %' AND EXISTS (SELECT 1 FROM pv WHERE pv.site = tt.site AND pv.fingerprint = tt.fingerprint) AS narrow FROM tt),
fx AS (SELECT ft.site, ft.fingerprint, bd.* EXCLUDE (site) FROM ft JOIN bd USING (site) JOIN en ON en.site = bd.site AND en.page_id = bd.page_id
       WHERE action = 'fix-contact' AND NOT narrow AND list_contains(opts, en.value) AND en.value <> answer),
pl AS (
  SELECT ft.site, ft.fingerprint, bd.page_id, bd.doc_id, bd.doc_type, bd.target_path FROM ft JOIN bd USING (site) WHERE action = 'generate-meta' AND NOT narrow AND doc_type = 'page' AND description IS NULL
  UNION SELECT ft.site, ft.fingerprint, bd.page_id, bd.doc_id, bd.doc_type, bd.target_path FROM ft JOIN bd USING (site) WHERE action = 'generate-alt' AND NOT narrow AND bad > 0
  UNION SELECT site, fingerprint, page_id, doc_id, doc_type, target_path FROM fx
  UNION SELECT pv.site, pv.fingerprint, pv.page_id, doc_id, doc_type, target_path FROM pv JOIN ft USING (site, fingerprint)
    WHERE action NOT IN ('generate-meta', 'generate-alt', 'fix-contact') OR answer LIKE 'Only %'
      OR (action = 'fix-contact' AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.site = ft.site AND fx.fingerprint = ft.fingerprint))),
pn AS (SELECT pl.*, mode, action, title, {_short('prompt', 70)} || ' → “' || {_short('answer', 60)} || '”' || CASE WHEN answer_note <> '' THEN ' (' || answer_note || ')' ELSE '' END AS why,
    CASE WHEN action = 'custom' AND mode = 'auto' THEN 'done' ELSE 'todo' END AS status, answer, opts,
    'task.' || pl.site || '.' || {D.key12('action', 'doc_id', 'fingerprint')} AS task_id
  FROM pl JOIN ft USING (site, fingerprint)),
tp2 AS (SELECT * FROM pn QUALIFY row_number() OVER (PARTITION BY site, task_id ORDER BY page_id) = 1)"""


def planned(spark, d):
    extract, rows, contacts = review_inputs(spark, d)
    found, ev = asked(rows, contacts)
    t = MQ.targets(spark, d, rows)
    desc = extract.select("site", "page_id", "url", "description")
    pages = t.join(desc, ["site", "page_id"]).join(blank_alts(extract), ["site", "page_id"], "left").select(
        "site", "page_id", F.col("old_path").alias("path"), "url", "description", F.coalesce("blank_alt_images", F.lit(0)).alias("blank_alt_images"),
        "doc_id", F.col("type").alias("doc_type"), F.col("new_path").alias("target_path"),
        F.when(F.col("state") == "mapped", "mapped").otherwise("dropped").alias("target_status"),
    )
    options = found.filter("kind = 'contradiction'").select("site", "fingerprint", F.explode("options").alias("option"))
    previews = TK.tasks_for_answer(found)
    return found, stored(TK.plan_tasks(previews, options, ev, pages, contacts), "tasks")


@query(
    "planned_tasks",
    f"""WITH {PLANNED} SELECT site, task_id, page_id, doc_id, doc_type, target_path, mode, action, title, why, status FROM tp2""",
    covers="H2",
)
def _(spark, d):
    return planned(spark, d)[1].drop("result", "fingerprint")


@query(
    "task_recipes",
    f"""WITH {PLANNED} SELECT site, task_id,
      CASE WHEN mode <> 'auto' THEN NULL WHEN action = 'fix-contact' THEN 'patch' WHEN action = 'rewrite-placeholder' THEN 'transform' WHEN action LIKE 'generate-%' THEN 'generate' END AS agent_kind,
      CASE WHEN mode <> 'auto' THEN NULL WHEN action = 'fix-contact' THEN '{{"replace":["' || array_to_string(list_sort(list_filter(opts, lambda o: o <> answer AND o NOT LIKE 'None of these%')), '","') || '"],"with":"' || answer || '"}}' END AS patch,
      CASE WHEN mode <> 'auto' OR action IN ('custom') THEN NULL WHEN action = 'generate-meta' THEN 'seoTitle,seoDescription' WHEN action = 'generate-alt' THEN 'body[].image.alt,body[].images[].alt'
        WHEN action = 'rewrite-placeholder' THEN 'body' ELSE '' END AS fields,
      CASE WHEN mode = 'human' THEN 'you' WHEN action = 'custom' THEN 'plan' WHEN action = 'fix-contact' THEN 'patch' WHEN action = 'generate-meta' THEN 'generate · seoTitle, seoDescription'
        WHEN action = 'generate-alt' THEN 'generate · body[].image.alt, body[].images[].alt' WHEN action = 'rewrite-placeholder' THEN 'transform · body' ELSE '—' END AS label
    FROM tp2""",
    covers="H3 H12",
)
def _(spark, d):
    found, tasks = planned(spark, d)
    rejected = (
        found.filter("kind = 'contradiction' and answer is not null")
        .select("site", "fingerprint", F.explode("options").alias("option"), F.col("answer").alias("chosen"))
        .filter((F.col("option") != F.col("chosen")) & ~F.col("option").startswith("None of these"))
    )
    out = TK.task_recipes(tasks, SF.recipes(spark), rejected)
    return out.select(
        "site", "task_id", "agent_kind", F.when(F.col("agent_kind") == "patch", F.col("instruction")).alias("patch"),
        F.array_join("fields", ",").alias("fields"),
        TK.agent_label(F.col("mode"), F.col("action"), F.col("agent_kind"), F.col("fields")).alias("label"),
    )


# tasks in every state, one per event: the action runs of an instance
RUNS = """rt AS (SELECT 's' || (user_id % 10) AS site, event_id AS task_id, user_id AS page_id, CASE WHEN event_id % 5 = 0 THEN 'human' ELSE 'auto' END AS mode,
  ['generate-meta', 'generate-alt', 'rewrite-placeholder', 'fix-contact', 'custom'][(event_id % 5)::INT + 1] AS action,
  CASE event_type WHEN 'signup' THEN 'todo' WHEN 'view' THEN 'done' WHEN 'click' THEN 'skipped' WHEN 'purchase' THEN 'casting' ELSE 'failed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'recipe' ELSE 'page' END AS doc_type,
  CASE WHEN event_id % 2 = 0 THEN '{"replace":["a"],"with":"b"}' END AS instruction,
  CASE WHEN user_id % 9 = 0 THEN '/' ELSE '/p/' || user_id END AS target_path, (floor(value * 100))::BIGINT AS cast_ms FROM events),
rc2 AS (SELECT DISTINCT 's' || (user_id % 10) AS site, user_id AS page_id, CASE user_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'applying' ELSE 'reviewing' END AS current_stage FROM events)"""


def task_runs(spark, d):
    e = T.table(spark, d, "events")
    n, u = F.col("event_id"), F.col("user_id")
    site = F.concat(F.lit("s"), (u % 10).cast("string"))
    actions = F.array(*[F.lit(a) for a in ["generate-meta", "generate-alt", "rewrite-placeholder", "fix-contact", "custom"]])
    et = F.col("event_type")
    runs = e.select(
        site.alias("site"), n.alias("task_id"), u.alias("page_id"), F.when(n % 5 == 0, "human").otherwise("auto").alias("mode"),
        F.get(actions, (n % 5).cast("int")).alias("action"),
        F.when(et == "signup", "todo").when(et == "view", "done").when(et == "click", "skipped").when(et == "purchase", "casting").otherwise("failed").alias("status"),
        F.when(n % 3 == 0, "recipe").otherwise("page").alias("doc_type"),
        F.when(n % 2 == 0, '{"replace":["a"],"with":"b"}').alias("instruction"),
        F.when(u % 9 == 0, "/").otherwise(F.concat(F.lit("/p/"), u.cast("string"))).alias("target_path"),
        F.floor(F.col("value") * 100).cast("long").alias("cast_ms"),
    )
    stage = F.when(u % 3 == 0, "approved").when(u % 3 == 1, "applying").otherwise("reviewing")
    children = e.select(site.alias("site"), u.alias("page_id"), stage.alias("current_stage")).distinct()
    return runs, children


@query(
    "synced_tasks",
    f"""WITH {RUNS}, o AS (SELECT * FROM rt WHERE task_id % 4 <> 0), p AS (SELECT site, task_id, 'todo' AS status, action FROM rt WHERE task_id % 7 <> 0)
    SELECT site, task_id, CASE WHEN o.status IN ('casting', 'done', 'failed', 'skipped') OR p.status IS NULL THEN o.status ELSE p.status END AS status,
      coalesce(p.action, o.action) AS action,
      CASE WHEN p.status IS NOT NULL THEN 'upsert' WHEN o.status = 'todo' THEN 'delete' ELSE 'keep' END AS change
    FROM p FULL JOIN o USING (site, task_id)""",
    covers="H4 A6",
)
def _(spark, d):
    runs, _ = task_runs(spark, d)
    existing = runs.filter("task_id % 4 <> 0").select("site", "task_id", "status", "action")
    plan = runs.filter("task_id % 7 <> 0").select("site", "task_id", F.lit("todo").alias("status"), "action")
    moved = F.col("old_status").isin("casting", "done", "failed", "skipped")
    return S.sync_by_id(plan, existing, {"status": moved}, F.col("old_status") == "todo", ["site", "task_id"])


@query(
    "replaced_values",
    f"""WITH {D.RD}, v AS (SELECT site, page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN '_meta.text' ELSE 'body.text' END AS field_path, text AS value FROM dp),
    n AS (SELECT *, CASE WHEN field_path LIKE '\\_%' ESCAPE '\\' OR site LIKE '%9' THEN value ELSE replace(replace(value, '(03) 260 1560', '0800 1'), '032601561', '0800 1') END AS nv FROM v)
    SELECT site, doc_id, field_path, nv AS value, nv <> value AS changed FROM n""",
    covers="H6",
)
def _(spark, d):
    docs = V.rich_documents(spark, d)
    values = docs.select(
        "site", F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 5 == 0, "_meta.text").otherwise("body.text").alias("field_path"),
        F.col("text").alias("value"),
    )
    fixes = docs.select("site").distinct().filter("site not like '%9'").select(
        "site", F.array(F.lit("(03) 260 1560"), F.lit("032601561"), F.lit("")).alias("wrong"), F.lit("0800 1").alias("chosen")
    )
    return TK.replace_values(values, fixes)


@query(
    "missing_alt_paths",
    f"""WITH {D.PG} SELECT site, page_id AS doc_id, p.block AS block_key, p.path AS alt_path FROM pg,
      (VALUES ('b1', 'body[b1].image.alt'), ('g', 'body[g].images[i1].alt'), ('g', 'body[g].cards[c1].image.alt')) p(block, path) WHERE page_id % 2 = 1""",
    covers="H7",
)
def _(spark, d):
    """Each image of a page as a block of its own, and all of them as a gallery and as cards."""
    found = X.page_images(V.rich_pages(spark, d))
    key = F.col("ord").cast("string")
    item = lambda head: F.struct(F.concat(F.lit(head), key).alias("key"), F.col("src").alias("asset"), "alt")
    in_order = lambda head: F.transform(F.array_sort(F.collect_list(F.struct("ord", item(head).alias("i")))), lambda r: r["i"])
    none = lambda c: F.lit(None).cast(f"{c}struct<key:string,asset:string,alt:string>{'>' if c else ''}")
    doc = F.col("page_id").alias("doc_id")
    single = found.select("site", doc, F.concat(F.lit("b"), key).alias("block_key"), F.struct(F.col("src").alias("asset"), "alt").alias("image"), none("array<").alias("images"), none("array<").alias("cards"))
    every = found.groupBy("site", "page_id").agg(in_order("i").alias("images"), in_order("c").alias("cards"))
    no_image = F.lit(None).cast("struct<asset:string,alt:string>")
    return TK.missing_alt_paths(single.unionByName(every.select("site", doc, F.lit("g").alias("block_key"), no_image.alias("image"), "images", "cards")))


@query(
    "castable_tasks",
    f"""WITH {RUNS} SELECT site, task_id, action, CASE WHEN action = 'generate-meta' AND doc_type <> 'page' THEN 'Collection docs have no SEO fields.'
      WHEN action = 'generate-alt' AND doc_type <> 'page' THEN 'Collection images have no alt field.' WHEN action = 'rewrite-placeholder' AND doc_type <> 'page' THEN 'Only page bodies are rewritten.'
      WHEN action = 'fix-contact' AND instruction IS NULL THEN 'Nothing to replace.' WHEN action = 'custom' THEN 'No automatic recipe; handled elsewhere.' END AS skip_reason
    FROM rt WHERE mode = 'auto' AND status IN ('todo', 'failed')""",
    covers="H8",
)
def _(spark, d):
    return TK.castable_tasks(task_runs(spark, d)[0]).select("site", "task_id", "action", "skip_reason")


@query(
    "cast_summary",
    f"""WITH {RUNS} SELECT site, page_id, action, count_if(status = 'done')::BIGINT AS done, count_if(status = 'skipped')::BIGINT AS skipped,
      count_if(status = 'failed')::BIGINT AS failed, round(avg(cast_ms), 3) AS avg_ms, max(cast_ms) AS max_ms, bool_or(status = 'failed') AS page_failed
    FROM rt GROUP BY ALL""",
    covers="H9",
)
def _(spark, d):
    return TK.cast_summary(task_runs(spark, d)[0])


@query(
    "task_counts",
    f"""WITH {RUNS}, t AS (SELECT site, count(*) AS total, count_if(status IN ('done', 'skipped'))::BIGINT AS done,
        count_if(mode = 'auto' AND status NOT IN ('done', 'skipped'))::BIGINT AS auto_left, count_if(mode = 'human' AND status NOT IN ('done', 'skipped'))::BIGINT AS human_left,
        count_if(status = 'failed')::BIGINT AS failed FROM rt GROUP BY site),
      c AS (SELECT site, count_if(current_stage = 'approved')::BIGINT AS approved, count(*) AS pages FROM rc2 GROUP BY site)
    SELECT * FROM t JOIN c USING (site)""",
    covers="H10",
)
def _(spark, d):
    return TK.task_counts(*task_runs(spark, d))


@query(
    "grouped_tasks",
    f"""WITH {RUNS}, t AS (SELECT * FROM rt WHERE page_id % 6 <> 0) SELECT rc2.site, rc2.page_id, coalesce(t.target_path, '/quiet/' || rc2.page_id) AS path, t.task_id, t.task_id IS NULL AS quiet,
      CASE WHEN t.target_path = '/' THEN 0 ELSE 1 END::INT AS page_order, CASE WHEN mode = 'human' THEN 0 ELSE 1 END::INT AS task_order
    FROM rc2 LEFT JOIN t ON t.site = rc2.site AND t.page_id = rc2.page_id""",
    covers="H11",
)
def _(spark, d):
    runs, children = task_runs(spark, d)
    paths = children.select("site", "page_id", F.concat(F.lit("/quiet/"), F.col("page_id").cast("string")).alias("path"))
    return TK.group_tasks(runs.filter("page_id % 6 <> 0"), children, paths)


@query(
    "publish_gates",
    f"""WITH {RUNS}, {FQ.CONV}, q AS (SELECT 's' || (site % 10) AS site, count(*) AS r, count(answer) AS a FROM cv0 WHERE required GROUP BY ALL),
    t AS (SELECT site, count_if(status = 'failed') AS f FROM rt WHERE site <> 's3' GROUP BY site),
    c AS (SELECT site, count(*) AS p, count_if(current_stage = 'approved') AS b FROM rc2 GROUP BY site),
    l AS (SELECT 's' || (page_id % 10) AS site, count(*) AS n, count_if(page_id % 17 <> 0 OR page_id % 10 < 5) AS k FROM pages GROUP BY ALL),
    z AS (SELECT c.site, c.site <> 's1' AS hs, coalesce(r, 0) AS r, coalesce(a, 0) AS a, coalesce(f, 0) AS f, p, b, coalesce(n, 0) AS n, coalesce(k, 0) AS k
          FROM c LEFT JOIN q USING (site) LEFT JOIN t USING (site) LEFT JOIN l USING (site))
    SELECT site, r = a AS questions_ok, a || ' of ' || r || ' required questions answered' AS questions_label, p > 0 AND b = p AS pages_ok, b || ' of ' || p || ' pages approved' AS pages_label,
      hs AND f = 0 AS schema_ok, CASE WHEN NOT hs THEN 'Schema not deployed yet' WHEN f = 1 THEN '1 cast failed' WHEN f > 1 THEN f || ' casts failed' ELSE 'Schema deployed, automatic tasks ran clean' END AS schema_label,
      n > 0 AND k = n AS ledger_ok, k || ' / ' || n || ' URLs accounted for' AS ledger_label FROM z""",
    covers="H13",
)
def _(spark, d):
    runs, children = task_runs(spark, d)
    qs = FQ.conversation_questions(spark, d).withColumn("site", F.concat(F.lit("s"), (F.col("site") % 10).cast("string")))
    n = F.col("page_id")
    ledger = T.table(spark, d, "pages").select(
        F.concat(F.lit("s"), (n % 10).cast("string")).alias("site"),
        F.when((n % 17 != 0) | (n % 10 < 5), "mapped").otherwise("unmapped").alias("status"),
    )
    sites = children.select("site").distinct().withColumn("has_schema", F.col("site") != "s1")
    return TK.publish_gates(sites, qs, runs.filter("site <> 's3'"), children, ledger)


@query(
    "published_release",
    f"""WITH {D.PG} SELECT site, 'r-' || split_part(path, '/', 2) AS release_id, page_id AS doc_id, md5(html) AS digest,
      CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END::INT AS run FROM pg""",
    covers="H14",
)
def _(spark, d):
    docs = T.read_pages(spark, d).select(
        "site", F.concat(F.lit("r-"), F.split_part("path", F.lit("/"), F.lit(2))).alias("release_id"), F.col("page_id").alias("doc_id"), F.md5("html").alias("digest")
    )
    out = SiteTable(spark, scratch_path(spark, "published"), ("site", "release_id"))
    TK.publish(out, docs.filter("doc_id % 3 = 0").withColumn("run", F.lit(1)), "first")
    TK.publish(out, docs.withColumn("run", F.lit(2)), "second")
    TK.publish(out, docs.withColumn("run", F.lit(3)), "second")  # a repeat adds nothing
    return out.read()
