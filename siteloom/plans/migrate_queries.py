"""Queries over the migration plan and its tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import elements as E
from siteloom.operators import extract as X
from siteloom.operators import findings as Q
from siteloom.operators import migrate as M
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans.extract_queries import RICH
from siteloom.plans.finding_queries import SIG, contact_entities, rich_signals
from siteloom.plans.registry import query
from siteloom.session import stored
from siteloom.sources import tables as T

TITLED = f"""{D.PX}, tp AS (SELECT site, page_id, url, path, http_status,
  title || CASE WHEN page_id % 4 <> 0 THEN ' | Site ' || site ELSE '' END AS title FROM px)"""
NAMES = f"""{TITLED},
tn AS (SELECT site, count(*) AS n FROM tp WHERE http_status < 400 AND title <> '' GROUP BY site),
tq AS (SELECT site, page_id, regexp_split_to_array(title, '\\s+[|–—-]\\s+') AS p FROM tp WHERE http_status < 400 AND title <> ''),
tc AS (SELECT site, trim(c.v) AS name, count(*) AS uses, min(page_id * 2 + c.w) AS first
  FROM tq, LATERAL (VALUES (0, p[len(p)]), (1, p[1])) c(w, v) WHERE len(p) >= 2 AND trim(c.v) <> '' GROUP BY ALL),
tb AS (SELECT site, first(name ORDER BY uses DESC, first) AS site_name, max(uses) AS uses FROM tc GROUP BY site),
sn AS (SELECT site, site_name FROM tb JOIN tn USING (site) WHERE uses >= greatest(2, ceil(n / 2.0)))"""


@query("site_names", f"WITH {NAMES} SELECT * FROM sn", covers="G1")
def _(spark, d):
    return M.site_names(V.stored_titles(spark, d))


@query(
    "clean_titles",
    f"""WITH {NAMES} SELECT tp.site, page_id, CASE WHEN site_name IS NULL THEN trim(title)
      ELSE coalesce(nullif(trim(array_to_string(list_filter(regexp_split_to_array(trim(title), '\\s+[|–—-]\\s+'), lambda p: trim(p) <> site_name), ' – ')), ''), site_name) END AS clean_title
    FROM tp LEFT JOIN sn USING (site)""",
    covers="G2",
)
def _(spark, d):
    pages = V.stored_titles(spark, d)
    return M.clean_titles(pages, M.site_names(pages)).select("site", "page_id", "clean_title")


@query(
    "common_values",
    f"""WITH {D.RE} SELECT site, kind, first(value ORDER BY n DESC, value) AS value
    FROM (SELECT site, kind, value, count(*) AS n FROM de WHERE http_status < 400 GROUP BY ALL) GROUP BY ALL""",
    covers="G3",
)
def _(spark, d):
    return M.most_common(contact_entities(spark, d), ["site", "kind"])


@query(
    "chrome_images",
    f"""WITH {RICH}, l AS (SELECT site, page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} AS o FROM pg WHERE http_status < 400),
    i AS (SELECT site, page_id, o || '/img/logo-' || (page_id % 3) || '.png' AS src FROM l UNION SELECT site, page_id, o || '/img/' || (page_id % 9) || '.jpg' FROM l),
    n AS (SELECT site, count(*) AS n FROM l GROUP BY site)
    SELECT site, src, count(*) AS pages FROM i JOIN n USING (site) GROUP BY site, src, n HAVING count(*) >= greatest(2, ceil(n / 2.0))""",
    covers="G4",
)
def _(spark, d):
    pages = V.rich_pages(spark, d)
    return M.chrome_images(X.page_images(pages), pages)


@query(
    "brand_picks",
    f"""WITH {D.PG}, f AS (SELECT site, min(page_id) AS page_id FROM pg GROUP BY site),
    o AS (SELECT f.site, f.page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} AS origin, substr(md5('' || (f.page_id % 7)), 1, 6) AS hx FROM f JOIN pg USING (page_id)),
    h AS (SELECT *, [('0x' || substr(hx, 1, 2))::INT, ('0x' || substr(hx, 3, 2))::INT, ('0x' || substr(hx, 5, 2))::INT] AS rgb FROM o),
    c AS (SELECT *, CASE WHEN list_max(rgb) > 0 AND (list_max(rgb) - list_min(rgb)) / list_max(rgb) > 0.25 THEN true ELSE false END AS vivid FROM h),
    k AS (SELECT *, list_concat(CASE WHEN page_id % 5 = 2 THEN ['#112233'] ELSE [] END, CASE WHEN vivid THEN ['#' || hx, '#ff0000', '#abc'] ELSE ['#ff0000', '#' || hx, '#abc'] END) AS colors FROM c)
    SELECT site, colors[1] AS primary_color, colors[2] AS secondary_color, CASE WHEN page_id % 5 = 2 THEN 'Inter' ELSE 'Lora, serif' END AS font_heading, 'Lora, serif' AS font_body,
      origin || '/img/logo-' || (page_id % 3) || '.png' AS logo FROM k""",
    covers="G5",
)
def _(spark, d):
    return M.brand_picks(X.site_brand(V.rich_pages(spark, d)))


@query(
    "answer_decisions",
    """WITH a AS (SELECT conv_id, turn, role, text || CASE turn % 5 WHEN 0 THEN ' not sure, kill?' WHEN 1 THEN ' Consolidate and remove it' WHEN 2 THEN ' please KILL it'
      WHEN 3 THEN ' it is authentic' ELSE ' and so on' END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN role = 'system' OR regexp_matches(t, '(?i)none of these|clarify|check with|i[''’]ll check|ask the client|not sure') THEN NULL
      WHEN regexp_matches(t, '(?i)consolidat|merge') THEN 'merge' WHEN regexp_matches(t, '(?i)remove|kill|drop|delete') THEN 'drop'
      WHEN regexp_matches(t, '(?i)\\b(keep|authentic|real|intentional)\\b') THEN 'keep' END AS decision FROM a""",
    covers="G6",
)
def _(spark, d):
    c = T.table(spark, d, "conversations")
    n = F.col("turn") % 5
    word = (
        F.when(n == 0, " not sure, kill?").when(n == 1, " Consolidate and remove it").when(n == 2, " please KILL it")
        .when(n == 3, " it is authentic").otherwise(" and so on")
    )
    kind = F.when(F.col("role") == "system", "mapping").otherwise("keep-or-kill")
    return c.select("conv_id", "turn", M.answer_decision(kind, F.concat("text", word)).alias("decision"))


# questions with answers, their evidence
ANSWERED = f"""{SIG},
aq AS (SELECT *, ('0x' || substr(fingerprint, 1, 1))::BIGINT AS dg2, string_split(options, '|') AS opts FROM pq),
qa AS (SELECT * EXCLUDE (opts), CASE WHEN dg2 < 12 THEN opts[(dg2 // 4 + 1)::INT] END AS answer,
         CASE WHEN dg2 % 2 = 0 THEN 'as agreed on the phone' END AS answer_note FROM aq),
qe AS (SELECT sm.site, pq.fingerprint, sm.page_id, sm.url, sm.ord FROM sm JOIN pq USING (site, finding, key))"""

DECIDED = f"""{ANSWERED},
dc AS (SELECT *, CASE WHEN regexp_matches(answer, '(?i)consolidat|merge') THEN 'merge'
  WHEN regexp_matches(answer, '(?i)remove|kill|drop|delete') THEN 'drop' WHEN regexp_matches(answer, '(?i)\\b(keep|authentic|real|intentional)\\b') THEN 'keep' END AS decision
  FROM qa WHERE kind = 'keep-or-kill' AND answer IS NOT NULL),
dp2 AS (SELECT DISTINCT site, fingerprint, {D.norm_path(D.path('url'))} AS path FROM qe),
dv AS (SELECT site, fingerprint, first(path ORDER BY length(path), path) AS survivor FROM dp2 GROUP BY ALL),
dm AS (SELECT dc.site, path, seq, fingerprint,
    CASE decision WHEN 'drop' THEN CASE WHEN path <> '/' THEN '/' END WHEN 'merge' THEN CASE WHEN path <> survivor THEN survivor END END AS to_path,
    CASE decision WHEN 'drop' THEN 'Dropped: “' || answer || '”' ELSE 'Merged into ' || survivor || ': “' || answer || '”' END AS reason
  FROM dc JOIN dp2 USING (site, fingerprint) JOIN dv USING (site, fingerprint)),
pd AS (SELECT site, path, last(to_path ORDER BY seq, fingerprint) AS to_path, last(reason ORDER BY seq, fingerprint) AS reason
  FROM dm WHERE to_path IS NOT NULL GROUP BY ALL)"""


def answered_questions(spark, d, rows=None):
    """Answered questions and their evidence, from stored ``rows`` of signals where there are some."""
    rows = rows or stored(Q.signal_rows(rich_signals(spark, d)), "signals")
    order = F.create_map(*[F.lit(v) for i, f in enumerate(["boilerplate", "http-error", "missing-meta", "missing-alt", "thin"]) for v in (f, i + 2)])
    found = stored(V.answered(Q.page_questions(rows).withColumn("seq", order[F.col("finding")])), "questions")
    ev = Q.with_fingerprint(Q.page_evidence(rows), found).select("site", "fingerprint", "page_id", "url")
    return found, stored(ev, "evidence")


@query("path_decisions", f"WITH {DECIDED} SELECT * FROM pd", covers="G7")
def _(spark, d):
    return M.path_decisions(*answered_questions(spark, d))


TYPES = f"pt AS ({V.TYPES_SQL.format(pg='pg')})"
RESERVED = ", ".join(f"'{n}'" for n in M.RESERVED_TYPES)
COLL = f"""{TYPES},
pe AS (SELECT pg.site, pt.version, pt.name AS type_name, page_id FROM pg JOIN pt ON pt.site = pg.site AND pt.seg = split_part(pg.path, '/', 2)),
ow AS (SELECT site, name AS type_name, CASE WHEN decision = 'merge' THEN coalesce(merge_into, name) ELSE name END AS type FROM pt),
cu AS (SELECT site, name AS type, confidence FROM pt WHERE coalesce(decision, 'keep') NOT IN ('drop', 'merge') AND name NOT IN ({RESERVED})
  AND block_match IS NULL AND kind = 'document'),
co AS (SELECT DISTINCT pe.site, ow.type, page_id, confidence FROM pe JOIN ow USING (site, type_name) JOIN cu ON cu.site = pe.site AND cu.type = ow.type)"""


def collections(spark, d):
    types = V.proposal_types(spark, d)
    ev = V.proposal_evidence(spark, d, types)
    return M.collection_pages(types, ev)


@query("collection_pages", f"WITH {D.PG}, {COLL} SELECT site, type, page_id, confidence FROM co", covers="G8")
def _(spark, d):
    return collections(spark, d).select("site", "type", "page_id", "confidence")


TARGETS = f"""{DECIDED}, {COLL},
ap AS (SELECT site, page_id, {D.norm_path('path')} AS old_path, http_status FROM pg),
am AS (SELECT site, old_path, min(page_id) AS page_id FROM ap WHERE http_status < 400 GROUP BY ALL),
bc AS (SELECT site, page_id, first(type ORDER BY confidence DESC, type) AS coll FROM co GROUP BY ALL),
ad AS (SELECT am.site, am.old_path, pd.to_path, pd.reason, CASE WHEN contains(trim(am.old_path, '/'), '/') THEN coll END AS coll
  FROM am LEFT JOIN pd ON pd.site = am.site AND pd.path = am.old_path LEFT JOIN bc ON bc.site = am.site AND bc.page_id = am.page_id),
safe AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN coll IS NOT NULL THEN regexp_extract(old_path, '([^/]*)$', 1) ELSE coalesce(nullif(trim(old_path, '/'), ''), 'home') END,
    '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM ad),
mp AS (SELECT site, old_path, coll, coalesce(coll, 'page') AS type, coalesce(coll || '-', 'page-') || sl AS did,
    CASE WHEN coll IS NOT NULL THEN '/' || lower(regexp_replace(coll, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) || '/' || sl ELSE old_path END AS np
  FROM safe WHERE to_path IS NULL),
cl AS (SELECT site, did, count(*) AS n FROM mp GROUP BY ALL),
md AS (SELECT mp.site, old_path, type, CASE WHEN n = 1 THEN did ELSE did || '-' || substr({D.key12('old_path')}, 1, 6) END AS doc_id,
    CASE WHEN n = 1 OR type = 'page' THEN np ELSE np || '-' || substr({D.key12('old_path')}, 1, 6) END AS new_path, 'mapped' AS state, NULL::VARCHAR AS reason
  FROM mp JOIN cl USING (site, did)
  UNION ALL SELECT site, old_path, NULL, NULL, to_path, 'dropped', reason FROM safe WHERE to_path IS NOT NULL),
tg AS (SELECT ap.site, page_id, old_path, type, doc_id, new_path, state, reason FROM ap JOIN md USING (site, old_path) WHERE http_status < 400
  UNION ALL SELECT site, page_id, old_path, NULL, NULL, '/', 'error', 'HTTP ' || http_status FROM ap WHERE http_status >= 400),
lg AS (SELECT site, old_path AS from_path, first(new_path ORDER BY pr, page_id) AS to_path, CASE WHEN min(pr) = 0 THEN 'mapped' ELSE 'dropped' END AS status,
    arg_min(coalesce(reason, '~'), pr * 1000000000 + page_id) AS rs
  FROM (SELECT *, CASE state WHEN 'mapped' THEN 0 WHEN 'dropped' THEN 1 ELSE 2 END AS pr FROM tg) GROUP BY ALL)"""


def targets(spark, d, rows=None, pages=None):
    decisions = M.path_decisions(*answered_questions(spark, d, rows))
    pages = (V.titled_pages(spark, d) if pages is None else pages).select("site", "page_id", "url", "path", "http_status", "title", "has_html")
    return stored(M.assign_targets(pages, collections(spark, d), decisions), "targets")


@query("assigned_targets", f"WITH {TARGETS} SELECT * FROM tg", covers="G9")
def _(spark, d):
    return targets(spark, d).drop("slug")


@query(
    "redirect_ledger",
    f"WITH {TARGETS} SELECT site, from_path, to_path, status, nullif(rs, '~') AS reason FROM lg",
    covers="G11",
)
def _(spark, d):
    return M.redirect_ledger(targets(spark, d))


@query(
    "redirects",
    f"WITH {TARGETS} SELECT site, 'redirect-' || {D.key12('from_path')} AS doc_id, from_path, to_path, 301::INT AS status_code FROM lg WHERE from_path <> to_path",
    covers="G12",
)
def _(spark, d):
    return M.redirects(M.redirect_ledger(targets(spark, d)))


@query(
    "site_settings",
    f"""WITH {D.RE}, m AS (SELECT site, kind, first(value ORDER BY n DESC, value) AS value
      FROM (SELECT site, kind, value, count(*) AS n FROM de WHERE http_status < 400 GROUP BY ALL) GROUP BY ALL)
    SELECT s.site, NULL::VARCHAR AS site_title, max(value) FILTER (kind = 'phones') AS phone, max(value) FILTER (kind = 'emails') AS email,
      max(value) FILTER (kind = 'addresses') AS address FROM (SELECT DISTINCT site FROM dp) s LEFT JOIN m USING (site) GROUP BY s.site""",
    covers="G13",
)
def _(spark, d):
    docs = T.read_document_pages(spark, d).withColumn("title", F.lit("Doc"))
    return M.site_settings(docs, contact_entities(spark, d))


@query(
    "written_targets",
    f"""WITH {TARGETS} SELECT ap.site, ap.page_id, tg.doc_id, tg.type, CASE WHEN tg.doc_id IS NOT NULL THEN tg.new_path ELSE coalesce(lg.to_path, '/') END AS target_path,
      CASE WHEN tg.doc_id IS NOT NULL THEN 'mapped' ELSE 'dropped' END AS target_status
    FROM ap LEFT JOIN tg ON tg.page_id = ap.page_id AND state = 'mapped' LEFT JOIN lg ON lg.site = ap.site AND lg.from_path = ap.old_path""",
    covers="G20",
)
def _(spark, d):
    t = targets(spark, d)
    return M.write_back_targets(T.read_pages(spark, d), t, M.redirect_ledger(t))


@query(
    "ledger_coverage",
    f"""WITH {TARGETS}, u AS (SELECT site, CASE WHEN length(from_path) % 5 = 0 THEN 'unmapped' ELSE status END AS status FROM lg)
    SELECT site, count_if(status <> 'unmapped')::BIGINT AS accounted, count(*) AS total,
      floor(100.0 * count_if(status <> 'unmapped') / count(*) + 0.5)::INT AS pct FROM u GROUP BY site""",
    covers="G21",
)
def _(spark, d):
    led = M.redirect_ledger(targets(spark, d))
    led = led.withColumn("status", F.when(F.length("from_path") % 5 == 0, "unmapped").otherwise(F.col("status")))
    return M.ledger_coverage(led)


@query(
    "ledger_labels",
    f"""WITH {TARGETS} SELECT site, from_path, CASE WHEN status = 'dropped' THEN CASE WHEN from_path = to_path THEN 'dropped' ELSE 'dropped · 301' END
      WHEN from_path = to_path THEN 'kept' ELSE 'moved · 301' END AS label FROM lg""",
    covers="G21",
)
def _(spark, d):
    return M.ledger_labels(M.redirect_ledger(targets(spark, d))).select("site", "from_path", "label")


@query(
    "resolved_requests",
    f"""WITH {TARGETS}, q AS (SELECT site, page_id, path FROM pg)
    SELECT q.site, page_id, q.path, CASE WHEN length(q.path) > 1 AND q.path LIKE '%/' THEN 308 WHEN to_path <> q.path THEN 301 ELSE 200 END::INT AS status,
      CASE WHEN length(q.path) > 1 AND q.path LIKE '%/' THEN {D.norm_path('q.path')} WHEN to_path <> q.path THEN to_path ELSE q.path END AS location
    FROM q LEFT JOIN lg ON lg.site = q.site AND lg.from_path = q.path AND lg.from_path <> lg.to_path""",
    covers="G22",
)
def _(spark, d):
    moved = M.redirects(M.redirect_ledger(targets(spark, d)))
    return M.resolve_requests(T.read_pages(spark, d).select("site", "page_id", "path"), moved)


@query(
    "plan_accounting",
    f"""WITH {TARGETS}, a AS (SELECT site, count_if(state = 'mapped')::BIGINT AS mapped_pages, count(DISTINCT doc_id) AS docs,
        count(DISTINCT CASE WHEN type <> 'page' THEN doc_id END) AS collection_docs, count(DISTINCT CASE WHEN type <> 'page' THEN type END) AS collections
      FROM tg GROUP BY site), r AS (SELECT site, count(*) AS redirects FROM lg WHERE from_path <> to_path GROUP BY site)
    SELECT a.*, coalesce(redirects, 0) AS redirects FROM a LEFT JOIN r USING (site)""",
    covers="G23",
)
def _(spark, d):
    t = targets(spark, d)
    return M.plan_accounting(t, M.redirect_ledger(t))


@query(
    "contact_blocks",
    f"""WITH {D.DP}, t AS (SELECT DISTINCT site, 'page-' || regexp_replace(trim(path, '/'), '[^a-zA-Z0-9_-]+', '-', 'g') AS doc_id FROM dp WHERE http_status < 400 AND path LIKE '%/contact')
    SELECT site, doc_id, 'contactBlock' AS type, {D.key12('doc_id', "'contact'")} AS key FROM t""",
    covers="G18",
)
def _(spark, d):
    docs = T.read_document_pages(spark, d).withColumns({"title": F.lit("t"), "has_html": F.lit(True)})
    none = spark.createDataFrame([], "site string, page_id long, type string, confidence double")
    decided = spark.createDataFrame([], "site string, path string, to_path string, reason string")
    return M.contact_blocks(M.assign_targets(docs, none, decided))


# (site, page_id, text, n): distinct paragraphs of the enriched pages in order
PARAGRAPHS = f"""SELECT site, page_id, text, min(n) AS n FROM (
  SELECT site, page_id, n, {D.squash(D.ents("regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g')"))} AS text FROM (
    SELECT site, page_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS part FROM (
      SELECT site, page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pg)))
  WHERE n > 0 AND length(text) >= 2 GROUP BY ALL"""

# rich pages → blocks: hero with the first paragraph, then the rest with the last image kept out
_BLK = f"""{RICH}, a1 AS (SELECT site, page_id, url, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pg),
a2 AS (SELECT site, page_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS part FROM a1),
a3 AS (SELECT site, page_id, n, {D.squash(D.ents("regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g')"))} AS text FROM a2),
pa AS (SELECT site, page_id, text, min(n) AS n FROM a3 WHERE n > 0 AND length(text) >= 2 GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY site, page_id ORDER BY n) AS k FROM pa),
hd AS (SELECT site, page_id, text AS heading FROM a3 WHERE n = 0 AND text <> '' AND length(text) <= 200)"""


@query(
    "page_blocks",
    f"""WITH {_BLK}, bl AS (
      SELECT hd.site, hd.page_id, 'hero' AS type, 1 AS part, heading, (SELECT text FROM pr WHERE pr.page_id = hd.page_id AND k = 1) AS block_text FROM hd
      UNION ALL
      SELECT hd.site, hd.page_id, 'richText', 2, NULL, string_agg(text, chr(10) || chr(10) ORDER BY k) FROM hd JOIN pr USING (site, page_id) WHERE k > 1 GROUP BY ALL)
    SELECT site, page_id, type, row_number() OVER (PARTITION BY site, page_id ORDER BY part)::INT AS block_no, heading, block_text FROM bl""",
    covers="G14 G15 G17",
)
def _(spark, d):
    blocks = E.section_blocks(E.page_sections(E.page_atoms(V.rich_pages(spark, d))))
    return blocks.select("site", "page_id", "type", "block_no", "heading", "block_text")


@query(
    "rich_text_blocks",
    f"""WITH {_BLK}, r AS (SELECT site, page_id, 'h2' AS style, heading AS text, 0 AS k FROM hd UNION ALL SELECT site, page_id, 'normal', text, k FROM pr)
    SELECT site, page_id, style, text, row_number() OVER (PARTITION BY site, page_id ORDER BY k)::INT AS block FROM r""",
    covers="G17",
)
def _(spark, d):
    sections = E.page_sections(E.page_atoms(V.rich_pages(spark, d)))
    return E.rich_text(sections).select("site", "page_id", "style", "text", "block")


def faq_pages(spark, d):
    """Paragraphs of a page as answers below h3 questions of a FAQ section."""
    body = F.regexp_replace("html", "<p>", "</p><h3>More?</h3><p>")
    marked = F.regexp_replace(body, "<article><h1>", "<article><h2>FAQ</h2><h1>")
    return T.read_pages(spark, d).withColumn("html", F.regexp_replace(marked, "(?s)<h1>.*?</h1>", "<h3>First?</h3>"))


@query(
    "faq_items",
    f"""WITH {D.PG}, p AS (SELECT site, page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pg),
    q AS (SELECT site, page_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS part FROM p),
    t AS (SELECT site, page_id, n, {D.squash(D.ents("regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g')"))} AS text FROM q WHERE n > 1),
    u AS (SELECT site, page_id, text, min(n) AS n FROM t WHERE length(text) >= 2 GROUP BY ALL)
    SELECT site, page_id, 'More?' AS question, n::INT AS item, text AS answer FROM u""",
    covers="G16",
)
def _(spark, d):
    items = E.faq_items(E.page_sections(E.page_atoms(faq_pages(spark, d))))
    return items.select("site", "page_id", "question", "item", "answer")


@query(
    "document_images",
    f"""WITH {RICH}, l AS (SELECT site, page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} || '/img/' || (page_id % 9) || '.jpg' AS src FROM pg),
    f AS (SELECT site, src, min(page_id) AS page_id FROM l GROUP BY ALL)
    SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id, src)::INT AS n, 'image-' || substr(sha1(src), 1, 12) AS asset_id
    FROM f QUALIFY page_id % 9 <> 4""",
    covers="G19",
)
def _(spark, d):
    atoms = E.page_atoms(V.rich_pages(spark, d)).filter("type = 'image'")
    uses = atoms.select("site", F.col("page_id").alias("doc_id"), "ord", "src")
    listed = M.image_sources(uses)
    assets = listed.filter(~F.col("src").endswith("/4.jpg")).select(
        "site", "src", F.concat(F.lit("image-"), F.substring(F.sha1("src"), 1, 12)).alias("asset_id")
    )
    return M.resolve_images(listed, assets)
