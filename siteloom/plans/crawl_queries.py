"""Crawl, link-graph and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import crawl as K
from siteloom.operators import links as L
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans.registry import query
from siteloom.session import scratch_path
from siteloom.sources import sync as S
from siteloom.sources import tables as T
from siteloom.sources.site_table import SiteTable

# links of the pages' HTML, those that several pages of a site carry leading from one of them to the next
LINKED = f"""{D.PG},
h0 AS (SELECT site, page_id, url, regexp_extract_all(html, '(?is)<a[^>]*?href\\s*=\\s*["\'\']([^"\'\']*)["\'\']', 1) AS hs FROM pg),
h1 AS (SELECT site, page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM h0),
h2 AS (SELECT site, page_id, url, {D.canon_rel('href', 'url')} AS link, pos FROM h1 WHERE href <> ''),
rl AS (SELECT site, page_id, url, link, min(pos)::INT AS pos FROM h2 GROUP BY ALL),
h3 AS (SELECT site, page_id, url, {D.norm_path(D.path('link'))} AS subject, min(pos) AS pos, arg_min(link, pos) AS link FROM rl GROUP BY ALL),
lk AS (SELECT site, page_id, {D.canon_abs('url')} AS from_url, pos,
    CASE WHEN count(*) OVER (PARTITION BY site, subject) = 1 THEN link
         ELSE coalesce(lead({D.canon_abs('url')}) OVER (PARTITION BY site, subject ORDER BY page_id), first_value({D.canon_abs('url')}) OVER (PARTITION BY site, subject ORDER BY page_id)) END AS to_url FROM h3),
pu AS (SELECT site, {D.canon_abs('url')} AS url, min(page_id) AS page_id FROM pg GROUP BY ALL),
ad AS (SELECT site, from_url, list(to_url ORDER BY pos, to_url) AS targets FROM (SELECT lk.site, from_url, to_url, min(pos) AS pos FROM lk JOIN pu ON pu.site = lk.site AND pu.url = lk.to_url GROUP BY ALL) GROUP BY ALL),
sd AS (SELECT site, arg_min(url, page_id) AS url FROM pu GROUP BY site)"""

_FETCH = """f AS (SELECT page_id, url || CASE page_id % 9 WHEN 3 THEN '/feed.xml' ELSE '' END AS url,
  CASE page_id % 9 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 4 THEN 'Application/XML'
    WHEN 5 THEN '' WHEN 6 THEN 'text/html' END AS content_type,
  CASE WHEN page_id % 9 = 7 THEN 0 ELSE 200 END AS status, CASE WHEN page_id % 9 IN (1, 2, 6, 7) THEN '' ELSE html END AS body FROM pages)"""


def fetch_log(spark, d):
    n = F.col("page_id") % 9
    ct = (
        F.when(n == 0, "text/html; charset=utf-8").when(n == 1, "application/pdf").when(n == 2, "image/png")
        .when(n == 4, "Application/XML").when(n == 5, "").when(n == 6, "text/html")
    )
    return T.table(spark, d, "pages").select(
        "page_id", F.concat("url", F.when(n == 3, "/feed.xml").otherwise("")).alias("url"), ct.alias("content_type"),
        F.when(n == 7, 0).otherwise(200).alias("status"),
        F.when(n.isin(1, 2, 6, 7), "").otherwise(F.col("html")).alias("body"),
    )


@query(
    "fetch_kinds",
    f"""WITH {_FETCH} SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'asset' WHEN 2 THEN 'asset' WHEN 3 THEN 'xml' WHEN 4 THEN 'xml' WHEN 6 THEN 'empty'
      WHEN 7 THEN 'error' ELSE 'html' END AS kind,
      CASE WHEN page_id % 9 IN (1, 2) THEN 'asset' WHEN page_id % 9 IN (3, 4, 7) THEN 'skip' ELSE 'page' END AS use FROM f""",
    covers="A2",
)
def _(spark, d):
    return K.classify_fetches(fetch_log(spark, d)).select("page_id", "kind", "use")


@query(
    "asset_links",
    f"""WITH {_FETCH} SELECT page_id + 0 AS page_id, url AS link FROM f WHERE page_id % 9 IN (1, 2)""",
    covers="C9",
)
def _(spark, d):
    log = K.classify_fetches(fetch_log(spark, d))
    links = log.select("page_id", F.col("url").alias("link"))
    return K.asset_links(links, log)


SITEMAP_PAGES = 100  # pages a sitemap lists


def site_origins(spark, d):
    """Scheme and host of each site's first page."""
    origin = F.regexp_extract("page_url", "^([a-z]+://[^/]+)", 1)
    return V.canonical_pages(spark, d).groupBy("site").agg(F.min_by(origin, "page_id").alias("origin"))


def sitemap_docs(spark, d):
    """Sitemaps of the pages and the links in their HTML: one for each hundred pages of a site's section, an index a section.

    Indexes list themselves first; those of the section ``es`` answer with HTML.
    """
    pages = T.read_pages(spark, d)
    section = F.split_part("path", F.lit("/"), F.lit(2))
    part = F.floor(F.col("page_id") / SITEMAP_PAGES).cast("long")
    own = pages.select("site", "page_id", F.lit(-1).alias("pos"), F.col("url").alias("loc"))
    locs = own.unionByName(L.page_links(pages).select("site", "page_id", "pos", F.col("link").alias("loc")))
    listed = locs.join(pages.select("site", "page_id", section.alias("section"), part.alias("part")), ["site", "page_id"])
    entry = F.concat(F.lit("<url><loc> "), F.replace("loc", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    in_order = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["e"]), "")
    urlsets = listed.groupBy("site", "section", "part").agg(in_order(F.struct("page_id", "pos", entry.alias("e"))).alias("locs"))
    urlsets = urlsets.join(site_origins(spark, d), "site")
    at = F.concat("origin", F.lit("/sm/"), "section", F.lit("-"), F.col("part").cast("string"), F.lit(".xml"))
    html = F.when(F.col("section") == "es", "text/html").otherwise("application/xml")
    maps = urlsets.select(
        "site", at.alias("url"), html.alias("content_type"),
        F.concat(F.lit('<?xml version="1.0"?><urlset>'), "locs", F.lit("<url><loc>https://other.example/x</loc></url></urlset>")).alias("body"),
    )
    place = F.concat("origin", F.lit("/index/"), "section", F.lit(".xml"))
    index = urlsets.withColumn("at", at).groupBy("site", "origin", "section").agg(
        in_order(F.struct("part", F.concat(F.lit("<sitemap><loc>"), "at", F.lit("</loc></sitemap>")).alias("e"))).alias("locs")
    )
    index = index.select(
        "site", place.alias("url"), F.lit("text/xml").alias("content_type"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>"), place, F.lit("</loc></sitemap>"), "locs", F.lit("</sitemapindex>")).alias("body"),
    )
    return maps.unionByName(index)


def robots_files(spark, d):
    """One robots.txt a site: rules on its sections, on some of its pages, a wildcard, and its sitemap indexes."""
    pages = T.read_pages(spark, d)
    section = F.split_part("path", F.lit("/"), F.lit(2))
    rules = F.array(
        F.concat(F.lit("Disallow: /"), section, F.lit("/1")), F.concat(F.lit("Allow: /"), section, F.lit("/11")), F.concat(F.lit("Disallow: /"), section, F.lit("/2"))
    )
    some = F.when(F.col("page_id") % 7 == 0, F.array(F.concat(F.lit("Disallow: "), "path"))).otherwise(F.array(F.concat(F.lit("Sitemap: "), section)))
    lines = pages.select("site", F.explode(F.concat(rules, some)).alias("line")).distinct().join(site_origins(spark, d), "site")
    line = F.when(F.col("line").startswith("Sitemap: "), F.concat(F.lit("sitemap: "), "origin", F.lit("/index/"), F.substring("line", 10, 100), F.lit(".xml"))).otherwise(F.col("line"))
    body = F.concat(
        F.lit("# rules\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /*5$\nDisallow:\n"),
        F.array_join(F.array_sort(F.collect_list(line)), "\n"),
    )
    return lines.groupBy("site", "origin").agg(body.alias("body"))


@query(
    "sitemap_urls",
    f"""WITH {LINKED}, og AS (SELECT site, arg_min(regexp_extract({D.canon_abs('url')}, '^([a-z]+://[^/]+)', 1), page_id) AS origin FROM pg GROUP BY site),
    lc AS (SELECT site, page_id, -1 AS pos, url AS loc FROM pg UNION ALL SELECT site, page_id, pos, link FROM rl),
    sq AS (SELECT lc.site, {D.canon_abs('loc')} AS url, row_number() OVER (PARTITION BY lc.site ORDER BY split_part(path, '/', 2), lc.page_id // 100, lc.page_id, pos, loc) AS n
      FROM lc JOIN pg USING (site, page_id) WHERE split_part(path, '/', 2) <> 'es'
        -- an index is listed by robots.txt if a page of its section has no rule of its own
        AND (lc.site, split_part(path, '/', 2)) IN (SELECT (site, split_part(path, '/', 2)) FROM pg WHERE page_id % 7 <> 0)),
    sf AS (SELECT sq.site, sq.url, min(n) AS n FROM sq JOIN og USING (site)
      WHERE regexp_extract(sq.url, '^([a-z]+)://', 1) = regexp_extract(origin, '^([a-z]+)://', 1) AND {D.site('sq.url')} = sq.site GROUP BY ALL)
    SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY n)::INT AS place FROM sf""",
    covers="A3",
)
def _(spark, d):
    return K.sitemap_urls(sitemap_docs(spark, d), robots_files(spark, d))


@query(
    "robots_allowed",
    f"""WITH {D.PG}, r AS (SELECT DISTINCT site, unnest([{{'a': false, 'p': '/' || seg || '/1'}}, {{'a': true, 'p': '/' || seg || '/11'}}, {{'a': false, 'p': '/' || seg || '/2'}}]) AS r
        FROM (SELECT site, split_part(path, '/', 2) AS seg FROM pg)
      UNION SELECT site, {{'a': false, 'p': path}} FROM pg WHERE page_id % 7 = 0),
    t AS (SELECT site, page_id, {D.esc(D.path('url'))} || CASE WHEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) ELSE '' END AS target FROM pg),
    m AS (SELECT t.site, page_id, length(r.p) AS n, r.a AS allow FROM t JOIN r ON r.site = t.site AND starts_with(target, r.p)
      UNION ALL SELECT site, page_id, 4, false FROM t WHERE target LIKE '/%5')
    SELECT t.site, t.page_id, coalesce(arg_max(allow, n * 2 + allow::INT), true) AS allowed FROM t LEFT JOIN m USING (site, page_id) GROUP BY ALL""",
    covers="A4",
)
def _(spark, d):
    return K.robots_allowed(T.read_pages(spark, d), robots_files(spark, d)).select("site", "page_id", "allowed")


def crawl_inputs(spark, d):
    """Links of the pages' HTML, each site's first page as seed, and the pages' URLs."""
    pages = V.canonical_pages(spark, d)
    seeds = pages.groupBy("site").agg(F.min_by("page_url", "page_id").alias("url")).withColumn("pos", F.lit(0))
    return V.related_links(pages).select("site", "from_url", "to_url", "pos"), seeds, pages.select("site", F.col("page_url").alias("url"))


# one queue a site: the page at its head appends the pages it links to that the queue does not hold
QUEUE = f"""{LINKED}, qu AS (SELECT site, 1 AS i, [url] AS q FROM sd
  UNION ALL SELECT qu.site, i + 1, list_concat(q, list_filter(coalesce(targets, []), lambda x: NOT list_contains(q, x)))
  FROM qu LEFT JOIN ad ON ad.site = qu.site AND ad.from_url = q[i] WHERE i <= len(q)),
qf AS (SELECT site, unnest(q) AS url, generate_subscripts(q, 1)::INT AS place FROM qu WHERE i = len(q) + 1),
bfs AS (SELECT site, url, 0 AS depth FROM sd UNION SELECT b.site, unnest(targets), depth + 1 FROM bfs b JOIN ad ON ad.site = b.site AND ad.from_url = b.url WHERE depth < 60),
dp AS (SELECT site, url, min(depth)::INT AS depth FROM bfs GROUP BY ALL)"""


@query("crawl_order", f"WITH RECURSIVE {QUEUE} SELECT site, url, depth, place FROM qf JOIN dp USING (site, url) WHERE place <= 5", covers="C18")
def _(spark, d):
    return K.crawl_order(*crawl_inputs(spark, d), cap=5)  # the page limit of a crawl


@query("crawl_places", f"WITH RECURSIVE {QUEUE} SELECT site, url, depth, place FROM qf JOIN dp USING (site, url)", covers="C18")
def _(spark, d):
    return K.crawl_order(*crawl_inputs(spark, d))


@query("crawl_depths", f"WITH RECURSIVE {QUEUE} SELECT site, url, depth FROM dp", covers="C18")
def _(spark, d):
    return K.crawl_order(*crawl_inputs(spark, d), places=False).select("site", "url", "depth")


_GRAPH = f"""{LINKED}, tg AS (SELECT site, {D.norm_path('path')} AS target_path, min(page_id) AS to_page, arg_min(http_status, page_id) AS http_status FROM pg GROUP BY ALL),
gg AS (SELECT DISTINCT l.site, l.page_id AS from_page, l.target_path, to_page, CASE WHEN to_page IS NULL THEN 'dangling' WHEN http_status >= 400 THEN 'error-target' ELSE 'ok' END AS state
  FROM (SELECT site, page_id, {D.norm_path(D.path('to_url'))} AS target_path FROM lk) l LEFT JOIN tg ON tg.site = l.site AND tg.target_path = l.target_path)"""


def page_graph(spark, d):
    pages = V.canonical_pages(spark, d)
    return K.link_graph(V.related_links(pages).withColumn("path", U.path_of("to_url")), pages)


@query("link_graph", f"WITH {_GRAPH} SELECT * FROM gg", covers="C19")
def _(spark, d):
    return page_graph(spark, d)


@query(
    "page_link_states",
    f"""WITH {D.PG}, h AS (SELECT site, page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pg),
    l AS (SELECT DISTINCT site, page_id, {D.norm_path(D.esc('href'))} AS target_path FROM h),
    t AS (SELECT site, {D.norm_path('path')} AS target_path, min(page_id) AS to_page FROM pg GROUP BY ALL)
    SELECT site, count(*) AS links, count_if(to_page IS NULL)::BIGINT AS dangling FROM l LEFT JOIN t USING (site, target_path) GROUP BY site""",
    covers="C19",
)
def _(spark, d):
    pages = T.read_pages(spark, d)
    links = L.page_links(pages).filter(U.same_site("link", "url")).withColumn("path", U.path_of("link"))
    g = K.link_graph(links, pages)
    return g.groupBy("site").agg(F.count("*").alias("links"), F.count_if(F.col("state") == "dangling").alias("dangling"))


@query(
    "orphan_pages",
    f"""WITH {_GRAPH} SELECT site, page_id, {D.norm_path('path')} AS path FROM pg WHERE path <> '/' AND NOT EXISTS (
      SELECT 1 FROM gg WHERE gg.site = pg.site AND gg.target_path = {D.norm_path('pg.path')} AND gg.to_page <> gg.from_page)""",
    covers="F16 C19",
)
def _(spark, d):
    return K.orphan_pages(page_graph(spark, d), T.read_pages(spark, d))


@query(
    "replaced_site_pages",
    f"""WITH {D.PG} SELECT site, page_id, url, path, md5(html) AS digest, CASE WHEN site LIKE 'blog.%' THEN 2 ELSE 1 END::INT AS run FROM pg
    WHERE site NOT LIKE 'blog.%' OR (page_id % 2 = 0 AND site NOT LIKE '%.net')""",
    covers="A5",
)
def _(spark, d):
    pages = T.read_pages(spark, d).select("site", "page_id", "url", "path", F.md5("html").alias("digest"))
    out = SiteTable(spark, scratch_path(spark, "site_pages"))
    out.replace(pages.withColumn("run", F.lit(1)), run="first")
    again = pages.filter("site like 'blog.%'")
    found = again.filter("page_id % 2 = 0 and site not like '%.net'").withColumn("run", F.lit(2))
    out.replace(found, again.select("site").distinct(), "again")  # a crawl that finds no page clears its site
    return out.read()


def stored_questions(spark, d):
    """Planned and stored questions of the conversations: the plan lacks some, the store others."""
    c = T.table(spark, d, "conversations").filter("role = 'user'")
    base = c.select(
        F.col("conv_id").alias("site"), F.col("turn").alias("question_id"), F.length("text").cast("long").alias("pages"),
        F.lit(None).cast("string").alias("answer"),
    )
    planned = base.filter("(site + question_id) % 5 <> 0")
    existing = base.filter("(site + question_id) % 3 <> 0").withColumns(
        {
            "pages": F.col("pages") - 1,
            "answer": F.when((F.col("site") + F.col("question_id")) % 2 == 0, F.concat(F.lit("a"), F.col("site").cast("string"))),
        }
    )
    return planned, existing


@query(
    "synced_questions",
    """WITH b AS (SELECT conv_id AS site, turn AS question_id, length(text)::BIGINT AS pages, conv_id + turn AS n FROM conversations WHERE role = 'user')
    SELECT site, question_id, CASE WHEN n % 5 <> 0 THEN pages ELSE pages - 1 END AS pages,
      CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 'a' || site END AS answer,
      CASE WHEN n % 5 <> 0 THEN 'upsert' WHEN n % 2 = 0 THEN 'keep' ELSE 'delete' END AS change
    FROM b WHERE n % 5 <> 0 OR n % 3 <> 0""",
    covers="A6",
)
def _(spark, d):
    planned, existing = stored_questions(spark, d)
    answered = F.col("old_answer").isNotNull()
    return S.sync_by_id(planned, existing, {"answer": answered}, ~answered, ["site", "question_id"])


@query(
    "applied_sync",
    """WITH b AS (SELECT conv_id AS site, turn AS question_id, length(text)::BIGINT AS pages, conv_id + turn AS n FROM conversations WHERE role = 'user')
    SELECT site, question_id, CASE WHEN site % 2 = 1 THEN pages - 1 WHEN n % 5 <> 0 THEN pages ELSE pages - 1 END AS pages,
      CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 'a' || site END AS answer
    FROM b WHERE CASE WHEN site % 2 = 1 THEN n % 3 <> 0 ELSE n % 5 <> 0 OR (n % 3 <> 0 AND n % 2 = 0) END""",
    covers="A6",
)
def _(spark, d):
    """The plans of every other site are synced into the stored questions; the rest of the table stays as it lies."""
    planned, existing = stored_questions(spark, d)
    out = SiteTable(spark, scratch_path(spark, "questions"))
    out.replace(existing, run="stored")
    even = F.col("site") % 2 == 0
    answered = F.col("old_answer").isNotNull()
    changes = S.sync_by_id(planned.filter(even), existing.filter(even), {"answer": answered}, ~answered, ["site", "question_id"])
    out.apply(changes, ["site", "question_id"], "synced")
    return out.read()


@query(
    "preferred_drafts",
    """WITH v AS (SELECT lang AS site, doc_id // 2 AS n, doc_id % 2 = 1 AND doc_id % 3 = 0 AS is_draft, doc_id % 2 = 0 OR doc_id % 3 = 0 AS ok, n_chars FROM documents)
    SELECT site, 'doc-' || n AS doc_id, arg_max(is_draft, is_draft::INT) AS is_draft, arg_max(n_chars, is_draft::INT) AS n_chars
    FROM v WHERE ok GROUP BY ALL""",
    covers="A7",
)
def _(spark, d):
    n, odd, third = F.floor(F.col("doc_id") / 2), F.col("doc_id") % 2 == 1, F.col("doc_id") % 3 == 0
    docs = T.table(spark, d, "documents").filter(~odd | third).select(
        F.col("lang").alias("site"),
        F.concat(F.when(odd & third, "drafts.").otherwise(""), F.lit("doc-"), n.cast("string")).alias("doc_id"), "n_chars",
    )
    return S.prefer_drafts(docs)
