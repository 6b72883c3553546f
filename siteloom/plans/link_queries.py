"""URL and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import links as L
from siteloom.plans import duck as D
from siteloom.plans.registry import query
from siteloom.sources import tables as T

HREFS = f"""{D.PG},
hr AS (SELECT site, page_id, url, u.href AS href, u.pos AS pos
       FROM (SELECT site, page_id, url,
                    regexp_extract_all(html, '(?is)<a[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hs FROM pg) t,
            LATERAL (SELECT unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos) u)"""


@query(
    "read_pages",
    f"WITH {D.PG} SELECT site, page_id, url, path, http_status::INT AS http_status, length(html)::BIGINT AS html_chars FROM pg",
    covers="A1",
)
def _(spark, d):
    return T.read_pages(spark, d).select(
        "site", "page_id", "url", "path", "http_status", F.length("html").cast("long").alias("html_chars")
    )


@query(
    "canonical_links",
    f"""WITH {HREFS}, l AS (SELECT site, page_id, {D.canon_rel('href', 'url')} AS link FROM hr)
    SELECT site, link, count(DISTINCT page_id) AS pages, count(*) AS uses, min(page_id) AS first_page
    FROM l GROUP BY ALL""",
    covers="B1",
)
def _(spark, d):
    return L.canonical_links(T.read_pages(spark, d))


@query(
    "canonical_page_urls",
    f"SELECT page_id, {D.canon_abs('url')} AS canonical FROM pages",
    covers="B1",
)
def _(spark, d):
    return T.read_pages(spark, d).select("page_id", U.canonical_url("url", "url").alias("canonical"))


_REDIRECTS = """r AS (
  SELECT url AS from_url,
         CASE page_id % 5 WHEN 0 THEN replace(url, 'http://', 'https://')
                          WHEN 1 THEN replace(url, '://', '://www.')
                          WHEN 2 THEN replace(url, 'https://', 'http://')
                          WHEN 3 THEN replace(url, '.example.', '.parked.')
                          ELSE replace(url, '://www.', '://') END AS to_url
  FROM pages)"""


def _redirect_log(spark, d):
    p = T.table(spark, d, "pages").select("page_id", "url")
    swap = lambda a, b: F.replace("url", F.lit(a), F.lit(b))
    n = F.col("page_id") % 5
    to = (
        F.when(n == 0, swap("http://", "https://"))
        .when(n == 1, swap("://", "://www."))
        .when(n == 2, swap("https://", "http://"))
        .when(n == 3, swap(".example.", ".parked."))
        .otherwise(swap("://www.", "://"))
    )
    return p.select(F.col("url").alias("from_url"), to.alias("to_url"))


@query(
    "redirect_classes",
    f"""WITH {_REDIRECTS}, k AS (
      SELECT from_url, to_url, {D.site('from_url')} AS a, {D.site('to_url')} AS b,
             split_part(from_url, ':', 1) AS sa, split_part(to_url, ':', 1) AS sb FROM r)
    SELECT from_url, to_url,
           CASE WHEN a = b AND (sa = sb OR (sa = 'http' AND sb = 'https')) THEN 'same-site' ELSE 'off-site' END AS class,
           a = b AND sa = sb AS same_site FROM k""",
    covers="B2 B3",
)
def _(spark, d):
    return L.redirect_classes(_redirect_log(spark, d))


_SLUG = f"""trim(substr(regexp_replace(regexp_replace({D.site('url')}, '[.][^.]*$', ''), '[^a-z0-9]+', '-', 'g'), 1, 64), '-')"""


@query(
    "site_keys",
    f"""WITH {D.PG} SELECT site, min({_SLUG}) AS slug, count(*) AS pages, count(DISTINCT {D.host('url')}) AS hosts
    FROM pg GROUP BY site""",
    covers="B4",
)
def _(spark, d):
    return L.site_keys(T.read_pages(spark, d))


@query(
    "page_paths",
    f"""WITH {D.PG}, n AS (SELECT site, page_id, {D.norm_path('path')} AS path FROM pg)
    SELECT site, page_id, path, '/' || split_part(path, '/', 2) AS prefix,
           CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END::BIGINT AS depth,
           least(4, CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END)::BIGINT AS display_depth
    FROM n""",
    covers="B5 B6 B10",
)
def _(spark, d):
    return L.page_paths(T.read_pages(spark, d))


@query(
    "localised_links",
    f"""WITH {HREFS} SELECT site, {D.esc('href')} AS local_href, count(*) AS uses FROM hr
    WHERE href LIKE '/%' GROUP BY ALL""",
    covers="B7",
)
def _(spark, d):
    return L.localised_links(T.read_pages(spark, d))


@query(
    "typed_site_urls",
    f"""WITH t AS (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN {D.host('url')}
             WHEN 2 THEN 'ftp://' || {D.host('url')} ELSE url END AS typed FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'https://' || typed WHEN 2 THEN NULL
           ELSE regexp_replace(trim(typed), '/$', '') END AS site_url FROM t""",
    covers="B8",
)
def _(spark, d):
    n = F.col("page_id") % 4
    typed = (
        F.when(n == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
        .when(n == 1, U.host_of("url"))
        .when(n == 2, F.concat(F.lit("ftp://"), U.host_of("url")))
        .otherwise(F.col("url"))
    )
    return T.table(spark, d, "pages").select("page_id", U.normalise_site_url(typed).alias("site_url"))


@query(
    "route_names",
    f"""WITH {D.PG} SELECT page_id,
      lower(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '[^A-Za-z]+', '', 'g'),
            '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS route,
      coalesce(nullif(substr(regexp_replace(regexp_replace(ltrim(path, '/'), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), ''), 'x') AS doc_id,
      trim(path, '/') AS trimmed FROM pg""",
    covers="B9",
)
def _(spark, d):
    name = F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)", 1), "[^A-Za-z]+", "")
    return T.read_pages(spark, d).select(
        "page_id",
        U.kebab(name).alias("route"),
        U.id_safe(U.trim_slashes("path")).alias("doc_id"),
        U.trim_slashes("path").alias("trimmed"),
    )


@query(
    "url_variants",
    f"""WITH {D.PG}, n AS (SELECT site, {D.norm_path('path')} AS path, url, min(page_id) AS page_id FROM pg GROUP BY ALL),
    v AS (SELECT site, path, count(*) AS variants FROM n GROUP BY ALL HAVING count(*) > 1)
    SELECT site, path, url, page_id, variants FROM n JOIN v USING (site, path)""",
    covers="B11",
)
def _(spark, d):
    return L.url_variants(T.read_pages(spark, d))


@query(
    "page_links",
    f"""WITH {HREFS} SELECT site, page_id, url, {D.canon_rel('href', 'url')} AS link, min(pos)::INT AS pos
    FROM hr GROUP BY ALL""",
    covers="C8",
)
def _(spark, d):
    return L.page_links(T.read_pages(spark, d))
