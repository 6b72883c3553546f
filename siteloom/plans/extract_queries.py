"""Extraction queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import elements as E
from siteloom.operators import extract as X
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans.registry import query
from siteloom.sources import tables as T

RICH = f"""{D.PG.replace('pg AS', 'pg0 AS')},
pg AS (SELECT site, page_id, url, path, http_status, {V.RICH_HTML} AS html FROM pg0)"""


def records(spark, d):
    return X.page_records(T.read_pages(spark, d))


@query("page_titles", f"WITH {D.PX} SELECT site, page_id, title FROM px", covers="C2")
def _(spark, d):
    return X.page_titles(records(spark, d))


@query(
    "builder_titles",
    f"""WITH {RICH} SELECT site, page_id,
      CASE WHEN page_id % 5 = 2 THEN 'Seo ' || page_id
           ELSE nullif(trim({D.ents("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') END AS title,
      CASE WHEN page_id % 5 = 2 THEN 'D' || page_id
           WHEN page_id % 3 = 0 THEN 'About page ' || page_id || ' & more' END AS description FROM pg""",
    covers="C2 C3 C13",
)
def _(spark, d):
    return X.page_records(V.rich_pages(spark, d)).select("site", "page_id", "title", "description")


@query(
    "page_meta",
    f"""WITH {RICH}, o AS (SELECT *, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} AS origin FROM pg)
    SELECT site, page_id, CASE WHEN page_id % 3 = 0 THEN 'About page ' || page_id || ' & more' END AS description,
      CASE WHEN page_id % 4 = 0 THEN origin || '/img/og-' || (page_id % 5) || '.png' END AS og_image,
      CASE WHEN page_id % 5 = 0 THEN origin || '/c/' || page_id || '?amp;k=1' END AS canonical FROM o""",
    covers="C3",
)
def _(spark, d):
    return X.page_meta(V.rich_pages(spark, d))


@query(
    "page_headings",
    f"""WITH {D.PX} SELECT site, page_id, (generate_subscripts(headings, 1) - 1)::INT AS ord, unnest(headings) AS heading FROM px""",
    covers="C4",
)
def _(spark, d):
    return X.page_headings(records(spark, d))


_SECS = "SELECT site, page_id, (generate_subscripts(secs, 1) - 1)::INT AS ord, unnest(secs) AS s FROM px"


@query(
    "page_sections",
    f"""WITH {D.PX}, x AS ({_SECS}) SELECT site, page_id, ord, s.kind AS kind, s.text AS text,
    length(s.text)::BIGINT AS full_chars FROM x""",
    covers="C5 C6",
)
def _(spark, d):
    return X.page_section_rows(records(spark, d))


@query(
    "document_kinds",
    f"""WITH {D.DP} SELECT page_id, {D.kind('text', 'text')} AS kind FROM dp""",
    covers="C6",
)
def _(spark, d):
    return T.read_document_pages(spark, d).select("page_id", X.section_kind(F.col("text"), F.col("text")).alias("kind"))


@query(
    "page_images",
    f"""WITH {RICH}, o AS (SELECT *, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} AS origin FROM pg)
    SELECT site, page_id, 0::INT AS ord, origin || '/img/logo-' || (page_id % 3) || '.png' AS src, 'Logo' AS alt,
      NULL::DOUBLE AS width, NULL::DOUBLE AS height FROM o
    UNION ALL
    SELECT site, page_id, 1, origin || '/img/' || (page_id % 9) || '.jpg',
      CASE WHEN page_id % 2 = 0 THEN 'Photo ' || (page_id % 9) ELSE '' END, 640.0, 480.0 + page_id % 10 FROM o""",
    covers="C7",
)
def _(spark, d):
    return X.page_images(V.rich_pages(spark, d))


@query(
    "hidden_emails",
    f"""WITH {D.PG} SELECT site, page_id, t.v AS email
    FROM pg, (VALUES (1, 'info@site.example'), (2, 'sales@site.example'), (2, 'hello@site.example')) t(k, v)
    WHERE k = page_id % 4""",
    covers="C1",
)
def _(spark, d):
    return X.hidden_emails(V.rich_pages(spark, d))


@query(
    "document_entities",
    f"WITH {D.DE} SELECT site, page_id, kind, value FROM de",
    covers="C10",
)
def _(spark, d):
    docs = T.read_document_pages(spark, d).select("site", "page_id", "text")
    return X.entity_rows(docs)


@query("contact_entities", f"WITH {D.RE} SELECT site, page_id, kind, value FROM de", covers="C10")
def _(spark, d):
    docs = V.rich_documents(spark, d).select("site", "page_id", "text")
    return X.entity_rows(docs)


@query(
    "page_entities",
    f"""WITH {D.RX}, ee AS (SELECT site, page_id, 'phones' AS kind, unnest(regexp_extract_all(corpus, '{D.PHONE}')) AS value FROM rc
        UNION ALL SELECT site, page_id, 'emails', unnest(regexp_extract_all(corpus, '{D.EMAIL}')) FROM rc UNION ALL SELECT site, page_id, 'addresses', unnest(regexp_extract_all(corpus, '{D.ADDRESS}')) FROM rc
        UNION ALL SELECT site, page_id, 'prices', unnest(regexp_extract_all(corpus, '{D.PRICE}')) FROM rc
        UNION ALL SELECT site, page_id, 'emails', unnest(CASE page_id % 4 WHEN 1 THEN ['info@site.example'] WHEN 2 THEN ['sales@site.example', 'hello@site.example'] ELSE [] END) FROM rc)
    SELECT DISTINCT site, page_id, kind, trim(value) AS value FROM ee WHERE trim(value) <> ''""",
    covers="C10",
)
def _(spark, d):
    return X.page_entities(X.page_records(V.rich_pages(spark, d)))


@query(
    "content_hashes",
    f"WITH {D.PX} SELECT site, page_id, substr(sha256(corpus), 1, 32) AS content_hash FROM pc",
    covers="C11 D10",
)
def _(spark, d):
    return X.content_hashes(records(spark, d))


@query(
    "sanitised_html",
    f"""WITH {RICH} SELECT site, page_id,
      length(CASE WHEN page_id % 5 = 2 THEN replace(replace(html, ',"ipAddress":"10.0.0.' || (page_id % 200) || '"', ''), '"apiUrl":"http://x",', '') ELSE html END)::BIGINT AS chars,
      false AS leaks FROM pg""",
    covers="C12",
)
def _(spark, d):
    clean = X.sanitise_html(V.rich_pages(spark, d))
    return clean.select(
        "site", "page_id", F.length("html").cast("long").alias("chars"),
        F.col("html").rlike("ipAddress|apiUrl").alias("leaks"),
    )


@query(
    "embedded_blocks",
    f"""WITH {D.PG} SELECT site, page_id, k.ord::INT AS ord, k.kind AS kind,
      CASE k.ord WHEN 0 THEN 'Site ' || page_id || ' Opening hours and prices for every day'
                 ELSE 'Work [{{"t":"A' || (page_id % 8) || '"}}]' END AS text
    FROM pg, (VALUES (0, 'hero'), (1, 'cardGrid')) k(ord, kind) WHERE page_id % 5 = 2""",
    covers="C13",
)
def _(spark, d):
    return X.embedded_blocks(V.rich_pages(spark, d))


@query(
    "embedded_site",
    f"""WITH {D.PG} SELECT site, page_id, 'Seo ' || page_id AS seo_title, 'D' || page_id AS seo_description,
      '#112233' AS colors, 'Inter' AS fonts, 'Biz ' || (page_id % 6) AS brand_name FROM pg WHERE page_id % 5 = 2""",
    covers="C13",
)
def _(spark, d):
    out = X.embedded_site(V.rich_pages(spark, d))
    return out.withColumns({"colors": F.array_join("colors", "|"), "fonts": F.array_join("fonts", "|")})


_HITS = f"""{D.PG}, ph AS (
    SELECT site, page_id,
      CASE WHEN page_id % 6 = 1 THEN 'wordpress' WHEN page_id % 10 = 2 THEN 'squarespace' ELSE 'static' END AS platform,
      CASE WHEN page_id % 6 = 1 OR page_id % 10 = 2 THEN 2 ELSE 0 END::BIGINT AS hits,
      round(CASE WHEN page_id % 6 = 1 THEN 0.55 + 0.4 * 2 / 3 WHEN page_id % 10 = 2 THEN 0.95 ELSE 0.6 END, 6)::DOUBLE AS confidence
    FROM pg)"""


@query("platform_hits", f"WITH {_HITS} SELECT * FROM ph", covers="C14")
def _(spark, d):
    return X.platform_hits(V.rich_pages(spark, d))


@query(
    "site_platform",
    f"""WITH {_HITS}, c AS (SELECT site, arg_min(platform, page_id) AS platform, arg_min(confidence, page_id) AS confidence
      FROM ph WHERE platform <> 'static' GROUP BY site)
    SELECT s.site, coalesce(c.platform, 'static') AS platform, coalesce(c.confidence, 0.6)::DOUBLE AS confidence
    FROM (SELECT DISTINCT site FROM ph) s LEFT JOIN c USING (site)""",
    covers="C15",
)
def _(spark, d):
    return X.site_platform(X.platform_hits(V.rich_pages(spark, d)))


@query(
    "site_brand",
    f"""WITH {D.PG}, f AS (SELECT site, min(page_id) AS page_id FROM pg GROUP BY site),
    o AS (SELECT f.site, f.page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} AS origin
          FROM f JOIN pg USING (page_id))
    SELECT site, CASE WHEN page_id % 5 = 2 THEN '#112233|' ELSE '' END || '#' || substr(md5('' || (page_id % 7)), 1, 6) || '|#ff0000|#abc' AS colors,
      CASE WHEN page_id % 5 = 2 THEN 'Inter|' ELSE '' END || 'Lora, serif|inherit' AS fonts,
      origin || '/img/logo-' || (page_id % 3) || '.png' AS logo,
      CASE WHEN page_id % 5 = 2 THEN 'Biz ' || (page_id % 6) END AS brand_name FROM o""",
    covers="C16",
)
def _(spark, d):
    out = X.site_brand(V.rich_pages(spark, d))
    return out.withColumns({"colors": F.array_join("colors", "|"), "fonts": F.array_join("fonts", "|")})


@query(
    "site_stats",
    f"""WITH {D.PX}, w AS (
      SELECT site, count(*) AS pages,
             sum({D.words("array_to_string(list_transform(secs, lambda s: s.text), ' ')")})::BIGINT AS words FROM px GROUP BY site),
    l0 AS (SELECT site, unnest(regexp_extract_all(html, '(?is)<a[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, url FROM pg),
    l AS (SELECT site, count(DISTINCT {D.canon_rel('href', 'url')}) AS links FROM l0 GROUP BY site)
    SELECT site, pages, 0::BIGINT AS images, words, coalesce(links, 0) AS links FROM w LEFT JOIN l USING (site)""",
    covers="C17",
)
def _(spark, d):
    pages = T.read_pages(spark, d)
    return X.site_stats(X.page_records(pages), pages)


_ATOMS = f"""{D.PG}, a0 AS (
  SELECT site, page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pg),
a1 AS (SELECT site, page_id, string_split(art, '<p>') AS parts FROM a0),
a2 AS (SELECT site, page_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS part FROM a1),
a3 AS (SELECT site, page_id, n, CASE WHEN n = 0 THEN 'heading' ELSE 'para' END AS type,
         {D.squash(D.ents("regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g')"))} AS text FROM a2),
atoms AS (SELECT site, page_id, type, text, min(n) AS n FROM a3 WHERE length(text) >= 2
          AND (type = 'para' OR length(text) <= 200) GROUP BY ALL)"""


@query(
    "page_atoms",
    f"""WITH {_ATOMS} SELECT site, page_id, row_number() OVER (PARTITION BY site, page_id ORDER BY n)::INT AS pos, type, text FROM atoms""",
    covers="C0 C20",
)
def _(spark, d):
    from pyspark.sql import Window as W

    atoms = E.page_atoms(T.read_pages(spark, d))
    pos = F.row_number().over(W.partitionBy("site", "page_id").orderBy("ord"))
    return atoms.select("site", "page_id", pos.alias("pos"), "type", "text")


@query(
    "element_counts",
    f"""WITH {D.PG} SELECT site, page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS p,
      len(regexp_extract_all(html, '<h1>'))::BIGINT AS h1, len(regexp_extract_all(html, '<li>'))::BIGINT AS li FROM pg""",
    covers="C0",
)
def _(spark, d):
    el = E.page_elements(T.read_pages(spark, d))
    return el.groupBy("site", "page_id").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("p", "h1", "li")])


@query(
    "inline_runs",
    f"""WITH {D.PG}, li AS (SELECT site, page_id, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS item FROM pg),
    r AS (SELECT site, page_id, {D.esc("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS href, {D.strip('item')} AS text FROM li)
    SELECT site, page_id, href, text, count(*) AS uses FROM r WHERE text <> '' GROUP BY ALL""",
    covers="C21",
)
def _(spark, d):
    items = E.page_elements(T.read_pages(spark, d)).filter("tag = 'li'")
    return E.inline_runs(items).groupBy("site", "page_id", "href", "text").agg(F.count("*").alias("uses"))
