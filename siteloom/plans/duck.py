"""SQL text shared by the oracles (DuckDB dialect): adapters and page extraction as CTEs.

Written independently of the Spark columns; where the supplied data cannot contain a case
(custom schemes, dot segments, …) the oracle leaves it out.
"""

from __future__ import annotations

from siteloom.functions.text import ADDRESS, EMAIL, PHONE, PRICE
from siteloom.plans.derived import RICH_HTML, RICH_TEXT


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1))"


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www[.]', '')"


def path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/')"


def esc(s: str) -> str:
    """Percent-encode every character outside printable ASCII."""
    return (
        f"array_to_string(list_transform(string_split({s}, ''), "
        "lambda ch: CASE WHEN regexp_matches(ch, '[^!-~]') THEN url_encode(ch) ELSE ch END), '')"
    )


TRACK = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid'"


def clean_query(u: str) -> str:
    """'?a=1&b=2' without tracking parameters, or ''."""
    parts = (
        f"list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), "
        f"lambda kv: kv <> '' AND string_split(kv, '=')[1] NOT IN ({TRACK}))"
    )
    return f"CASE WHEN len({parts}) > 0 THEN '?' || array_to_string({parts}, '&') ELSE '' END"


def canon_abs(u: str) -> str:
    """Canonical form of an absolute http(s) URL."""
    return (
        f"(lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || {host(u)} || "
        f"{esc(path(u))} || {clean_query(u)})"
    )


def canon_rel(h: str, b: str) -> str:
    """Canonical form of a root-relative or absolute href on page b."""
    origin = f"lower(regexp_extract({b}, '^([a-zA-Z]+)://', 1)) || '://' || {host(b)}"
    full = f"(CASE WHEN {h} LIKE '/%' THEN {origin} || {h} ELSE {h} END)"
    return canon_abs(full)


def norm_path(p: str) -> str:
    return f"coalesce(nullif(regexp_replace({p}, '/+$', ''), ''), '/')"


def ents(s: str) -> str:
    return (
        f"replace(replace(replace(replace(replace(replace({s}, '&copy;', '©'), '&middot;', '·'), "
        "'&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    )


def squash(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def strip(h: str) -> str:
    """Text of an HTML fragment."""
    bare = (
        f"regexp_replace(regexp_replace(regexp_replace({h}, '(?s)<!--.*?-->', '', 'g'), "
        "'(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
    )
    return squash(ents(f"regexp_replace({bare}, '<[^>]*>', '', 'g')"))


def words(s: str) -> str:
    return f"(CASE WHEN {squash(s)} = '' THEN 0 ELSE len(string_split({squash(s)}, ' ')) END)::BIGINT"


def kind(t: str, h: str) -> str:
    return (
        f"CASE WHEN regexp_matches({t}, '(?i)faq|frequently asked') THEN 'faq' "
        f"WHEN regexp_matches({t}, '(?i)testimonial|what our clients') THEN 'testimonial' "
        f"WHEN regexp_matches({t}, '(?i)contact|get in touch|phone|email') THEN 'contact' "
        f"WHEN regexp_matches({t}, '(?i)hero|welcome|we are') AND contains({h}, '<h1') THEN 'hero' "
        f"WHEN contains({h}, '<form') THEN 'form' ELSE 'prose' END"
    )


def fp(*parts: str) -> str:
    joined = " || chr(0) || ".join(f"({p})::VARCHAR" for p in parts)
    return f"substr(sha256({joined}), 1, 16)"


def key12(*parts: str) -> str:
    joined = " || chr(0) || ".join(f"({p})::VARCHAR" for p in parts)
    return f"substr(sha1({joined}), 1, 12)"


def digest(m: str) -> str:
    return (
        f"count({m})::VARCHAR || '-' || "
        f"sum(('0x' || substr(sha1(({m})::VARCHAR), 1, 12))::BIGINT::DECIMAL(38,0))::DECIMAL(38,0)::VARCHAR"
    )


# pages as the page table
PG = f"""pg AS (
  SELECT {site('url')} AS site, page_id, url, {path('url')} AS path,
         CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS http_status, html
  FROM pages)"""

# extraction: title, headings, sections (article bodies, else whole body)
PX = (
    PG
    + f""",
px0 AS (
  SELECT site, page_id, url, path, http_status,
         nullif(trim({ents("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') AS title,
         list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1),
                     lambda h: {strip('h')}), lambda h: h <> '') AS headings,
         regexp_extract_all(html, '(?is)<article[^>]*>.*?</article>') AS arts, html
  FROM pg),
px1 AS (
  SELECT px0.*, list_filter(list_transform(arts, lambda a: {{'kind': {kind(strip('a'), 'a')}, 'text': {strip('a')}}}),
                            lambda s: length(s.text) >= 40) AS secs
  FROM px0),
px AS (
  SELECT site, page_id, url, path, http_status, title, headings,
         CASE WHEN len(secs) > 0 THEN secs
              WHEN {strip("regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1)")} <> ''
              THEN [{{'kind': 'prose', 'text': {strip("regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1)")}}}]
              ELSE [] END AS secs
  FROM px1),
pc AS (
  SELECT site, page_id, url, path, http_status, title, headings, secs,
         array_to_string(list_concat(CASE WHEN title IS NULL THEN [] ELSE [title] END,
                         list_concat(headings, list_transform(secs, lambda s: s.text))), chr(10)) AS corpus
  FROM px)"""
)

# documents as pages
DP = """dp AS (
  SELECT source AS site, doc_id AS page_id,
         'https://' || source || '.example' ||
           CASE WHEN doc_id % 7 = 0 THEN '/contact' ELSE '/doc/' || doc_id END AS url,
         CASE WHEN doc_id % 7 = 0 THEN '/contact' ELSE '/doc/' || doc_id END AS path,
         CASE WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS http_status, text, lang
  FROM documents)"""

# rich documents (derived.RICH_TEXT) and their entity values
RD = DP.replace(", text, lang", f", {RICH_TEXT} AS text, lang")

def entity_ctes(documents: str) -> str:
    """``de``: distinct trimmed entity values of every page of ``dp``."""
    return (
        documents
        + f""",
de AS (
  SELECT DISTINCT site, page_id, url, path, http_status, kind, trim(v) AS value
  FROM (SELECT dp.*, 'phones' AS kind, unnest(regexp_extract_all(text, '{PHONE}')) AS v FROM dp
        UNION ALL SELECT dp.*, 'emails', unnest(regexp_extract_all(text, '{EMAIL}')) FROM dp
        UNION ALL SELECT dp.*, 'addresses', unnest(regexp_extract_all(text, '{ADDRESS}')) FROM dp
        UNION ALL SELECT dp.*, 'prices', unnest(regexp_extract_all(text, '{PRICE}')) FROM dp)
  WHERE trim(v) <> '')"""
    )


DE = entity_ctes(DP)
RE = entity_ctes(RD)

STAGE = "['start','crawl','model','review','build','apply','publish','live','failed']"
EFFECT = "['extract','infer','ask','plan','cast','release']"

# events as the lifecycle log
HI = f"""hi AS (
  SELECT user_id AS instance, event_id, ts AS tm,
    CASE event_type WHEN 'signup' THEN 'stageEntered' WHEN 'view' THEN 'actionFired'
                    WHEN 'click' THEN 'effectQueued' ELSE 'effectCompleted' END AS kind,
    CASE WHEN event_id % 4 <> 0 THEN 'u' || user_id END AS actor,
    CASE WHEN event_type = 'signup' THEN {STAGE}[(event_id % 9)::INT + 1] END AS stage,
    CASE WHEN event_type = 'view' THEN 'action-' || (event_id % 3) END AS action,
    CASE WHEN event_type = 'view' THEN 'activity-' || (event_id % 5) END AS activity,
    CASE WHEN event_type NOT IN ('signup', 'view') THEN {EFFECT}[(event_id % 6)::INT + 1] END AS effect,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status, value
  FROM events)"""


# rich pages (derived.RICH_HTML) with hidden mail addresses shown, as extraction does
SHOWN_HTML = f"""replace(replace({RICH_HTML},
  '<a class="m" data-cfemail="4f262129200f3c263b2a612a372e223f232a">x</a>', 'info@site.example'),
  '<a href="/cdn-cgi/l/email-protection#1063717c756350637964753e7568717d607c75">x</a><a href="/cdn-cgi/l/email-protection#1078757c7c7f50637964753e7568717d607c75">x</a>', 'sales@site.examplehello@site.example')"""
RICH_PX = PX.replace("pg AS (", "pg0 AS (", 1).replace("px0 AS (", f"pg AS (SELECT site, page_id, url, path, http_status, {SHOWN_HTML} AS html FROM pg0),\npx0 AS (", 1)
# after extraction: builder pages take title and sections from JSON
RX = (
    RICH_PX
    + """,
rx AS (
  SELECT site, page_id, url, path, http_status,
         CASE WHEN page_id % 5 = 2 THEN 'Seo ' || page_id ELSE title END AS title,
         CASE WHEN page_id % 5 = 2 THEN 'D' || page_id
              WHEN page_id % 3 = 0 THEN 'About page ' || page_id || ' & more' END AS description,
         headings,
         CASE WHEN page_id % 5 = 2
              THEN [{'kind': 'hero', 'text': 'Site ' || page_id || ' Opening hours and prices for every day'},
                    {'kind': 'cardGrid', 'text': 'Work [{"t":"A' || (page_id % 8) || '"}]'}]
              ELSE secs END AS secs
  FROM px),
rc AS (
  SELECT rx.*, array_to_string(list_concat(CASE WHEN title IS NULL THEN [] ELSE [title] END,
               list_concat(headings, list_transform(secs, lambda s: s.text))), chr(10)) AS corpus
  FROM rx)"""
)
