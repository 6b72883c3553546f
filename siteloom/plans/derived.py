"""Inputs the supplied tables do not hold, derived from them row by row.

The text below is plain SQL that Spark and DuckDB read alike, so the oracle of a query
starts from the same rows. Every derived table grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import links as L
from siteloom.session import stored
from siteloom.sources import tables as T

# Page HTML with the marks the supplied pages lack: meta tags, colours, a logo, images,
# hidden e-mails and site-builder JSON, spread over the pages by page_id.
RICH_HTML = """
replace(replace(replace(replace(html, '</footer>', ' &copy; 20' || (10 + page_id % 16) || ' Co</footer>'),
 '</head>',
 CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="About page ' || page_id || ' &amp; more">' ELSE '' END ||
 CASE WHEN page_id % 4 = 0 THEN '<meta content="/img/og-' || (page_id % 5) || '.png" property="og:image">' ELSE '' END ||
 CASE WHEN page_id % 5 = 0 THEN '<link rel="canonical" href="/c/' || page_id || '?utm_source=x&amp;k=1#f">' ELSE '' END ||
 CASE WHEN page_id % 6 = 1 THEN '<meta name="generator" content="WordPress 6.' || (page_id % 7) || '"><script src="/wp-content/a.js"></script>' ELSE '' END ||
 CASE WHEN page_id % 10 = 2 THEN '<link rel="preload" href="https://static1.squarespace.com/s.css">' ELSE '' END ||
 '<style>:root{--brand-color: #' || substr(md5('' || (page_id % 7)), 1, 6) || ';--pad:4px} h1{color:#FF0000;background:#ABC;font-family: Lora, serif;} p{color:#ff0000;font-family:inherit}</style></head>'),
 '<article>',
 '<header><a href="/"><img src="/img/logo-' || (page_id % 3) || '.png" alt="Logo"></a></header>' ||
 CASE WHEN page_id % 4 = 1 THEN '<a class="m" data-cfemail="4f262129200f3c263b2a612a372e223f232a">x</a>' ELSE '' END ||
 CASE WHEN page_id % 4 = 2 THEN '<a href="/cdn-cgi/l/email-protection#1063717c756350637964753e7568717d607c75">x</a><a href="/cdn-cgi/l/email-protection#1078757c7c7f50637964753e7568717d607c75">x</a>' ELSE '' END ||
 '<article>'),
 '</article>',
 '<p><img src="/img/' || (page_id % 9) || '.jpg" alt="' || CASE WHEN page_id % 2 = 0 THEN 'Photo ' || (page_id % 9) ELSE '' END || '" width="640" height="48' || (page_id % 10) || '"><img src="data:image/gif;base64,R0" alt="dot"></p></article>' ||
 CASE WHEN page_id % 5 = 2 THEN '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"page":{"blocks":[{"type":"banner","headline":"Site ' || page_id || '","content":"Opening hours and prices for every day"},{"type":"services","headline":"Work","items":[{"t":"A' || (page_id % 8) || '"}]},{"type":"quote"}],"seo":{"title":"Seo ' || page_id || '","description":"D' || page_id || '"}},"website":{"primaryColor":"#112233","fonts":{"head":{"family":"Inter"},"body":{"family":"Inter"}},"Business":{"name":"Biz ' || (page_id % 6) || '"}},"ipAddress":"10.0.0.' || (page_id % 200) || '","nested":[{"apiUrl":"http://x","keep":' || page_id || '}]}}}</script>' ELSE '' END)
"""


# Document text with contact values, spread by doc_id.
RICH_TEXT = """
text || CASE doc_id % 4
  WHEN 0 THEN ' Call (03) 260 15' || (60 + doc_id % 3) || ' or visit 1' || (doc_id % 3) || ' High Street, Level ' || (doc_id % 2) || '. '
  WHEN 1 THEN ' Call 0326015' || (60 + doc_id % 3) || ' now, from $1,2' || (10 + doc_id % 5) || '.50 each'
  WHEN 2 THEN ' Mail Info' || (doc_id % 3) || '@Site.example today'
  ELSE ' Mail info' || (doc_id % 3) || '@site.example or +64 3 555 1' || (100 + doc_id % 2) || ' today' END
"""


def rich_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.read_document_pages(spark, folder)
    return docs.withColumn("doc_id", F.col("page_id")).withColumn("text", F.expr(RICH_TEXT)).drop("doc_id")


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    return T.read_pages(spark, folder).withColumn("html", F.expr(RICH_HTML))


def stored_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction of the enriched pages, done once; signals, contacts, images and targets read what they need of it."""
    from siteloom.operators.extract import page_extract

    return stored(page_extract(rich_pages(spark, folder)), "extract")


def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with ``page_url``, the canonical form of their URL."""
    return U.keep_valid(U.add_canonical(T.read_pages(spark, folder), "url", "url", "page_url"), "page_url")


def related_links(pages: DataFrame) -> DataFrame:
    """Links of the pages' HTML: site, page_id, from_url, to_url, pos.

    The supplied pages link to paths that no page has. Pages of a site that carry one such path are taken to
    treat one subject: its link leads to the next of them, the last one's to the first. A path that one page
    alone carries stays a link without a page.
    """
    links = L.page_links(pages).filter(U.same_site("link", "url")).withColumn("subject", U.norm_path(U.path_of("link")))
    once = links.groupBy("site", "page_id", "subject").agg(F.min(F.struct("pos", "link")).alias("l"))
    rows = once.join(pages.select("site", "page_id", "page_url"), ["site", "page_id"])
    ring = W.partitionBy("site", "subject").orderBy("page_id")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead("page_url").over(ring), F.first("page_url").over(whole))
    alone = F.count("*").over(whole) == 1
    return rows.select("site", "page_id", F.col("page_url").alias("from_url"), F.when(alone, F.col("l.link")).otherwise(after).alias("to_url"), F.col("l.pos").alias("pos"))


# One proposed type per (site, first path segment), names and decisions spread by the first page.
TYPES_SQL = """
SELECT site, CAST(1 AS INT) AS version, seg, m, n,
  CASE WHEN m % 9 = 0 THEN 'hero' WHEN m % 9 = 1 THEN seg || '-page' WHEN m % 9 = 2 THEN 'image' ELSE seg || 'Article' END AS name,
  'Type ' || seg AS title,
  CASE WHEN m % 5 = 0 THEN 'object' ELSE 'document' END AS kind,
  CASE WHEN m % 7 = 0 THEN 'hero' WHEN m % 7 = 1 THEN 'megaBlock' END AS block_match,
  'Seen on ' || n || ' pages' AS rationale,
  CAST(30 + (m * 7) % 65 AS DOUBLE) / 100 AS confidence,
  CASE WHEN m % 11 = 0 THEN 'drop' WHEN m % 11 = 1 THEN 'merge' WHEN m % 11 = 2 THEN NULL ELSE 'keep' END AS decision,
  CASE WHEN m % 11 = 1 THEN 'enArticle' END AS merge_into
FROM (SELECT site, seg, min(page_id) AS m, count(*) AS n
      FROM (SELECT site, page_id, split_part(path, '/', 2) AS seg FROM {pg}) s GROUP BY site, seg) t
"""

# Candidate fields of a type: number, name, type, members, targets, required.
FIELD_ROWS = [
    (0, "title", "string", [], [], True),
    (1, "price", "number", [], [], False),
    (2, "body", "array", ["block", "hero"], [], False),
    (3, "author", "reference", [], ["enArticle"], False),
    (4, "tags", "array", ["string", "ghost"], ["hero", "frArticle"], False),
    (5, "_hidden", "string", [], [], False),
    (6, "summary", "text", [], [], False),
    (7, "photo", "image", [], [], False),
    (8, "slug", "slug", [], [], True),
    (9, "Bad Name", "object", ["line"], [], False),
]


def proposal_types(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TYPES_SQL, pg=T.read_pages(spark, folder).select("site", "page_id", "path"))


def proposal_fields(types: DataFrame) -> DataFrame:
    texts = lambda items: F.array(*[F.lit(i) for i in items]).cast("array<string>")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(n).alias("field_name"), F.lit(t).alias("field_type"), texts(of).alias("of"),
                     texts(to).alias("to"), F.lit(r).alias("required"))
            for i, n, t, of, to, r in FIELD_ROWS
        ]
    )
    picked = types.withColumn("f", F.explode(F.filter(rows, lambda r: (F.col("m") + r["i"]) % 3 != 0)))
    return picked.select(
        "site", "version", F.col("name").alias("type_name"), F.col("f.i").alias("ord"), "f.field_name", "f.field_type", "f.of", "f.to", "f.required",
        ((F.col("m") + F.col("f.i")) % 7).cast("int").alias("evidence_count"), "m",
    )


def proposal_evidence(spark: SparkSession, folder: str, types: DataFrame) -> DataFrame:
    """Every page proves the type of its path segment; a third of the excerpts are wrong."""
    from siteloom.operators.extract import page_records

    rec = page_records(T.read_pages(spark, folder), tree_layouts=False)
    n = F.col("page_id") % 3
    excerpt = F.when(n == 0, F.col("title")).when(n == 1, F.upper("title")).otherwise("")
    pages = rec.select("site", "page_id", "url", F.split_part("path", F.lit("/"), F.lit(2)).alias("seg"), excerpt.alias("excerpt"))
    return pages.join(types.select("site", "version", "seg", F.col("name").alias("type_name")), ["site", "seg"]).drop("seg")


def titled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted pages whose titles mostly end in the site's name."""
    from siteloom.operators.extract import page_records

    rec = page_records(T.read_pages(spark, folder), tree_layouts=False)
    suffix = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit(" | Site "), "site")).otherwise("")
    return rec.withColumn("title", F.concat("title", suffix)).withColumn("has_html", F.col("html") != "")


def stored_titles(spark: SparkSession, folder: str, text: bool = False) -> DataFrame:
    """Titled pages without their HTML, extracted once; with their whole text where ``text`` is asked for."""
    from siteloom.operators.extract import corpus

    kept = ["site", "page_id", "url", "path", "http_status", "title", "has_html", *([corpus().alias("text")] if text else [])]
    return stored(titled_pages(spark, folder).select(*kept), "titles")


def answered(questions: DataFrame) -> DataFrame:
    """Answers picked from the options by the question id; a quarter stays open."""
    digit = F.conv(F.substring("fingerprint", 1, 1), 16, 10).cast("int")
    pick = F.get("options", F.floor(digit / 4).cast("int"))
    return questions.withColumns(
        {"answer": F.when(digit < 12, pick), "answer_note": F.when(digit % 2 == 0, F.lit("as agreed on the phone"))}
    )
