"""Page extraction: HTML columns → titles, headings, sections, links, images, entities.

Built-in regex and JSON functions do the work. Only pages whose layout needs the element
tree (main sections, content divs, nested articles) take the ``mapInPandas`` branch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators import elements as E

SECTION = "array<struct<kind:string,text:string>>"

# Site-builder block type → section kind.
BUILDER_KINDS = {
    "banner": "hero",
    "about": "mediaText",
    "services": "cardGrid",
    "quote": "testimonial",
    "image-carousel": "gallery",
    "contact": "contactBlock",
}
BUILDER_JSON = (
    "props struct<pageProps:struct<"
    "page:struct<blocks:array<struct<type:string,headline:string,content:string,items:string>>,"
    "seo:struct<title:string,description:string>>,"
    "website:struct<primaryColor:string,secondaryColor:string,"
    "colorPalette:struct<Palette:struct<colors:array<struct<hex:string,value:string>>>>,"
    "fonts:struct<head:struct<family:string>,body:struct<family:string>>,"
    "Business:struct<name:string>>>>"
)
# Keys removed from stored builder JSON.
PRIVATE_KEYS = ["ipAddress", "captchaKey", "apiUrl"]

# Platform marks in HTML.
PLATFORM_MARKS = {
    "wordpress": ["wp-content/", "wp-json/", "(?i)<meta[^>]+generator[^>]+WordPress"],
    "durable": [r"cdn\.durable\.co", r"durable\.co"],
    "wix": [r"static\.wixstatic\.com", r"wixsite\.com", "(?i)X-Wix-"],
    "squarespace": [r"squarespace\.com", r"static1\.squarespace"],
    "webflow": [r"webflow\.com", "data-wf-page"],
}
# Platform marks in server headers.
HEADER_MARKS = {
    "wordpress": ["(?i)wordpress", r"(?i)wp\s*engine"],
    "durable": ["(?i)durable"],
    "wix": ["(?i)wix"],
    "squarespace": ["(?i)squarespace"],
    "webflow": ["(?i)webflow"],
}

_SCRIPT = r"(?is)<script[^>]*\bid\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"


def section_kind(text: Column, html: Column) -> Column:
    """Ordered rules; the first that applies names the kind."""
    return (
        F.when(text.rlike("(?i)faq|frequently asked"), "faq")
        .when(text.rlike("(?i)testimonial|what our clients"), "testimonial")
        .when(text.rlike("(?i)contact|get in touch|phone|email"), "contact")
        .when(text.rlike("(?i)hero|welcome|we are") & html.contains("<h1"), "hero")
        .when(html.contains("<form"), "form")
        .otherwise("prose")
    )


def builder_data(html: Column) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(html, _SCRIPT, 1), F.lit("")), BUILDER_JSON)["props"]["pageProps"]


def _builder_sections(data: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in BUILDER_KINDS.items() for v in kv])
    rows = F.transform(
        data["page"]["blocks"],
        lambda b: F.struct(
            F.coalesce(names[F.coalesce(b["type"], F.lit("prose"))], b["type"], F.lit("prose")).alias("kind"),
            X.collapse(
                F.concat_ws(
                    "\n",
                    F.nullif(b["headline"], F.lit("")),
                    F.nullif(b["content"], F.lit("")),
                    b["items"],
                )
            ).alias("text"),
        ),
    )
    return F.filter(rows, lambda s: s["text"] != "")


def needs_tree(html: Column) -> Column:
    """Layouts a regex cannot cut: main content, content divs, articles inside articles."""
    before_close = F.substring_index(F.lower(html), "</article", 1)
    openings = F.length(before_close) - F.length(F.replace(before_close, F.lit("<article"), F.lit("<articl")))
    return html.rlike(r"(?i)<main\b|\bclass\s*=\s*[\"'][^\"']*\b(?:entry-)?content\b") | (openings > 1)


def _regex_sections(visible: Column) -> Column:
    articles = F.regexp_extract_all(visible, F.lit(r"(?is)(<article\b[^>]*>.*?</article\s*>)"), F.lit(1))
    typed = F.transform(articles, lambda a: F.struct(X.markup_text(a).alias("text"), a.alias("html")))
    kept = F.filter(typed, lambda s: F.length(s["text"]) >= 40)
    return F.transform(
        kept, lambda s: F.struct(section_kind(s["text"], s["html"]).alias("kind"), s["text"].alias("text"))
    )


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("marker", StringType())])))
def _tree_cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts of the section elements in document order, with what ``section_kind`` looks for in their markup."""

    def is_section(e: dict) -> bool:
        return (
            (e["tag"] == "section" and "main" in e["outer"])
            or e["tag"] == "article"
            or (e["tag"] == "div" and e["parent_tag"] == "main")
            or ".content" in e["own"]
            or ".entry-content" in e["own"]
        )

    def cut(html: str | None) -> list[dict] | None:
        if not isinstance(html, str):
            return None
        found = [(E.element_text(e), e) for e in E.walked(html, E.INVISIBLE) if is_section(e)]
        return [
            {"text": text, "marker": "<h1" * e["has_h1"] + "<form" * e["has_form"]} for text, e in found if len(text) >= 40
        ]

    for batch in batches:
        yield batch.map(cut)


def tree_sections(html: Column) -> Column:
    """Sections of a tree layout; pages of other layouts pass as nulls, so no HTML of theirs travels to Python."""
    cut = _tree_cut(F.when(needs_tree(html), html))
    return F.transform(cut, lambda s: F.struct(section_kind(s["text"], s["marker"]).alias("kind"), s["text"].alias("text")))


def page_records(pages: DataFrame, tree_layouts: bool = True) -> DataFrame:
    """The wide page table: title, meta, headings, sections (whole text), raw html.

    Everything is one projection over the page scan; Spark prunes what a caller does not
    select. ``tree_layouts=False`` skips the element walker for crawls known not to need it.
    A page without HTML (null) stays, with nulls and no sections.
    """
    seen = pages.withColumn("_visible", X.drop_invisible("html"))
    seen = seen.withColumn("_builder", F.when(F.instr("html", "__NEXT_DATA__") > 0, builder_data(F.col("html"))))
    by_regex, none = _regex_sections(F.col("_visible")), F.expr(f"cast(array() as {SECTION})")
    if tree_layouts:
        seen = seen.withColumn("_tree", tree_sections(F.col("html")))
        by_regex = F.when(F.col("_tree").isNull(), by_regex).otherwise(F.col("_tree"))
    seen = seen.withColumn("_cut", F.coalesce(by_regex, none))
    body = X.markup_text(F.regexp_extract("_visible", r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1))
    seen = seen.withColumn("_body", F.when(F.size("_cut") == 0, body))
    h1 = F.get(F.regexp_extract_all("_visible", F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), F.lit(1)), F.lit(0))
    headings = F.filter(
        F.transform(
            F.regexp_extract_all("_visible", F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1)), X.markup_text
        ),
        lambda h: h != "",
    )
    own = F.when(F.size("_cut") > 0, F.col("_cut")).when(
        F.col("_body") != "", F.array(F.struct(F.lit("prose").alias("kind"), F.col("_body").alias("text")))
    ).otherwise(none)
    from_builder = _builder_sections(F.col("_builder"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return seen.select(
        "site", "page_id", "url", "path", "http_status",
        F.coalesce(
            F.nullif(F.col("_builder.page.seo.title"), F.lit("")),
            blank(X.decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))),
            blank(X.markup_text(h1)),
        ).alias("title"),
        F.coalesce(
            F.nullif(F.col("_builder.page.seo.description"), F.lit("")),
            blank(X.decode_entities(meta_content(F.col("html"), "name", "description"))),
        ).alias("description"),
        headings.alias("headings"),
        F.when(F.size(from_builder) > 0, from_builder).otherwise(own).alias("sections"),
        "html",
    )


def meta_content(html: Column, attr: str, value: str) -> Column:
    """``content`` of a meta tag, whichever attribute comes first."""
    one = rf"(?is)<meta\b[^>]*\b{attr}\s*=\s*[\"']{value}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    two = rf"(?is)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\b{attr}\s*=\s*[\"']{value}[\"']"
    return F.coalesce(
        F.nullif(F.regexp_extract(html, one, 1), F.lit("")), F.nullif(F.regexp_extract(html, two, 1), F.lit(""))
    )


def link_href(html: Column, rel: str) -> Column:
    one = rf"(?is)<link\b[^>]*\brel\s*=\s*[\"']{rel}[\"'][^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"
    two = rf"(?is)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*\brel\s*=\s*[\"']{rel}[\"']"
    return F.coalesce(
        F.nullif(F.regexp_extract(html, one, 1), F.lit("")), F.nullif(F.regexp_extract(html, two, 1), F.lit(""))
    )


def page_meta(pages: DataFrame) -> DataFrame:
    """description, og_image and canonical (both resolved) per page."""
    raw = pages.select(
        "site", "page_id", "url",
        F.nullif(F.trim(X.decode_entities(meta_content(F.col("html"), "name", "description"))), F.lit("")).alias("description"),
        F.trim(meta_content(F.col("html"), "property", "og:image")).alias("_og"),
        F.trim(link_href(F.col("html"), "canonical")).alias("_canon"),
    )
    out = U.add_canonical(raw, "_og", "url", "_og_url")
    out = U.add_canonical(out, "_canon", "url", "_canon_url")
    return out.select(
        "site", "page_id", "description",
        F.coalesce("_og_url", "_og").alias("og_image"),
        F.coalesce("_canon_url", "_canon").alias("canonical"),
    )


def corpus(title="title", headings="headings", sections="sections") -> Column:
    """Title, headings and section texts joined by newlines."""
    return F.concat_ws("\n", F.col(title), F.col(headings), F.transform(sections, lambda s: s["text"]))


def page_titles(records: DataFrame) -> DataFrame:
    return records.select("site", "page_id", "title")


def _items(rows: DataFrame, items: str, name: str, *keep: str) -> DataFrame:
    """(site, page_id, ord, ``name``) for each item of an array that is costly to make.

    The outer form makes the array once: for the inner one Spark adds a filter on its size, pushes that below the
    projection and so makes it again, with everything that it is made from.
    """
    return rows.select("site", "page_id", *keep, F.posexplode_outer(items).alias("ord", name)).filter(F.col("ord").isNotNull())


def page_headings(records: DataFrame) -> DataFrame:
    return _items(records, "headings", "heading")


def page_section_rows(records: DataFrame, max_sections: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Section rows with their whole text; the first sections or characters only where limits are given."""
    rows = _items(records, "sections", "s")
    if max_sections is not None:
        rows = rows.filter(F.col("ord") < max_sections)
    text = F.col("s.text") if max_chars is None else F.substring("s.text", 1, max_chars)
    return rows.select("site", "page_id", "ord", "s.kind", text.alias("text"), F.length("s.text").cast("long").alias("full_chars"))


def content_hashes(records: DataFrame) -> DataFrame:
    return records.select("site", "page_id", F.substring(F.sha2(corpus(), 256), 1, 32).alias("content_hash"))


def visible_image_tags(html: str = "html") -> Column:
    return F.regexp_extract_all(X.drop_invisible(html), F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))


def images_without_alt(html: Column) -> Column:
    """Number of image tags with a source (data: apart) whose alt text is missing or blank."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))
    sourced = r"(?is)[\s\"']src\s*=\s*[\"'](?!data:)[^\"']+[\"']"
    described = r"(?is)\balt\s*=\s*[\"'][^\"']*[^\"'\s][^\"']*[\"']"
    return F.size(F.filter(tags, lambda t: t.rlike(sourced) & ~t.rlike(described))).cast("long")


def page_extract(pages: DataFrame) -> DataFrame:
    """What findings, model and plan read of a page: its record with image tags, hidden e-mails and
    the number of undescribed images in place of the HTML.

    Stored once, it feeds ``page_signals``, ``page_entities`` and ``page_images`` without another look at the HTML.
    """
    return page_records(pages).select(
        "site", "page_id", "url", "path", "http_status", "title", "description", "headings", "sections",
        visible_image_tags().alias("image_tags"), images_without_alt(F.col("html")).alias("bad_images"),
        hidden_email_list(F.col("html")).alias("hidden_emails"),
    )


def page_images(pages: DataFrame) -> DataFrame:
    """One row per ``<img src>``: absolute src, alt, numeric width and height; data: skipped.

    ``pages`` has ``html`` or is an extraction that holds the ``image_tags``.
    """
    tags = F.col("image_tags") if "image_tags" in pages.columns else visible_image_tags()
    rows = pages.select("site", "page_id", "url", F.posexplode(tags).alias("ord", "tag"))
    attr = lambda name: F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    has_alt = F.col("tag").rlike(r"(?is)\balt\s*=")
    rows = rows.select(
        "site", "page_id", "url", "ord",
        F.regexp_extract("tag", r"(?is)[\s\"']src\s*=\s*[\"']([^\"']*)[\"']", 1).alias("_raw"),
        F.when(has_alt, X.decode_entities(attr("alt"))).alias("alt"),
        attr("width").alias("_w"),
        attr("height").alias("_h"),
    ).filter((F.col("_raw") != "") & ~F.col("_raw").startswith("data:"))
    out = U.keep_valid(U.add_canonical(rows, "_raw", "url", "src"), "src")
    return out.select(
        "site", "page_id", "ord", "src", "alt",
        F.expr("try_cast(_w as double)").alias("width"), F.expr("try_cast(_h as double)").alias("height"),
    )


def hidden_email_list(html: Column) -> Column:
    """Decoded XOR-hex e-mails of ``data-cfemail`` attributes and protection links, each once."""
    codes = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?i)data-cfemail\s*=\s*[\"']([0-9a-f]+)[\"']"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"'][^\"']*/cdn-cgi/l/email-protection#([0-9a-f]+)[\"']"), F.lit(1)),
    )
    byte = lambda code, i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")

    def decoded(code: Column) -> Column:
        places = F.sequence(F.lit(3), F.greatest(F.length(code) - 1, F.lit(3)), F.lit(2))
        return F.array_join(F.transform(places, lambda i: F.char(byte(code, i).bitwiseXOR(byte(code, F.lit(1))))), "")

    whole = F.filter(F.array_distinct(codes), lambda c: (F.length(c) > 3) & (F.length(c) % 2 == 0))
    marked = html.rlike("(?i)cfemail|email-protection#")
    return F.when(marked, F.array_distinct(F.transform(whole, decoded))).otherwise(F.expr("cast(array() as array<string>)"))


def hidden_emails(pages: DataFrame) -> DataFrame:
    """Hidden e-mails of pages with ``html`` or of an extraction that holds them."""
    found = F.col("hidden_emails") if "hidden_emails" in pages.columns else hidden_email_list(F.col("html"))
    return pages.select("site", "page_id", F.explode(found).alias("email")).distinct()


ENTITY_PATTERNS = {"phones": X.PHONE, "emails": X.EMAIL, "addresses": X.ADDRESS, "prices": X.PRICE}


def entity_rows(texts: DataFrame, text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """Long form of the contact values and prices a page shows: (…, kind, value), distinct per page."""
    wanted = kinds or list(ENTITY_PATTERNS)
    def tagged(kind: str) -> Column:
        return F.transform(
            X.find_all(text_col, ENTITY_PATTERNS[kind]),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")),
        )

    found = F.flatten(F.array(*[tagged(k) for k in wanted]))
    keep = [c for c in texts.columns if c != text_col]
    return texts.select(*keep, F.explode(found).alias("e")).select(*keep, "e.kind", "e.value")


def page_entities(records: DataFrame) -> DataFrame:
    """Entity rows of extracted pages, hidden e-mails merged."""
    shown = entity_rows(records.select("site", "page_id", corpus().alias("text")))
    hidden = hidden_emails(records).select("site", "page_id", F.lit("emails").alias("kind"), F.col("email").alias("value"))
    return shown.unionByName(hidden).distinct()


def embedded_blocks(pages: DataFrame) -> DataFrame:
    """Typed blocks of site-builder JSON as section rows."""
    with_json = pages.filter(F.instr("html", "__NEXT_DATA__") > 0)
    rows = with_json.select("site", "page_id", _builder_sections(builder_data(F.col("html"))).alias("s"))
    return rows.select("site", "page_id", F.posexplode("s").alias("ord", "b")).select(
        "site", "page_id", "ord", "b.kind", "b.text"
    )


def embedded_site(pages: DataFrame) -> DataFrame:
    """SEO text, colours, fonts and brand name of the builder JSON, per page."""
    data = pages.filter(F.instr("html", "__NEXT_DATA__") > 0).select(
        "site", "page_id", builder_data(F.col("html")).alias("d")
    )
    w = F.col("d.website")
    palette = F.transform(
        F.coalesce(w["colorPalette"]["Palette"]["colors"], F.expr("cast(array() as array<struct<hex:string,value:string>>)")),
        lambda c: F.coalesce(c["hex"], c["value"]),
    )
    real = lambda a: F.array_distinct(F.filter(a, lambda v: v.isNotNull() & (v != "")))
    return data.filter(F.size("d.page.blocks") > 0).select(
        "site", "page_id",
        F.col("d.page.seo.title").alias("seo_title"),
        F.col("d.page.seo.description").alias("seo_description"),
        real(F.concat(F.array(w["primaryColor"], w["secondaryColor"]), palette)).alias("colors"),
        real(F.array(w["fonts"]["head"]["family"], w["fonts"]["body"]["family"])).alias("fonts"),
        w["Business"]["name"].alias("brand_name"),
    )


@F.pandas_udf(StringType())
def _scrub_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    private = set(PRIVATE_KEYS)

    def scrub(node):
        if isinstance(node, dict):
            return {k: scrub(v) for k, v in node.items() if k not in private}
        return [scrub(v) for v in node] if isinstance(node, list) else node

    def clean(raw):
        if raw is None:
            return None
        try:
            return json.dumps(scrub(json.loads(raw)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return "{}"

    for batch in batches:
        yield batch.map(clean)


def sanitise_html(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """HTML fit for storing: private keys leave the builder JSON.

    With ``max_bytes`` longer pages are cut to at most that many bytes of UTF-8, behind a marker.

    Only the JSON text travels to Python; pages without it pass a null.
    """
    cut = r"(?is)^(.*?<script[^>]*\bid\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>)(.*?)(</script>.*)$"
    marked = F.when(F.instr("html", "__NEXT_DATA__") > 0, F.col("html"))
    parts = pages.withColumns(
        {
            "_head": F.regexp_extract(marked, cut, 1),
            "_json": F.nullif(F.regexp_extract(marked, cut, 2), F.lit("")),
            "_tail": F.regexp_extract(marked, cut, 3),
        }
    ).withColumn("_clean", _scrub_json("_json"))
    whole = F.when(
        F.col("_head") != "", F.concat("_head", F.coalesce("_clean", F.lit("{}")), "_tail")
    ).otherwise(F.col("html"))
    capped = F.col("_whole")
    if max_bytes is not None:
        size = F.octet_length("_whole")
        # a cut inside a character leaves bytes that decode to one replacement sign
        kept = F.rtrim(F.decode(F.substring(F.encode("_whole", "UTF-8"), 1, max_bytes), "UTF-8"), F.lit("\ufffd"))
        capped = F.when(size > max_bytes, F.concat(F.lit("<!-- truncated: "), size.cast("string"), F.lit(f" bytes → cap {max_bytes} -->\n"), kept)).otherwise(F.col("_whole"))
    return parts.withColumn("_whole", whole).select("site", "page_id", capped.alias("html"))


def platform_hits(
    pages: DataFrame,
    marks: dict[str, list[str]] = PLATFORM_MARKS,
    header_marks: dict[str, list[str]] = HEADER_MARKS,
    server_col: str | None = None,
) -> DataFrame:
    """Best platform per page. The mark list is fixed, so it is a projection and not a join."""
    scores = []
    for order, (name, patterns) in enumerate(marks.items()):
        hits = sum((F.col("html").rlike(p).cast("int") for p in patterns), F.lit(0))
        if server_col:
            server = F.coalesce(server_col, F.lit(""))
            hits = sum((server.rlike(p).cast("int") for p in header_marks.get(name, [])), hits)
        scores.append(
            F.struct((hits / F.lit(float(len(patterns)))).alias("score"), F.lit(-order).alias("order"),
                     F.lit(name).alias("platform"), hits.cast("long").alias("hits"))
        )
    best = F.array_max(F.array(*scores))
    rows = pages.withColumn("_best", best)
    found = F.col("_best.hits") > 0
    static = F.trim("html") != ""
    return rows.select(
        "site", "page_id",
        F.when(found, F.col("_best.platform")).when(static, "static").otherwise("unknown").alias("platform"),
        F.when(found, F.col("_best.hits")).otherwise(F.lit(0).cast("long")).alias("hits"),
        F.round(
            F.when(found, F.least(F.lit(0.97), 0.55 + 0.4 * F.col("_best.score"))).when(static, 0.6).otherwise(0.1), 6
        ).alias("confidence"),
    )


def site_platform(hits: DataFrame) -> DataFrame:
    """First page in crawl order with a known platform wins, else static, else unknown."""
    verdict = F.struct("platform", "confidence")
    cms = ~F.col("platform").isin("static", "unknown")
    folded = hits.groupBy("site").agg(
        F.min_by(F.when(cms, verdict), F.when(cms, F.col("page_id"))).alias("cms"),
        F.bool_or(F.col("platform") == "static").alias("static"),
    )
    return folded.select(
        "site",
        F.when(F.col("cms").isNotNull(), F.col("cms.platform")).when(F.col("static"), "static").otherwise("unknown").alias("platform"),
        F.when(F.col("cms").isNotNull(), F.col("cms.confidence")).when(F.col("static"), 0.6).otherwise(0.1).alias("confidence"),
    )


def site_stats(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages, words in sections, distinct images and links per site.

    Counted as tagged values grouped by value first, so a large site is spread before the
    final group by site sees one row per distinct value.
    """
    from siteloom.operators.links import page_links

    words = X.word_count(F.array_join(F.transform("sections", lambda s: s["text"]), " "))
    page_side = records.groupBy("site").agg(F.count("*").alias("pages"), F.sum(words).alias("words"))
    values = (
        page_links(pages).select("site", F.lit("link").alias("tag"), F.col("link").alias("value"))
        .unionByName(page_images(pages).select("site", F.lit("image").alias("tag"), F.col("src").alias("value")))
        .distinct()
        .groupBy("site")
        .agg(F.count_if(F.col("tag") == "image").alias("images"), F.count_if(F.col("tag") == "link").alias("links"))
    )
    zero = F.lit(0).cast("long")
    return page_side.join(values, "site", "left").select(
        "site", "pages", F.coalesce("images", zero).alias("images"), "words", F.coalesce("links", zero).alias("links")
    )


def site_brand(pages: DataFrame, max_colors: int | None = None, max_fonts: int | None = None) -> DataFrame:
    """Colours, fonts, logo and name from the first page of each site.

    All colours and fonts of its style sheets, most used and first ones first, or the first few where limits are given.
    The style text and logo source are cut out first; the fold keeps one small struct per site.
    """
    styles = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    src = lambda outer: F.nullif(
        F.regexp_extract("html", outer + r"[^>]*?\ssrc\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")
    )
    logo = F.coalesce(
        src(r"(?is)<header\b[^>]*>(?:(?!</header).)*?<img\b"),
        src(r"(?is)class\s*=\s*[\"'][^\"']*\b(?:site-)?logo\b[^\"']*[\"'][^>]*>(?:(?!</div|</a>).)*?<img\b"),
        src(r"(?is)<a\b[^>]*\brel\s*=\s*[\"']home[\"'][^>]*>(?:(?!</a>).)*?<img\b"),
        meta_content(F.col("html"), "property", "og:image"),
        link_href(F.col("html"), "icon"),
        link_href(F.col("html"), "shortcut icon"),
    )
    payload = pages.select(
        "site", "page_id", "url", styles.alias("css"), logo.alias("_logo"),
        F.when(F.instr("html", "__NEXT_DATA__") > 0, F.regexp_extract("html", _SCRIPT, 1)).alias("_json"),
    )
    first = payload.groupBy("site").agg(
        F.min_by(F.struct("page_id", "url", "css", "_logo", "_json"), "page_id").alias("p")
    ).select("site", "p.*")
    first = U.add_resolved(first, "_logo", "url", "_logo_url")
    data = F.from_json("_json", BUILDER_JSON)["props"]["pageProps"]["website"]
    hex_code = r"(#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3,4})\b)"
    uses = F.transform(F.regexp_extract_all("css", F.lit(hex_code), F.lit(1)), F.lower)
    tokens = F.transform(
        F.regexp_extract_all("css", F.lit(r"(?i)--[a-z0-9-]*color[a-z0-9-]*\s*:\s*([^;]+)"), F.lit(1)),
        lambda v: F.lower(F.regexp_extract(v, hex_code, 1)),
    )
    weighed = F.transform(
        F.array_distinct(uses),
        lambda c: F.struct(
            (-(F.size(F.filter(uses, lambda u: u == c)) + 3 * F.size(F.filter(tokens, lambda t: t == c)))).alias("w"),
            F.array_position(uses, c).alias("pos"),
            c.alias("color"),
        ),
    )
    some = lambda a, n: a if n is None else F.slice(a, 1, n)
    ranked = some(F.transform(F.array_sort(weighed), lambda s: s["color"]), max_colors)
    families = F.transform(
        F.regexp_extract_all("css", F.lit(r"(?i)font-family\s*:\s*([^;!}{]+)"), F.lit(1)), lambda f: F.trim(f)
    )
    fonts = some(F.array_distinct(F.filter(families, lambda f: f != "")), max_fonts)
    real = lambda a: F.filter(a, lambda v: v.isNotNull() & (v != ""))
    palette = F.transform(
        F.coalesce(data["colorPalette"]["Palette"]["colors"], F.expr("cast(array() as array<struct<hex:string,value:string>>)")),
        lambda c: F.coalesce(c["hex"], c["value"]),
    )
    return first.select(
        "site",
        F.array_distinct(
            F.concat(real(F.concat(F.array(data["primaryColor"], data["secondaryColor"]), palette)), ranked)
        ).alias("colors"),
        F.array_distinct(
            F.concat(real(F.array(data["fonts"]["head"]["family"], data["fonts"]["body"]["family"])), fonts)
        ).alias("fonts"),
        F.coalesce("_logo_url", "_logo").alias("logo"),
        data["Business"]["name"].alias("brand_name"),
    )
