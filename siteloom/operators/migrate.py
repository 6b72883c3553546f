"""Migration plan: pages → target documents, redirects, settings.

Everything is keyed by (site, path) or (site, page_id); a site with most of the pages is as
spread out as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.condense import live_pages

# Standard section blocks of the target site.
STANDARD_BLOCKS = [
    "hero", "richText", "mediaText", "cardGrid", "gallery", "testimonial", "faq", "cta", "contactBlock",
    "logoStrip", "stats", "embed",
]
# Names a block match may use; names a collection may not take.
BLOCK_MATCH_NAMES = [*STANDARD_BLOCKS, "link"]
RESERVED_TYPES = [*BLOCK_MATCH_NAMES, "page", "siteSettings", "redirect", "testimonialDoc"]
# Keywords of answers, the first rule that applies decides.
ANSWER_RULES = {
    "clarify": r"(?i)none of these|clarify|check with|i['’]ll check|ask the client|not sure",
    "merge": r"(?i)consolidat|merge",
    "drop": r"(?i)remove|kill|drop|delete",
    "keep": r"(?i)\b(keep|authentic|real|intentional)\b",
}
TITLE_SEPARATOR = r"\s+[|–—-]\s+"


def site_names(pages: DataFrame) -> DataFrame:
    """Name shared by the titles of a site: a last or first title part on at least half of them."""
    titled = live_pages(pages).filter(F.coalesce("title", F.lit("")) != "")
    sizes = titled.groupBy("site").agg(F.count("*").alias("n"))
    parts = titled.select("site", "page_id", F.split("title", TITLE_SEPARATOR).alias("p")).filter(F.size("p") >= 2)
    both = F.array(F.element_at("p", -1), F.element_at("p", 1))
    counted = (
        parts.select("site", "page_id", F.posexplode(both).alias("which", "part"))
        .select("site", F.trim("part").alias("name"), F.struct("page_id", "which").alias("at"))
        .filter("name <> ''")
        .groupBy("site", "name")
        .agg(F.count("*").alias("uses"), F.min("at").alias("first"))
    )
    best = counted.groupBy("site").agg(F.min(F.struct((-F.col("uses")).alias("o"), "first", "name", "uses")).alias("b"))
    return (
        best.join(sizes, "site")
        .filter(F.col("b.uses") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))
        .select("site", F.col("b.name").alias("site_name"))
    )


def clean_titles(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``clean_title``: the site name leaves the title; it is also the fallback."""
    joined = pages.join(names, "site", "left")
    title = F.trim(F.coalesce("title", F.lit("")))
    kept = F.filter(F.split(title, TITLE_SEPARATOR), lambda p: F.trim(p) != F.col("site_name"))
    cleaned = F.when(F.col("site_name").isNull(), title).otherwise(F.trim(F.array_join(kept, " – ")))
    return joined.withColumn(
        "clean_title", F.coalesce(F.nullif(cleaned, F.lit("")), F.col("site_name"), F.lit("Untitled"))
    )


def most_common(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Most frequent trimmed value per key, ties alphabetical."""
    counted = values.select(*keys, F.trim(value).alias("v")).filter("v <> ''").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("o"), "v"))["v"].alias(value))


def chrome_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Image sources on at least half of a site's live pages (and on two)."""
    live = live_pages(pages).select("site", "page_id")
    sizes = live.groupBy("site").agg(F.count("*").alias("n"))
    used = (
        images.select("site", "page_id", "src").distinct().join(live, ["site", "page_id"], "left_semi")
        .groupBy("site", "src").agg(F.count("*").alias("pages"))
    )
    return used.join(sizes, "site").filter(
        F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))
    ).select("site", "src", "pages")


def saturation(color: Column) -> Column:
    raw = F.regexp_extract(F.trim(color), "(?i)^#?([0-9a-f]{6}|[0-9a-f]{3})$", 1)
    six = F.when(F.length(raw) == 3, F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("double") / 255
    top, low = F.greatest(part(1), part(3), part(5)), F.least(part(1), part(3), part(5))
    return F.when((raw == "") | (top == 0), F.lit(0.0)).otherwise((top - low) / top)


def brand_picks(brand: DataFrame) -> DataFrame:
    """Primary and secondary colour (saturated first), heading and body font."""
    blank = lambda a: F.filter(F.transform(a, lambda v: F.trim(v)), lambda v: v != "")
    colors = F.array_distinct(blank(F.col("colors")))
    ranked = F.array_sort(
        F.transform(
            colors,
            lambda c, i: F.struct(F.when(saturation(c) > 0.25, 0).otherwise(1).alias("o"), i.alias("i"), c.alias("c")),
        )
    )
    fonts = F.filter(
        blank(F.col("fonts")),
        lambda f: ~f.rlike("(?i)^(inherit|initial|unset|revert|normal)$") & ~f.rlike("(?i)mono|courier|consolas|menlo"),
    )
    out = brand.withColumns({"_ranked": ranked, "_fonts": fonts})
    at = lambda a, i: F.get(a, F.lit(i))
    return out.select(
        "site",
        at("_ranked", 0)["c"].alias("primary_color"),
        at("_ranked", 1)["c"].alias("secondary_color"),
        at("_fonts", 0).alias("font_heading"),
        F.coalesce(at("_fonts", 1), at("_fonts", 0)).alias("font_body"),
        "logo",
    )


def answer_decision(kind: Column, answer: Column) -> Column:
    """drop / merge / keep for a keep-or-kill answer, null when it decides nothing."""
    a = F.trim(answer)
    decides = (a != "") & (kind == "keep-or-kill") & ~a.rlike(ANSWER_RULES["clarify"])
    return F.when(
        decides,
        F.when(a.rlike(ANSWER_RULES["merge"]), "merge")
        .when(a.rlike(ANSWER_RULES["drop"]), "drop")
        .when(a.rlike(ANSWER_RULES["keep"]), "keep"),
    )


def path_decisions(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per (site, path) where it goes and why; a later question (``seq``) overrides.

    Dropped paths go to '/', merged ones to the shortest (then first) path of their question.
    """
    decided = questions.withColumn("decision", answer_decision(F.col("kind"), F.col("answer"))).filter(
        F.col("decision").isin("drop", "merge")
    )
    paths = evidence.select(
        "site", "fingerprint",
        F.when(U.authority_of("url") != "", U.norm_path(U.path_of("url")))
        .when(F.col("url").startswith("/"), U.norm_path("url")).alias("path"),
    ).filter(F.col("path").isNotNull()).distinct()
    survivors = paths.groupBy("site", "fingerprint").agg(
        F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("survivor")
    )
    rows = (
        decided.select("site", "fingerprint", "seq", "decision", F.trim("answer").alias("answer"))
        .join(paths, ["site", "fingerprint"])
        .join(survivors, ["site", "fingerprint"])
    )
    is_drop = F.col("decision") == "drop"
    to = F.when(is_drop, F.when(F.col("path") != "/", "/")).otherwise(
        F.when(F.col("path") != F.col("survivor"), F.col("survivor"))
    )
    quoted = F.concat(F.lit("“"), "answer", F.lit("”"))
    reason = F.when(is_drop, F.concat(F.lit("Dropped: "), quoted)).otherwise(
        F.concat(F.lit("Merged into "), "survivor", F.lit(": "), quoted)
    )
    moved = rows.withColumns({"to_path": to, "reason": reason}).filter(F.col("to_path").isNotNull())
    return moved.groupBy("site", "path").agg(
        F.max(F.struct("seq", "fingerprint", "to_path", "reason")).alias("d")
    ).select("site", "path", "d.to_path", "d.reason")


def collection_pages(types: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages evidencing each kept custom document type; merged types hand theirs to the owner."""
    custom = types.filter(
        ~F.coalesce("decision", F.lit("keep")).isin("drop", "merge")
        & ~F.col("name").isin(*RESERVED_TYPES)
        & (F.coalesce("block_match", F.lit("")) == "")
        & (F.col("kind") == "document")
    ).select("site", F.col("name").alias("type"), "confidence")
    owner = types.select(
        "site", F.col("name").alias("type_name"),
        F.when(F.col("decision") == "merge", F.coalesce("merge_into", "name")).otherwise(F.col("name")).alias("type"),
    )
    pages = evidence.join(owner, ["site", "type_name"]).select("site", "type", "page_id").distinct()
    return pages.join(custom, ["site", "type"])


def assign_targets(pages: DataFrame, collections: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per page: state (mapped / dropped / error), doc_id, type, new path.

    ``pages``: site, page_id, url, path, http_status, title, has_html. URL variants share the
    target of the first live page of their path. Two paths whose document ids would collide
    get a short hash of the path appended.
    """
    p = pages.withColumn("old_path", U.norm_path("path", "url"))
    live = live_pages(p)
    primary = live.groupBy("site", "old_path").agg(F.min(F.struct("page_id", "has_html", "title")).alias("m"))
    best = collections.groupBy("site", "page_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("o"), "type"))["type"].alias("collection")
    )
    todo = primary.join(
        decisions.select("site", F.col("path").alias("old_path"), "to_path", "reason"), ["site", "old_path"], "left"
    ).withColumn("page_id", F.col("m.page_id"))
    trimmed = U.trim_slashes("old_path")
    todo = todo.join(best, ["site", "page_id"], "left").withColumn(
        "collection",
        F.when(F.col("m.has_html") & (F.instr(trimmed, "/") > 0), F.col("collection")),
    )
    slug = F.when(
        F.col("collection").isNotNull(), U.id_safe(F.substring_index(trimmed, "/", -1))
    ).otherwise(F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("home")))
    todo = todo.withColumn("slug", slug).withColumns(
        {
            "type": F.coalesce("collection", F.lit("page")),
            "doc_id": F.when(
                F.col("collection").isNotNull(), F.concat("collection", F.lit("-"), "slug")
            ).otherwise(F.concat(F.lit("page-"), U.id_safe(F.col("slug")))),
            "new_path": F.when(
                F.col("collection").isNotNull(),
                F.concat(F.lit("/"), U.kebab("collection"), F.lit("/"), "slug"),
            ).when(F.col("slug") == "home", "/").otherwise(F.concat(F.lit("/"), "slug")),
        }
    )
    mapped = todo.filter(F.col("to_path").isNull())
    clashes = mapped.groupBy("site", "doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    mapped = mapped.join(clashes, ["site", "doc_id"], "left").select(
        "site", "old_path", "type", "slug",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(
            F.concat("doc_id", F.lit("-"), F.substring(X.short_key("old_path"), 1, 6))
        ).alias("doc_id"),
        F.when(F.col("n").isNull() | (F.col("type") == "page"), F.col("new_path")).otherwise(
            F.concat("new_path", F.lit("-"), F.substring(X.short_key("old_path"), 1, 6))
        ).alias("new_path"),
        F.lit("mapped").alias("state"), F.lit(None).cast("string").alias("reason"),
    )
    dropped = todo.filter(F.col("to_path").isNotNull()).select(
        "site", "old_path", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("slug"),
        F.lit(None).cast("string").alias("doc_id"), F.col("to_path").alias("new_path"), F.lit("dropped").alias("state"), "reason",
    )
    decided = mapped.unionByName(dropped)
    out = live.select("site", "page_id", "old_path").join(decided, ["site", "old_path"])
    broken = p.filter(F.coalesce("http_status", F.lit(200)) >= 400).select(
        "site", "page_id", "old_path", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("slug"),
        F.lit(None).cast("string").alias("doc_id"), F.lit("/").alias("new_path"), F.lit("error").alias("state"),
        F.concat(F.lit("HTTP "), F.col("http_status").cast("string")).alias("reason"),
    )
    return out.unionByName(broken)


def redirect_ledger(targets: DataFrame) -> DataFrame:
    """One row per old path; a mapped page wins over a decision, that over an error."""
    prio = F.when(F.col("state") == "mapped", 0).when(F.col("state") == "dropped", 1).otherwise(2)
    rows = targets.groupBy("site", F.col("old_path").alias("from_path")).agg(
        F.min(F.struct(prio.alias("p"), "page_id", F.col("new_path").alias("to_path"), "reason")).alias("r")
    )
    return rows.select(
        "site", "from_path", "r.to_path", F.when(F.col("r.p") == 0, "mapped").otherwise("dropped").alias("status"), "r.reason"
    )


def redirects(ledger: DataFrame) -> DataFrame:
    """301 rows for every path that moved."""
    return ledger.filter(F.col("from_path") != F.col("to_path")).select(
        "site", F.concat(F.lit("redirect-"), X.short_key("from_path")).alias("doc_id"), "from_path", "to_path",
        F.lit(301).alias("status_code"),
    )


def site_settings(pages: DataFrame, entities: DataFrame, brand: DataFrame | None = None) -> DataFrame:
    """Title, most common phone, e-mail and address of the live pages, and the brand picks."""
    live = live_pages(pages).select("site", "page_id")
    facts = entities.filter(F.col("kind").isin("phones", "emails", "addresses")).join(live, ["site", "page_id"], "left_semi")
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    contact = most_common(facts, ["site", "kind"]).groupBy("site").agg(
        pick("phones").alias("phone"), pick("emails").alias("email"), pick("addresses").alias("address")
    )
    out = pages.select("site").distinct().join(site_names(pages), "site", "left").join(contact, "site", "left")
    out = out.withColumnRenamed("site_name", "site_title")
    return out.join(brand_picks(brand), "site", "left") if brand is not None else out


def contact_blocks(targets: DataFrame) -> DataFrame:
    """Extra contact block of page documents on contact paths."""
    return targets.filter(
        (F.col("state") == "mapped") & (F.col("type") == "page") & F.col("slug").rlike("(?i)(^|/)contact")
    ).select("site", "doc_id", F.lit("contactBlock").alias("type"), X.short_key(F.col("doc_id"), F.lit("contact")).alias("key")).distinct()


def fill_fields(
    docs: DataFrame, fields: DataFrame, summaries: DataFrame,
    paragraphs: int | None = None, chars: int | None = None, string_chars: int | None = None,
) -> DataFrame:
    """Field values of collection documents by field type and name, long form.

    ``docs``: site, page_id, doc_id, type, slug, url; ``fields``: site, type_name, field_name,
    field_type, of; ``summaries``: site, page_id, title, paragraphs, images, and the first
    phone, email, address and price. Fields that nothing fits stay empty. Running text is every paragraph, or
    the first ``paragraphs`` and ``chars`` characters (``string_chars`` in fields of type string) where given.
    """
    wide = docs.join(fields.withColumnRenamed("type_name", "type"), ["site", "type"]).join(
        summaries, ["site", "page_id"], "left"
    )
    name = F.lower("field_name")
    some = lambda text, n: text if n is None else F.substring(text, 1, n)
    summary = some(F.array_join("paragraphs" if paragraphs is None else F.slice("paragraphs", 1, paragraphs), " "), chars)
    body = F.array_join("paragraphs", "\n\n")
    text = (
        F.when(name.rlike("^(title|name|heading|label)$"), F.col("title"))
        .when(name.rlike("price|cost"), F.col("price"))
        .when(name.rlike("phone|tel"), F.col("phone"))
        .when(name.rlike("email"), F.col("email"))
        .when(name.rlike("address|location"), F.col("address"))
        .when(
            name.rlike("desc|summary|excerpt|intro|body|content|detail|about|text"),
            F.when(F.col("field_type") == "string", some(summary, string_chars)).otherwise(summary),
        )
    )
    number = F.expr("try_cast(regexp_replace(price, '[^0-9.]', '') as double)")
    of = F.coalesce("of", F.expr("cast(array() as array<string>)"))
    kind = F.col("field_type")
    value = (
        F.when(kind == "slug", F.col("slug"))
        .when(kind.isin("string", "text"), text)
        .when((kind == "number") & name.rlike("price|cost|amount"), F.when(number > 0, number.cast("string")))
        .when((kind == "url") & name.rlike("url|link|website"), F.col("url"))
        .when(kind == "image", F.get("images", F.lit(0)))
        .when(kind == "portableText", body)
        .when((kind == "array") & F.array_contains(of, "image"), F.array_join("images", "|"))
        .when((kind == "array") & F.array_contains(of, "block"), body)
    )
    return wide.select("site", "doc_id", "field_name", F.nullif(value, F.lit("")).alias("value")).filter(
        F.col("value").isNotNull()
    )


def page_summaries(titles: DataFrame, atoms: DataFrame, texts: DataFrame) -> DataFrame:
    """Per page: clean title, paragraphs over 20 characters, images, first entity of each kind."""
    ordered = lambda cond, col: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("ord", F.col(col).alias("v"))))), lambda s: s["v"]
    )
    parts = atoms.groupBy("site", "page_id").agg(
        ordered((F.col("type") == "para") & (F.length("text") > 20), "text").alias("paragraphs"),
        ordered(F.col("type") == "image", "src").alias("images"),
    )
    first = lambda p: F.get(X.find_all("text", p), F.lit(0))
    ents = texts.select(
        "site", "page_id", first(X.PHONE).alias("phone"), first(X.EMAIL).alias("email"),
        first(X.ADDRESS).alias("address"), first(X.PRICE).alias("price"),
    )
    return titles.select("site", "page_id", F.col("clean_title").alias("title")).join(
        parts, ["site", "page_id"], "left"
    ).join(ents, ["site", "page_id"], "left")


def image_sources(uses: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct image URLs the documents of a site use, in document order; the first ``cap`` where given."""
    first = uses.groupBy("site", "src").agg(F.min(F.struct("doc_id", "ord")).alias("at"))
    nth = F.row_number().over(W.partitionBy("site").orderBy("at", "src"))
    placed = first.withColumn("n", nth)
    return (placed if cap is None else placed.filter(F.col("n") <= cap)).select("site", "src", "n")


def resolve_images(uses: DataFrame, assets: DataFrame) -> DataFrame:
    """Swap image URLs for asset ids; images without an asset go."""
    return uses.join(assets.select("site", "src", "asset_id"), ["site", "src"]).drop("src")


def write_back_targets(pages: DataFrame, targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """page.target: the mapped document, else dropped to the ledger's path or '/'."""
    mapped = targets.filter("state = 'mapped'").select("site", "page_id", "doc_id", "type", F.col("new_path").alias("p"))
    gone = ledger.select("site", F.col("from_path").alias("old_path"), F.col("to_path").alias("d"))
    out = pages.select("site", "page_id", U.norm_path("path", "url").alias("old_path"))
    out = out.join(mapped, ["site", "page_id"], "left").join(gone, ["site", "old_path"], "left")
    is_mapped = F.col("doc_id").isNotNull()
    return out.select(
        "site", "page_id", "doc_id", "type",
        F.when(is_mapped, F.col("p")).otherwise(F.coalesce("d", F.lit("/"))).alias("target_path"),
        F.when(is_mapped, "mapped").otherwise("dropped").alias("target_status"),
    )


def ledger_labels(ledger: DataFrame) -> DataFrame:
    same = F.col("from_path") == F.col("to_path")
    label = (
        F.when(F.col("status") == "dropped", F.when(same, "dropped").otherwise("dropped · 301"))
        .when(F.col("status") == "unmapped", "unmapped")
        .otherwise(F.when(same, "kept").otherwise("moved · 301"))
    )
    return ledger.withColumn("label", label)


def ledger_coverage(ledger: DataFrame) -> DataFrame:
    """Accounted and total paths per site, rounded percentage."""
    ok = F.count_if(F.col("status").isin("mapped", "dropped"))
    return ledger.groupBy("site").agg(ok.alias("accounted"), F.count("*").alias("total")).withColumn(
        "pct", F.floor(100 * F.col("accounted") / F.col("total") + 0.5).cast("int")
    )


def resolve_requests(requests: DataFrame, redirect_rows: DataFrame) -> DataFrame:
    """Requests (site, path): 308 without a trailing slash, 301 by a single lookup, else 200.

    The redirect side is joined by key; Spark broadcasts it when its size allows.
    """
    table = redirect_rows.select("site", F.col("from_path").alias("path"), "to_path")
    joined = requests.join(table, ["site", "path"], "left")
    slash = (F.length("path") > 1) & F.col("path").endswith("/")
    moved = F.col("to_path").isNotNull() & (F.col("to_path") != F.col("path"))
    stripped = F.coalesce(F.nullif(F.regexp_replace("path", "/+$", ""), F.lit("")), F.lit("/"))
    return joined.withColumns(
        {
            "status": F.when(slash, 308).when(moved, 301).otherwise(200),
            "location": F.when(slash, stripped).when(moved, F.col("to_path")).otherwise(F.col("path")),
        }
    ).drop("to_path")


def plan_accounting(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents, mapped pages, collection documents and redirects per site."""
    mapped = F.col("state") == "mapped"
    docs = targets.filter(mapped).select("site", "doc_id", "type").distinct().groupBy("site").agg(
        F.count("*").alias("docs"), F.count_if(F.col("type") != "page").alias("collection_docs"),
        F.countDistinct(F.when(F.col("type") != "page", F.col("type"))).alias("collections"),
    )
    pages = targets.groupBy("site").agg(F.count_if(mapped).alias("mapped_pages"))
    moved = redirects(ledger).groupBy("site").agg(F.count("*").alias("redirects"))
    zero = F.lit(0).cast("long")
    out = pages.join(docs, "site", "left").join(moved, "site", "left")
    return out.select(
        "site", "mapped_pages", *[F.coalesce(c, zero).alias(c) for c in ("docs", "collection_docs", "collections", "redirects")]
    )
