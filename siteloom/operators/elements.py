"""Document-order elements of HTML pages and what the page builder needs from them.

``walked`` is the only Python row code over HTML: tag nesting cannot be expressed
with built-in functions. Everything after it is DataFrame code keyed by page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.functions.text import collapse

# Elements that never carry text.
INVISIBLE = ["script", "style", "noscript", "iframe"]
# Controls and drawings left out of page content.
CONTROLS = ["svg", "template", "button", "select", "input", "textarea"]
# Page furniture, by tag, role, id and class.
CHROME = [
    "header",
    "nav",
    "footer",
    "aside",
    "form",
    "[role=navigation]",
    "[role=banner]",
    "[role=contentinfo]",
    "#main-header",
    "#main-footer",
    "#top-header",
    "#et-top-navigation",
    ".site-header",
    ".site-footer",
    ".menu",
    ".nav",
    ".navbar",
    ".breadcrumb",
    ".woocommerce-breadcrumb",
    ".cookie",
    "#cookie-notice",
    ".screen-reader-text",
    ".skip-link",
]
# Where the main content may sit, best first.
CONTENT_ROOTS = ["main", "[role=main]", "#main-content", "article", ".entry-content", "#content"]

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr b code em font i small span strong sub sup u".split())
_CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
_KEEP = set("h1 h2 h3 h4 p ul ol li blockquote img article section div main body".split())

ELEMENT_SCHEMA = (
    "site string, page_id long, url string, ord int, tag string, parent int, parent_tag string, "
    "own array<string>, outer array<string>, ancestors array<int>, text string, has_h1 boolean, has_form boolean, "
    "src string, alt string, width string, runs array<struct<text:string,href:string>>"
)


class _Walker(HTMLParser):
    """Collects one record per kept element; open elements share the text they contain."""

    def __init__(self, drop: set[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.rows, self.open, self.skip_depth, self.count = drop, [], [], 0, 0

    def _tokens(self, tag: str, attrs: dict) -> list[str]:
        own = [tag]
        if attrs.get("id"):
            own.append("#" + attrs["id"])
        own += ["." + c for c in (attrs.get("class") or "").split()]
        if attrs.get("role"):
            own.append(f"[role={attrs['role']}]")
        return own

    def handle_starttag(self, tag, attrs):
        if self.skip_depth:
            self.skip_depth += tag not in _VOID
            return
        attrs = dict(attrs)
        own = self._tokens(tag, attrs)
        if self.drop.intersection(own):
            self.skip_depth = int(tag not in _VOID)
            return
        if tag in _CLOSES_P:
            self._close("p")
        if tag == "li":
            self._close("li", stop={"ul", "ol"})
        if tag == "br":
            self._add_text(" ", line_break=True)
        for e in self.open:
            e["has_h1"] |= tag == "h1"
            e["has_form"] |= tag == "form"
        element = {
            "tag": tag, "own": own, "attrs": attrs, "ord": self.count, "buf": [], "runs": [],
            "has_h1": tag == "h1", "has_form": tag == "form",
            "parent": self.open[-1]["ord"] if self.open else None,
            "parent_tag": self.open[-1]["tag"] if self.open else None,
            "ancestors": [e["ord"] for e in self.open],
            "outer": sorted({t for e in self.open for t in e["own"]}),
        }
        self.count += 1
        if tag in _KEEP or len(own) > 1:
            self.rows.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip_depth:
            self.skip_depth -= 1
        elif tag in _INLINE:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] == tag:
                    del self.open[i]
                    break
        else:
            self._close(tag)

    def _close(self, tag: str, stop: set[str] = frozenset()):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return
            if self.open[i]["tag"] in stop:
                return

    def _add_text(self, data: str, line_break: bool = False):
        href = next((e["attrs"].get("href") for e in reversed(self.open) if e["tag"] == "a"), None)
        for e in self.open:
            if not line_break:
                e["buf"].append(data)
            if e["tag"] in ("p", "li", "blockquote"):
                e["runs"].append({"text": data, "href": None if line_break else href})

    def handle_data(self, data):
        if not self.skip_depth:
            self._add_text(data)


def walked(html: str | None, drop: Iterable[str]) -> list[dict]:
    """Kept elements of one page in document order."""
    walker = _Walker(set(drop))
    walker.feed(html or "")
    walker.close()
    return walker.rows


def element_text(element: dict) -> str:
    return " ".join("".join(element["buf"]).split())


FRAME_ROWS = 5000


def page_elements(pages: DataFrame, drop: Iterable[str] = tuple(INVISIBLE)) -> DataFrame:
    """Element rows of every page; subtrees matching a ``drop`` selector are left out.

    Rows leave in frames of about ``FRAME_ROWS``, so memory follows the largest page, not a batch of pages.
    """
    drop_set = set(drop)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in _split_schema(ELEMENT_SCHEMA)]

        def frame(rows: list) -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=columns)
            made["parent"] = made["parent"].astype("Int32")
            return made

        for batch in batches:
            out = []
            for site, page_id, url, html in batch.itertuples(index=False):
                for e in walked(html, drop_set):
                    a = e["attrs"]
                    src = a.get("src") or a.get("data-src") or a.get("data-lazy-src")
                    out.append(
                        (site, page_id, url, e["ord"], e["tag"], e["parent"], e["parent_tag"], e["own"], e["outer"],
                         e["ancestors"], element_text(e), e["has_h1"], e["has_form"],
                         src, a.get("alt"), a.get("width"), e["runs"])
                    )
                if len(out) >= FRAME_ROWS:
                    yield frame(out)
                    out = []
            yield frame(out)

    return pages.select("site", "page_id", "url", "html").mapInPandas(walk, ELEMENT_SCHEMA)


def _split_schema(ddl: str) -> list[str]:
    """Top-level column definitions of a DDL string."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return parts + [ddl[start:]]


def has(tokens: str, selectors: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in selectors]))


def content_elements(pages: DataFrame) -> DataFrame:
    """Elements below the page's content root, furniture and controls removed."""
    elements = page_elements(pages, INVISIBLE + CONTROLS + CHROME)
    wanted = [*CONTENT_ROOTS, "body"]
    priority = F.array_min(
        F.filter(
            F.transform(F.col("own"), lambda t: F.array_position(F.array(*[F.lit(r) for r in wanted]), t)),
            lambda p: p > 0,
        )
    )
    by_page = W.partitionBy("site", "page_id")
    ranked = elements.withColumn("_prio", priority).withColumn(
        # the first element of each selector counts, and only with enough text
        "_first", F.row_number().over(W.partitionBy("site", "page_id", "_prio").orderBy("ord"))
    )
    good = F.col("_prio").isNotNull() & (F.col("_first") == 1) & (
        (F.length("text") > 80) | (F.col("_prio") == len(wanted))
    )
    root = F.min(F.when(good, F.struct("_prio", "ord"))).over(by_page)
    rooted = ranked.withColumn("_root", root["ord"])
    return rooted.filter(
        F.col("_root").isNull() | F.array_contains("ancestors", F.col("_root"))
    ).drop("_prio", "_first", "_root")


def inline_runs(elements: DataFrame) -> DataFrame:
    """Link-aware runs: neighbours with the same link merge, the ends are trimmed.

    ``runs`` of p, li and blockquote elements become array<struct<text,href>>.
    """
    local = U.add_localised(
        elements.select("site", "page_id", "url", "ord", F.posexplode_outer("runs").alias("pos", "run")).select(
            "*", F.regexp_replace("run.text", r"\s+", " ").alias("text"), F.col("run.href").alias("raw_href")
        ),
        "raw_href",
        "url",
        "href",
    ).filter(F.col("text") != "")
    element = W.partitionBy("site", "page_id", "ord").orderBy("pos")
    changed = ~F.col("href").eqNullSafe(F.lag("href").over(element)) | (F.row_number().over(element) == 1)
    grouped = (
        local.withColumn("_change", changed.cast("int"))
        .withColumn("_run", F.sum("_change").over(element))
        .groupBy("site", "page_id", "ord", "_run")
        .agg(
            F.first("href").alias("href"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), ""
            ).alias("text"),
        )
    )
    last = F.max("_run").over(W.partitionBy("site", "page_id", "ord"))
    first = F.min("_run").over(W.partitionBy("site", "page_id", "ord"))
    trimmed = grouped.withColumns({"_last": last, "_first": first}).withColumn(
        "text",
        F.when((F.col("_run") == F.col("_first")) & (F.col("_run") == F.col("_last")), F.trim("text"))
        .when(F.col("_run") == F.col("_first"), F.ltrim("text"))
        .when(F.col("_run") == F.col("_last"), F.rtrim("text"))
        .otherwise(F.col("text")),
    )
    return trimmed.filter(F.col("text") != "").select(
        "site", "page_id", "ord", F.col("_run").cast("int").alias("run"), "text", "href"
    )


def page_atoms(pages: DataFrame, skip_images: DataFrame | None = None) -> DataFrame:
    """Ordered content atoms: heading, para, list, quote, image.

    Nested copies, repeated paragraphs, repeated or tiny images and ``skip_images``
    (site, src) are left out.
    """
    el = content_elements(pages)
    in_list, in_p = has("outer", ["ul", "ol", "blockquote"]), has("outer", ["p"])
    text_tags = F.col("tag").isin("h1", "h2", "h3", "h4", "ul", "ol", "blockquote")
    el = el.filter(
        (F.col("tag") == "img")
        | (F.col("tag") == "li")
        | ((F.col("tag") == "p") & ~in_list)
        | (text_tags & ~in_list & ~in_p)
    )
    # list items belong to their list; nested lists stay inside the outer item
    items = (
        el.filter((F.col("tag") == "li") & F.col("parent_tag").isin("ul", "ol") & (F.col("text") != ""))
        .groupBy("site", "page_id", F.col("parent").alias("ord"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("items"))
    )
    runs_text = collapse(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    base = el.filter(F.col("tag") != "li").join(items, ["site", "page_id", "ord"], "left")
    base = U.add_resolved(base, "src", "url", "_src")
    width = F.expr("try_cast(width as double)")
    base = base.withColumns(
        {
            "type": F.when(F.col("tag").rlike("^h[1-4]$"), "heading")
            .when(F.col("tag") == "p", "para")
            .when(F.col("tag") == "blockquote", "quote")
            .when(F.col("tag") == "img", "image")
            .otherwise("list"),
            "body": F.when(F.col("tag").isin("p", "blockquote"), runs_text)
            .when(F.col("tag").isin("ul", "ol"), F.array_join("items", "\n"))
            .when(F.col("tag") != "img", F.col("text")),
        }
    )
    ok = (
        F.when(F.col("type") == "heading", (F.col("body") != "") & (F.length("body") <= 200))
        .when(F.col("type").isin("para", "quote"), F.length("body") >= 2)
        .when(F.col("type") == "list", F.size("items") > 0)
        .otherwise(
            F.col("_src").isNotNull()
            & ~F.col("src").startswith("data:")
            & ~F.coalesce((width > 0) & (width < 64), F.lit(False))
        )
    )
    kept = base.filter(F.coalesce(ok, F.lit(False)))
    once = W.partitionBy(
        "site", "page_id",
        F.when(F.col("type").isin("para", "quote"), F.lit("text"))
        .when(F.col("type") == "image", F.lit("image"))
        .otherwise(F.concat(F.lit("#"), F.col("ord").cast("string"))),
        F.coalesce("_src", "body"),
    ).orderBy("ord")
    kept = kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    atoms = kept.select(
        "site", "page_id", "ord", "type",
        F.when(F.col("type") == "heading", F.substring("tag", 2, 1).cast("int")).alias("level"),
        F.col("body").alias("text"),
        F.col("_src").alias("src"),
        F.when(F.col("type") == "image", F.nullif(collapse(F.coalesce("alt", F.lit(""))), F.lit(""))).alias("alt"),
        (F.col("tag") == "ol").alias("ordered"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
    if skip_images is not None:
        atoms = atoms.join(skip_images.select("site", "src"), ["site", "src"], "left_anti").select(atoms.columns)
    return atoms


def page_sections(atoms: DataFrame) -> DataFrame:
    """Number the sections: a new one starts at every h1 or h2; leading atoms form section 0."""
    by_page = W.partitionBy("site", "page_id").orderBy("ord")
    opens = ((F.col("type") == "heading") & (F.col("level") <= 2)).cast("int")
    numbered = atoms.withColumn("_open", opens).withColumn("section", F.sum("_open").over(by_page).cast("int"))
    head = W.partitionBy("site", "page_id", "section")
    return numbered.withColumns(
        {
            "heading": F.max(F.when(F.col("_open") == 1, F.col("text"))).over(head),
            "heading_level": F.max(F.when(F.col("_open") == 1, F.col("level"))).over(head),
            "is_heading": F.col("_open") == 1,
        }
    ).drop("_open")


def faq_items(sections: DataFrame) -> DataFrame:
    """Question (h3 or h4) with the text atoms below it; questions without an answer go."""
    inside = sections.filter(
        ~F.col("is_heading") & (F.col("type") != "image") & F.col("heading").rlike("(?i)faq|frequently asked")
    )
    by_section = W.partitionBy("site", "page_id", "section").orderBy("ord")
    is_q = (F.col("type") == "heading") & (F.col("level") >= 3)
    numbered = inside.withColumn("item", F.sum(is_q.cast("int")).over(by_section).cast("int")).filter("item > 0")
    return (
        numbered.groupBy("site", "page_id", "section", "item")
        .agg(
            F.max(F.when(is_q, F.col("text"))).alias("question"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(~is_q, F.struct("ord", "text")))), lambda s: s["text"]
                ),
                "\n\n",
            ).alias("answer"),
        )
        .filter(F.col("answer") != "")
    )


def _at_most(column: Column, limit: int | None, cut) -> Column:
    return column if limit is None else cut(column, limit)


def _text_length(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.length(F.regexp_replace("text", "\n", "")))), F.lit(0))


def section_blocks(
    sections: DataFrame, max_blocks: int | None = None, max_texts: int | None = None, max_gallery: int | None = None,
    heading_chars: int | None = None, lead_chars: int | None = None,
) -> DataFrame:
    """One block per section (two for a hero with more text): hero, faq, gallery, mediaText, richText.

    ``block_text`` is the plain text of the block body. All blocks of a page stay, with all their texts and images, unless
    limits are given: blocks a page, texts a section, images a gallery, characters of a hero's heading and lead.
    """
    first_chars = lambda column, n: F.substring(column, 1, n)
    body = ~F.col("is_heading")
    is_img, is_para = F.col("type") == "image", F.col("type") == "para"
    ordered = W.partitionBy("site", "page_id", "section").orderBy("ord")
    marked = sections.withColumn(
        "_para_no", F.sum((body & is_para).cast("int")).over(ordered)
    ).withColumn("_lead", body & is_para & (F.col("_para_no") == 1))
    joined = lambda cond: F.array_join(
        F.transform(
            _at_most(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text")))), max_texts, lambda a, n: F.slice(a, 1, n)),
            lambda s: s["text"],
        ),
        "\n\n",
    )
    faq_heading = F.coalesce(F.col("heading").rlike("(?i)faq|frequently asked"), F.lit(False))
    sized = marked.groupBy("site", "page_id", "section").agg(
        F.first("heading").alias("heading"),
        F.first("heading_level").alias("heading_level"),
        F.count_if(body & is_img).alias("images"),
        F.min(F.when(body & is_img, F.struct("ord", "src", "alt"))).alias("image"),
        F.min(F.when(F.col("_lead"), F.struct("ord", "text")))["text"].alias("lead"),
        _text_length(body & ~is_img).alias("text_len"),
        _text_length(body & ~is_img & ~F.col("_lead")).alias("rest_len"),
        joined(body & ~is_img).alias("full_text"),
        joined(body & ~is_img & ~F.col("_lead")).alias("rest_text"),
        F.max(
            (body & (F.col("type") == "heading") & (F.col("level") >= 3) & faq_heading).cast("int")
        ).alias("_has_q"),
    )
    answered = faq_items(sections).select("site", "page_id", "section").distinct().withColumn("faq", F.lit(True))
    sized = sized.join(answered, ["site", "page_id", "section"], "left")
    # section 0 exists only when atoms precede the first heading, so the first two sections may be 0/1 or 1/2
    index = F.row_number().over(W.partitionBy("site", "page_id").orderBy("section")) - 1
    leading_zero = F.min("section").over(W.partitionBy("site", "page_id"))
    sized = sized.withColumns({"_index": index, "_zero": leading_zero})
    hero = (F.col("heading_level") == 1) & (F.col("_index") <= 1)
    kind = (
        F.when(hero, "hero")
        .when(F.coalesce("faq", F.lit(False)), "faq")
        .when((F.col("images") >= 3) & (F.col("text_len") < 200), "gallery")
        .when((F.col("images") >= 1) & (F.col("text_len") > 0), "mediaText")
        .when((F.col("text_len") > 0) | F.col("heading").isNotNull(), "richText")
    )
    typed = sized.withColumn("type", kind).filter(F.col("type").isNotNull())
    side_no = F.sum((F.col("type") == "mediaText").cast("int")).over(
        W.partitionBy("site", "page_id").orderBy("section")
    )
    typed = typed.withColumn("image_side", F.when(F.col("type") == "mediaText", F.when(side_no % 2 == 1, "right").otherwise("left")))
    first = F.struct(
        F.lit(0).alias("part"),
        F.col("type"),
        F.when(hero, _at_most(F.col("heading"), heading_chars, first_chars)).otherwise(F.col("heading")).alias("heading"),
        F.when(hero, _at_most(F.col("lead"), lead_chars, first_chars)).when(F.col("type") == "gallery", "").otherwise(F.col("full_text")).alias("block_text"),
    )
    rest = F.struct(
        F.lit(1).alias("part"), F.lit("richText").alias("type"), F.lit(None).cast("string").alias("heading"),
        F.col("rest_text").alias("block_text"),
    )
    blocks = F.when(hero & (F.col("rest_len") > 0), F.array(first, rest)).otherwise(F.array(first))
    flat = typed.withColumn("b", F.explode(blocks)).select(
        "site", "page_id", "section", "b.part", "b.type", "b.heading", "b.block_text",
        F.when((F.col("b.part") == 0) & F.col("b.type").isin("hero", "mediaText"), F.col("image.src")).alias("image_src"),
        F.when((F.col("b.part") == 0) & F.col("b.type").isin("hero", "mediaText"), F.col("image.alt")).alias("image_alt"),
        F.when(F.col("b.type") == "gallery", _at_most(F.col("images"), max_gallery, lambda c, n: F.least(c, F.lit(n)))).alias("gallery_images"),
        F.when(F.col("b.part") == 0, F.col("image_side")).alias("image_side"),
    )
    nth = F.row_number().over(W.partitionBy("site", "page_id").orderBy("section", "part"))
    placed = flat.withColumn("block_no", nth)
    return placed if max_blocks is None else placed.filter(F.col("block_no") <= max_blocks)


def rich_text(sections: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Block rows of the text atoms: style, list marker, text; the first ``max_rows`` per section where given."""
    body = sections.filter(F.col("type") != "image")
    style = (
        F.when((F.col("type") == "heading") & (F.col("level") <= 2), "h2")
        .when((F.col("type") == "heading") & (F.col("level") == 3), "h3")
        .when(F.col("type") == "heading", "h4")
        .when(F.col("type") == "quote", "blockquote")
        .otherwise("normal")
    )
    lines = F.when(F.col("type") == "list", F.col("items")).otherwise(F.array("text"))
    rows = body.select(
        "site", "page_id", "section", "ord", "is_heading",
        style.alias("style"),
        F.when(F.col("type") == "list", F.when(F.col("ordered"), "number").otherwise("bullet")).alias("list_item"),
        F.posexplode(lines).alias("item", "text"),
    )
    nth = F.row_number().over(W.partitionBy("site", "page_id", "section").orderBy("ord", "item"))
    placed = rows.withColumn("block", nth).drop("ord", "item")
    return placed if max_rows is None else placed.filter(F.col("block") <= max_rows)
