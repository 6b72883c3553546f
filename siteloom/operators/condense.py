"""Condense a site: drop copies, find shared blocks, collect facts, group page shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.extract import corpus
from siteloom.operators.spread import join_per_site, placed_within
from siteloom.session import cut_lineage

SITE_BUDGET = 240_000
MIN_SECTION = 40


def dedupe_pages(pages: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """One page per content hash of a site: shortest path, then smallest path, then page_id.

    Only the keys are reduced (partial aggregation, so a third of all pages may be copies of
    one another); the surviving ids then pick their full rows. Pages without a hash stay.
    """
    path = U.page_path("path", "url") if "url" in pages.columns else F.col("path")
    keys = pages.filter(F.col(hash_col).isNotNull()).select(
        "site", hash_col, F.struct(F.length(path).alias("n"), path.alias("p"), F.col("page_id").alias("id")).alias("k")
    )
    winners = keys.groupBy("site", hash_col).agg(F.min("k").alias("k")).select(
        "site", F.col("k.id").alias("page_id")
    )
    hashed = pages.filter(F.col(hash_col).isNotNull()).join(winners, ["site", "page_id"], "left_semi")
    return hashed.unionByName(pages.filter(F.col(hash_col).isNull()))


def live_pages(pages: DataFrame) -> DataFrame:
    """Status below 400; a missing status counts as 200."""
    return pages.filter(F.coalesce("http_status", F.lit(200)) < 400)


def block_rows(texts: DataFrame, text_col: str = "text", low: int = 40, high: int = 400) -> DataFrame:
    """Distinct line blocks of 40–400 characters per page."""
    lines = texts.select("site", "page_id", F.explode(F.split(text_col, r"\n+")).alias("line"))
    return (
        lines.select("site", "page_id", X.collapse("line").alias("block"))
        .filter(F.length("block").between(low, high))
        .distinct()
    )


def chrome_blocks(texts: DataFrame, ratio: float = 0.7, top: int | None = None, text_col: str = "text") -> DataFrame:
    """Blocks found on at least ceil(ratio·n) of a site's n ≥ 3 pages, or the ``top`` most common of them.

    ``rank`` orders by page count, then block. Counting is keyed by (site, block), so one
    large site spreads over all tasks; a top filter is pushed below its shuffle.
    """
    sizes = texts.groupBy("site").agg(F.countDistinct("page_id").alias("site_pages")).filter("site_pages >= 3")
    counts = block_rows(texts, text_col).groupBy("site", "block").agg(F.count("*").alias("pages"))
    enough = F.col("pages") >= F.ceil(F.col("site_pages") * F.lit(ratio))
    rank = F.row_number().over(W.partitionBy("site").orderBy(F.desc("pages"), "block"))
    ranked = counts.join(sizes, "site").filter(enough).withColumn("rank", rank)
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("site", "block", "pages", "rank")


def _splice_first(text: Column, block: Column) -> Column:
    at = F.instr(text, block)
    cut = F.concat(
        F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(block), F.length(text))
    )
    return F.when(at > 0, X.collapse(cut)).otherwise(text)


def strip_chrome(sections: DataFrame, chrome: DataFrame, cap: int | None = None) -> DataFrame:
    """Collapse, remove the first use of every chrome block, drop empties; cut first where ``cap`` is given.

    ``sections``: (site, page_id, ord, kind, text). A block is on a fixed
    share of a site's pages, so at most 1 / share times the blocks of one page make up its list.
    """
    lists = chrome.groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]).alias("_blocks")
    )
    text = X.collapse("text") if cap is None else F.substring(X.collapse("text"), 1, cap)
    short = sections.withColumn("text", text).filter("text <> ''")
    cleaned = join_per_site(short, lists, "page_id", "left").withColumn(
        "text",
        F.when(F.col("_blocks").isNull(), F.col("text")).otherwise(F.aggregate("_blocks", F.col("text"), _splice_first)),
    )
    return cleaned.filter("text <> ''").drop("_blocks")


def condensed_sections(records: DataFrame) -> DataFrame:
    """Section rows of pages; a page without sections contributes its joined headings."""
    joined = F.trim(F.array_join("headings", " "))
    fallback = F.when(joined != "", F.array(F.struct(F.lit("prose").alias("kind"), joined.alias("text"))))
    rows = F.when(F.size("sections") > 0, F.col("sections")).otherwise(fallback)
    return records.select("site", "page_id", F.posexplode(rows).alias("ord", "s")).select(
        "site", "page_id", "ord", "s.kind", "s.text"
    )


def site_facts(entities: DataFrame) -> DataFrame:
    """Per (site, kind, value): number of distinct pages and the first of them.

    Ordered use: pages descending, then value. ``fact_pages`` lists the pages themselves.
    """
    per_page = entities.select("site", "kind", F.trim("value").alias("value"), "page_id").filter("value <> ''").distinct()
    return per_page.groupBy("site", "kind", "value").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("first_page")
    )


def fact_pages(entities: DataFrame) -> DataFrame:
    """(site, kind, value, page_id) rows; long, because one value may be on every page."""
    return entities.select("site", "kind", F.trim("value").alias("value"), "page_id").filter("value <> ''").distinct()


def shape_signatures(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Ordered list of section kinds of every page, with its path prefix."""
    kinds = sections.groupBy("site", "page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda s: s["kind"]).alias("signature")
    )
    return pages.select("site", "page_id", U.path_prefix(U.page_path("path", "url")).alias("prefix")).join(
        kinds, ["site", "page_id"], "left"
    ).withColumn("signature", F.coalesce("signature", F.expr("cast(array() as array<string>)")))


def signature_distance(a: Column, b: Column, kinds: list[str]) -> Column:
    """Edit distance of two kind lists; a length gap above 1 is returned as it is.

    Every kind becomes one character, so the built-in ``levenshtein`` applies.
    """
    letters = F.create_map(*[F.lit(v) for i, k in enumerate(kinds) for v in (k, chr(65 + i))])
    code = lambda s: F.array_join(F.transform(s, lambda k: F.coalesce(letters[k], F.lit("~"))), "")
    gap = F.abs(F.size(a) - F.size(b))
    return F.when(gap > 1, gap).otherwise(F.levenshtein(code(a), code(b)))


def near_signatures(distinct: DataFrame) -> DataFrame:
    """(site, prefix, a, b): ordered pairs of distinct signatures one edit apart, named by their first page.

    Two signatures of one length differ in one place if they agree when that place is cut out of both; one is the
    other with a kind added if cutting that place out gives the shorter one. Both are equi-joins on what is
    left after a cut. Only signatures that agree in all other places share a key, so a key holds no more of them than there are kinds.
    """
    s, n = F.col("signature"), F.size("signature")
    key = lambda kinds: F.xxhash64(F.array_join(kinds, "\u0000"), F.size(kinds))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    cut = distinct.select("site", "prefix", F.col("first_page").alias("a"), "signature", F.explode(places).alias("place"))
    cut = cut.withColumn("rest", F.concat(F.slice(s, F.lit(1), F.col("place") - 1), F.slice(s, F.col("place") + 1, n)))
    cut = cut.select("site", "prefix", "a", "place", "rest", key(F.col("rest")).alias("key"))
    other = cut.select("site", "prefix", "place", "key", F.col("rest").alias("other_rest"), F.col("a").alias("b"))
    changed = cut.join(other, ["site", "prefix", "place", "key"]).filter((F.col("a") != F.col("b")) & (F.col("rest") == F.col("other_rest")))
    whole = distinct.select("site", "prefix", key(s).alias("key"), F.col("signature").alias("whole"), F.col("first_page").alias("b"))
    added = cut.join(whole, ["site", "prefix", "key"]).filter(F.col("rest") == F.col("whole")).select("site", "prefix", "a", "b")
    both = added.unionByName(added.select("site", "prefix", F.col("b").alias("a"), F.col("a").alias("b")))
    return changed.select("site", "prefix", "a", "b").unionByName(both).distinct()


def first_come_seeds(edges: DataFrame) -> DataFrame:
    """(site, prefix, b): the nodes of ``edges`` (site, prefix, a, b, both ways) that a smaller seed takes.

    Going through the nodes in order, a node that no seed has taken becomes a seed and takes its neighbours. In rounds: every
    undecided node that is smaller than its undecided neighbours is a seed, its neighbours are taken, and edges of
    decided nodes go. A round is checkpointed; rounds follow the longest run of neighbours in falling order.
    """
    node = ["site", "prefix"]
    open_edges, taken = cut_lineage(edges), None
    while not open_edges.isEmpty():
        seeds = open_edges.groupBy(*node, "a").agg(F.min("b").alias("least")).filter("a < least").select(*node, "a")
        lost = cut_lineage(open_edges.join(seeds, [*node, "a"], "left_semi").select(*node, "b").distinct())
        taken = lost if taken is None else taken.unionByName(lost)
        left = open_edges.join(lost, [*node, "b"], "left_anti").join(lost.withColumnRenamed("b", "a"), [*node, "a"], "left_anti")
        open_edges = cut_lineage(left.select(*node, "a", "b"))
    return edges.select(*node, "b").limit(0) if taken is None else taken


def shape_clusters(signatures: DataFrame, min_pages: int = 3) -> DataFrame:
    """Clusters of pages with one prefix and almost equal signatures, as if gathered page by page in order.

    Pages with equal signatures always share a cluster, so the work is on the distinct signatures of a
    prefix, by first page: a signature that is one edit from no earlier seed is a seed, others go to the earliest
    seed one edit away. Neighbours come from equi-joins, seeds from rounds over the whole table, so a prefix with
    a third of all signatures is spread. Returns (site, prefix, cluster, signature, member_signature); the
    page list is the join ``cluster_pages``.
    """
    node = ["site", "prefix"]
    distinct = cut_lineage(
        signatures.groupBy("site", "prefix", "signature").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
    )
    edges = cut_lineage(near_signatures(distinct))
    taken = first_come_seeds(edges).select(*node, F.col("b").alias("first_page"))
    seeds = distinct.select(*node, F.col("first_page").alias("a")).join(taken.withColumnRenamed("first_page", "a"), [*node, "a"], "left_anti")
    owner = edges.join(seeds, [*node, "a"], "left_semi").groupBy(*node, F.col("b").alias("first_page")).agg(F.min("a").alias("seed"))
    owner = owner.join(taken, [*node, "first_page"], "left_semi")
    members = distinct.join(owner, [*node, "first_page"], "left").withColumn("seed", F.coalesce("seed", "first_page"))
    groups = members.groupBy(*node, "seed").agg(
        F.sum("pages").alias("pages"), F.min(F.struct(F.size("signature").alias("n"), "first_page", "signature"))["signature"].alias("shortest")
    ).filter(F.col("pages") >= min_pages)
    numbered = placed_within(groups.select(*node, "seed", "shortest"), node, ["seed"], "cluster").withColumn("cluster", F.col("cluster") - 1)
    return members.join(numbered, [*node, "seed"]).select(
        *node, "cluster", F.col("shortest").alias("signature"), F.col("signature").alias("member_signature")
    )


def cluster_pages(signatures: DataFrame, clusters: DataFrame) -> DataFrame:
    """(site, prefix, cluster, page_id) membership rows."""
    return signatures.join(
        clusters.select("site", "prefix", "cluster", F.col("member_signature").alias("signature")),
        ["site", "prefix", "signature"],
    ).select("site", "prefix", "cluster", "page_id")


def fit_text_budget(sections: DataFrame, chars: int = SITE_BUDGET, floor: int = MIN_SECTION) -> DataFrame:
    """Cut the longest section texts until a site fits the budget; no page is dropped.

    Water level: lengths are counted per (site, length) first, so the running sum of a site
    goes over its distinct lengths only, however many sections it has. The level L is the
    largest one (never below 40) with sum(min(length, L)) within the budget.
    """
    lengths = sections.select("site", F.length("text").cast("long").alias("len"))
    hist = lengths.groupBy("site", "len").agg(F.count("*").alias("n"))
    up = W.partitionBy("site").orderBy("len").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy("site")
    steps = hist.withColumns(
        {
            "below": F.coalesce(F.sum(F.col("len") * F.col("n")).over(up), F.lit(0)),
            "rest": F.sum("n").over(total) - F.coalesce(F.sum("n").over(up), F.lit(0)),
            "all": F.sum(F.col("len") * F.col("n")).over(total),
        }
    )
    # the first length that no longer fits decides the level
    over = steps.filter(F.col("below") + F.col("len") * F.col("rest") > chars)
    level = over.groupBy("site").agg(
        F.min_by(F.greatest(F.lit(floor).cast("long"), F.floor((F.lit(chars) - F.col("below")) / F.col("rest"))), "len").alias("cap")
    )
    capped = join_per_site(sections, level, "page_id", "left")
    fits = F.when(F.col("cap").isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("cap").cast("int")))
    return capped.withColumn("text", fits).drop("cap")


def page_corpus(records: DataFrame) -> DataFrame:
    """Evidence text and its word count."""
    text = corpus()
    return records.select("site", "page_id", text.alias("corpus")).withColumn("words", X.word_count("corpus"))


def entity_summary(entities: DataFrame) -> DataFrame:
    """Distinct values per kind and site; more than one (prices excepted) is a contradiction."""
    values = entities.select("site", "kind", "value").distinct().groupBy("site", "kind").agg(F.count("*").alias("values"))
    return values.withColumn("contradiction", (F.col("values") > 1) & (F.col("kind") != "prices"))


def page_status_labels(pages: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """'left alone' for errors, 'digging' for the newest page of a running site, else 'extracted'."""
    out = pages.select("site", "page_id", "http_status")
    if running is not None:
        newest = pages.join(running.select("site").distinct(), "site", "left_semi").groupBy("site").agg(
            F.max("page_id").alias("_newest")
        )
        out = out.join(newest, "site", "left")
    else:
        out = out.withColumn("_newest", F.lit(None).cast("long"))
    label = (
        F.when(F.coalesce("http_status", F.lit(200)) >= 400, "left alone")
        .when(F.col("page_id") == F.col("_newest"), "digging")
        .otherwise("extracted")
    )
    return out.select("site", "page_id", label.alias("label"))
