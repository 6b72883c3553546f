"""Crawl planning over stored tables: fetch kinds, sitemaps, robots rules, link graph, order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteloom.functions import urls as U
from siteloom.operators.spread import join_per_site, placed_within
from siteloom.session import cut_lineage, scratch_path

# Content types read as HTML and as XML; sitemap locations tried on every site.
HTML_TYPES = ["text/html", "application/xhtml+xml"]
XML_TYPES = ["application/xml", "text/xml", "application/rss+xml", "application/atom+xml"]
SITEMAP_DEFAULTS = ["/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap"]


def fetch_kind(content_type: Column, url: Column, body: Column, status: Column) -> Column:
    ct = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    kind = (
        F.when(ct.isin(*HTML_TYPES), "html")
        .when(ct.isin(*XML_TYPES) | url.rlike(r"(?i)\.xml(\?|$)"), "xml")
        .when(ct == "", "html")
        .otherwise("asset")
    )
    return F.when(F.coalesce(status, F.lit(0)) == 0, "error").when(
        (kind != "asset") & (F.coalesce(body, F.lit("")) == ""), "empty"
    ).otherwise(kind)


def classify_fetches(fetch_log: DataFrame) -> DataFrame:
    """Adds ``kind`` and what a crawl does with the row: page, asset link or skipped."""
    kind = fetch_kind(F.col("content_type"), F.col("url"), F.col("body"), F.col("status"))
    typed = fetch_log.withColumn("kind", kind)
    use = (
        F.when(F.col("kind") == "asset", "asset")
        .when((F.col("kind") == "error") | ((F.col("body") == "") & (F.col("status") == 0)), "skip")
        .when(F.col("kind") == "xml", "skip")
        .otherwise("page")
    )
    return typed.withColumn("use", use)


def asset_links(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Links whose fetch returned an asset: kept as links, never pages."""
    assets = fetches.filter("kind = 'asset'").select(F.col("url").alias("link")).distinct()
    return links.join(assets, "link", "left_semi")


def is_sitemap(body: Column, content_type: Column) -> Column:
    """XML sitemap and not an HTML soft 404."""
    ct = F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))
    text = F.ltrim(body)
    html = text.rlike(r"(?i)^<!doctype\s+html") | text.rlike(r"(?i)^<html[\s>]")
    xml = ct.contains("xml") | text.startswith("<?xml") | F.substring(text, 1, 500).rlike(r"(?i)<(urlset|sitemapindex)[\s>]")
    return ~ct.contains("html") & ~html & xml


def sitemap_candidates(robots: DataFrame) -> DataFrame:
    """Sitemap URLs of a site: robots.txt lines, then the default places. (site, sm_url, ord)"""
    listed = F.regexp_extract_all("body", F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), F.lit(1))
    defaults = F.array(*[F.concat("origin", F.lit(p)) for p in SITEMAP_DEFAULTS])
    rows = robots.select("site", F.posexplode(F.concat(listed, defaults)).alias("pos", "sm_url"))
    return rows.groupBy("site", "sm_url").agg(F.min("pos").alias("pos")).select(
        "site", "sm_url", F.lpad(F.col("pos").cast("string"), 6, "0").alias("ord")
    )


def sitemap_urls(sitemaps: DataFrame, robots: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct same-site canonical page URLs of a site's sitemaps, at most ``cap`` per site where given.

    ``sitemaps``: stored documents (site, url, content_type, body). Index files are followed
    level by level; a level is checkpointed so the plan does not grow with the nesting.
    """
    docs = sitemaps.filter(is_sitemap(F.col("body"), F.col("content_type")))
    unescape = lambda c: F.replace(F.trim(c), F.lit("&amp;"), F.lit("&"))
    locs = F.transform(
        F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), F.lit(1)), unescape
    )
    entries = docs.select(
        "site", F.col("url").alias("sm_url"),
        F.col("body").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.posexplode(locs).alias("pos", "loc"),
    )
    level = sitemap_candidates(robots)
    seen = level.select("site", "sm_url")
    visited, depth = None, 0
    while True:
        here = level.join(entries, ["site", "sm_url"]).withColumn("level", F.lit(depth))
        here = cut_lineage(
            here.withColumn("ord", F.concat("ord", F.lit("."), F.lpad(F.col("pos").cast("string"), 6, "0")))
        )
        visited = here if visited is None else visited.unionByName(here)
        nested = here.filter("is_index").groupBy("site", F.col("loc").alias("sm_url")).agg(F.min("ord").alias("ord"))
        level, depth = cut_lineage(nested.join(seen, ["site", "sm_url"], "left_anti")), depth + 1
        if level.isEmpty():  # every level visits new documents only, so this ends
            break
        seen = seen.unionByName(level.select("site", "sm_url"))
    found = visited.filter(~F.col("is_index")).join(robots.select("site", "origin").distinct(), "site")
    found = U.keep_valid(U.add_canonical(found, "loc", "origin", "url"), "url").filter(U.same_site("url", "origin"))
    first = found.groupBy("site", "url").agg(F.min(F.struct("level", "ord")).alias("o"))
    place = F.row_number().over(W.partitionBy("site").orderBy("o", "url"))
    placed = first.withColumn("place", place)
    return (placed if cap is None else placed.filter(F.col("place") <= cap)).select("site", "url", "place")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Rules of the group that addresses ``agent`` (else ``*``): (site, allow, pattern).

    ``robots``: one robots.txt per site. Lines are numbered inside the file, which the
    public standard limits to a few hundred kilobytes.
    """
    lines = robots.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    field = lines.select(
        "site", "n",
        F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("field"),
        F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    by_file = W.partitionBy("site").orderBy("n")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(by_file), F.lit("")) != "user-agent")
    groups = field.withColumn("_start", starts.cast("int")).withColumn("group", F.sum("_start").over(by_file))
    name = F.lower(F.lit(agent))
    token = F.lower("value")
    match = F.when((token != "*") & (F.instr(name, token) > 0), F.length(token)).when(token == "*", 0)
    heads = groups.filter(is_agent).withColumn("m", match).filter(F.col("m").isNotNull())
    best = heads.groupBy("site").agg(F.max("m").alias("m"))
    chosen = heads.join(best, ["site", "m"]).select("site", "group").distinct()
    return groups.join(chosen, ["site", "group"]).filter(~is_agent & (F.col("value") != "")).select(
        "site", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern")
    )


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Adds ``allowed``: the longest matching rule decides, allow wins ties, no rule allows.

    Rules without wildcards are an index of prefixes: a path is cut to the lengths that occur among its
    site's rules, and each cut is looked up by equi-join, so thousands of rules cost as many lookups as
    they have lengths. Rules with ``*`` or ``$`` are few and tried one by one.
    """
    rules = robots_rules(robots, agent).withColumn("n", F.length("pattern"))
    wild = F.col("pattern").rlike(r"[*$]")
    plain = rules.filter(~wild).groupBy("site", "pattern", "n").agg(F.max("allow").alias("allow"))
    lengths = plain.groupBy("site").agg(F.collect_set("n").alias("_lengths"))
    escaped = F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\$(?!$)", r"\\$"))
    tried = rules.filter(wild).groupBy("site").agg(F.collect_list(F.struct("n", "allow", regex.alias("regex"))).alias("_rules"))

    query = U.query_of("url")
    target = F.concat(U.path_of("url"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    asked = urls.withColumn("_target", target)
    targets = asked.select("site", "_target").distinct()
    cuts = join_per_site(targets, lengths, "_target").select(
        "site", "_target", F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))).alias("_n")
    )
    cuts = cuts.select("site", "_target", F.substring("_target", F.lit(1), F.col("_n")).alias("pattern"))
    found = join_per_site(cuts, plain, "_target", on=("site", "pattern")).select("site", "_target", "n", "allow")
    more = join_per_site(targets, tried, "_target").select(
        "site", "_target", F.explode(F.filter("_rules", lambda r: F.rlike(F.col("_target"), r["regex"]))).alias("r")
    )
    verdict = found.unionByName(more.select("site", "_target", "r.n", "r.allow")).groupBy("site", "_target").agg(
        F.max(F.struct("n", "allow"))["allow"].alias("allowed")
    )
    out = asked.join(verdict, ["site", "_target"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
    return out.select(*urls.columns, "allowed")


def url_dictionary(pages: DataFrame) -> DataFrame:
    """(site, url, id): each distinct page URL with a number that stays its own; within a site numbers ascend with URLs."""
    urls = pages.select("site", "url").distinct().repartitionByRange("site", "url").sortWithinPartitions("site", "url")
    return cut_lineage(urls.withColumn("id", F.monotonically_increasing_id()))


def adjacency(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """(site, src, dst, pos) of the links between known URLs, and the name of the table that holds them.

    Stored once, bucketed by ``src``: a join with some sources shuffles those and reads the links as they lie.
    """
    spark = links.sparkSession
    source = ids.select("site", F.col("url").alias("from_url"), F.col("id").alias("src"))
    target = ids.select("site", F.col("url").alias("to_url"), F.col("id").alias("dst"))
    edges = links.join(source, ["site", "from_url"]).join(target, ["site", "to_url"]).groupBy("site", "src", "dst").agg(F.min("pos").cast("long").alias("pos"))
    path = scratch_path(spark, "adjacency")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option("path", path).saveAsTable(name)
    return spark.table(name), name


#: A site with at most so many links and seeds is crawled by one task, which holds their numbers (some 150 bytes a link).
LINKS_AT_ONCE = 2_000_000


def _numbers(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy()


def _walk(site: pa.Table, cap: int | None, places: bool) -> pa.Table:
    """Queue of one site from its rows (site, src, dst, pos), those of the seeds with a null src."""
    dst, pos = _numbers(site["dst"]), _numbers(site["pos"], np.iinfo(np.int64).min)
    is_seed = site["src"].is_null().to_numpy()
    known, at = np.unique(np.concatenate([dst, _numbers(site["src"])[~is_seed]]), return_inverse=True)
    to, start = at[: len(dst)], np.full(len(dst), -1)
    start[~is_seed] = at[len(dst) :]
    order = np.lexsort((to, pos, start))  # seeds first, then the links of each page by position and URL
    to, bounds = to[order], np.searchsorted(start[order], np.arange(-1, len(known) + 1))
    fresh, queue, depths, found, depth = np.ones(len(known), bool), [], [], to[: bounds[1]], 0
    left = len(known) if cap is None else cap
    while True:
        level, first = np.unique(found, return_index=True)
        level = level[np.argsort(first)]
        level = level[fresh[level]][:left]
        if not len(level):
            break
        fresh[level] = False
        queue.append(level)
        depths.append(np.full(len(level), depth, np.int32))
        left, depth = left - len(level), depth + 1
        many = bounds[level + 2] - bounds[level + 1]
        found = to[np.repeat(bounds[level + 1] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    queue = np.concatenate([np.zeros(0, int), *queue])
    place = pa.array(np.arange(1, len(queue) + 1, dtype=np.int32)) if places else pa.nulls(len(queue), pa.int32())
    return pa.table({"site": pa.repeat(site["site"][0], len(queue)), "id": pa.array(known[queue], pa.int64()), "place": place, "depth": pa.array(np.concatenate([np.zeros(0, np.int32), *depths]))})


def crawl_order(
    links: DataFrame, seeds: DataFrame, pages: DataFrame, cap: int | None = None, places: bool = True, links_at_once: int = LINKS_AT_ONCE
) -> DataFrame:
    """Breadth-first discovery over a stored link table: site, url, depth and place in the site's queue.

    ``links``: site, from_url, to_url, pos; ``seeds``: site, url, pos; ``pages``: site, url. A page's place goes by
    (place of the page that links first, position of the link, URL).

    Sites of at most ``links_at_once`` links are dealt to tasks and crawled there, however deep they are. Larger ones go level
    by level over the whole cluster: a level joins the frontier with the adjacency table and drops what was seen. With a
    cap the frontier never exceeds ``cap`` pages per site; without one, places come from ordered ranges, or are left null if
    not asked for. Every level is checkpointed, so neither the plan nor a lost executor costs more than one level.
    """
    spark = links.sparkSession
    ids = url_dictionary(pages)
    edges, table = adjacency(links, ids)
    start = cut_lineage(seeds.join(ids, ["site", "url"]).groupBy("site", "id").agg(F.min("pos").cast("long").alias("pos")))
    rows = edges.unionByName(start.select("site", F.lit(None).cast("long").alias("src"), F.col("id").alias("dst"), "pos"))
    large = cut_lineage(rows.groupBy("site").count().filter(F.col("count") > links_at_once).select("site"))
    schema = StructType([ids.schema["site"], *StructType.fromDDL("id long, place int, depth int")])
    walked = rows.join(large, "site", "left_anti").groupBy("site").applyInArrow(lambda t: _walk(t, cap, places or cap is not None), schema)
    seen = cut_lineage(walked)
    if not large.isEmpty():
        seen = seen.unionByName(_levels(edges, start.join(large, "site", "left_semi"), cap, places))
    spark.sql(f"DROP TABLE {table}")  # all that was read of it is checkpointed by now
    return seen.join(ids, ["site", "id"]).select("site", "url", "depth", "place")


def _levels(edges: DataFrame, start: DataFrame, cap: int | None, places: bool) -> DataFrame:
    """(site, id, place, depth) of the pages reached from ``start`` (site, id, pos), one level after the other."""

    def placed(found: DataFrame, done: DataFrame | None) -> DataFrame:
        if cap is None and not places:
            return cut_lineage(found.select("site", "id", F.lit(None).cast("int").alias("place")))
        found = found.select("site", "id", F.col("ord.parent").alias("parent"), F.col("ord.pos").alias("pos"))
        if cap is None:
            out = placed_within(found, ["site"], ["parent", "pos", "id"], "n")
        else:
            n = F.row_number().over(W.partitionBy("site").orderBy("parent", "pos", "id"))
            out = found.withColumn("n", n).filter(F.col("n") <= cap)
        if done is not None:
            counts = done.groupBy("site").agg(F.count("*").alias("before"))
            out = join_per_site(out, counts, "id").withColumn("n", (F.col("n") + F.col("before")).cast("int"))
        out = out.select("site", "id", F.col("n").cast("int").alias("place"))
        return cut_lineage(out if cap is None else out.filter(F.col("place") <= cap))

    frontier = placed(start.select("site", "id", F.struct(F.lit(0).alias("parent"), "pos").alias("ord")), None).withColumn("depth", F.lit(0))
    seen, depth = frontier, 0
    while True:
        depth += 1
        out = frontier.select(F.col("id").alias("src"), F.coalesce("place", F.lit(0)).alias("parent")).join(edges, "src")
        found = out.groupBy("site", F.col("dst").alias("id")).agg(F.min(F.struct("parent", "pos")).alias("ord")).join(seen.select("id"), "id", "left_anti")
        frontier = placed(found, seen).withColumn("depth", F.lit(depth))
        if frontier.isEmpty():  # every level holds new pages only, so this ends
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = cut_lineage(seen)
    return seen


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal edges per target path with the page behind it (null when dangling).

    ``links``: site, page_id, path (target). ``pages``: site, page_id, path, http_status.
    Several pages of one path fold into the first.
    """
    targets = pages.groupBy("site", U.norm_path("path").alias("target_path")).agg(
        F.min(F.struct("page_id", "http_status")).alias("t")
    )
    edges = links.select("site", F.col("page_id").alias("from_page"), U.norm_path("path").alias("target_path")).distinct()
    status = F.coalesce("t.http_status", F.lit(200))
    return edges.join(targets, ["site", "target_path"], "left").select(
        "site", "from_page", "target_path",
        F.col("t.page_id").alias("to_page"),
        F.when(F.col("t").isNull(), "dangling").when(status >= 400, "error-target").otherwise("ok").alias("state"),
    )


def orphan_pages(graph: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages no other page links to (the home page is never an orphan)."""
    linked = graph.filter((F.col("to_page").isNotNull()) & (F.col("to_page") != F.col("from_page"))).select(
        "site", F.col("target_path").alias("path")
    ).distinct()
    norm = pages.select("site", "page_id", U.norm_path("path").alias("path")).filter("path <> '/'")
    return norm.join(linked, ["site", "path"], "left_anti")
