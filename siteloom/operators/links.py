"""Jobs over the page and link tables that need nothing but URL columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U


def raw_hrefs(pages: DataFrame) -> DataFrame:
    """One row per ``<a href>`` in document order: site, page_id, url, pos, href."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select("site", "page_id", "url", F.posexplode(hrefs).alias("pos", "href"))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute links of each page with the position of the first use.

    E-mail protection links are not links. The pre-aggregation key holds the page, so a
    large site spreads over all partitions.
    """
    links = raw_hrefs(pages).filter(
        ~F.lower("href").contains("/cdn-cgi/l/email-protection") & (F.col("href") != "")
    )
    links = U.keep_valid(U.add_canonical(links, "href", "url", "link"), "link")
    return links.groupBy("site", "page_id", "url", "link").agg(F.min("pos").alias("pos"))


def canonical_links(pages: DataFrame) -> DataFrame:
    """Distinct canonical targets per site with the pages and uses they have."""
    links = U.keep_valid(U.add_canonical(raw_hrefs(pages), "href", "url", "link"), "link")
    per_page = links.groupBy("site", "link", "page_id").agg(F.count("*").alias("uses"))
    return per_page.groupBy("site", "link").agg(
        F.count("*").alias("pages"), F.sum("uses").alias("uses"), F.min("page_id").alias("first_page")
    )


def page_paths(pages: DataFrame) -> DataFrame:
    """Path columns of every page: normalised path, prefix, depth, display depth."""
    path = U.norm_path("path", "url")
    return pages.select(
        "site",
        "page_id",
        path.alias("path"),
        U.path_prefix(path).alias("prefix"),
        U.path_depth(path).cast("long").alias("depth"),
        U.path_depth(path, cap=4).cast("long").alias("display_depth"),
    )


def site_keys(pages: DataFrame) -> DataFrame:
    """One row per site: key, slug, and the page range it covers."""
    return pages.groupBy("site").agg(
        F.min(U.site_slug("url")).alias("slug"),
        F.count("*").alias("pages"),
        F.countDistinct(U.host_of("url")).alias("hosts"),
    )


def url_variants(pages: DataFrame) -> DataFrame:
    """Pages that share (site, path) but differ in URL, one row per variant URL."""
    keyed = pages.select("site", U.norm_path("path", "url").alias("path"), "url", "page_id")
    per_url = keyed.groupBy("site", "path", "url").agg(F.min("page_id").alias("page_id"))
    shared = (
        per_url.groupBy("site", "path").agg(F.count("*").alias("variants")).filter("variants > 1")
    )
    return per_url.join(shared, ["site", "path"])


def redirect_classes(redirects: DataFrame) -> DataFrame:
    """Redirect log rows (from_url, to_url) with their class and whether they stay on site."""
    return redirects.select(
        "from_url",
        "to_url",
        U.classify_redirect("from_url", "to_url").alias("class"),
        U.same_site("from_url", "to_url").alias("same_site"),
    )


def localised_links(pages: DataFrame) -> DataFrame:
    """Hrefs as the new site would print them, counted per site."""
    out = U.add_localised(raw_hrefs(pages), "href", "url", "local_href")
    return (
        U.keep_valid(out, "local_href")
        .groupBy("site", "local_href")
        .agg(F.count("*").alias("uses"))
    )
