"""URL columns on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls as U


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select


CANONICAL = [
    ("/a/b", "https://x.com/c/d", "https://x.com/a/b"),
    ("b?utm_source=1&k=2#f", "https://x.com/c/d", "https://x.com/c/b?k=2"),
    ("../up/./x", "https://x.com/c/d/e", "https://x.com/c/up/x"),
    ("..", "https://x.com/c/d/e", "https://x.com/c/"),
    ("//y.com", "http://x.com/", "http://y.com/"),
    ("HTTPS://Y.com:443/A?flag", "http://x.com/", "https://y.com/A?flag="),
    ("?p=1", "https://x.com/c/d?q=2", "https://x.com/c/d?p=1"),
    ("#top", "https://x.com/c?fbclid=9", "https://x.com/c"),
    ("mailto:a@b.co", "https://x.com/", None),
    ("javascript:void(0)", "https://x.com/", None),
    ("/straße x", "https://x.com/", "https://x.com/stra%C3%9Fe%20x"),
    ("http://x.com:8080/", "https://x.com/", "http://x.com:8080/"),
]


def test_canonical_url_column_and_job_agree(spark):
    rows = [(i, h, b) for i, (h, b, _) in enumerate(CANONICAL)]
    df = spark.createDataFrame(rows, "i int, href string, base string")
    by_column = {r.i: r.u for r in df.select("i", U.canonical_url("href", "base").alias("u")).collect()}
    by_job = {r.i: r.u for r in U.add_canonical(df, "href", "base", "u").collect()}
    for i, (_, _, want) in enumerate(CANONICAL):
        assert by_column[i] == want, CANONICAL[i]
        assert by_job[i] == want, CANONICAL[i]


@pytest.mark.parametrize(
    "href,want",
    [
        ("/a?x=1#y", "/a?x=1"),
        ("https://x.com/z", "/z"),
        ("https://www.x.com/z", "https://www.x.com/z"),
        ("tel:+1", "tel:+1"),
        ("MAILTO:a@b.c", "MAILTO:a@b.c"),
        ("#", None),
        ("javascript:x", None),
        ("https://o.com/q#f", "https://o.com/q#f"),
    ],
)
def test_localised_href(spark, href, want):
    df = spark.createDataFrame([(href, "https://x.com/p")], "href string, url string")
    assert U.add_localised(df, "href", "url", "l").first().l == want


def test_same_site_and_redirects(spark):
    rows = [
        ("https://x.com/", "https://www.x.com/a", True, "same-site"),
        ("http://x.com/", "https://x.com/", False, "same-site"),
        ("https://x.com/", "http://x.com/", False, "off-site"),
        ("https://x.com/", "https://parked.example/", False, "off-site"),
        ("nonsense", "nonsense", False, "off-site"),
    ]
    df = spark.createDataFrame(rows, "a string, b string, same boolean, cls string")
    for r in df.select("*", U.same_site("a", "b").alias("s"), U.classify_redirect("a", "b").alias("c")).collect():
        assert (r.s, r.c) == (r.same, r.cls)


def test_names(spark):
    df = spark.createDataFrame([(1,)], "x int")
    lit = F.lit
    got = df.select(
        U.site_slug(lit("https://www.acme-build.co.nz/x")).alias("a"),
        U.site_slug(lit("https://shop.acme.com")).alias("b"),
        U.normalise_site_url(lit(" acme.com/ ")).alias("c"),
        U.normalise_site_url(lit("ftp://acme.com")).alias("d"),
        U.kebab(lit("blogPostItem")).alias("e"),
        U.id_safe(lit("--a b/ü--")).alias("f"),
        U.id_safe(lit("///")).alias("g"),
        U.norm_path(lit("about/"), lit("https://x.com")).alias("h"),
        U.norm_path(lit(None).cast("string"), lit("https://x.com/q/")).alias("i"),
        U.path_prefix(lit("/services/a/")).alias("j"),
        U.path_depth(lit("/a/b/c/d/e"), cap=4).alias("k"),
    ).first()
    assert tuple(got) == (
        "acme-build", "shop-acme", "https://acme.com", None, "blog-post-item", "a-b", "x", "/about", "/q", "/services", 4,
    )
