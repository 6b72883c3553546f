"""URL and path columns built from Spark built-ins (no UDFs, no java.net parsing).

``parse_url`` rejects characters that real links contain, so the pieces are cut with the
generic URI pattern instead; every function takes and returns Columns and stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only identify a campaign or click.
TRACKING_PARAMS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
]

# Public suffixes of two labels that are removed as a whole.
TWO_LABEL_SUFFIXES = [
    ".co.nz",
    ".org.nz",
    ".net.nz",
    ".ac.nz",
    ".co.uk",
    ".org.uk",
    ".com.au",
    ".net.au",
    ".org.au",
]

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scheme_of(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority_of(url) -> Column:
    """Host with a non-default port, lower-cased; '' when the text is not an absolute URL."""
    raw = F.lower(F.regexp_extract(_c(url), _AUTHORITY, 1))
    port = F.when(scheme_of(url) == "https", F.lit(":443$")).otherwise(F.lit(":80$"))
    return F.regexp_replace(raw, port, F.lit(""))


def host_of(url) -> Column:
    return F.regexp_replace(authority_of(url), r":[0-9]*$", "")


def site_key(url) -> Column:
    """The key every table is grouped by: host without a leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def raw_path_of(url) -> Column:
    return F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_of(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def _escape(text: Column) -> Column:
    """Percent-encode blanks and non-ASCII characters, the way browsers print a URL."""
    per_char = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(r"[^\x21-\x7e]"), per_char).otherwise(text)


def _remove_dots(path: Column) -> Column:
    def step(acc, seg):
        return (
            F.when(seg == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segments = F.split(path, "/")
    folded = F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/")
    folded = F.when(path.rlike(r"/\.{1,2}$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(path)


def path_of(url) -> Column:
    """Path of an absolute URL; '/' when empty."""
    p = _escape(_remove_dots(raw_path_of(url)))
    return F.when(p == "", "/").otherwise(p)


def _clean_query(query: Column) -> Column:
    drop = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    pairs = F.filter(
        F.split(query, "&"),
        lambda kv: (kv != "") & ~F.array_contains(drop, F.substring_index(kv, "=", 1)),
    )
    shaped = F.transform(
        pairs,
        lambda kv: F.replace(
            F.when(F.instr(kv, "=") > 0, kv).otherwise(F.concat(kv, F.lit("="))), F.lit("%20"), F.lit("+")
        ),
    )
    return F.when(query == "", "").otherwise(_escape(F.array_join(shaped, "&")))


def resolve_url(href, base) -> Column:
    """Absolute form of ``href`` seen on page ``base`` (http and https only, else null)."""
    h, b = F.trim(_c(href)), _c(base)
    origin = F.concat(scheme_of(b), F.lit("://"), authority_of(b))
    base_path = F.when(raw_path_of(b) == "", "/").otherwise(raw_path_of(b))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    scheme = scheme_of(h)
    absolute = (
        F.when(scheme.isin("http", "https"), F.when(authority_of(h) != "", h))
        .when(scheme != "", F.lit(None))
        .when(h.startswith("//"), F.concat(scheme_of(b), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, base_path, h))
        .when((h == "") | h.startswith("#"), F.regexp_replace(b, "#.*$", ""))
        .otherwise(F.concat(origin, folder, h))
    )
    return F.when(authority_of(absolute) != "", absolute)


def _print_url(url: Column, query: Column) -> Column:
    return F.concat(
        scheme_of(url),
        F.lit("://"),
        authority_of(url),
        path_of(url),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def canonical_url(href, base) -> Column:
    """Resolve, keep http(s), drop the fragment and the tracking parameters.

    For use on plain columns; ``add_canonical`` names the intermediate parts instead of
    repeating them, which is what jobs over link tables want.
    """
    url = resolve_url(href, base)
    return _print_url(url, _clean_query(query_of(url)))


def add_resolved(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``out`` = absolute URL of column ``href`` on page ``base`` (null unless http(s)).

    Intermediate columns keep each pattern match to one evaluation per row.
    """
    h, b = F.col(href), F.col(base)
    parts = df.withColumns(
        {
            "_href": F.trim(h),
            "_base_scheme": scheme_of(b),
            "_base_auth": authority_of(b),
            "_base_path": F.when(raw_path_of(b) == "", "/").otherwise(raw_path_of(b)),
        }
    ).withColumn("_scheme", scheme_of("_href"))
    origin = F.concat(F.col("_base_scheme"), F.lit("://"), F.col("_base_auth"))
    hh = F.col("_href")
    absolute = (
        F.when(F.col("_scheme").isin("http", "https"), hh)
        .when(F.col("_scheme") != "", F.lit(None))
        .when(hh.startswith("//"), F.concat(F.col("_base_scheme"), F.lit(":"), hh))
        .when(hh.startswith("/"), F.concat(origin, hh))
        .when(hh.startswith("?"), F.concat(origin, F.col("_base_path"), hh))
        .when((hh == "") | hh.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), hh))
        .otherwise(F.concat(origin, F.regexp_replace("_base_path", "[^/]*$", ""), hh))
    )
    return (
        parts.withColumn("_abs", absolute)
        .withColumn(out, F.when(F.col("_abs").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), F.col("_abs")))
        .drop("_href", "_base_scheme", "_base_path", "_scheme", "_abs", "_base_auth")
    )


def add_parts(df: DataFrame, url: str) -> DataFrame:
    return df.withColumns(
        {
            "_u_scheme": scheme_of(url),
            "_u_auth": authority_of(url),
            "_u_raw": _remove_dots(raw_path_of(url)),
            "_u_query": query_of(url),
        }
    ).withColumn("_u_path", F.when(F.col("_u_raw") == "", "/").otherwise(_escape(F.col("_u_raw"))))


_PART_COLUMNS = ["_u_scheme", "_u_auth", "_u_raw", "_u_query", "_u_path"]


def add_canonical(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """Add ``out`` = canonical URL of ``href`` on page ``base``."""
    parts = add_parts(add_resolved(df, href, base, "_u"), "_u").withColumn("_u_q", _clean_query(F.col("_u_query")))
    q = F.col("_u_q")
    printed = F.concat(
        F.col("_u_scheme"), F.lit("://"), F.col("_u_auth"), F.col("_u_path"),
        F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)),
    )
    return parts.withColumn(out, printed).drop("_u", "_u_q", *_PART_COLUMNS)


def keep_valid(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose ``column`` is null.

    Written as an explode: a filter on a derived URL would be pushed down and every part of
    the derivation repeated inside the predicate.
    """
    return df.withColumn(column, F.explode(F.array_compact(F.array(column))))


def add_localised(df: DataFrame, href: str, page_url: str, out: str) -> DataFrame:
    """Add ``out``: same-host links as path+query; mailto/tel stay; fragments and scripts go."""
    h = F.col(href)
    parts = add_parts(add_resolved(df, href, page_url, "_u"), "_u").withColumns(
        {"_h_scheme": scheme_of(h), "_page_auth": authority_of(page_url)}
    )
    q = F.col("_u_query")
    tail = F.concat(F.col("_u_path"), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    printed = F.concat(
        F.col("_u_scheme"), F.lit("://"), F.col("_u_auth"), tail, F.regexp_extract("_u", "(#.*)?$", 0)
    )
    local = (
        F.when(h.isNull() | (h == "") | h.startswith("#") | (F.col("_h_scheme") == "javascript"), F.lit(None))
        .when((F.col("_h_scheme") != "") & ~F.col("_h_scheme").isin("http", "https"), h)
        .when(F.col("_u_auth") == F.col("_page_auth"), tail)
        .otherwise(printed)
    )
    return parts.withColumn(out, local).drop("_u", "_h_scheme", "_page_auth", *_PART_COLUMNS)


def same_site(a, b) -> Column:
    ok = (scheme_of(a) == scheme_of(b)) & (site_key(a) == site_key(b)) & (site_key(a) != "")
    return F.coalesce(ok, F.lit(False))


def classify_redirect(src, dst) -> Column:
    """'same-site' for www/apex or http→https hops, 'off-site' for every other target."""
    same_host = (site_key(src) == site_key(dst)) & (site_key(src) != "")
    upgrade = (scheme_of(src) == scheme_of(dst)) | ((scheme_of(src) == "http") & (scheme_of(dst) == "https"))
    return F.when(F.coalesce(same_host & upgrade, F.lit(False)), "same-site").otherwise("off-site")


def site_slug(url) -> Column:
    host = site_key(url)
    two_label = "(" + "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES) + ")$"
    base = (
        F.when(host.rlike(two_label), F.regexp_replace(host, two_label, ""))
        .when(F.instr(host, ".") > 0, F.regexp_replace(host, r"\.[^.]*$", ""))
        .otherwise(host)
    )
    dashed = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(dashed, 1, 64)


def norm_path(path, url=None) -> Column:
    """Leading slash, no trailing slash; falls back to the URL's path, then '/'."""
    p = F.nullif(_c(path), F.lit(""))
    if url is not None:
        p = F.coalesce(p, F.when(authority_of(url) != "", path_of(url)))
    p = F.coalesce(p, F.lit("/"))
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def page_path(path, url) -> Column:
    """Like ``norm_path`` but a trailing slash stays (review findings quote it)."""
    p = F.coalesce(F.nullif(_c(path), F.lit("")), F.when(authority_of(url) != "", path_of(url)), F.lit("/"))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def _segments(path) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda s: s != "")


def path_prefix(path) -> Column:
    return F.concat(F.lit("/"), F.coalesce(F.get(_segments(path), F.lit(0)), F.lit("")))


def path_depth(path, cap: int | None = None) -> Column:
    depth = F.size(_segments(path))
    return F.least(depth, F.lit(cap)) if cap is not None else depth


def normalise_site_url(raw) -> Column:
    """What a person types → https URL without trailing slash; null for other schemes."""
    t = F.trim(_c(raw))
    full = F.when(F.instr(t, "://") > 0, t).otherwise(F.concat(F.lit("https://"), t))
    printed = F.concat(
        _print_url(full, query_of(full)),
        F.when(F.instr(full, "#") > 0, F.regexp_extract(full, "(#.*)$", 1)).otherwise(""),
    )
    ok = (t != "") & scheme_of(full).isin("http", "https") & (authority_of(full) != "")
    return F.when(ok, F.regexp_replace(printed, "/$", ""))


def trim_slashes(path) -> Column:
    return F.regexp_replace(_c(path), "^/+|/+$", "")


def kebab(name) -> Column:
    return F.lower(F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1-$2"))


def id_safe(text) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(_c(text), "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 100), F.lit("")), F.lit("x"))
