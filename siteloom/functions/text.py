"""Text, hashing and markup columns shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references decoded in page text ("&amp;" must stay last).
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&middot;", "·"),
    ("&bull;", "•"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&hellip;", "…"),
    ("&pound;", "£"),
    ("&euro;", "€"),
    ("&apos;", "'"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
]

NUL = "\u0000"

# Contact and price patterns.
PHONE = (
    r"(?:\+?(?:64|61|44)\s?[1-9][\d\s()-]{7,14}"
    r"|\(0[2-9]\)\s?\d{3,4}\s?\d{3,4}|0[2-9]\d{7,9}|021[\s-]?\d{3}[\s-]?\d{4})"
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PRICE = r"(?:NZ\$|AU\$|£|\$)\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
ADDRESS = (
    r"\d{1,5}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+"
    r"(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Way|Place|Pl)\b[^.\n]{0,40}"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse(text) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def decode_entities(text) -> Column:
    t = _c(text)
    numeric = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(&#[xX]?[0-9a-fA-F]{1,6};)"), F.lit(1)))

    def replace_one(acc, ref):
        hexed = F.lower(F.substring(ref, 3, 1)) == "x"
        code = F.when(
            hexed, F.conv(F.regexp_extract(ref, r"([0-9a-fA-F]+);", 1), 16, 10)
        ).otherwise(F.regexp_extract(ref, r"([0-9]+)", 1)).cast("int")
        # two UTF-16 units are decoded as bytes because chr() covers only 0-255
        unit = F.lpad(F.hex(code), 8, "0")
        return F.replace(acc, ref, F.decode(F.unhex(unit), "UTF-32"))

    decoded = F.when(F.instr(t, "&#") > 0, F.aggregate(numeric, t, replace_one)).otherwise(t)
    for name, char in NAMED_ENTITIES:
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    return F.when(F.instr(t, "&") > 0, decoded).otherwise(t)


def drop_invisible(html) -> Column:
    """Remove comments and elements whose content is never text."""
    return F.regexp_replace(
        _c(html),
        r"(?is)<!--.*?-->|<(script|style|noscript|iframe)\b[^>]*>.*?</\1\s*>",
        "",
    )


def markup_text(html) -> Column:
    """Text of an HTML fragment: tags vanish without a separator, references are decoded."""
    bare = F.regexp_replace(drop_invisible(html), r"<[^>]*>", "")
    # bound once: the decoder looks at its input several times
    return collapse(F.get(F.transform(F.array(bare), lambda t: decode_entities(t)), F.lit(0)))


def word_count(text) -> Column:
    t = collapse(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")


def fingerprint(*parts) -> Column:
    """Stable 16-hex id of NUL-joined parts."""
    return F.substring(F.sha2(F.concat_ws(NUL, *[_c(p).cast("string") for p in parts]), 256), 1, 16)


def short_key(*parts) -> Column:
    """Stable 12-hex key of NUL-joined parts."""
    return F.substring(F.sha1(F.concat_ws(NUL, *[_c(p).cast("string") for p in parts])), 1, 12)


def set_digest(member) -> Column:
    """Aggregate: order-free digest of a set of any size (count + 48-bit hash sum).

    Stands in for hashing the joined list of members, which would need the whole group in
    one task; the partial sums combine before the shuffle.
    """
    unit = F.conv(F.substring(F.sha1(_c(member).cast("string")), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.concat_ws("-", F.count(member).cast("string"), F.sum(unit).cast("decimal(38,0)").cast("string"))


def find_all(text, pattern: str) -> Column:
    """Distinct trimmed matches in order of first appearance."""
    hits = F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))
    return F.filter(F.array_distinct(F.transform(hits, lambda v: F.trim(v))), lambda v: v != "")


def plural(n, singular: str, plural_: str | None = None) -> Column:
    """'1 page' / '3 pages'."""
    many = plural_ or singular + "s"
    return F.concat(_c(n).cast("string"), F.lit(" "), F.when(_c(n) == 1, singular).otherwise(many))
