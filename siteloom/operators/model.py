"""Content model: reading proposals, validation, decisions, versions, compiled schemas.

Types and fields are long tables keyed (site, version, type[, field]). A site's model is a
few dozen types by construction, so per-site arrays of types or fields stay small; pages
never enter such arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.extract import corpus
from siteloom.operators.migrate import BLOCK_MATCH_NAMES, STANDARD_BLOCKS

# Names a type may not take; members every array may hold.
RESERVED_NAMES = ["type", "id", "document", "image"]
BUILT_IN_MEMBERS = [
    "string", "text", "number", "boolean", "date", "datetime", "url", "slug", "image", "file", "reference", "block", "object",
]
# The two types every site has, with their fields.
CORE_TYPES = {
    "page": ("Page", "document", [("title", "string", True), ("slug", "slug", True), ("body", "array", None)]),
    "siteSettings": ("Site settings", "singleton", [("siteTitle", "string", None), ("phone", "string", None), ("email", "string", None)]),
}
CORE_CONFIDENCE = 0.4
LOW_CONFIDENCE = 0.6
CAMEL_CASE = "^[a-z][a-zA-Z0-9]*$"

FIELD_JSON = "array<struct<name:string,type:string,of:array<string>,to:array<string>,required:boolean,evidenceCount:int>>"
TYPE_JSON = (
    "array<struct<name:string,title:string,kind:string,bonesMatch:string,blockMatch:string,rationale:string,confidence:double,"
    f"decision:string,mergeInto:string,fields:{FIELD_JSON},"
    "evidence:array<struct<pageId:long,url:string,excerpt:string>>>>"
)


def _names(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def repair_double_encoded(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Model output → ``types`` array, also where the object or its list arrived as a JSON string."""
    text = F.trim(col)
    inner = F.when(
        text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    ).otherwise(text)
    return raw.withColumn("types", F.from_json(F.get_json_object(inner, "$.types"), TYPE_JSON)).drop(col)


def flatten_proposal(proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested proposals (site, version, types) → types, fields and evidence tables."""
    t = proposals.select("site", "version", F.posexplode("types").alias("ord", "t"))
    types = t.select(
        "site", "version", "ord", "t.name", "t.title", "t.kind", F.coalesce("t.blockMatch", "t.bonesMatch").alias("block_match"),
        "t.rationale", "t.confidence", "t.decision", F.col("t.mergeInto").alias("merge_into"),
    )
    fields = t.select("site", "version", F.col("t.name").alias("type_name"), F.posexplode("t.fields").alias("ord", "f")).select(
        "site", "version", "type_name", "ord", F.col("f.name").alias("field_name"), F.col("f.type").alias("field_type"),
        "f.of", "f.to", "f.required", F.col("f.evidenceCount").alias("evidence_count"),
    )
    evidence = t.select("site", "version", F.col("t.name").alias("type_name"), F.explode("t.evidence").alias("e")).select(
        "site", "version", "type_name", F.col("e.pageId").alias("page_id"), "e.url", "e.excerpt"
    )
    return types, fields, evidence


def check_evidence(
    types: DataFrame, evidence: DataFrame, corpora: DataFrame, chrome: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep evidence found verbatim in its page (or the site's chrome); a type that loses all
    of it loses 0.2 confidence, never below 0. Returns (types, kept evidence).

    Counts of seen and kept evidence come from one pass over the joined rows.
    """
    joined = evidence.join(corpora.select("site", "page_id", "corpus"), ["site", "page_id"], "left")
    proven = F.coalesce(F.col("corpus").contains(F.col("excerpt")), F.lit(False))
    if chrome is not None:
        blocks = chrome.groupBy("site").agg(F.array_join(F.collect_list("block"), "\n").alias("_chrome"))
        joined = joined.join(blocks, "site", "left")
        proven = proven | F.coalesce(F.col("_chrome").contains(F.col("excerpt")), F.lit(False))
    marked = joined.withColumn("kept", (F.length("excerpt") > 0) & proven)
    counts = marked.groupBy("site", "version", F.col("type_name").alias("name")).agg(
        F.count("*").alias("_seen"), F.count_if("kept").alias("_kept")
    )
    out = types.join(counts, ["site", "version", "name"], "left")
    lost = (F.coalesce("_seen", F.lit(0)) > 0) & (F.col("_kept") == 0)
    checked = out.withColumns(
        {
            "confidence": F.when(lost, F.round(F.greatest(F.lit(0.0), F.col("confidence") - 0.2), 6)).otherwise(F.col("confidence")),
            "evidence": F.coalesce("_kept", F.lit(0).cast("long")),
        }
    ).drop("_seen", "_kept")
    return checked, marked.filter("kept").select(*evidence.columns)


def core_rows(types: DataFrame) -> DataFrame:
    """(site, version, core type) rows that a proposal lacks."""
    wanted = types.select("site", "version").distinct().withColumn(
        "c",
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("name"), F.lit(t).alias("title"), F.lit(k).alias("kind")) for n, (t, k, _) in CORE_TYPES.items()]
            )
        ),
    ).select("site", "version", "c.*")
    return wanted.join(types.select("site", "version", "name"), ["site", "version", "name"], "left_anti")


def ensure_core_types(types: DataFrame) -> DataFrame:
    """Add the page and site-settings types where a proposal lacks them (confidence 0.4, kept)."""
    added = core_rows(types).withColumns(
        {
            "confidence": F.lit(CORE_CONFIDENCE), "decision": F.lit("keep"),
            "rationale": F.when(F.col("name") == "page", "Default page document (added, the proposal had none).").otherwise(
                "Singleton for site-wide facts (added, the proposal had none)."
            ),
        }
    )
    return types.unionByName(added, allowMissingColumns=True)


def core_fields(types: DataFrame) -> DataFrame:
    """Fields of the core types that ``ensure_core_types`` adds."""
    none = F.lit(None).cast("array<string>")
    rows = [
        F.struct(F.lit(n).alias("type_name"), F.lit(i).alias("ord"), F.lit(f).alias("field_name"), F.lit(t).alias("field_type"),
                 (_names(STANDARD_BLOCKS) if f == "body" else none).alias("of"), none.alias("to"), F.lit(r).cast("boolean").alias("required"))
        for n, (_, _, fields) in CORE_TYPES.items()
        for i, (f, t, r) in enumerate(fields)
    ]
    missing = core_rows(types).withColumn("f", F.explode(F.array(*rows))).filter(F.col("f.type_name") == F.col("name"))
    return missing.select("site", "version", "f.*", F.lit(0).alias("evidence_count"))


def normalise_block_match(types: DataFrame) -> DataFrame:
    """A block name outside the catalogue becomes null and the rationale says so."""
    odd = (F.coalesce("block_match", F.lit("")) != "") & ~F.col("block_match").isin(*BLOCK_MATCH_NAMES)
    note = F.concat(
        F.col("rationale"), F.lit(' (Proposed block match "'), F.col("block_match"),
        F.lit('" is not in the catalogue; kept as a custom type.)'),
    )
    return types.withColumns(
        {"rationale": F.when(odd, note).otherwise(F.col("rationale")), "block_match": F.when(~odd, F.col("block_match"))}
    )


def move_block_targets(fields: DataFrame) -> DataFrame:
    """Block names in ``to`` of array fields move to ``of``."""
    blocks = F.array_intersect("to", _names(BLOCK_MATCH_NAMES))
    moves = (F.col("field_type") == "array") & (F.size(F.coalesce(blocks, F.expr("cast(array() as array<string>)"))) > 0)
    rest = F.array_except("to", _names(BLOCK_MATCH_NAMES))
    return fields.withColumns(
        {
            "of": F.when(moves, F.array_union(F.coalesce("of", F.expr("cast(array() as array<string>)")), blocks)).otherwise(F.col("of")),
            "to": F.when(moves, F.when(F.size(rest) > 0, rest)).otherwise(F.col("to")),
        }
    )


def name_violations(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Rule and subject of every bad name, one row per occurrence."""
    key = ["site", "version"]
    t = types.select(*key, "name")

    def found(df: DataFrame, cond: Column, rule: str, subject: Column) -> DataFrame:
        return df.filter(cond).select(*key, F.lit(rule).alias("rule"), subject.alias("subject"))

    field = F.concat("type_name", F.lit("."), "field_name")
    repeated = (
        t.groupBy(*key, "name").agg(F.count("*").alias("n")).filter("n > 1")
        .select(*key, F.lit("duplicate type").alias("rule"), F.col("name").alias("subject"))
    )
    return (
        found(t, ~F.col("name").rlike(CAMEL_CASE), "type not camelCase", F.col("name"))
        .unionByName(found(t, F.col("name").isin(*RESERVED_NAMES), "reserved type", F.col("name")))
        .unionByName(repeated)
        .unionByName(found(fields, ~F.col("field_name").rlike(CAMEL_CASE), "field not camelCase", field))
        .unionByName(found(fields, F.col("field_name").startswith("_"), "field starts with _", field))
    )


def reference_violations(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Dangling references, unknown array members and page bodies with foreign members."""
    key = ["site", "version"]
    names = types.select(*key, F.col("name").alias("member")).distinct()
    empty = F.expr("cast(array() as array<string>)")
    of, to = F.coalesce("of", empty), F.coalesce("to", empty)
    is_ref = (F.col("field_type") == "reference") | ((F.col("field_type") == "array") & F.array_contains(of, "reference"))
    subject = F.concat("type_name", F.lit("."), "field_name").alias("subject")
    checks = F.filter(
        F.concat(
            F.when(is_ref, F.transform(to, lambda m: F.struct(F.lit("dangling reference").alias("rule"), m.alias("member")))).otherwise(
                F.expr("cast(array() as array<struct<rule:string,member:string>>)")
            ),
            F.transform(
                F.filter(of, lambda m: ~m.isin(*BUILT_IN_MEMBERS, *BLOCK_MATCH_NAMES)),
                lambda m: F.struct(F.lit("unknown array member").alias("rule"), m.alias("member")),
            ),
            F.when(
                (F.col("type_name") == "page") & (F.col("field_name") == "body") & (F.col("field_type") == "array"),
                F.transform(
                    F.filter(of, lambda m: ~m.isin(*BLOCK_MATCH_NAMES)),
                    lambda m: F.struct(F.lit("foreign page.body member").alias("rule"), m.alias("member")),
                ),
            ).otherwise(F.expr("cast(array() as array<struct<rule:string,member:string>>)")),
        ),
        lambda c: c["member"].isNotNull(),
    )
    rows = fields.select(*key, subject, F.explode(checks).alias("c")).select(*key, "subject", "c.rule", "c.member")
    return rows.join(names, [*key, "member"], "left_anti")


def _field_json() -> Column:
    empty = F.expr("cast(array() as array<string>)")
    of, to = F.coalesce("of", empty), F.coalesce("to", empty)
    none = F.lit(None)
    target = "array<struct<type:string>>"
    member = f"array<struct<type:string,to:{target}>>"
    targets = F.transform(to, lambda n: F.struct(n.alias("type")))
    members = F.transform(
        of, lambda m: F.struct(m.alias("type"), F.when((m == "reference") & (F.size(to) > 0), targets).alias("to"))
    )
    kind = F.col("field_type")
    inner = F.when(
        kind == "object",
        F.when(F.size(of) > 0, F.transform(of, lambda n: F.struct(n.alias("name"), F.lit("string").alias("type")))).otherwise(
            F.array(F.struct(F.lit("value").alias("name"), F.lit("string").alias("type")))
        ),
    )
    return F.struct(
        F.col("field_name").alias("name"),
        F.when(kind == "portableText", "array").otherwise(kind).alias("type"),
        F.col("field_name").alias("title"),
        F.when(kind == "portableText", F.array(F.struct(F.lit("block").alias("type"), none.cast(target).alias("to"))))
        .when((kind == "array") & (F.size(of) > 0), members)
        .otherwise(none).cast(member).alias("of"),
        F.when((kind == "reference") & (F.size(to) > 0), targets).alias("to"),
        inner.alias("fields"),
    )


def compile_schema(types: DataFrame, fields: DataFrame) -> DataFrame:
    """One schema JSON per type, and stubs for standard blocks the site does not define itself."""
    key = ["site", "version"]
    lists = fields.groupBy(*key, F.col("type_name").alias("name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", _field_json().alias("f")))), lambda s: s["f"]).alias("fs")
    )
    whole = F.struct(
        "name", F.coalesce(F.nullif("title", F.lit("")), F.col("name")).alias("title"),
        F.when(F.col("kind") == "object", "object").otherwise("document").alias("type"),
        F.col("fs").alias("fields"),
    )
    default = F.struct(
        "name", F.coalesce(F.nullif("title", F.lit("")), F.col("name")).alias("title"),
        F.when(F.col("kind") == "object", "object").otherwise("document").alias("type"),
        F.array(F.struct(F.lit("title").alias("name"), F.lit("string").alias("type"))).alias("fields"),
    )
    own = types.join(lists, [*key, "name"], "left").select(
        *key, "name", F.when(F.col("fs").isNull(), F.to_json(default)).otherwise(F.to_json(whole)).alias("schema"), F.lit(False).alias("stub")
    )
    field = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))
    stub_fields = F.when(F.col("name") == "link", F.array(field("label", "string"), field("href", "url"))).otherwise(
        F.array(field("placeholder", "string"))
    )
    stub = F.struct(
        "name", F.when(F.col("name") == "link", "Link").otherwise(F.col("name")).alias("title"), F.lit("object").alias("type"),
        stub_fields.alias("fields"),
    )
    wanted = types.select(*key).distinct().withColumn("name", F.explode(_names(BLOCK_MATCH_NAMES)))
    stubs = wanted.join(types.select(*key, "name"), [*key, "name"], "left_anti").select(
        *key, "name", F.to_json(stub).alias("schema"), F.lit(True).alias("stub")
    )
    return own.unionByName(stubs)


def target_manifest(types: DataFrame) -> DataFrame:
    """Standard block types plus the site's own types whose names they do not take."""
    key = ["site", "version"]
    standard = types.select(*key).distinct().withColumn("name", F.explode(_names([*STANDARD_BLOCKS, "link", "page", "siteSettings", "redirect"])))
    own = types.select(*key, "name").distinct().join(standard, [*key, "name"], "left_anti")
    return standard.withColumn("origin", F.lit("standard")).unionByName(own.withColumn("origin", F.lit("site")))


def human_decisions(types: DataFrame) -> DataFrame:
    """Drop and merge decisions a person made, to carry to the next version."""
    merge = (F.col("decision") == "merge") & (F.coalesce("merge_into", F.lit("")) != "")
    return types.filter((F.col("decision") == "drop") | merge).select(
        "site", "version", F.col("decision").alias("kind"), "name", F.when(merge, F.col("merge_into")).alias("into")
    )


def apply_decisions(types: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edits of a proposal: rename, retitle, re-match, decide. Accepted versions stay frozen.

    ``decisions``: site, version, name, new_name, new_title, new_block_match, decision, merge_into.
    ``types`` may carry ``accepted_at``.
    """
    frozen = F.col("accepted_at").isNotNull() if "accepted_at" in types.columns else F.lit(False)
    d = decisions.select(
        "site", "version", "name", "new_name", "new_title", "new_block_match", F.col("decision").alias("_d"),
        F.col("merge_into").alias("_m"),
    )
    out = types.join(d, ["site", "version", "name"], "left").withColumn("_open", ~frozen)
    edit = lambda new, old: F.when(F.col("_open"), F.coalesce(new, old)).otherwise(F.col(old))
    return out.select(
        *[c for c in types.columns if c not in ("name", "title", "block_match", "decision", "merge_into")],
        edit("new_name", "name").alias("name"), edit("new_title", "title").alias("title"),
        edit("new_block_match", "block_match").alias("block_match"), edit("_d", "decision").alias("decision"),
        F.when(F.col("_open") & F.col("_d").isNotNull(), F.when(F.col("_d") == "merge", F.col("_m"))).otherwise(F.col("merge_into")).alias("merge_into"),
    )


def low_confidence_types(types: DataFrame, below: float = LOW_CONFIDENCE, top: int | None = None) -> DataFrame:
    """Undecided weak types with their place in the site, weakest first; the first ``top`` where given."""
    weak = types.filter((F.col("confidence") < below) & ~F.coalesce("decision", F.lit("keep")).isin("drop"))
    nth = F.row_number().over(W.partitionBy("site").orderBy("confidence", "name"))
    placed = weak.withColumn("n", nth)
    return placed if top is None else placed.filter(F.col("n") <= top)


def type_changes(cur: DataFrame, prior: DataFrame) -> DataFrame:
    """(site, name, change) with change added or removed."""
    a = cur.select("site", "name", F.lit(True).alias("c")).distinct()
    b = prior.select("site", "name", F.lit(True).alias("p")).distinct()
    both = a.join(b, ["site", "name"], "full_outer").filter("c is null or p is null")
    return both.select("site", "name", F.when(F.col("p").isNull(), "added").otherwise("removed").alias("change"))


def field_changes(cur_fields: DataFrame, prior_fields: DataFrame, cur: DataFrame, prior: DataFrame) -> DataFrame:
    """Fields of types in both versions that appeared, went, or changed type or required."""
    common = cur.select("site", "name").distinct().join(prior.select("site", "name").distinct(), ["site", "name"])
    pick = lambda f, p: f.select(
        "site", F.col("type_name").alias("name"), "field_name", F.struct("field_type", "required").alias(p)
    )
    both = pick(cur_fields, "a").join(pick(prior_fields, "b"), ["site", "name", "field_name"], "full_outer")
    return both.join(common, ["site", "name"], "left_semi").filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "site", "name", "field_name"
    )


def diff_versions(cur: DataFrame, prior: DataFrame, cur_fields: DataFrame, prior_fields: DataFrame) -> DataFrame:
    """Per site: added, removed, changed fields and the summary line."""
    sizes = cur.groupBy("site").agg(F.count("*").alias("types"))
    had = prior.groupBy("site").agg(F.count("*").alias("prior_types"))
    t = type_changes(cur, prior).groupBy("site").agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")
    )
    f = field_changes(cur_fields, prior_fields, cur, prior).groupBy("site").agg(F.count("*").alias("fields_changed"))
    zero = F.lit(0).cast("long")
    out = sizes.join(had, "site", "left").join(t, "site", "left").join(f, "site", "left").select(
        "site", "types", "prior_types", *[F.coalesce(c, zero).alias(c) for c in ("added", "removed", "fields_changed")]
    )
    delta = F.col("added") - F.col("removed")
    one = F.when(F.abs(delta) == 1, " type").otherwise(" types")
    type_part = F.when(delta == 0, F.concat(F.col("types").cast("string"), F.lit(" types"))).otherwise(
        F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string"), one)
    )
    n = F.col("fields_changed")
    field_part = F.when(n == 0, "no field changes").otherwise(F.concat(X.plural(n, "field"), F.lit(" changed")))
    first = F.concat(F.lit("First model · "), X.plural("types", "type"))
    return out.withColumn(
        "summary", F.when(F.col("prior_types").isNull(), first).otherwise(F.concat(type_part, F.lit(", "), field_part))
    ).drop("prior_types")


def merge_hints(types: DataFrame, fields: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Visible type pairs of a site whose field names overlap (Jaccard ≥ threshold).

    Prefix filter: pairs above the threshold share one of the rarest
    n − ceil(threshold·n) + 1 fields of each side, so common fields never produce pairs.
    """
    shown = types.filter(~F.coalesce("decision", F.lit("keep")).isin("drop", "merge")).select("site", "name").distinct()
    rows = fields.select("site", F.col("type_name").alias("name"), "field_name").distinct().join(shown, ["site", "name"], "left_semi")
    freq = rows.groupBy("field_name").agg(F.count("*").alias("df"))
    sets = rows.join(freq, "field_name").groupBy("site", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "field_name"))), lambda s: s["field_name"]).alias("fs")
    )
    size = F.size("fs")
    prefix = F.slice("fs", F.lit(1), (size - F.ceil(F.lit(threshold) * size) + 1).cast("int"))
    probe = sets.select("site", "name", "fs", F.explode(prefix).alias("key"))
    left = probe.select("site", "key", F.col("name").alias("a"), F.col("fs").alias("fa"))
    right = probe.select("site", "key", F.col("name").alias("b"), F.col("fs").alias("fb"))
    pairs = left.join(right, ["site", "key"]).filter("a < b").select("site", "a", "b", "fa", "fb").distinct()
    common = F.size(F.array_intersect("fa", "fb"))
    overlap = common / (F.size("fa") + F.size("fb") - common)
    return pairs.withColumn("overlap", overlap).filter(F.col("overlap") >= threshold).select(
        "site", "a", "b", F.round("overlap", 6).alias("overlap")
    )


def type_nodes(types: DataFrame, fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """Visible types with their node class and evidence score."""
    match = F.coalesce("block_match", F.lit("")) != ""
    node = (
        F.when(F.col("kind") == "singleton", "singleton")
        .when((F.col("kind") == "object") | (match & (F.col("kind") != "document")), F.when(match, "block").otherwise("object"))
        .otherwise("document")
    )
    key = ["site", "version", "name"]
    shown = types.filter(~F.coalesce("decision", F.lit("keep")).isin("drop", "merge"))
    e = evidence.groupBy("site", "version", F.col("type_name").alias("name")).agg(F.count("*").alias("_e"))
    f = fields.groupBy("site", "version", F.col("type_name").alias("name")).agg(F.sum("evidence_count").alias("_f"))
    zero = F.lit(0).cast("long")
    return shown.join(e, key, "left").join(f, key, "left").select(
        *key, node.alias("node"), F.greatest(F.coalesce("_e", zero), F.coalesce("_f", zero)).alias("score")
    )


def type_edges(types: DataFrame, fields: DataFrame) -> DataFrame:
    """Edges between visible types from ``to`` and ``of``: style body, chrome or ref."""
    shown = types.filter(~F.coalesce("decision", F.lit("keep")).isin("drop", "merge")).select("site", "version", "name").distinct()
    empty = F.expr("cast(array() as array<string>)")
    of, to = F.coalesce("of", empty), F.coalesce("to", empty)
    body = (F.col("field_name") == "body") | (
        (F.col("field_type") == "array") & F.exists(of, lambda m: m != "reference")
    )
    rows = fields.select(
        "site", "version", F.col("type_name").alias("source"), "field_name", body.alias("_body"), F.explode(F.concat(to, of)).alias("target")
    ).filter(F.col("target") != F.col("source"))
    named = lambda c: shown.select("site", "version", F.col("name").alias(c))
    rows = rows.join(named("source"), ["site", "version", "source"], "left_semi").join(
        named("target"), ["site", "version", "target"], "left_semi"
    )
    style = F.when(F.col("_body"), "body").when(F.col("target") == "siteSettings", "chrome").otherwise("ref")
    return rows.select("site", "version", "source", "target", "field_name", style.alias("style"))


def infer_collections(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """A document type per cluster of at least three pages of one shape, with its pages counted.

    ``clusters``/``members``: ``shape_clusters`` and ``cluster_pages``. The pages themselves are
    the evidence rows of ``members``.
    """
    sizes = members.groupBy("site", "prefix", "cluster").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
    shape = clusters.groupBy("site", "prefix", "cluster").agg(F.min(F.array_join("signature", ",")).alias("signature"))
    words = F.regexp_replace(F.trim(F.regexp_replace("prefix", "[^a-zA-Z0-9]+", " ")), "^$", "page")
    camel = F.regexp_replace(F.initcap(words), " ", "")
    base = F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, F.lit(2), F.length(camel)))
    name = F.concat(base, F.when(F.col("cluster") > 0, (F.col("cluster") + 1).cast("string")).otherwise(""))
    return sizes.join(shape, ["site", "prefix", "cluster"]).select(
        "site", name.alias("name"), F.lit("document").alias("kind"), "prefix", "cluster", "signature", "pages", "first_page"
    )


def infer_field_rules(values: DataFrame) -> DataFrame:
    """Per (site, type, field): evidence, required when on 90 % of the documents, longest text × 1.2.

    ``values``: site, type_name, field_name, value (null when absent).
    """
    present = F.coalesce(F.trim("value") != "", F.lit(False))
    return values.groupBy("site", "type_name", "field_name").agg(
        F.count_if(present).alias("evidence_count"),
        (F.avg(present.cast("double")) >= 0.9).alias("required"),
        F.ceil(F.max(F.when(present, F.length("value"))) * F.lit(12) / F.lit(10)).cast("long").alias("max_length"),
    )


def usage_totals(proposals: DataFrame) -> DataFrame:
    """Tokens in and out and repair rounds per site and model."""
    return proposals.groupBy("site", "model").agg(
        F.count("*").alias("versions"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("repair_rounds").alias("repair_rounds"),
    )


def model_input_batch(records: DataFrame, pages: int | None = None, chars: int | None = None, batch: int = 40) -> DataFrame:
    """Export for an outside model: the live pages of a site as JSON rows, numbered and dealt to batches of ``batch`` pages.

    Every page with its whole text, or the first ``pages`` pages and ``chars`` characters where given.
    """
    live = records.filter(F.coalesce("http_status", F.lit(200)) < 400)
    nth = F.row_number().over(W.partitionBy("site").orderBy("page_id"))
    text = corpus() if chars is None else F.substring(corpus(), 1, chars)
    # pages are numbered by id alone: their texts stay out of the sort by site
    placed = live.select("site", "page_id").withColumn("n", nth)
    if pages is not None:
        placed = placed.filter(F.col("n") <= pages)
    rows = live.select("site", "page_id", U.page_path("path", "url").alias("path"), "url", "title", text.alias("text"))
    payload = F.to_json(F.struct(F.col("page_id").alias("pageId"), "path", "url", "title", "text"))
    return rows.select("site", "page_id", payload.alias("payload")).join(placed, ["site", "page_id"]).select(
        "site", "page_id", "n", F.ceil(F.col("n") / batch).cast("int").alias("batch"), "payload"
    )


def document_violations(docs: DataFrame) -> DataFrame:
    """Block and document rules as one explode of predicates: site, doc_id, rule.

    Rules look only at columns the table has, so block, page, redirect and working tables can
    be checked separately or as one wide table.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    over = lambda c, n: F.length(c) > n
    outside = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    is_ = lambda t: F.col("doc_type") == t
    rules: list[tuple[str, set[str], Column]] = [
        ("hero heading required", {"heading"}, is_("hero") & blank("heading") if "heading" in docs.columns else F.lit(False)),
        ("hero heading over 90", {"heading"}, is_("hero") & over("heading", 90)),
        ("hero subheading over 240", {"subheading"}, is_("hero") & over("subheading", 240)),
        ("image without alt", {"image_src", "image_alt"}, ~blank("image_src") & blank("image_alt")),
        ("page title required", {"title"}, is_("page") & blank("title")),
        ("page slug required", {"slug"}, is_("page") & blank("slug")),
        ("seoTitle over 60", {"seo_title"}, over("seo_title", 60)),
        ("seoDescription over 155", {"seo_description"}, over("seo_description", 155)),
        ("cards and items together", {"cards", "items"}, is_("cardGrid") & ((F.col("cards") > 0) == (F.col("items") > 0))),
        ("link needs href or internal", {"link_href", "link_internal"}, is_("link") & (blank("link_href") == blank("link_internal"))),
        ("redirect code outside 301-308", {"status_code"}, is_("redirect") & outside("status_code", 301, 308)),
        ("status outside 100-599", {"http_status"}, outside("http_status", 100, 599)),
        ("confidence outside 0-1", {"confidence"}, outside("confidence", 0, 1)),
        ("page cap outside 1-200", {"page_cap"}, outside("page_cap", 1, 200)),
    ]
    usable = [F.when(cond, F.lit(rule)) for rule, needs, cond in rules if needs <= set(docs.columns)]
    return docs.select("site", "doc_id", "doc_type", F.explode(F.array_compact(F.array(*usable))).alias("rule"))
