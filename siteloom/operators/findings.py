"""Review findings: rule-based questions about a site and the evidence behind them.

Questions are one table; their evidence (and the values of a contradiction) are long tables
keyed by (site, fingerprint), because a finding can touch any number of pages. Nothing here
collects the pages of a site: members enter a fingerprint through an order-free digest, and
samples come from top-k windows that Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.operators.extract import corpus, images_without_alt
from siteloom.session import stored

# Nouns of the contact kinds that must agree across a site.
CONTACT_KINDS = {"phones": "phone number", "emails": "email", "addresses": "address"}
# Pages that speak for the whole site.
KEY_PAGE = r"(?i)^/(?:(?:contact|about)(?:-us)?/?)?$"
# Placeholder phrases, in order of preference.
BOILERPLATE = [
    "Welcome to our website",
    "Lorem ipsum",
    "dolor sit amet",
    "Your trusted partner",
    "Coming soon",
    "Under construction",
    "This is a sample",
    "Replace this text",
    "Click here to learn more",
    "We are a leading provider",
    "Insert your content here",
    "Placeholder text",
    "Your company name",
    "Add your content",
    "Dummy text",
]
# Score of a question without a rank, by kind.
KIND_FLOOR = {"contradiction": 100, "authenticity": 90, "mapping": 70, "missing-info": 55, "keep-or-kill": 45}
# Answer options by finding.
OPTIONS = {
    "missing-meta": ["Yes — generate meta descriptions", "No — leave them empty", "Only for key pages"],
    "missing-alt": ["Yes — generate alt text", "No — skip images without alt", "Only hero images"],
    "http-error": ["Drop this page", "Keep as a soft 404 / stub", "Redirect elsewhere (note where)"],
    "thin": ["Keep as-is", "Merge into another page", "Kill this page"],
    "boilerplate": ["Rewrite all boilerplate", "Keep — it is intentional", "Rewrite only the worst offenders"],
}
NONE_OF_THESE = "None of these — I will clarify"
THIN_WORDS = 60

QUESTION_COLUMNS = [
    "site", "fingerprint", "finding", "key", "kind", "prompt", "options", "required", "source", "spawns_tasks", "rank", "pages",
]


def evidence_excerpt(preferred: Column | None = None) -> Column:
    """Text proving a finding: preferred value if present, title, first 80 characters, or the path.

    Needs the columns corpus, title and path.
    """
    text = F.col("corpus")
    first = F.substring(X.collapse(text), 1, 80)
    options = []
    if preferred is not None:
        options.append(F.when((preferred != "") & text.contains(preferred), preferred))
    options += [
        F.when((F.col("title") != "") & text.contains(F.col("title")), F.col("title")),
        F.when((first != "") & text.contains(first), first),
        F.nullif(F.substring(F.regexp_extract(text, r"([^\n]{8,})", 1), 1, 80), F.lit("")),
        F.col("title"),
        F.col("path"),
    ]
    return F.coalesce(*options)


def normalise_value(kind: Column, value: Column) -> Column:
    """Phones compare by digits, the rest by lower case and single blanks."""
    return F.when(kind == "phones", F.regexp_replace(value, r"\D", "")).otherwise(
        F.regexp_replace(F.lower(value), r"\s+", " ")
    )


def _value_hits(entities: DataFrame) -> DataFrame:
    """One row per (site, kind, key, page); entities: site, page_id, path, url, kind, value."""
    hits = (
        entities.filter(F.col("kind").isin(*CONTACT_KINDS))
        .withColumn("key", normalise_value(F.col("kind"), F.trim("value")))
        .filter("key <> ''")
    )
    return hits.groupBy("site", "kind", "key", "page_id").agg(
        F.min(F.trim("value")).alias("raw"), F.min("path").alias("path"), F.min("url").alias("url")
    )


def contradiction_values(entities: DataFrame) -> DataFrame:
    """Site-level values of kinds that have at least two: site, kind, key, label, hits, values.

    A value is site-level on two pages or on a key page. Counts combine before each shuffle:
    (key, raw form) first, then the key, then the kind.
    """
    by_raw = _value_hits(entities).groupBy("site", "kind", "key", "raw").agg(
        F.count("*").alias("n"), F.bool_or(F.col("path").rlike(KEY_PAGE)).alias("on_key_page")
    )
    by_key = by_raw.groupBy("site", "kind", "key").agg(
        F.sum("n").alias("hits"),
        F.bool_or("on_key_page").alias("on_key_page"),
        F.min(F.struct((-F.col("n")).alias("o"), "raw"))["raw"].alias("label"),
    )
    level = by_key.filter((F.col("hits") >= 2) | F.col("on_key_page"))
    kinds = level.groupBy("site", "kind").agg(F.count("*").alias("values")).filter("values >= 2")
    return level.join(kinds, ["site", "kind"]).select("site", "kind", "key", "label", "hits", "values")


def contradictions(entities: DataFrame, listed: int | None = None) -> DataFrame:
    """One required question per (site, kind) with conflicting site-level values.

    Prompt and options hold every value, most used first; with ``listed`` the prompt names only that many
    and how many more there are. ``contradiction_values`` has them as rows.
    """
    values = contradiction_values(entities)
    labels = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "label"))), lambda s: s["label"])
    totals = values.groupBy("site", "kind").agg(F.sum("hits").alias("pages"), X.set_digest(F.col("label")).alias("digest"), labels.alias("labels"))
    named = F.col("labels") if listed is None else F.slice("labels", 1, listed)
    nouns = F.create_map(*[F.lit(v) for kv in CONTACT_KINDS.items() for v in kv])
    quoted = F.array_join(F.transform(named, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    more = F.size("labels") - F.size(named)
    prompt = F.concat(
        F.lit("This site lists different "), nouns[F.col("kind")], F.lit("s across pages: "), quoted,
        F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""),
        F.lit(". Which is correct?"),
    )
    return totals.select(
        "site",
        X.fingerprint(F.lit("contradiction"), F.col("kind"), F.col("digest")).alias("fingerprint"),
        F.concat(F.lit("contradiction-"), F.col("kind")).alias("finding"),
        F.lit("").alias("key"),
        F.lit("contradiction").alias("kind"),
        prompt.alias("prompt"),
        F.concat("labels", F.array(F.lit(NONE_OF_THESE))).alias("options"),
        F.lit(True).alias("required"),
        F.lit("rule").alias("source"),
        F.lit(True).alias("spawns_tasks"),
        F.lit(100).alias("rank"),
        "pages",
    )


def contradiction_evidence(entities: DataFrame, pages: int | None = None) -> DataFrame:
    """The pages of every site-level value, or its first ``pages``: site, finding, label, page_id, url, excerpt."""
    hits = _value_hits(entities)
    if pages is not None:
        hits = hits.withColumn("_n", F.row_number().over(W.partitionBy("site", "kind", "key").orderBy("page_id"))).filter(F.col("_n") <= pages)
    return hits.join(contradiction_values(entities).select("site", "kind", "key", "label"), ["site", "kind", "key"]).select(
        "site", F.concat(F.lit("contradiction-"), F.col("kind")).alias("finding"), "label", "page_id", "url", F.col("raw").alias("excerpt"),
    )


def page_signals(records: DataFrame, phrases: list[str] = BOILERPLATE) -> DataFrame:
    """One narrow row per page with everything the page-level rules look at (a single pass).

    ``records`` has ``html`` or is an extraction that holds the number of ``bad_images``.
    """
    bad_images = F.col("bad_images") if "bad_images" in records.columns else images_without_alt(F.col("html"))
    base = records.select(
        "site", "page_id", U.page_path("path", "url").alias("path"), "url",
        F.coalesce("http_status", F.lit(200)).alias("http_status"), "title",
        corpus().alias("corpus"),
        F.coalesce(F.trim("description"), F.lit("")).alias("_desc"),
        bad_images.alias("bad_images"),
    ).withColumn("_lower", F.lower("corpus"))
    phrase = F.coalesce(*[F.when(F.instr("_lower", p.lower()) > 0, F.lit(p)) for p in phrases])
    base = base.withColumn("phrase", phrase)
    return base.select(
        "site", "page_id", "path", "url", "http_status", "title",
        X.word_count("corpus").alias("words"),
        (F.col("_desc") == "").alias("no_description"),
        "bad_images", "phrase",
        F.substring("corpus", F.instr("_lower", F.lower("phrase")), F.length("phrase")).alias("phrase_excerpt"),
        evidence_excerpt().alias("excerpt"),
    )


def signal_rows(signals: DataFrame) -> DataFrame:
    """Explode a page's signals into (site, finding, key, page, …) rows for one shared group-by."""
    live = F.col("http_status") < 400

    def row(cond: Column, finding: str, key: Column, excerpt: Column) -> Column:
        return F.when(
            cond,
            F.struct(F.lit(finding).alias("finding"), key.alias("key"), excerpt.alias("excerpt")),
        )

    shown = F.array(
        row(live & F.col("phrase").isNotNull(), "boilerplate", F.lit(""), F.col("phrase_excerpt")),
        row(~live, "http-error", F.col("page_id").cast("string"), F.col("excerpt")),
        row(live & F.col("no_description"), "missing-meta", F.lit(""), F.col("excerpt")),
        row(live & (F.col("bad_images") > 0), "missing-alt", F.lit(""), F.col("excerpt")),
        row(live & (F.col("words") > 0) & (F.col("words") < THIN_WORDS), "thin", F.col("path"), F.col("excerpt")),
    )
    return signals.select(
        "site", "page_id", "path", "url", "http_status", "words", "bad_images", "phrase",
        F.explode(F.filter(shown, lambda s: s.isNotNull())).alias("s"),
    ).select(
        "site", "s.finding", "s.key", "page_id", "path", "url", "http_status", "words", "bad_images", "phrase", "s.excerpt"
    )


def sample_rows(rows: DataFrame, pages: int) -> DataFrame:
    """First ``pages`` pages of each finding."""
    nth = F.row_number().over(W.partitionBy("site", "finding", "key").orderBy("page_id"))
    return rows.withColumn("ord", nth).filter(F.col("ord") <= pages)


def page_questions(rows: DataFrame) -> DataFrame:
    """Questions of the page-level findings (``signal_rows`` in, QUESTION_COLUMNS out).

    Totals and samples both read the rows, so these are stored: pages are extracted once.
    """
    rows = stored(rows, "signals")
    totals = rows.groupBy("site", "finding", "key").agg(
        F.count("*").alias("pages"),
        F.sum("bad_images").alias("images"),
        F.max("words").alias("words"),
        F.max("http_status").alias("status"),
        # at most as many phrases as the fixed list holds
        F.array_sort(F.collect_set("phrase")).alias("phrases"),
        X.set_digest(F.col("page_id")).alias("digest"),
        F.min("path").alias("path"),
    )
    samples = sample_rows(rows, 3).groupBy("site", "finding", "key").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]), ", "
        ).alias("sample")
    )
    q = totals.join(samples, ["site", "finding", "key"])
    n = F.col("pages").cast("string")
    is_ = lambda f: F.col("finding") == f
    quoted = F.array_join(F.transform("phrases", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", ")
    variants = F.when(F.col("pages") > 1, F.concat(F.lit(" ("), n, F.lit(" URL variants)"))).otherwise("")
    prompt = (
        F.when(is_("missing-meta"), F.concat(n, F.lit(" page(s) have no meta description (e.g. "), F.col("sample"),
               F.lit("). Should we generate SEO descriptions during the clean-up?")))
        .when(is_("missing-alt"), F.concat(F.col("images").cast("string"), F.lit(" image(s) on "), n,
              F.lit(" page(s) lack alt text. Generate alt text in the clean-up?")))
        .when(is_("http-error"), F.concat(F.col("path"), F.lit(" returned HTTP "), F.col("status").cast("string"),
              F.lit(". Keep a stub redirect target, or drop it from the new site?")))
        .when(is_("thin"), F.concat(F.col("path"), F.lit(" has only "), F.col("words").cast("string"), F.lit(" words"),
              variants, F.lit(". Keep it, merge into another page, or kill it?")))
        .otherwise(F.concat(F.lit("Placeholder / theme boilerplate detected ("), quoted, F.lit(") on "), n,
                   F.lit(" page(s). Is this authentic copy to keep, or should it be rewritten?")))
    )
    ident = (
        F.when(is_("http-error"), F.concat_ws(X.NUL, "finding", "key", F.col("status").cast("string")))
        .when(is_("thin"), F.concat_ws(X.NUL, "finding", "key", "digest"))
        .when(is_("boilerplate"), F.concat_ws(X.NUL, F.col("finding"), F.col("phrases"), F.col("digest")))
        .otherwise(F.concat_ws(X.NUL, "finding", "digest"))
    )
    kind = (
        F.when(is_("boilerplate"), "authenticity").when(F.col("finding").isin("missing-meta", "missing-alt"), "missing-info")
        .otherwise("keep-or-kill")
    )
    rank = F.create_map(
        *[F.lit(v) for kv in {"boilerplate": 95, "http-error": 80, "missing-meta": 55, "missing-alt": 50, "thin": 40}.items() for v in kv]
    )
    options = F.create_map(
        *[c for k, v in OPTIONS.items() for c in (F.lit(k), F.array(*[F.lit(o) for o in v]))]
    )
    return q.select(
        "site", X.fingerprint(ident).alias("fingerprint"), "finding", "key", kind.alias("kind"), prompt.alias("prompt"),
        options[F.col("finding")].alias("options"), is_("boilerplate").alias("required"), F.lit("rule").alias("source"),
        F.lit(True).alias("spawns_tasks"), rank[F.col("finding")].alias("rank"), "pages",
    )


def finding_questions(signals: DataFrame, *findings: str) -> DataFrame:
    """Questions of the chosen page-level findings."""
    return page_questions(signal_rows(signals).filter(F.col("finding").isin(*findings)))


def collect_findings(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """All rule findings with their sequence: contradictions, boilerplate, errors, meta, alt, thin."""
    order = ["boilerplate", "http-error", "missing-meta", "missing-alt", "thin"]
    seq = F.create_map(*[F.lit(v) for i, f in enumerate(order) for v in (f, i + 2)])
    found = contradictions(entities).unionByName(page_questions(signal_rows(signals)))
    return found.select(*QUESTION_COLUMNS, F.coalesce(seq[F.col("finding")], F.lit(1)).alias("seq"))


def page_evidence(rows: DataFrame, pages: int | None = None) -> DataFrame:
    """Evidence of page-level findings, all pages or the first ``pages`` of each: site, finding, key, page_id, url, excerpt."""
    shown = rows if pages is None else sample_rows(rows, pages)
    return shown.select("site", "finding", "key", "page_id", "url", "excerpt")


def with_fingerprint(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Attach the question id to evidence rows."""
    return evidence.join(questions.select("site", "finding", "key", "fingerprint"), ["site", "finding", "key"])


def filter_question_evidence(evidence: DataFrame, corpora: DataFrame) -> DataFrame:
    """Evidence rows whose excerpt occurs verbatim in the page's text."""
    joined = evidence.join(corpora.select("site", "page_id", "corpus"), ["site", "page_id"])
    return joined.filter((F.length("excerpt") > 0) & F.col("corpus").contains(F.col("excerpt"))).drop("corpus")


def questions_with_evidence(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    return questions.join(evidence.select("site", "fingerprint").distinct(), ["site", "fingerprint"], "left_semi")


def rank_score() -> Column:
    """Rank, or the floor of the kind where the rank is 0 or missing."""
    floors = F.create_map(*[F.lit(v) for kv in KIND_FLOOR.items() for v in kv])
    return F.coalesce(F.nullif(F.col("rank"), F.lit(0)), floors[F.col("kind")], F.lit(0))


def drop_overlapping(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drop an optional keep-or-kill question whose pages another one covers.

    The wider one is earlier in (page count desc, score desc, fingerprint). Being a subset is
    transitive, so "covered by a kept question" equals "covered by an earlier one". A set
    can only be covered by sets that hold its rarest path, so candidates come from an
    equi-join on that path after questions with equal sets were folded to the earliest.
    """
    kok = questions.filter("kind = 'keep-or-kill'").select("site", "fingerprint", "required", rank_score().alias("score"))
    paths = evidence.select("site", "fingerprint", U.path_of("url").alias("path")).distinct()
    paths = paths.join(kok.select("site", "fingerprint"), ["site", "fingerprint"], "left_semi")
    freq = paths.groupBy("site", "path").agg(F.count("*").alias("df"))
    sets = paths.join(freq, ["site", "path"]).groupBy("site", "fingerprint").agg(
        F.count("*").alias("n"), X.set_digest(F.col("path")).alias("digest"), F.min(F.struct("df", "path"))["path"].alias("rarest")
    ).join(kok, ["site", "fingerprint"])
    sets = sets.withColumn("ord", F.struct((-F.col("n")).alias("a"), (-F.col("score")).alias("b"), F.col("fingerprint").alias("c")))
    folded = sets.groupBy("site", "n", "digest", "rarest").agg(F.min("ord").alias("first_ord"))
    equal_dropped = sets.join(folded, ["site", "n", "digest", "rarest"]).filter(
        (F.col("ord") > F.col("first_ord")) & ~F.col("required")
    ).select("site", "fingerprint")
    # one question stands for each set; its paths stay rows
    heads = folded.select("site", F.col("first_ord.c").alias("fingerprint"), "n", "digest", "rarest")
    rows = paths.join(heads.select("site", "fingerprint", "n"), ["site", "fingerprint"])
    wide = rows.select("site", F.col("path").alias("rarest"), F.col("fingerprint").alias("wide"), F.col("n").alias("wide_n"))
    pairs = heads.join(wide, ["site", "rarest"]).filter("wide_n > n").select("site", "fingerprint", "digest", "n", "wide")
    common = pairs.join(paths, ["site", "fingerprint"]).join(rows.select("site", F.col("fingerprint").alias("wide"), "path"), ["site", "wide", "path"])
    covered = common.groupBy("site", "digest", "n", "wide").agg(F.count("*").alias("held")).filter("held = n").select("site", "digest", "n").distinct()
    sub_dropped = sets.join(covered, ["site", "digest", "n"], "left_semi").filter(~F.col("required")).select("site", "fingerprint")
    return questions.join(equal_dropped.unionByName(sub_dropped).distinct(), ["site", "fingerprint"], "left_anti")


def first_per_fingerprint(questions: DataFrame) -> DataFrame:
    """First row (by seq) of every (site, fingerprint)."""
    rest = [c for c in questions.columns if c not in ("site", "fingerprint")]
    return questions.groupBy("site", "fingerprint").agg(F.min_by(F.struct(*rest), "seq").alias("q")).select(
        "site", "fingerprint", "q.*"
    )


def rank_questions(questions: DataFrame, evidence: DataFrame, cap: int | None = None) -> DataFrame:
    """Unique, not overlapping, required first, best score first; at most ``cap`` per site where given."""
    unique = drop_overlapping(first_per_fingerprint(questions), evidence).withColumn("score", rank_score())
    place = F.row_number().over(
        W.partitionBy("site").orderBy(F.desc("required"), F.desc("score"), "fingerprint")
    )
    placed = unique.withColumn("place", place)
    return placed if cap is None else placed.filter(F.col("place") <= cap)


def strip_doc_ids(prompt: Column) -> Column:
    """Remove lists of ids in parentheses and doubled blanks."""
    return F.trim(
        F.regexp_replace(
            F.regexp_replace(prompt, r"\s*\((?:\s*[A-Za-z0-9._-]{20,}\s*,?)+\)", ""), r"\s{2,}", " "
        )
    )


def is_answered() -> Column:
    return F.coalesce(F.trim("answer") != "", F.lit(False))


def question_counts(questions: DataFrame) -> DataFrame:
    """total, answered, required_left, optional_left per site."""
    req = F.coalesce("required", F.lit(False))
    return questions.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count_if(is_answered()).alias("answered"),
        F.count_if(req & ~is_answered()).alias("required_left"),
        F.count_if(~req & ~is_answered()).alias("optional_left"),
    )


def short_label(prompt: Column, limit: int = 64) -> Column:
    """First sentence, cut with an ellipsis beyond 64 characters."""
    text = X.collapse(F.coalesce(prompt, F.lit("")))
    sentence = F.coalesce(F.nullif(F.regexp_extract(text, r"^(.+?[.?!])(?:\s|$)", 1), F.lit("")), text)
    cut = F.concat(F.rtrim(F.substring(sentence, 1, limit - 1)), F.lit("…"))
    return F.when(text == "", "Question").when(F.length(sentence) > limit, cut).otherwise(sentence)


def order_questions(questions: DataFrame) -> DataFrame:
    """Adds ``label`` and the sort keys of the review list: required first, input order next."""
    return questions.withColumns(
        {
            "label": short_label(F.col("prompt")),
            "group": F.when(F.coalesce("required", F.lit(False)), 0).otherwise(1),
        }
    )


def evidence_path(path: Column, url: Column) -> Column:
    """Path and query of an evidence URL for display."""
    query = U.query_of(url)
    shown = F.concat(U.path_of(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return (
        F.when(F.coalesce(path, F.lit("")) != "", path)
        .when(F.coalesce(url, F.lit("")) == "", "page")
        .when(U.authority_of(url) != "", shown)
        .otherwise(url)
    )


def site_question_gate(questions: DataFrame) -> DataFrame:
    """Open required questions per site; the review stage may end at 0."""
    open_ = F.count_if(F.coalesce("required", F.lit(False)) & ~is_answered())
    return questions.groupBy("site").agg(open_.alias("open_required")).withColumn(
        "may_advance", F.col("open_required") == 0
    )


def stale_pages(pages: DataFrame, before_year: int) -> DataFrame:
    """Pages whose latest copyright year lies before ``before_year``."""
    years = F.transform(
        F.regexp_extract_all(
            "html", F.lit(r"(?i)(?:&copy;|©|\(c\)|copyright)[^0-9<]{0,40}((?:19|20)[0-9]{2})\b"), F.lit(1)
        ),
        lambda y: y.cast("int"),
    )
    return pages.select("site", "page_id", F.array_max(years).alias("year")).filter(F.col("year") < before_year)


def sites_without_contact(pages: DataFrame) -> DataFrame:
    """Sites none of whose paths looks like a contact page."""
    return (
        pages.groupBy("site")
        .agg(F.bool_or(U.norm_path("path", "url").rlike(r"(?i)(^|/)contact")).alias("c"), F.count("*").alias("pages"))
        .filter(~F.col("c"))
        .select("site", "pages")
    )
