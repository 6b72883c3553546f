"""Queries over review findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import text as TX
from siteloom.functions import urls as U
from siteloom.operators import condense as C
from siteloom.operators import extract as X
from siteloom.operators import findings as Q
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans.registry import query
from siteloom.session import stored
from siteloom.sources import tables as T

PHRASES = ["Opening hours", "et des", "of the", "und der"]


def contact_entities(spark, d):
    """Entity rows of live documents that carry contact values."""
    docs = C.live_pages(V.rich_documents(spark, d)).drop("lang")
    return X.entity_rows(docs)


def values_sql(entities: str) -> str:
    """CTEs from ``en`` (site, page_id, path, url, kind, value) to site-level values."""
    return f"""{entities},
k AS (SELECT *, CASE kind WHEN 'phones' THEN regexp_replace(value, '[^0-9]', '', 'g')
             ELSE lower({D.squash('value')}) END AS key FROM en),
h AS (SELECT site, kind, key, page_id, min(value) AS raw, min(path) AS path, min(url) AS url FROM k WHERE key <> '' GROUP BY ALL),
rw AS (SELECT site, kind, key, raw, count(*) AS n, bool_or(path = '/contact') AS kp FROM h GROUP BY ALL),
kl AS (SELECT site, kind, key, sum(n)::BIGINT AS hits, bool_or(kp) AS kp, first(raw ORDER BY n DESC, raw) AS label FROM rw GROUP BY ALL),
lv AS (SELECT * FROM kl WHERE hits >= 2 OR kp),
cv AS (SELECT site, kind, key, label, hits, count(*) OVER (PARTITION BY site, kind) AS values FROM lv
       QUALIFY values >= 2)"""


VALUES = values_sql(
    f"{D.RE}, en AS (SELECT site, page_id, path, url, kind, value FROM de WHERE http_status < 400 AND kind <> 'prices')"
)


@query("contradiction_values", f"WITH {VALUES} SELECT * FROM cv", covers="F1")
def _(spark, d):
    return Q.contradiction_values(contact_entities(spark, d))


def contradictions_sql(values: str) -> str:
    return f"""{values}, ct AS (
  SELECT site, kind AS k, sum(hits)::BIGINT AS pages, {D.digest('label')} AS dg,
    string_agg('"' || label || '"', ', ' ORDER BY hits DESC, label) AS quoted,
    string_agg(label, '|' ORDER BY hits DESC, label) AS opts FROM cv GROUP BY ALL),
cq AS (SELECT site, {D.fp("'contradiction'", 'k', 'dg')} AS fingerprint, 'contradiction-' || k AS finding, '' AS key,
  'contradiction' AS kind,
  'This site lists different ' || CASE k WHEN 'phones' THEN 'phone number' WHEN 'emails' THEN 'email' ELSE 'address' END || 's across pages: ' || quoted ||
  '. Which is correct?' AS prompt, opts || '|None of these — I will clarify' AS options, true AS required, 'rule' AS source,
  true AS spawns_tasks, 100::INT AS rank, pages, 1::INT AS seq FROM ct)"""


CONTRA = contradictions_sql(VALUES)


def shown(df):
    return df.withColumn("options", F.array_join("options", "|"))


@query("contradictions", f"WITH {CONTRA} SELECT * EXCLUDE (seq) FROM cq", covers="F1")
def _(spark, d):
    return shown(Q.contradictions(contact_entities(spark, d)))


@query(
    "contradiction_evidence",
    f"""WITH {VALUES} SELECT site, 'contradiction-' || kind AS finding, label, page_id, url, raw AS excerpt FROM h JOIN cv USING (site, kind, key)""",
    covers="F1 F8",
)
def _(spark, d):
    return Q.contradiction_evidence(contact_entities(spark, d))


def rich_signals(spark, d):
    return Q.page_signals(X.page_records(V.rich_pages(spark, d)), PHRASES)


_PH = "['Opening hours', 'et des', 'of the', 'und der']"
SIG = f"""{D.RX}, sg AS (
  SELECT site, page_id, path, url, http_status, title, corpus, {D.words('corpus')} AS words,
    description IS NULL AS no_description, (page_id % 2)::BIGINT AS bad_images,
    list_filter({_PH}, lambda p: contains(lower(corpus), lower(p)))[1] AS phrase FROM rc),
sf AS (SELECT *, substr(corpus, instr(lower(corpus), lower(phrase)), length(phrase)) AS pe,
    CASE WHEN contains(corpus, title) THEN title ELSE path END AS excerpt FROM sg),
sr AS (
  SELECT site, 'boilerplate' AS finding, '' AS key, * EXCLUDE (site, excerpt), pe AS excerpt FROM sf WHERE http_status < 400 AND phrase IS NOT NULL
  UNION ALL SELECT site, 'http-error', page_id::VARCHAR, * EXCLUDE (site, excerpt), excerpt FROM sf WHERE http_status >= 400
  UNION ALL SELECT site, 'missing-meta', '', * EXCLUDE (site, excerpt), excerpt FROM sf WHERE http_status < 400 AND no_description
  UNION ALL SELECT site, 'missing-alt', '', * EXCLUDE (site, excerpt), excerpt FROM sf WHERE http_status < 400 AND bad_images > 0
  UNION ALL SELECT site, 'thin', path, * EXCLUDE (site, excerpt), excerpt FROM sf WHERE http_status < 400 AND words BETWEEN 1 AND 59),
sm AS (SELECT site, finding, key, page_id, path, url, excerpt,
         row_number() OVER (PARTITION BY site, finding, key ORDER BY page_id)::INT AS ord FROM sr),
st AS (SELECT site, finding, key, count(*) AS pages, sum(bad_images)::BIGINT AS images, max(words) AS words, max(http_status) AS status,
         string_agg(DISTINCT phrase, chr(0) ORDER BY phrase) AS ph0,
         string_agg(DISTINCT '"' || phrase || '"', ', ' ORDER BY '"' || phrase || '"') AS phq,
         {D.digest('page_id')} AS dg, min(path) AS path FROM sr GROUP BY ALL),
ss AS (SELECT site, finding, key, string_agg(path, ', ' ORDER BY ord) AS sample FROM sm WHERE ord <= 3 GROUP BY ALL),
pq AS (
  SELECT site,
    CASE finding WHEN 'http-error' THEN {D.fp('finding', 'key', 'status')} WHEN 'thin' THEN {D.fp('finding', 'key', 'dg')}
      WHEN 'boilerplate' THEN {D.fp('finding', 'ph0', 'dg')} ELSE {D.fp('finding', 'dg')} END AS fingerprint,
    finding, key,
    CASE finding WHEN 'boilerplate' THEN 'authenticity' WHEN 'missing-meta' THEN 'missing-info' WHEN 'missing-alt' THEN 'missing-info'
      ELSE 'keep-or-kill' END AS kind,
    CASE finding
      WHEN 'missing-meta' THEN pages || ' page(s) have no meta description (e.g. ' || sample || '). Should we generate SEO descriptions during the clean-up?'
      WHEN 'missing-alt' THEN images || ' image(s) on ' || pages || ' page(s) lack alt text. Generate alt text in the clean-up?'
      WHEN 'http-error' THEN path || ' returned HTTP ' || status || '. Keep a stub redirect target, or drop it from the new site?'
      WHEN 'thin' THEN path || ' has only ' || words || ' words' || CASE WHEN pages > 1 THEN ' (' || pages || ' URL variants)' ELSE '' END ||
        '. Keep it, merge into another page, or kill it?'
      ELSE 'Placeholder / theme boilerplate detected (' || phq || ') on ' || pages || ' page(s). Is this authentic copy to keep, or should it be rewritten?' END AS prompt,
    CASE finding
      WHEN 'missing-meta' THEN 'Yes — generate meta descriptions|No — leave them empty|Only for key pages'
      WHEN 'missing-alt' THEN 'Yes — generate alt text|No — skip images without alt|Only hero images'
      WHEN 'http-error' THEN 'Drop this page|Keep as a soft 404 / stub|Redirect elsewhere (note where)'
      WHEN 'thin' THEN 'Keep as-is|Merge into another page|Kill this page'
      ELSE 'Rewrite all boilerplate|Keep — it is intentional|Rewrite only the worst offenders' END AS options,
    finding = 'boilerplate' AS required, 'rule' AS source, true AS spawns_tasks,
    CASE finding WHEN 'boilerplate' THEN 95 WHEN 'http-error' THEN 80 WHEN 'missing-meta' THEN 55 WHEN 'missing-alt' THEN 50 ELSE 40 END::INT AS rank,
    pages,
    CASE finding WHEN 'boilerplate' THEN 2 WHEN 'http-error' THEN 3 WHEN 'missing-meta' THEN 4 WHEN 'missing-alt' THEN 5 ELSE 6 END::INT AS seq
  FROM st JOIN ss USING (site, finding, key))"""

for _finding, _op in [
    ("missing_meta", "F2"), ("missing_alt", "F3"), ("http_error", "F4"), ("thin", "F5"), ("boilerplate", "F6"),
]:

    def _register(finding=_finding.replace("_", "-"), name=_finding + "_questions", covers=_op):
        @query(name, f"WITH {SIG} SELECT * EXCLUDE (seq) FROM pq WHERE finding = '{finding}'", covers=covers)
        def _(spark, d):
            return shown(Q.finding_questions(rich_signals(spark, d), finding))

    _register()

FINDINGS = f"""{SIG}, {CONTRA}, fq AS (SELECT * FROM cq UNION ALL BY NAME SELECT * FROM pq)"""


def findings(spark, d):
    return Q.collect_findings(rich_signals(spark, d), contact_entities(spark, d))


@query("site_findings", f"WITH {FINDINGS} SELECT * FROM fq", covers="F7")
def _(spark, d):
    return shown(findings(spark, d))


@query("finding_evidence", f"WITH {SIG} SELECT site, finding, key, page_id, url, excerpt FROM sm", covers="F5 F6 F8")
def _(spark, d):
    return Q.page_evidence(Q.signal_rows(rich_signals(spark, d)))


@query(
    "evidence_excerpts",
    f"""WITH {D.RX}, p AS (SELECT *, regexp_extract(corpus, '[a-zA-Z]+ing', 0) AS pref FROM rc)
    SELECT site, page_id, CASE WHEN pref <> '' THEN pref ELSE title END AS excerpt FROM p""",
    covers="F8",
)
def _(spark, d):
    rec = X.page_records(V.rich_pages(spark, d)).withColumn("corpus", X.corpus())
    return rec.select("site", "page_id", Q.evidence_excerpt(F.regexp_extract("corpus", "[a-zA-Z]+ing", 0)).alias("excerpt"))


@query(
    "proven_evidence",
    f"""WITH {SIG}, ev AS (SELECT sm.site, pq.fingerprint, sm.page_id,
        CASE sm.page_id % 3 WHEN 0 THEN upper(excerpt) WHEN 1 THEN '' ELSE excerpt END AS excerpt FROM sm JOIN pq USING (site, finding, key))
    SELECT ev.site, fingerprint, ev.page_id, ev.excerpt FROM ev JOIN sg USING (site, page_id)
    WHERE length(ev.excerpt) > 0 AND contains(sg.corpus, ev.excerpt)""",
    covers="F9",
)
def _(spark, d):
    rec = X.page_records(V.rich_pages(spark, d))
    rows = Q.signal_rows(Q.page_signals(rec, PHRASES))
    ev = Q.with_fingerprint(Q.page_evidence(rows), Q.page_questions(rows))
    n = F.col("page_id") % 3
    broken = ev.withColumn("excerpt", F.when(n == 0, F.upper("excerpt")).when(n == 1, "").otherwise(F.col("excerpt")))
    proven = Q.filter_question_evidence(broken, C.page_corpus(rec))
    return proven.select("site", "fingerprint", "page_id", "excerpt")


@query(
    "fingerprints",
    f"SELECT conv_id, turn, {D.fp('role', 'conv_id', 'text')} AS fingerprint, {D.key12('conv_id', 'turn')} AS short_key FROM conversations",
    covers="F10",
)
def _(spark, d):
    return T.table(spark, d, "conversations").select(
        "conv_id", "turn", TX.fingerprint("role", "conv_id", "text").alias("fingerprint"),
        TX.short_key("conv_id", "turn").alias("short_key"),
    )


def review_questions(spark, d):
    """Findings plus one wide keep-or-kill question per path prefix, with all evidence."""
    rows = stored(Q.signal_rows(rich_signals(spark, d)), "signals")
    found = stored(Q.page_questions(rows).withColumn("seq", F.lit(2)), "questions")
    ev = Q.with_fingerprint(Q.page_evidence(rows), found).select("site", "fingerprint", "url")
    pages = T.read_pages(spark, d)
    prefix = pages.withColumn("prefix", U.path_prefix("path"))
    fp = TX.fingerprint(F.lit("prefix"), F.col("prefix"))
    wide = prefix.groupBy("site", "prefix").agg(F.count("*").alias("pages")).select(
        "site", fp.alias("fingerprint"), F.lit("prefix").alias("finding"), F.col("prefix").alias("key"),
        F.lit("keep-or-kill").alias("kind"), F.concat(F.lit("Merge "), F.col("prefix"), F.lit("?")).alias("prompt"),
        F.array(F.lit("Merge"), F.lit("Keep")).alias("options"), F.lit(False).alias("required"), F.lit("model").alias("source"),
        F.lit(True).alias("spawns_tasks"), F.lit(0).alias("rank"), "pages", F.lit(7).alias("seq"),
    )
    ev2 = prefix.filter("page_id % 3 <> 0").select("site", fp.alias("fingerprint"), "url")
    return found.unionByName(wide), stored(ev.unionByName(ev2), "evidence")


REVIEW = f"""{SIG}, wq AS (
  SELECT site, {D.fp("'prefix'", "'/' || split_part(path, '/', 2)")} AS fingerprint, 'keep-or-kill' AS kind, false AS required, 0 AS rank, url, page_id FROM pg),
rq AS (SELECT site, fingerprint, kind, required, rank FROM pq
       UNION ALL SELECT DISTINCT site, fingerprint, kind, required, rank FROM wq),
rs AS (SELECT *, CASE WHEN rank > 0 THEN rank WHEN kind = 'keep-or-kill' THEN 45 END AS score FROM rq),
re AS (SELECT sm.site, fingerprint, sm.url FROM sm JOIN pq USING (site, finding, key)
       UNION ALL SELECT site, fingerprint, url FROM wq WHERE page_id % 3 <> 0),
rp AS (SELECT re.site, re.fingerprint, list_sort(list(DISTINCT {D.path('re.url')})) AS paths
       FROM re JOIN rs USING (site, fingerprint) WHERE kind = 'keep-or-kill' GROUP BY ALL),
ro AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY len(paths) DESC, score DESC, fingerprint) AS o FROM rp JOIN rs USING (site, fingerprint)),
dr AS (SELECT DISTINCT a.site, a.fingerprint FROM ro a JOIN ro b ON a.site = b.site AND b.o < a.o AND list_has_all(b.paths, a.paths) WHERE NOT a.required),
kp AS (SELECT * FROM rs ANTI JOIN dr USING (site, fingerprint))"""


@query(
    "distinct_questions",
    f"WITH {REVIEW} SELECT site, fingerprint, kind FROM kp",
    covers="F12",
)
def _(spark, d):
    qs, ev = review_questions(spark, d)
    return Q.drop_overlapping(qs, ev).select("site", "fingerprint", "kind")


@query(
    "ranked_questions",
    f"""WITH {REVIEW} SELECT site, fingerprint, score::INT AS score,
      row_number() OVER (PARTITION BY site ORDER BY required DESC, score DESC, fingerprint)::INT AS place FROM kp""",
    covers="F11",
)
def _(spark, d):
    qs, ev = review_questions(spark, d)
    return Q.rank_questions(qs.unionByName(qs), ev).select("site", "fingerprint", "score", "place")


CONV = """cv0 AS (
  SELECT q.conv_id AS site, q.turn, q.text || CASE WHEN q.turn % 4 = 2 THEN ' (' || md5(q.text) || ', ' || md5(q.role || q.turn) || ')  x' ELSE '' END AS prompt,
    q.turn % 4 = 0 AS required, CASE WHEN q.conv_id % 5 = 4 THEN '  ' ELSE a.text END AS answer
  FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  WHERE q.role = 'user')"""


def conversation_questions(spark, d):
    """User turns as questions of the site ``conv_id``; the next assistant turn answers."""
    c = T.table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    ids = F.concat(F.lit(" ("), F.md5("text"), F.lit(", "), F.md5(F.concat("role", F.col("turn").cast("string"))), F.lit(")  x"))
    q = c.filter("role = 'user'").join(a, ["conv_id", "turn"], "left")
    return q.select(
        F.col("conv_id").alias("site"), "turn",
        F.concat("text", F.when(F.col("turn") % 4 == 2, ids).otherwise("")).alias("prompt"),
        (F.col("turn") % 4 == 0).alias("required"),
        F.when(F.col("conv_id") % 5 == 4, "  ").otherwise(F.col("a")).alias("answer"),
    )


@query(
    "clean_prompts",
    f"""WITH {CONV} SELECT site, turn, trim(regexp_replace(regexp_replace(prompt,
      '\\s*\\((?:\\s*[A-Za-z0-9._-]{{20,}}\\s*,?)+\\)', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS prompt FROM cv0""",
    covers="F13",
)
def _(spark, d):
    q = conversation_questions(spark, d)
    return q.select("site", "turn", Q.strip_doc_ids(F.col("prompt")).alias("prompt"))


@query(
    "question_counts",
    f"""WITH {CONV}, c AS (SELECT *, coalesce(trim(answer) <> '', false) AS a FROM cv0)
    SELECT site, count(*) AS total, count_if(a)::BIGINT AS answered, count_if(required AND NOT a)::BIGINT AS required_left,
      count_if(NOT required AND NOT a)::BIGINT AS optional_left FROM c GROUP BY site""",
    covers="F14",
)
def _(spark, d):
    return Q.question_counts(conversation_questions(spark, d))


@query(
    "question_labels",
    f"""WITH {CONV}, t AS (SELECT *, {D.squash('prompt')} AS p FROM cv0),
    s AS (SELECT *, coalesce(nullif(regexp_extract(p, '^(.+?[.?!])(?:\\s|$)', 1), ''), p) AS first FROM t)
    SELECT site, turn, CASE WHEN p = '' THEN 'Question' WHEN length(first) > 64 THEN rtrim(substr(first, 1, 63)) || '…' ELSE first END AS label,
      CASE WHEN required THEN 0 ELSE 1 END::INT AS "group" FROM s""",
    covers="F15",
)
def _(spark, d):
    return Q.order_questions(conversation_questions(spark, d)).select("site", "turn", "label", "group")


@query(
    "evidence_paths",
    f"""WITH {D.PG} SELECT page_id, path || CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '[?]([^#]*)', 1) ELSE '' END AS shown FROM pg""",
    covers="F15",
)
def _(spark, d):
    return T.read_pages(spark, d).select("page_id", Q.evidence_path(F.lit(None).cast("string"), F.col("url")).alias("shown"))


@query(
    "question_gate",
    f"""WITH {CONV} SELECT site, count_if(required AND NOT coalesce(trim(answer) <> '', false))::BIGINT AS open_required,
      count_if(required AND NOT coalesce(trim(answer) <> '', false)) = 0 AS may_advance FROM cv0 GROUP BY site""",
    covers="F17",
)
def _(spark, d):
    return Q.site_question_gate(conversation_questions(spark, d))


@query(
    "stale_pages",
    f"WITH {D.PG} SELECT site, page_id, (2010 + page_id % 16)::INT AS year FROM pg WHERE 2010 + page_id % 16 < 2018",
    covers="F16",
)
def _(spark, d):
    return Q.stale_pages(V.rich_pages(spark, d), 2018)


@query(
    "sites_without_contact",
    f"WITH {D.PG} SELECT site, count(*) AS pages FROM pg GROUP BY site HAVING NOT bool_or(path ILIKE '%/contact%')",
    covers="F18",
)
def _(spark, d):
    return Q.sites_without_contact(T.read_pages(spark, d))
