"""Queries over condensed sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.operators import condense as C
from siteloom.operators import extract as X
from siteloom.plans import duck as D
from siteloom.plans.extract_queries import records
from siteloom.plans.registry import query
from siteloom.sources import tables as T

HASHED = f"""{D.DP}, dh AS (
  SELECT *, CASE WHEN page_id % 23 <> 0 THEN substr(sha256(text), 1, 32) END AS content_hash FROM dp),
dd AS (SELECT *, row_number() OVER (PARTITION BY site, content_hash ORDER BY length(path), path, page_id) AS rn FROM dh)"""


def hashed_documents(spark, d):
    n = F.col("page_id") % 23
    return T.read_document_pages(spark, d).withColumn(
        "content_hash", F.when(n != 0, F.substring(F.sha2("text", 256), 1, 32))
    )


@query(
    "deduped_pages",
    f"WITH {HASHED} SELECT site, page_id, path, content_hash FROM dd WHERE rn = 1 OR content_hash IS NULL",
    covers="D1",
)
def _(spark, d):
    return C.dedupe_pages(hashed_documents(spark, d)).select("site", "page_id", "path", "content_hash")


@query(
    "live_pages",
    f"WITH {HASHED} SELECT site, page_id FROM dd WHERE (rn = 1 OR content_hash IS NULL) AND http_status < 400",
    covers="D2",
)
def _(spark, d):
    return C.live_pages(C.dedupe_pages(hashed_documents(spark, d))).select("site", "page_id")


BLOCKS = f"""{D.DP}, bl AS (
  SELECT DISTINCT site, page_id, block FROM (
    SELECT site, page_id, {D.squash('line')} AS block
    FROM (SELECT site, page_id, unnest(regexp_split_to_array(text, '\\n+')) AS line FROM dp))
  WHERE length(block) BETWEEN 40 AND 400),
sz AS (SELECT site, count(DISTINCT page_id) AS n FROM dp GROUP BY site HAVING count(DISTINCT page_id) >= 3),
bc AS (SELECT site, block, count(*) AS pages FROM bl GROUP BY ALL),
ch AS (SELECT site, block, pages, row_number() OVER (PARTITION BY site ORDER BY pages DESC, block)::INT AS rank
       FROM bc JOIN sz USING (site) WHERE pages >= ceil(n * 0.05))"""


@query("chrome_blocks", f"WITH {BLOCKS} SELECT site, block, pages, rank FROM ch", covers="D3")
def _(spark, d):
    return C.chrome_blocks(T.read_document_pages(spark, d), ratio=0.05)


def _splice(t, b):
    cut = f"(substr({t}, 1, instr({t}, {b}) - 1) || ' ' || substr({t}, instr({t}, {b}) + length({b})))"
    return f"CASE WHEN instr({t}, {b}) > 0 THEN {D.squash(cut)} ELSE {t} END"


@query(
    "stripped_sections",
    f"""WITH {BLOCKS}, ls AS (SELECT site, list(block ORDER BY rank) AS blocks FROM ch GROUP BY site),
    s AS (SELECT site, page_id, {D.squash('text')} AS t FROM dp),
    j AS (SELECT s.site, page_id, t, coalesce(blocks, []) AS blocks FROM s LEFT JOIN ls USING (site) WHERE t <> ''),
    r AS (SELECT site, page_id, list_reduce(list_prepend(t, blocks), lambda a, b: {_splice('a', 'b')}) AS text FROM j)
    SELECT site, page_id, text FROM r WHERE text <> ''""",
    covers="D4",
)
def _(spark, d):
    docs = T.read_document_pages(spark, d)
    sections = docs.select("site", "page_id", F.lit(0).alias("ord"), F.lit("prose").alias("kind"), "text")
    return C.strip_chrome(sections, C.chrome_blocks(docs, ratio=0.05)).select("site", "page_id", "text")


def live_entities(spark, d):
    docs = C.live_pages(T.read_document_pages(spark, d))
    return X.entity_rows(docs.drop("lang"))


@query(
    "site_facts",
    f"""WITH {D.DE} SELECT site, kind, value, count(DISTINCT page_id) AS pages, min(page_id) AS first_page
    FROM de WHERE http_status < 400 GROUP BY ALL""",
    covers="D5",
)
def _(spark, d):
    return C.site_facts(live_entities(spark, d))


@query(
    "fact_pages",
    f"WITH {D.DE} SELECT DISTINCT site, kind, value, page_id FROM de WHERE http_status < 400",
    covers="D5",
)
def _(spark, d):
    return C.fact_pages(live_entities(spark, d))


# section kinds of documents: the kind of every line
LINES = f"""{D.DP}, ln AS (
  SELECT site, page_id, path, generate_subscripts(ls, 1) AS ord, unnest(ls) AS line
  FROM (SELECT site, page_id, path, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM dp)),
lk AS (SELECT site, page_id, ord,
  CASE WHEN length(line) < 60 THEN 'short' WHEN length(line) < 400 THEN 'medium' ELSE 'long' END AS kind FROM ln),
sg AS (SELECT dp.site, dp.page_id, '/' || split_part(path, '/', 2) AS prefix,
  coalesce(array_to_string(k.kinds, ','), '') AS signature, coalesce(len(k.kinds), 0) AS n
  FROM dp LEFT JOIN (SELECT site, page_id, list(kind ORDER BY ord) AS kinds FROM lk GROUP BY ALL) k USING (site, page_id))"""


def line_signatures(spark, d):
    docs = T.read_document_pages(spark, d)
    lines = F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")
    rows = docs.select("site", "page_id", F.posexplode(lines).alias("ord", "line"))
    n = F.length("line")
    kind = F.when(n < 60, "short").when(n < 400, "medium").otherwise("long")
    return C.shape_signatures(rows.select("site", "page_id", "ord", kind.alias("kind")), docs)


@query("shape_signatures", f"WITH {LINES} SELECT site, page_id, prefix, signature FROM sg", covers="D6")
def _(spark, d):
    return line_signatures(spark, d).withColumn("signature", F.array_join("signature", ","))


_CODE = "list_reduce(list_prepend('', list_transform(string_split({0}, ','), lambda k: upper(substr(k, 1, 1)))), lambda a, b: a || b)"


@query(
    "signature_distances",
    f"""WITH {LINES}, m AS (SELECT site, prefix, min(signature) AS base FROM sg WHERE n > 0 GROUP BY ALL),
    d AS (SELECT DISTINCT site, prefix, signature, n FROM sg WHERE n > 0)
    SELECT site, prefix, signature,
      CASE WHEN abs(n - len(string_split(base, ','))) > 1 THEN abs(n - len(string_split(base, ',')))
           ELSE levenshtein({_CODE.format('signature')}, {_CODE.format('base')}) END::INT AS distance
    FROM d JOIN m USING (site, prefix)""",
    covers="D7",
)
def _(spark, d):
    sig = line_signatures(spark, d).filter(F.size("signature") > 0)
    shapes = sig.groupBy("site", "prefix", "signature").agg(F.count("*").alias("n")).drop("n")
    base = shapes.groupBy("site", "prefix").agg(F.min(F.array_join("signature", ",")).alias("base"))
    dist = C.signature_distance(F.col("signature"), F.split("base", ","), ["short", "medium", "long"])
    return shapes.join(base, ["site", "prefix"]).select(
        "site", "prefix", F.array_join("signature", ",").alias("signature"), dist.cast("int").alias("distance")
    )


# signature by signature in the order of first pages: the first seed one edit away takes it, else it is a seed
CLUSTERS = f"""{LINES},
nd AS (SELECT *, row_number() OVER (PARTITION BY site, prefix ORDER BY fp) AS k FROM (
  SELECT site, prefix, signature, n, replace(replace(replace(replace(signature, 'short', 's'), 'medium', 'm'), 'long', 'l'), ',', '') AS code, count(*) AS pages, min(page_id) AS fp
  FROM sg GROUP BY ALL)),
gr AS (SELECT DISTINCT site, prefix, 0::BIGINT AS k, []::VARCHAR[] AS seeds FROM nd
  UNION ALL SELECT g.site, g.prefix, nd.k, CASE WHEN len(list_filter(g.seeds, lambda s: levenshtein(s, code) <= 1)) > 0 THEN g.seeds ELSE list_append(g.seeds, code) END
  FROM gr g JOIN nd ON nd.site = g.site AND nd.prefix = g.prefix AND nd.k = g.k + 1),
mb AS (SELECT nd.*, list_filter(seeds, lambda s: levenshtein(s, code) <= 1)[1] AS seed
  FROM nd JOIN (SELECT site, prefix, arg_max(seeds, k) AS seeds FROM gr GROUP BY ALL) f USING (site, prefix)),
cg AS (SELECT site, prefix, seed, first(signature ORDER BY n, fp) AS shortest, (row_number() OVER (PARTITION BY site, prefix ORDER BY min(fp)) - 1)::INT AS cluster
  FROM mb GROUP BY site, prefix, seed HAVING sum(pages) >= 3),
cm AS (SELECT sg.site, sg.prefix, cluster, page_id, shortest FROM sg JOIN mb USING (site, prefix, signature) JOIN cg USING (site, prefix, seed))"""


@query("shape_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT site, prefix, cluster, page_id FROM cm", covers="D8")
def _(spark, d):
    sig = line_signatures(spark, d)
    members = C.cluster_pages(sig, C.shape_clusters(sig))
    return members


@query(
    "budgeted_sections",
    f"""WITH {D.DP}, s AS (SELECT site, page_id, text, length(text) AS n FROM dp),
    c AS (SELECT site, max(cap) AS cap, bool_or(total > 20000) AS cut FROM (
      SELECT a.site, x.cap, sum(a.n) AS total, sum(least(a.n, x.cap)) AS used
      FROM s a, (SELECT unnest(range(40, 20001)) AS cap) x WHERE (SELECT sum(n) FROM s b WHERE b.site = a.site) > 20000
      GROUP BY a.site, x.cap) WHERE used <= 20000 OR cap = 40 GROUP BY site)
    SELECT s.site, page_id, CASE WHEN c.cap IS NULL THEN text ELSE substr(text, 1, c.cap) END AS text
    FROM s LEFT JOIN c USING (site)""",
    covers="D9",
)
def _(spark, d):
    docs = T.read_document_pages(spark, d)
    return C.fit_text_budget(docs.select("site", "page_id", "text"), chars=20000)


@query(
    "page_corpus",
    f"WITH {D.PX} SELECT site, page_id, corpus, {D.words('corpus')} AS words FROM pc",
    covers="D10",
)
def _(spark, d):
    return C.page_corpus(records(spark, d))


@query(
    "entity_summary",
    f"""WITH {D.DE} SELECT site, kind, count(DISTINCT value) AS values, count(DISTINCT value) > 1 AND kind <> 'prices' AS contradiction
    FROM de WHERE http_status < 400 GROUP BY site, kind""",
    covers="D11",
)
def _(spark, d):
    return C.entity_summary(live_entities(spark, d))


@query(
    "page_status_labels",
    f"""WITH {D.PG}, n AS (SELECT site, max(page_id) AS newest FROM pg WHERE site LIKE '%.example.com' GROUP BY site)
    SELECT pg.site, page_id, CASE WHEN http_status >= 400 THEN 'left alone' WHEN page_id = newest THEN 'digging'
      ELSE 'extracted' END AS label FROM pg LEFT JOIN n USING (site)""",
    covers="D12",
)
def _(spark, d):
    pages = T.read_pages(spark, d)
    return C.page_status_labels(pages, pages.filter(F.col("site").like("%.example.com")).select("site"))


@query(
    "near_duplicate_pages",
    f"""WITH {D.DP}, t0 AS (SELECT site, page_id, string_split(lower({D.squash('text')}), ' ') AS w FROM dp WHERE {D.squash('text')} <> ''),
    sh AS (SELECT DISTINCT site, page_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM t0),
    nn AS (SELECT site, page_id, count(*) AS n FROM sh GROUP BY ALL),
    cc AS (SELECT a.site, a.page_id, b.page_id AS dup_of, count(*) AS c FROM sh a JOIN sh b ON a.site = b.site AND a.s = b.s AND b.page_id < a.page_id GROUP BY ALL),
    jj AS (SELECT cc.site, cc.page_id, dup_of, c / (x.n + y.n - c) AS j FROM cc JOIN nn x ON x.site = cc.site AND x.page_id = cc.page_id JOIN nn y ON y.site = cc.site AND y.page_id = cc.dup_of)
    SELECT site, page_id, min(dup_of) AS dup_of, round(arg_min(j, dup_of), 6) AS similarity FROM jj WHERE j >= 0.7 - 1e-12 GROUP BY ALL""",
    covers="D13",
)
def _(spark, d):
    from siteloom.operators.near_duplicates import near_duplicate_pages

    docs = T.read_document_pages(spark, d).select("site", "page_id", "text")
    return near_duplicate_pages(docs, threshold=0.7)
