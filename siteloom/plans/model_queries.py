"""Queries over the content model."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siteloom.operators import condense as C
from siteloom.operators import elements as E
from siteloom.operators import extract as X
from siteloom.operators import migrate as M
from siteloom.operators import model as MD
from siteloom.plans import condense_queries as CQ
from siteloom.plans import derived as V
from siteloom.plans import duck as D
from siteloom.plans import migrate_queries as MQ
from siteloom.plans.extract_queries import records
from siteloom.plans.registry import query
from siteloom.session import scratch_path
from siteloom.sources import sync as S
from siteloom.sources import tables as T

PT = f"{D.PG}, {MQ.TYPES}"


def _sql_list(items):
    return "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"


_FV = ", ".join(
    f"({i}, '{n}', '{t}', {_sql_list(of)}, {_sql_list(to)}, {str(r).lower()})" for i, n, t, of, to, r in V.FIELD_ROWS
)
PF = f"""{PT}, pf AS (SELECT pt.site, pt.version, pt.name AS type_name, pt.m, f.i AS ord, f.field_name, f.field_type, f."of", f."to", f.required,
  ((pt.m + f.i) % 7)::INT AS evidence_count
  FROM pt JOIN (VALUES {_FV}) f(i, field_name, field_type, "of", "to", required) ON (pt.m + f.i) % 3 <> 0)"""


def _raw_proposals(spark, d):
    """Model output per type: a JSON object, or one whose list or whole arrived as a string."""
    t = V.proposal_types(spark, d)
    f = V.proposal_fields(t).groupBy("site", "version", F.col("type_name").alias("name"), "m").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", F.col("field_name").alias("name"), F.col("field_type").alias("type"), "of", "to", "required",
                                    F.col("evidence_count").alias("evidenceCount")))
        ).alias("fields")
    )
    whole = t.join(f, ["site", "version", "name", "m"])
    body = F.to_json(
        F.array(F.struct("name", "title", "kind", F.col("block_match").alias("blockMatch"), "rationale", "confidence", "decision",
                         F.col("merge_into").alias("mergeInto"), "fields"))
    )
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    obj = F.concat(F.lit('{"types":'), body, F.lit("}"))
    raw = F.when(F.col("m") % 3 == 0, obj).when(
        F.col("m") % 3 == 1, F.concat(F.lit('{"types":'), quoted(body), F.lit("}"))
    ).otherwise(quoted(obj))
    return whole.select("site", "version", raw.alias("raw"))


@query(
    "flattened_types",
    f"""WITH {PF} SELECT site, version, name, title, kind, block_match, rationale, confidence, decision, merge_into FROM pt
    WHERE EXISTS (SELECT 1 FROM pf WHERE pf.site = pt.site AND pf.m = pt.m)""",
    covers="E1 E18",
)
def _(spark, d):
    types, _, _ = MD.flatten_proposal(MD.repair_double_encoded(_raw_proposals(spark, d)))
    return types.drop("ord")


@query(
    "flattened_fields",
    f"""WITH {PF} SELECT site, version, type_name, field_name, field_type, array_to_string("of", ',') AS "of", array_to_string("to", ',') AS "to", required, evidence_count FROM pf""",
    covers="E1 E18",
)
def _(spark, d):
    _, fields, _ = MD.flatten_proposal(MD.repair_double_encoded(_raw_proposals(spark, d)))
    return fields.drop("ord").withColumns({"of": F.array_join("of", ","), "to": F.array_join("to", ",")})


EV = f"""{D.PX.replace('px AS (', 'px AS (', 1)}, {MQ.TYPES},
pv AS (SELECT pc.site, pt.version, pt.name AS type_name, page_id, corpus,
   CASE page_id % 3 WHEN 0 THEN pc.title WHEN 1 THEN upper(pc.title) ELSE '' END AS excerpt
   FROM pc JOIN pt ON pt.site = pc.site AND pt.seg = split_part(pc.path, '/', 2)),
pk AS (SELECT *, length(excerpt) > 0 AND contains(corpus, excerpt) AS ok FROM pv),
pn AS (SELECT site, version, type_name AS name, count(*) AS seen, count_if(ok) AS kept FROM pk GROUP BY ALL)"""


@query(
    "checked_types",
    f"""WITH {EV} SELECT pt.site, pt.version, pt.name, m, round(CASE WHEN seen > 0 AND kept = 0 THEN greatest(0, confidence - 0.2) ELSE confidence END, 6)::DOUBLE AS confidence,
      coalesce(kept, 0)::BIGINT AS evidence FROM pt LEFT JOIN pn USING (site, version, name)""",
    covers="E2",
)
def _(spark, d):
    types = V.proposal_types(spark, d)
    ev = V.proposal_evidence(spark, d, types)
    checked, _ = MD.check_evidence(types, ev, C.page_corpus(records(spark, d)))
    return checked.select("site", "version", "name", "m", "confidence", "evidence")


@query(
    "proven_type_evidence",
    f"WITH {EV} SELECT site, version, type_name, page_id, excerpt FROM pk WHERE ok",
    covers="E2",
)
def _(spark, d):
    types = V.proposal_types(spark, d)
    ev = V.proposal_evidence(spark, d, types)
    _, kept = MD.check_evidence(types, ev, C.page_corpus(records(spark, d)))
    return kept.select("site", "version", "type_name", "page_id", "excerpt")


@query(
    "core_types",
    f"""WITH {PT} SELECT site, version, name, title, kind, confidence FROM pt
    UNION ALL SELECT s.site, s.version, c.name, c.title, c.kind, 0.4::DOUBLE FROM (SELECT DISTINCT site, version FROM pt) s,
      (VALUES ('page', 'Page', 'document'), ('siteSettings', 'Site settings', 'singleton')) c(name, title, kind)""",
    covers="E3",
)
def _(spark, d):
    return MD.ensure_core_types(V.proposal_types(spark, d)).select("site", "version", "name", "title", "kind", "confidence")


@query(
    "core_fields",
    f"""WITH {PT} SELECT s.site, s.version, c.type_name, c.field_name, c.field_type, CASE WHEN field_name = 'body' THEN 12 ELSE -1 END::INT AS members
    FROM (SELECT DISTINCT site, version FROM pt) s, (VALUES ('page', 'title', 'string'), ('page', 'slug', 'slug'), ('page', 'body', 'array'),
      ('siteSettings', 'siteTitle', 'string'), ('siteSettings', 'phone', 'string'), ('siteSettings', 'email', 'string')) c(type_name, field_name, field_type)""",
    covers="E3",
)
def _(spark, d):
    f = MD.core_fields(V.proposal_types(spark, d))
    return f.select("site", "version", "type_name", "field_name", "field_type", F.coalesce(F.size("of"), F.lit(-1)).alias("members"))


@query(
    "block_matches",
    f"""WITH {PT} SELECT site, version, name, m, CASE WHEN block_match = 'hero' THEN 'hero' END AS block_match,
      rationale || CASE WHEN block_match = 'megaBlock' THEN ' (Proposed block match "megaBlock" is not in the catalogue; kept as a custom type.)' ELSE '' END AS rationale FROM pt""",
    covers="E4",
)
def _(spark, d):
    return MD.normalise_block_match(V.proposal_types(spark, d)).select("site", "version", "name", "m", "block_match", "rationale")


@query(
    "moved_targets",
    f"""WITH {PF} SELECT site, version, type_name, m, field_name, CASE WHEN field_name = 'tags' THEN 'string,ghost,hero' ELSE array_to_string("of", ',') END AS "of",
      CASE WHEN field_name = 'tags' THEN 'frArticle' ELSE array_to_string("to", ',') END AS "to" FROM pf""",
    covers="E5",
)
def _(spark, d):
    f = MD.move_block_targets(V.proposal_fields(V.proposal_types(spark, d)))
    return f.select("site", "version", "type_name", "m", "field_name", F.array_join("of", ",").alias("of"), F.array_join("to", ",").alias("to"))


@query(
    "name_violations",
    f"""WITH {PF} SELECT site, version, 'type not camelCase' AS rule, name AS subject FROM pt WHERE name LIKE '%-page' OR name = 'Article'
    UNION ALL SELECT site, version, 'reserved type', name FROM pt WHERE name = 'image'
    UNION ALL SELECT site, version, 'duplicate type', name FROM pt GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT site, version, 'field not camelCase', type_name || '.' || field_name FROM pf WHERE field_name IN ('_hidden', 'Bad Name')
    UNION ALL SELECT site, version, 'field starts with _', type_name || '.' || field_name FROM pf WHERE field_name = '_hidden'""",
    covers="E6",
)
def _(spark, d):
    types = V.proposal_types(spark, d)
    return MD.name_violations(types, V.proposal_fields(types))


@query(
    "reference_violations",
    f"""WITH {PF}, n AS (SELECT DISTINCT site, version, name FROM pt),
    c AS (SELECT site, version, type_name || '.author' AS subject, 'dangling reference' AS rule, 'enArticle' AS member FROM pf WHERE field_name = 'author'
      UNION ALL SELECT site, version, type_name || '.tags', 'unknown array member', 'ghost' FROM pf WHERE field_name = 'tags'
      UNION ALL SELECT site, version, type_name || '.Bad Name', 'unknown array member', 'line' FROM pf WHERE field_name = 'Bad Name')
    SELECT c.* FROM c ANTI JOIN n ON n.site = c.site AND n.version = c.version AND n.name = c.member""",
    covers="E7",
)
def _(spark, d):
    types = V.proposal_types(spark, d)
    return MD.reference_violations(types, V.proposal_fields(types))


_J = """CASE field_name WHEN 'title' THEN '{"name":"title","type":"string","title":"title"}' WHEN 'price' THEN '{"name":"price","type":"number","title":"price"}'
  WHEN 'body' THEN '{"name":"body","type":"array","title":"body","of":[{"type":"block"},{"type":"hero"}]}'
  WHEN 'author' THEN '{"name":"author","type":"reference","title":"author","to":[{"type":"enArticle"}]}'
  WHEN 'tags' THEN '{"name":"tags","type":"array","title":"tags","of":[{"type":"string"},{"type":"ghost"}]}'
  WHEN 'Bad Name' THEN '{"name":"Bad Name","type":"object","title":"Bad Name","fields":[{"name":"line","type":"string"}]}'
  ELSE '{"name":"' || field_name || '","type":"' || field_type || '","title":"' || field_name || '"}' END"""


@query(
    "compiled_schemas",
    f"""WITH {PF}, u AS (SELECT site, version, name, min(m) AS m FROM pt GROUP BY ALL),
    own AS (SELECT pt.site, pt.version, pt.name, '{{"name":"' || pt.name || '","title":"' || title || '","type":"' || CASE WHEN kind = 'object' THEN 'object' ELSE 'document' END || '","fields":[' ||
        (SELECT string_agg({_J}, ',' ORDER BY ord) FROM pf WHERE pf.site = pt.site AND pf.m = pt.m) || ']}}' AS schema, false AS stub FROM pt JOIN u USING (site, version, name, m)),
    bn AS (SELECT unnest({_sql_list(MD.BLOCK_MATCH_NAMES)}) AS name)
    SELECT * FROM own UNION ALL
    SELECT s.site, s.version, bn.name, CASE WHEN bn.name = 'link' THEN '{{"name":"link","title":"Link","type":"object","fields":[{{"name":"label","type":"string"}},{{"name":"href","type":"url"}}]}}'
      ELSE '{{"name":"' || bn.name || '","title":"' || bn.name || '","type":"object","fields":[{{"name":"placeholder","type":"string"}}]}}' END, true
    FROM (SELECT DISTINCT site, version FROM pt) s, bn WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.site = s.site AND pt.version = s.version AND pt.name = bn.name)""",
    covers="E8",
)
def _(spark, d):
    types = V.proposal_types(spark, d)
    first = types.groupBy("site", "version", "name").agg(F.min("m").alias("m"))
    types = types.join(first, ["site", "version", "name", "m"], "left_semi")
    return MD.compile_schema(types, V.proposal_fields(types))


@query(
    "target_manifest",
    f"""WITH {PT}, st AS (SELECT unnest({_sql_list([*MD.STANDARD_BLOCKS, 'link', 'page', 'siteSettings', 'redirect'])}) AS name)
    SELECT site, version, st.name, 'standard' AS origin FROM (SELECT DISTINCT site, version FROM pt), st
    UNION ALL SELECT DISTINCT site, version, name, 'site' FROM pt WHERE name NOT IN (SELECT name FROM st)""",
    covers="E9",
)
def _(spark, d):
    return MD.target_manifest(V.proposal_types(spark, d))


@query(
    "human_decisions",
    f"WITH {PT} SELECT site, version, decision AS kind, name, CASE WHEN decision = 'merge' THEN merge_into END AS \"into\" FROM pt WHERE decision IN ('drop', 'merge')",
    covers="E10",
)
def _(spark, d):
    return MD.human_decisions(V.proposal_types(spark, d))


@query(
    "edited_types",
    f"""WITH {PT} SELECT site, version, m, CASE WHEN m % 2 = 1 OR m % 4 = 0 THEN seg ELSE 'renamed' || seg END AS name,
      CASE WHEN m % 2 = 1 THEN title ELSE CASE WHEN m % 6 = 0 THEN 'New' ELSE title END END AS title,
      CASE WHEN m % 2 = 1 THEN block_match WHEN m % 8 = 0 THEN 'faq' ELSE block_match END AS block_match,
      CASE WHEN m % 2 = 0 AND m % 10 = 0 THEN 'merge' ELSE decision END AS decision,
      CASE WHEN m % 2 = 0 AND m % 10 = 0 THEN 'other' ELSE merge_into END AS merge_into FROM pt""",
    covers="E11",
)
def _(spark, d):
    t = V.proposal_types(spark, d).withColumns(
        {"name": F.col("seg"), "accepted_at": F.when(F.col("m") % 2 == 1, F.lit("2024-01-01"))}
    )
    m, none = F.col("m"), F.lit(None).cast("string")
    edits = t.select(
        "site", "version", "name", F.when(m % 4 != 0, F.concat(F.lit("renamed"), "seg")).alias("new_name"),
        F.when(m % 6 == 0, "New").alias("new_title"), F.when(m % 8 == 0, "faq").alias("new_block_match"),
        F.when(m % 10 == 0, "merge").otherwise(none).alias("decision"), F.lit("other").alias("merge_into"),
    )
    out = MD.apply_decisions(t, edits)
    return out.select("site", "version", "m", "name", "title", "block_match", "decision", "merge_into")


@query(
    "low_confidence_types",
    f"""WITH {PT}, w AS (SELECT site, name, m, confidence, row_number() OVER (PARTITION BY site ORDER BY confidence, name)::INT AS k
      FROM pt WHERE confidence < 0.6 AND coalesce(decision, 'keep') <> 'drop')
    SELECT site, name, m, confidence, k AS n FROM w""",
    covers="E12",
)
def _(spark, d):
    return MD.low_confidence_types(V.proposal_types(spark, d)).select("site", "name", "m", "confidence", "n")


VERSIONS = f"""{PF}, t1 AS (SELECT site, seg AS name, m FROM pt WHERE m % 4 <> 0 AND site NOT LIKE 'b%'), t2 AS (SELECT site, seg AS name, m FROM pt WHERE m % 4 <> 3),
f1 AS (SELECT pt.site, pt.seg AS name, field_name, field_type, required FROM pf JOIN pt USING (site, m) WHERE pt.m % 4 <> 0 AND pt.site NOT LIKE 'b%'),
f2 AS (SELECT pt.site, pt.seg AS name, field_name, CASE WHEN (ord + pt.m) % 5 = 0 THEN 'text' ELSE field_type END AS field_type, CASE WHEN (ord + pt.m) % 7 = 0 THEN NOT required ELSE required END AS required
       FROM pf JOIN pt USING (site, m) WHERE pt.m % 4 <> 3 AND (ord + pt.m) % 4 <> 0)"""


def versions(spark, d):
    t = V.proposal_types(spark, d).withColumn("name", F.col("seg"))
    f = V.proposal_fields(t)
    m, n = F.col("m"), F.col("m") + F.col("ord")
    old, oldf = t.filter("m % 4 <> 0 and site not like 'b%'"), f.filter("m % 4 <> 0 and site not like 'b%'")
    new = t.filter("m % 4 <> 3")
    newf = f.filter((m % 4 != 3) & (n % 4 != 0)).withColumns(
        {
            "field_type": F.when(n % 5 == 0, "text").otherwise(F.col("field_type")),
            "required": F.when(n % 7 == 0, ~F.col("required")).otherwise(F.col("required")),
        }
    )
    return new, old, newf, oldf


@query(
    "version_diffs",
    f"""WITH {VERSIONS}, s AS (SELECT site, count(*) AS types FROM t2 GROUP BY site), h AS (SELECT DISTINCT site FROM t1),
    a AS (SELECT site, count(*) AS added FROM t2 ANTI JOIN t1 USING (site, name) GROUP BY site), r AS (SELECT site, count(*) AS removed FROM t1 ANTI JOIN t2 USING (site, name) GROUP BY site),
    c AS (SELECT coalesce(f1.site, f2.site) AS site, coalesce(f1.name, f2.name) AS name FROM f2 FULL JOIN f1 ON f1.site = f2.site AND f1.name = f2.name AND f1.field_name = f2.field_name
          WHERE f1.field_type IS DISTINCT FROM f2.field_type OR f1.required IS DISTINCT FROM f2.required),
    k AS (SELECT site, count(*) AS fc FROM c SEMI JOIN (SELECT * FROM t1 SEMI JOIN t2 USING (site, name)) b USING (site, name) GROUP BY site),
    z AS (SELECT s.site, types, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(fc, 0) AS fields_changed, h.site IS NOT NULL AS had
          FROM s LEFT JOIN a USING (site) LEFT JOIN r USING (site) LEFT JOIN k USING (site) LEFT JOIN h ON h.site = s.site)
    SELECT site, types, added, removed, fields_changed, CASE WHEN NOT had THEN 'First model · ' || types || CASE WHEN types = 1 THEN ' type' ELSE ' types' END
      ELSE CASE WHEN added = removed THEN types || ' types' ELSE CASE WHEN added > removed THEN '+' ELSE '' END || (added - removed) || CASE WHEN abs(added - removed) = 1 THEN ' type' ELSE ' types' END END
        || ', ' || CASE fields_changed WHEN 0 THEN 'no field changes' WHEN 1 THEN '1 field changed' ELSE fields_changed || ' fields changed' END END AS summary FROM z""",
    covers="E13",
)
def _(spark, d):
    return MD.diff_versions(*versions(spark, d))


@query(
    "merge_hints",
    f"""WITH {PF}, f AS (SELECT DISTINCT pt.site, pt.seg AS name, field_name FROM pf JOIN pt USING (site, m) WHERE coalesce(decision, 'keep') NOT IN ('drop', 'merge')),
    n AS (SELECT site, name, count(*) AS n FROM f GROUP BY ALL),
    p AS (SELECT a.site, a.name AS a, b.name AS b, count(*) AS c FROM f a JOIN f b ON a.site = b.site AND a.field_name = b.field_name AND a.name < b.name GROUP BY ALL)
    SELECT p.site, a, b, round(c / (x.n + y.n - c), 6) AS overlap FROM p JOIN n x ON x.site = p.site AND x.name = a JOIN n y ON y.site = p.site AND y.name = b WHERE c / (x.n + y.n - c) >= 0.75""",
    covers="E14",
)
def _(spark, d):
    t = V.proposal_types(spark, d).withColumn("name", F.col("seg"))
    return MD.merge_hints(t, V.proposal_fields(t))


# titled pages under names of their own, as the targets read the enriched ones
_OWN = re.sub(r"\b(pg|px0|px1|px|pc|tp|tn|tq|tc|tb|sn)\b", r"q_\1", MQ.NAMES)
_TITLE = """CASE WHEN site_name IS NULL THEN trim(title) ELSE coalesce(nullif(trim(array_to_string(list_filter(regexp_split_to_array(trim(title), '\\s+[|–—-]\\s+'),
  lambda p: trim(p) <> site_name), ' – ')), ''), site_name) END"""
FIELD_VALUES = f"""{MQ.TARGETS}, {PF.removeprefix(PT + ", ")}, {_OWN},
fb AS (SELECT q_tp.site, q_tp.page_id, q_tp.url, {_TITLE} AS clean_title,
    regexp_extract(array_to_string(list_concat([title], list_concat(headings, list_transform(secs, lambda s: s.text))), chr(10)), '{D.PRICE}') AS price
  FROM q_tp JOIN (SELECT page_id, headings, secs FROM q_px) x USING (page_id) LEFT JOIN q_sn ON q_sn.site = q_tp.site),
fa AS (SELECT page_id, list(text ORDER BY n) FILTER (length(text) > 20) AS paras FROM ({MQ.PARAGRAPHS}) GROUP BY ALL),
fd AS (SELECT tg.site, tg.page_id, doc_id, type, regexp_replace(regexp_replace(regexp_extract(old_path, '([^/]*)$', 1), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
  FROM tg WHERE state = 'mapped' AND type <> 'page'),
fv AS (SELECT fd.site, doc_id, field_name, CASE field_name WHEN 'title' THEN clean_title WHEN 'slug' THEN slug WHEN 'summary' THEN array_to_string(paras, ' ') WHEN 'body' THEN array_to_string(paras, chr(10) || chr(10))
    WHEN 'photo' THEN lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {D.host('url')} || '/img/' || (fd.page_id % 9) || '.jpg'
    WHEN 'price' THEN CASE WHEN try_cast(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE) > 0 THEN try_cast(regexp_replace(price, '[^0-9.]', '', 'g') AS DOUBLE)::VARCHAR END END AS value
  FROM fd JOIN pf ON pf.site = fd.site AND pf.type_name = fd.type JOIN fb ON fb.page_id = fd.page_id LEFT JOIN fa ON fa.page_id = fd.page_id)"""


@query("collection_fields", f"WITH {FIELD_VALUES} SELECT * FROM fv WHERE coalesce(value, '') <> ''", covers="G10")
def _(spark, d):
    pages = V.stored_titles(spark, d, text=True)
    t = MQ.targets(spark, d, pages=pages).filter("state = 'mapped' and type <> 'page'")
    types = V.proposal_types(spark, d)
    titles = M.clean_titles(pages, M.site_names(pages))
    texts = pages.select("site", "page_id", "text")
    atoms = E.page_atoms(V.rich_pages(spark, d))
    docs = t.join(pages.select("site", "page_id", "url"), ["site", "page_id"])
    docs = docs.select("site", "page_id", "doc_id", "type", "slug", "url")
    return M.fill_fields(docs, V.proposal_fields(types), M.page_summaries(titles, atoms, texts))


@query(
    "type_nodes",
    f"""WITH {PF}, s AS (SELECT pt.*, CASE WHEN kind = 'object' THEN CASE WHEN block_match IS NOT NULL THEN 'block' ELSE 'object' END ELSE 'document' END AS node FROM pt WHERE coalesce(decision, 'keep') NOT IN ('drop', 'merge')),
    f AS (SELECT site, m, sum(evidence_count)::BIGINT AS fs FROM pf GROUP BY ALL)
    SELECT s.site, s.version, s.seg AS name, node, greatest(n, coalesce(fs, 0))::BIGINT AS score FROM s LEFT JOIN f USING (site, m)""",
    covers="E15",
)
def _(spark, d):
    t = V.proposal_types(spark, d).withColumn("name", F.col("seg"))
    return MD.type_nodes(t, V.proposal_fields(t), V.proposal_evidence(spark, d, t))


@query(
    "type_edges",
    f"""WITH {PF}, v AS (SELECT DISTINCT site, version, name FROM pt WHERE coalesce(decision, 'keep') NOT IN ('drop', 'merge')),
    e AS (SELECT site, version, type_name AS source, field_name, unnest(list_concat("to", "of")) AS target, field_name IN ('body', 'tags') AS body FROM pf)
    SELECT e.site, e.version, source, target, field_name, CASE WHEN body THEN 'body' ELSE 'ref' END AS style FROM e
    SEMI JOIN v a ON a.site = e.site AND a.version = e.version AND a.name = e.source SEMI JOIN v b ON b.site = e.site AND b.version = e.version AND b.name = e.target
    WHERE source <> target""",
    covers="E15",
)
def _(spark, d):
    t = V.proposal_types(spark, d)
    return MD.type_edges(t, V.proposal_fields(t))


@query(
    "inferred_collections",
    f"""WITH RECURSIVE {CQ.CLUSTERS} SELECT site, substr(prefix, 2) || CASE WHEN cluster > 0 THEN (cluster + 1)::VARCHAR ELSE '' END AS name, 'document' AS kind, prefix, cluster,
      shortest AS signature, count(*) AS pages, min(page_id) AS first_page FROM cm GROUP BY ALL""",
    covers="E16",
)
def _(spark, d):
    sig = CQ.line_signatures(spark, d)
    clusters = C.shape_clusters(sig)
    return MD.infer_collections(clusters, C.cluster_pages(sig, clusters))


_FVAL = f"""{D.RE}, fv AS (SELECT dp.site, 'listing' AS type_name, k.kind AS field_name, (SELECT min(value) FROM de WHERE de.site = dp.site AND de.page_id = dp.page_id AND de.kind = k.kind) AS value
  FROM dp, (VALUES ('phones'), ('emails'), ('prices')) k(kind)
  UNION ALL SELECT site, 'listing', 'body', CASE WHEN page_id % 12 <> 0 THEN text END FROM dp)"""


@query(
    "field_rules",
    f"""WITH {_FVAL} SELECT site, type_name, field_name, count_if(coalesce(trim(value) <> '', false))::BIGINT AS evidence_count, avg(coalesce(trim(value) <> '', false)::INT) >= 0.9 AS required,
      ceil(max(CASE WHEN trim(value) <> '' THEN length(value) END) * 12 / 10)::BIGINT AS max_length FROM fv GROUP BY ALL""",
    covers="E17",
)
def _(spark, d):
    docs = V.rich_documents(spark, d)
    first = lambda k: F.array_min(X.X.find_all("text", X.ENTITY_PATTERNS[k]))
    pairs = F.array(
        *[F.struct(F.lit(k).alias("field_name"), first(k).alias("value")) for k in ("phones", "emails", "prices")],
        F.struct(F.lit("body").alias("field_name"), F.when(F.col("page_id") % 12 != 0, F.col("text")).alias("value")),
    )
    rows = docs.select("site", F.lit("listing").alias("type_name"), F.explode(pairs).alias("v")).select("site", "type_name", "v.*")
    return MD.infer_field_rules(rows)


@query(
    "usage_totals",
    """SELECT conv_id AS site, 'model-' || (conv_id % 3) AS model, count(*) AS versions, sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS input_tokens,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output_tokens, sum(turn % 2)::BIGINT AS repair_rounds FROM conversations GROUP BY ALL""",
    covers="E19",
)
def _(spark, d):
    c = T.table(spark, d, "conversations")
    n = F.length("text").cast("long")
    out = F.col("role") == "assistant"
    return MD.usage_totals(
        c.select(
            F.col("conv_id").alias("site"), F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
            F.when(~out, n).otherwise(0).alias("input_tokens"), F.when(out, n).otherwise(0).alias("output_tokens"),
            (F.col("turn") % 2).alias("repair_rounds"),
        )
    )


@query(
    "model_input_batch",
    f"""WITH {D.PX}, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id)::INT AS n FROM pc WHERE http_status < 400)
    SELECT site, page_id, n, ceil(n / 40.0)::INT AS batch, to_json({{'pageId': page_id, 'path': path, 'url': url, 'title': title, 'text': corpus}})::VARCHAR AS payload FROM n""",
    covers="E20",
)
def _(spark, d):
    return MD.model_input_batch(records(spark, d))


@query(
    "document_violations",
    f"""WITH {D.PX}, o AS (SELECT site, page_id AS doc_id, CASE page_id % 5 WHEN 0 THEN 'hero' WHEN 1 THEN 'page' WHEN 2 THEN 'cardGrid' WHEN 3 THEN 'link' ELSE 'redirect' END AS doc_type,
      CASE WHEN page_id % 10 = 0 THEN '' ELSE title || title END AS heading, corpus AS subheading, CASE WHEN page_id % 3 = 0 THEN '/a.png' END AS image_src, CASE WHEN page_id % 6 = 0 THEN 'alt' END AS image_alt,
      CASE WHEN page_id % 7 <> 0 THEN title END AS title, CASE WHEN page_id % 11 <> 0 THEN path END AS slug, title AS seo_title, substr(corpus, 1, 100 + page_id % 100) AS seo_description,
      page_id % 2 AS cards, page_id % 3 AS items, CASE WHEN page_id % 2 = 0 THEN url END AS link_href, CASE WHEN page_id % 4 = 0 THEN 'x' END AS link_internal, 295 + page_id % 20 AS status_code,
      CASE WHEN page_id % 50 = 0 THEN 700 ELSE http_status END AS http_status, page_id % 12 / 10.0 AS confidence, page_id % 220 AS page_cap FROM pc)
    SELECT site, doc_id, doc_type, r.rule FROM o, LATERAL (VALUES
      (doc_type = 'hero' AND coalesce(trim(heading), '') = '', 'hero heading required'), (doc_type = 'hero' AND length(heading) > 90, 'hero heading over 90'),
      (doc_type = 'hero' AND length(subheading) > 240, 'hero subheading over 240'), (image_src IS NOT NULL AND image_alt IS NULL, 'image without alt'),
      (doc_type = 'page' AND title IS NULL, 'page title required'), (doc_type = 'page' AND slug IS NULL, 'page slug required'), (length(seo_title) > 60, 'seoTitle over 60'),
      (length(seo_description) > 155, 'seoDescription over 155'), (doc_type = 'cardGrid' AND (cards > 0) = (items > 0), 'cards and items together'),
      (doc_type = 'link' AND (link_href IS NULL) = (link_internal IS NULL), 'link needs href or internal'), (doc_type = 'redirect' AND status_code NOT BETWEEN 301 AND 308, 'redirect code outside 301-308'),
      (http_status NOT BETWEEN 100 AND 599, 'status outside 100-599'), (confidence NOT BETWEEN 0 AND 1, 'confidence outside 0-1'), (page_cap NOT BETWEEN 1 AND 200, 'page cap outside 1-200')) r(bad, rule) WHERE r.bad""",
    covers="E21",
)
def _(spark, d):
    rec = records(spark, d)
    n = F.col("page_id")
    kind = F.when(n % 5 == 0, "hero").when(n % 5 == 1, "page").when(n % 5 == 2, "cardGrid").when(n % 5 == 3, "link").otherwise("redirect")
    text = X.corpus()
    docs = rec.select(
        "site", n.alias("doc_id"), kind.alias("doc_type"), F.when(n % 10 == 0, "").otherwise(F.concat("title", "title")).alias("heading"),
        text.alias("subheading"), F.when(n % 3 == 0, "/a.png").alias("image_src"), F.when(n % 6 == 0, "alt").alias("image_alt"),
        F.when(n % 7 != 0, F.col("title")).alias("title"), F.when(n % 11 != 0, F.col("path")).alias("slug"), F.col("title").alias("seo_title"),
        F.substring(text, F.lit(1), (100 + n % 100).cast("int")).alias("seo_description"), (n % 2).alias("cards"), (n % 3).alias("items"),
        F.when(n % 2 == 0, F.col("url")).alias("link_href"), F.when(n % 4 == 0, "x").alias("link_internal"), (295 + n % 20).alias("status_code"),
        F.when(n % 50 == 0, 700).otherwise(F.col("http_status")).alias("http_status"), (n % 12 / 10).alias("confidence"), (n % 220).alias("page_cap"),
    )
    return MD.document_violations(docs)


@query(
    "latest_types",
    f"""WITH {PT}, v AS (SELECT site, name, m, (1 + m % 3)::INT AS version FROM pt) SELECT * FROM v WHERE version = (SELECT max(version) FROM v w WHERE w.site = v.site)""",
    covers="A8",
)
def _(spark, d):
    t = V.proposal_types(spark, d).select("site", "name", "m", (1 + F.col("m") % 3).cast("int").alias("version"))
    return S.latest_version(t)


@query(
    "next_versions",
    f"""WITH {PT}, v AS (SELECT site, max(1 + m % 3) AS v FROM pt WHERE m % 4 <> 0 GROUP BY site)
    SELECT site, (coalesce(v, 0) + 1)::INT AS next_version FROM (SELECT DISTINCT site FROM pg) LEFT JOIN v USING (site)""",
    covers="A8",
)
def _(spark, d):
    t = V.proposal_types(spark, d).filter("m % 4 <> 0").select("site", (1 + F.col("m") % 3).cast("int").alias("version"))
    return S.next_version(T.read_pages(spark, d), t)


@query(
    "proposal_history",
    f"WITH {PT} SELECT site, name, m, v.version FROM pt, (VALUES (1::INT), (2::INT)) v(version) WHERE v.version = 1 OR m % 2 = 0",
    covers="A9",
)
def _(spark, d):
    t = V.proposal_types(spark, d).select("site", "name", "m", "version")
    out = scratch_path(spark, "proposals")
    S.append_version(t, out)
    S.append_version(t.filter("m % 2 = 0").withColumn("version", F.lit(2)), out)
    return spark.read.schema("name string, m long, version int, site string").parquet(out).select("site", "name", "m", "version")


@query(
    "site_manifests",
    f"""WITH {PT}, c AS (SELECT DISTINCT site, name, kind FROM pt)
    SELECT s.site, 'Site ' || s.site AS site_title, 'r' || substr(sha1('release' || chr(0) || s.site), 1, 9) AS release_id,
      (SELECT '[' || string_agg('{{"type":"' || name || '","route":"' || lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) || '"}}', ',' ORDER BY name) || ']' FROM (SELECT DISTINCT name FROM c WHERE c.site = s.site AND kind = 'document')) AS collections,
      (SELECT '[' || string_agg('{{"name":"' || name || '","kind":"' || kind || '"}}', ',' ORDER BY name, kind) || ']' FROM c WHERE c.site = s.site) AS manifest
    FROM (SELECT DISTINCT site FROM pg) s""",
    covers="A10",
)
def _(spark, d):
    from siteloom.functions import urls as U

    t = V.proposal_types(spark, d).select("site", "name", "kind").distinct()
    settings = T.read_pages(spark, d).select("site").distinct().withColumn("site_title", F.concat(F.lit("Site "), "site"))
    cols = t.filter("kind = 'document'").select("site", F.col("name").alias("type"), U.kebab("name").alias("route")).distinct()
    return S.site_manifest(settings, cols, t)
