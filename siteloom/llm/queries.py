"""One query per corpus operator, over its whole table, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import language, quality
from siteloom.llm.ann_search import search
from siteloom.llm.compression_bands import compression_bands
from siteloom.llm.embedding_dedup import link_embeddings
from siteloom.llm.hard_negatives import mine_embeddings
from siteloom.llm.merkle_manifest import FAN, LOWER, UPPER, merkle_manifest
from siteloom.llm.mixing import mix_sources
from siteloom.llm.ngram_join import ngram_jaccard_join
from siteloom.llm.packing import pack
from siteloom.llm.pii import pii_digest
from siteloom.llm.suffix_dedup import remove_repeats
from siteloom.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_removed", "n_spans", "n_bytes", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op11_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_embeddings(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents")).drop("lo", "levels")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_pii, op3_packing, op4_source_mixing, op5_quality_classifier, op6_suffix_dedup, op7_language_id, op8_ann_search, op9_warc, op10_embedding_near_dedup, op11_compression_bands, op12_hard_negatives, op13_merkle_manifest)}

#: A record is a revisit if its payload has at least 1000 bytes and another page with a larger id has the same.
OP9 = """
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND last > page_id THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last FROM pages)
"""

#: Every anchor's product with every row, ranked within the anchor and within each of its bands.
OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS code
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(coalesce(list_sum(list_transform(list_zip(a.code, b.code), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.code) = len(b.code)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


def merkle_sql(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """The manifest level by level, for up to 16 ** ``leaf_levels`` documents a source and 16 ** ``source_levels`` sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    crc = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {crc}), 4294967295)"
    small = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = [f"""hashed AS (
  SELECT doc_id, source, sha256({fields("text")}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(small)}) END AS other FROM documents),
t0 AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM hashed)"""]

    def grow(name: str, levels: int) -> None:
        for k in range(levels):
            side = f"OVER (PARTITION BY tree, place // {FAN} ORDER BY place ROWS BETWEEN"
            sql.append(f"""{name}s{k} AS (
  SELECT tree, place, n, digest, coalesce(string_agg(digest, '') {side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') {side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k} WHERE n > {FAN**k}),
{name}{k + 1} AS (SELECT tree, place // {FAN} AS place, n, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}s{k} GROUP BY 1, 2, 3)""")

    grow("t", leaf_levels)
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM t{k} WHERE n <= {FAN**k} AND n > {FAN ** (k - 1) if k else 0}" for k in range(leaf_levels + 1))
    sql.append(f"subroots AS ({tops}), u0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, digest FROM subroots)")
    grow("u", source_levels)
    root = " UNION ALL ".join(f"SELECT digest AS root FROM u{k} WHERE n <= {FAN**k} AND n > {FAN ** (k - 1) if k else 0}" for k in range(source_levels + 1))
    proof, fold, joins, cur = [], [], [], "f0"
    sql.append(f"roots AS ({root})")
    for name, levels, at in (("t", leaf_levels, "t0.place"), ("u", source_levels, "t0.tree")):
        for k in range(levels):
            tree = f"{name}s{k}.tree = t0.tree AND " if name == "t" else ""
            joins.append(f"LEFT JOIN {name}s{k} ON {tree}{name}s{k}.place = {at} // {FAN**k}")
            proof.append(f"coalesce({name}s{k}.lft || {name}s{k}.rgt, '')")
            fold.append((f"{name}s{k}.lft", f"{name}s{k}.rgt"))
    sides = ", ".join(f"{left} AS l{i}, {right} AS r{i}" for i, (left, right) in enumerate(fold))
    sql.append(f"f0 AS (SELECT t0.doc_id, t0.leaf, subroots.digest AS subroot, sha256({' || '.join(proof)}) AS proof_sha256, coalesce(other, leaf) AS h, {sides} FROM t0 JOIN subroots ON subroots.tree = t0.tree {' '.join(joins)})")
    for i in range(len(fold)):
        sql.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN l{i} IS NULL THEN h ELSE sha256(l{i} || h || r{i}) END AS h) FROM {cur})")
        cur = f"f{i + 1}"
    return f"WITH {', '.join(sql)}\nSELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM {cur}, roots"


ORACLES: dict[str, str] = {"op9_warc": OP9, "op12_hard_negatives": OP12, "op13_merkle_manifest": merkle_sql()}
