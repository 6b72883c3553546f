"""Archives, vector operators, registration and the pipeline."""

import hashlib
import io
import random

import numpy as np
import pytest

import corpus_pipeline
from siteloom.llm import ann_search, components, embedding_dedup, queries, warc

VECTORS = "vec_id long, embedding array<float>, label int, cid string, v int, list int"


def page_rows() -> list[tuple]:
    r = random.Random(1)
    big = "".join(r.choice("abc<>é\n") for _ in range(5000))
    rows = [(i, f"http://x/{i}", big) for i in (3, 9, 5)] + [(6, "http://x/6", "small"), (7, None, "small"), (8, "http://x/\r\n8", ""), (10, "u", None), (None, "n", big), (11, "u", "<p>" * 200_000)]
    return [*rows, (9, "http://x/9", big)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra", "x") for r in page_rows()], "page_id long, url string, html string, digest string, first string")
    got = warc.archive_round_trip(spark, pages).collect()
    wanted = []
    for i, _, html in page_rows():
        raw = (html or "").encode()
        again = len(raw) == len(page_rows()[0][2].encode()) and i != 9
        wanted.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(wanted, key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**6])
def test_ranges_own_each_record_once(step):
    r = random.Random(2)
    records = [f"WARC/1.1\r\nn: {i}\r\n\r\n".encode() + bytes(r.choice(b"\x1f\x8b\x08ab") for _ in range(r.randint(0, 300))) for i in range(30)]
    raw = b"".join(warc.gzip_member(x) + (warc.gzip_member(b"") if i % 3 else b"") for i, x in enumerate(records))
    # stored, so the magic of a member that holds no record stands inside another member
    inner = warc.gzip_member(b"not a record")
    raw += warc.gzip_member(b"WARC/1.1\r\n\r\n" + inner, level=0)
    found = [x for a in range(0, len(raw), step) for x in warc.members_in(io.BytesIO(raw), len(raw), a, a + step, read=50)]
    assert found == [*records, b"WARC/1.1\r\n\r\n" + inner]


def vector_rows() -> list[tuple]:
    r = np.random.default_rng(4)
    centre = r.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + r.standard_normal(16) * (0.05 + 0.3 * (i % 5 == 0))).astype(np.float32).tolist(), i % 6 // 3) for i in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] + [1.0] * 15, 0), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (207, [], 0), (208, [float("inf")] * 16, 1), rows[5], (None, rows[7][1], 1)]
    return rows


def usable(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in vector_rows()], VECTORS)


@pytest.mark.parametrize(("tile", "block"), [(8, 1024), (64, 16), (4096, 1024)])
def test_embedding_links_equal_brute_force(vectors, tile, block):
    rows = vector_rows()
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and la is not None and la == lb and usable(a) and usable(b):
                a, b = np.array(a, float), np.array(b, float)
                link[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93
    root = np.arange(n)
    for _ in range(n):
        root = np.minimum(root, np.where(link, root[None, :], n).min(1))
    wanted = []
    for i, (vid, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        wanted.append((vid, int(link[i].sum()), least, vid is not None and vid == least))
    got = [tuple(r) for r in embedding_dedup.link_embeddings(vectors, tile_rows=tile, block_rows=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and link.sum() > 100
    assert embedding_dedup.link_embeddings(vectors.limit(0)).count() == 0
    if tile > 64:  # labels of any type; double components
        named = vectors.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "concat('l', label) as label")
        assert sorted(str(tuple(r)) for r in embedding_dedup.link_embeddings(named).collect()) == sorted(map(str, wanted))


def test_quantised_bounds_hold_and_save_work():
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, length, lost = embedding_dedup.quantised(x)
    product = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    bound = lost[:, None] * length[None, :] + length[:, None] * lost[None, :] + lost[:, None] * lost[None, :]
    assert (np.abs(x @ x.T - product) <= bound).all()
    i, j, checked = embedding_dedup.close_pairs(x, x, 0.3, True)
    exact = np.tril(x @ x.T, -1) >= 0.3
    assert len(i) == exact.sum() and checked < 0.2 * x.shape[0] ** 2


def test_search_recall_and_edge_rows(spark, vectors):
    asked = vectors.where("vec_id % 20 = 0")
    got = ann_search.search(vectors, asked).collect()
    rows = [(i, np.array(v, float)) for i, v, _ in vector_rows() if usable(v) and i is not None]
    hit = total = 0
    for q in {r.query_id for r in got}:
        own = next(v for i, v in rows if i == q)
        best = sorted((-float(own @ v), i) for i, v in rows if i != q)[:20]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len({i for _, i in best} & {r.vec_id for r in found})
        total += 20
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80, 100} and hit / total >= 0.9
    few = ann_search.search(vectors.where("vec_id < 4"), asked.where("vec_id = 0")).collect()
    assert [(r.rank, r.query_id) for r in sorted(few)] and {r.vec_id for r in few} == {1, 2, 3}
    assert ann_search.search(vectors.limit(0), asked).count() == 0


@pytest.mark.parametrize("indexed", [50, 10**6])
def test_vectors_of_every_length_are_searched_among_their_own(spark, monkeypatch, indexed):
    monkeypatch.setattr(ann_search, "INDEXED", indexed)
    monkeypatch.setattr(ann_search, "CHUNK", 16)
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(4 if i < 70 else 7 if i < 90 else 3).tolist()) for i in range(95)] + [(200, [1.0] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_search.search(table, table.where("vec_id % 5 = 0"), 6).collect()
    by_id, hit = dict(rows), 0
    for q in range(0, 95, 5):
        own = [i for i, v in rows if len(v) == len(by_id[q]) and i != q]
        best = sorted(own, key=lambda i: (-float(np.dot(by_id[i], by_id[q])), i))[:6]
        found = [x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == q]
        assert len(found) == len(best) and set(found) <= set(own)
        hit += len(set(found) & set(best))
        assert found == best or (q < 70 and indexed == 50)
    assert not [x for x in got if x.query_id == 200] and hit >= 0.9 * len(got)


def test_search_recall_on_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ann_search.search(table, table.where("vec_id % 20 = 0")).collect()
    hit = 0
    for q in {r.query_id for r in got}:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * len(got)


def test_dimension_scan_drops_only_far_pairs():
    r = np.random.default_rng(6)
    x, q = r.standard_normal((500, 64)), r.standard_normal((20, 64))
    far = ((q[:, None] - x[None]) ** 2).sum(2)
    limit = np.sort(far, axis=1)[:, 10]
    i, j, read = ann_search.scan(q, x, limit)
    kept = np.zeros(far.shape, bool)
    kept[i, j] = True
    assert (kept & (far <= limit[:, None])).sum() >= 0.97 * (far <= limit[:, None]).sum() and read < far.size * 64


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(40)) and got[201] == 200 and len(got) == 93
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_each_operator_has_one_query(spark, con, folder):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    from compare import compare

    for name, sql in queries.ORACLES.items():
        assert compare(spark, con, name, queries.QUERIES[name], sql, folder)[0] == "ok"


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 !!"), (10**6 + 2, "write to jo@mail.example.com today the and of")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    steps, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    language, single, clean, mixed, packed = steps
    assert {r.doc_id for r in language.where("doc_id >= 1000000").collect()} == {10**6 + 2}
    assert single.count() < language.count() and single.count() == single.select("doc_id").distinct().count()
    assert clean.where("text like '%@%.example.com%'").count() == 0 and clean.where("text like '%[EMAIL]%'").count() > 0
    assert clean.where("n_chars <> length(text)").count() == 0 and clean.count() == single.count()
    assert packed.count() == mixed.count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
