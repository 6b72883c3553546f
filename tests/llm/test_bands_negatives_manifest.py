"""Compression bands, hard negatives and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from siteloom.llm import compression_bands as bands
from siteloom.llm import hard_negatives as negatives
from siteloom.llm import merkle_manifest as merkle
from siteloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple("" if x is None else f"{x:020d}" if isinstance(x, int) else str(x) for x in row)


# compression bands


def counted(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    held = {}
    for w in windows:
        held[w] = held.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if held[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def judged_plainly(text: str | None) -> bool:
    n_words, _, _, _, repeat = counted(text)
    if n_words < 20 or 100 * repeat > 30 * n_words:
        return False
    raw = text.encode()
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    inside = lambda x: bands.limits(len(x))[0] <= ratio(x) <= bands.limits(len(x))[1]
    pieces = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
    bad = sum(len(p) for p in pieces if not inside(p)) if len(pieces) > 1 else 0
    return inside(raw) and bad <= 0.3 * len(raw)


def texts() -> list[str | None]:
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 9)))
    vocabulary = [word() for _ in range(2000)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    out = [None, "", " \n\t\r\x0b\x0c ", "a", "ok", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "    x y", "#*$%&|<> # ü\n\n#*\n#*\n #*", "x\ny\nx\nx\r\nx"]
    out += [prose(n) for n in (5, 19, 20, 21, 60, 400, 3000, 9000)]
    out += [" ".join([prose(30)] * 5), prose(100) + "\n" + prose(100) + "\n" + "spam eggs " * 60, prose(800) + " spam" * 3000, "word " * 40, " ".join(w for w in r.choices(vocabulary, k=30) for _ in range(6))]
    out += [prose(2000) + " " + " ".join("".join(chr(r.randint(33, 126)) for _ in range(60)) for _ in range(150))]
    out += ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + (" " if i % 60 == 59 else "") for i in range(9000))]
    out += ["q" * 20_000 + " " + prose(50) + " " + "q" * 20_000, prose(300_000), "\n".join([prose(8)] * 4 + [prose(8) for _ in range(6)]), "".join(chr(0x4E00 + r.randint(0, 500)) + (" " if i % 9 == 8 else "") for i in range(4000))]
    return out


def test_compression_bands_counts_and_verdicts(spark):
    rows = [(i, t, "extra", 1.5) for i, t in enumerate(texts())] + [(3, "a", "again", 0.0), (None, texts()[14], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, ratio double")
    got = bands.compression_bands(docs).collect()
    wanted = []
    for i, text, *_ in rows:
        c = counted(text)
        wanted.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0], judged_plainly(text)))
    assert sorted([tuple(r)[:8] for r in got], key=key) == sorted(wanted, key=key)
    reasons = {r.reason for r in got if not r.base_failed}
    assert {None, "repetitive", "incompressible"} <= reasons and any(r and r.endswith("chunks") for r in reasons)
    kept = bands.passing_documents(docs)
    assert kept.columns == docs.columns and sorted(key(r) for r in kept.collect()) == sorted(key(r) for r, w in zip(rows, wanted, strict=True) if w[-1])
    assert bands.compression_bands(docs.limit(0)).count() == 0


def test_slices_of_long_texts_count_alike(monkeypatch):
    data = [(t or "").encode() for t in texts()]
    joined, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    whole = bands.base_counts(joined, offsets)
    monkeypatch.setattr(bands, "SLICE", 300)
    monkeypatch.setattr(bands, "LONG_WORD", 7)
    again = bands.base_counts(joined, offsets)
    assert all((whole[c] == again[c]).all() for c in bands.COUNTS)


# hard negatives


@pytest.mark.parametrize("scale", [1, 200, 10**6, 10**12])
def test_packed_products_are_exact(scale):
    r = np.random.default_rng(1)
    for rows, dims in ((1, 1), (7, 3), (40, 64), (5, 0)):
        codes = r.integers(-scale, scale + 1, (rows, dims))
        anchors = r.integers(-2 * scale, scale + 1, (6, dims))
        packed = negatives.Packed(codes, int(anchors.min(initial=0)), int(anchors.max(initial=0)))
        wanted = [[min(sum(int(a) * int(c) for a, c in zip(x, y, strict=True)), 2**63 - 1) for y in codes] for x in anchors]
        wanted = [[max(s, -(2**63)) for s in x] for x in wanted]
        assert packed.products(anchors).tolist() == wanted
    assert negatives.Packed(np.array([[100, -100]] * 4), -100, 100).fields > 1


def mined_plainly(rows: list[tuple]) -> list[tuple]:
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for a, label, code in good:
        if a % 100:
            continue
        score = [(sum(x * y for x, y in zip(code, c, strict=True)), i, other) for i, other, c in good if i != a and len(c) == len(code)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in score if s[2] == label][:5]:
            near = [s for s in score if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(a, i, k, n, p, s) for k, (s, n, _) in enumerate(near, 1)]
    return out


def embedding_rows() -> list[tuple]:
    r = np.random.default_rng(5)
    centre = r.standard_normal((5, 12))
    rows = [(i, (centre[i % 5] / 3 + r.standard_normal(12) * 0.2).astype(np.float32).tolist(), 0 if i % 3 else int(r.integers(0, 10))) for i in range(401)]
    rows += [(500, rows[3][1], 0), (501, rows[3][1], 0), (502, rows[3][1], 4), (507, [0.0] * 12, 1), (600, [0.0] * 12, 1), (601, None, 1), (602, [None] + [1.0] * 11, 1), (603, [float("nan")] * 12, 1), (604, [float("inf")] * 12, 2)]
    rows += [(700, [1.0, 2.0], 0), (701, [1.0, 1.0], 0), (703, [0.5, 0.5], 3), (704, [], 3), (800, [], 3), (801, [], 5), (705, rows[5][1], None), (None, rows[6][1], 2), (-100, rows[7][1], 0), rows[8]]
    return rows


@pytest.mark.parametrize("block_rows", [None, 60])
def test_hard_negatives_against_all_pairs(spark, block_rows):
    rows = embedding_rows()
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, rank int").repartition(5)
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
    ready = table.where(negatives.whole()).selectExpr("vec_id", f"{label} as label", "transform(embedding, x -> floor(256 * double(x))) as code")
    got = negatives.hard_negatives(ready, ready.where("vec_id % 100 = 0"), block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == sorted(mined_plainly(rows))
    if block_rows is None:
        assert sorted(map(tuple, negatives.mine_embeddings(table).collect())) == sorted(mined_plainly(rows))
        assert negatives.mine_embeddings(table.limit(0)).count() == 0


def test_hard_negatives_of_repeated_anchors_and_huge_components(spark):
    rows = [(100, [1e20, 1 / 256], 1), (1, [1e18, 2.0], 1), (2, [0.0, 2e16], 2), (3, [-1e18, 0.0], 2), (100, [1e20, 1 / 256], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine_embeddings(table).collect()
    assert [r.positive_id for r in got] == [1, 1] and all((r.positive_score, r.negative_id, r.negative_score) == (2**63 - 1, 2, 5120000000000000000) for r in got)


# Merkle manifest


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and each node's (left, right) siblings by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            steps[i].append((run[: k % 16], run[k % 16 + 1 :]))
        nodes, at = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], steps


def manifest_plainly(rows: list[tuple]) -> list[tuple]:
    small = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaves = [(d, s, digest(*map(field, (d, s, g, n, t))), digest(*map(field, (d, s, g, n, small(t))))) for d, t, g, s, n in rows]
    if not rows:
        return []
    sources = sorted({x[1] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {s: sorted((x for x in leaves if x[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[2])) for s in sources}
    trees = {s: tree([x[2] for x in mine[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for x, own in zip(mine[s], trees[s][1], strict=True):
            steps = own + above[k]
            h = x[3] if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0 else x[2]
            for left, right in steps:
                h = digest(*left, h, *right)
            out.append((x[0], x[2], trees[s][0], root, digest(*(y for left, right in steps for y in left + right)), h, h == root))
    return out


def document_rows(n: int) -> list[tuple]:
    r = random.Random(6)
    source = lambda i: "hot" if i % 3 else None if i % 7 == 0 else f"s{r.randint(0, 25)}" if i % 2 else "é" + "Z" * (i % 3)
    rows = [(i, r.choice([None, "", "abc", f"Text {i}", "ÀÉ Mixed CASE", "x" * 3]), r.choice(["en", None]), source(i), r.choice([None, 3, 10**9])) for i in range(n)]
    return [*rows, *rows[:20], (None, "A", "en", "hot", 1), (None, "B", "en", "hot", 1), (5, "Other", "en", "hot", 1), (-5, "Neg", None, "alone", -1), (10**15, "Q" * 300_000, "en", "alone2", 7)][: n + 25 if n else 0]


@pytest.mark.parametrize("n", [0, 1, 40, 900])
def test_merkle_manifest_against_plain_trees(spark, n):
    rows = document_rows(n)[: 1 if n == 1 else None]
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int").repartition(3)
    got = merkle.merkle_manifest(docs)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=key) == sorted(manifest_plainly(rows), key=key)
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_intervals_of_siblings(spark):
    rows = [(i, "t", "en", "one", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.merkle_manifest(docs).collect()
    assert sorted(r.lo for r in got) == list(range(300)) and {r.levels for r in got} == {3}
    assert all(r.doc_id == r.lo and r.verified for r in got)  # no capitals: tampering changes nothing


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_merkle_manifest"])
def test_registered_queries_equal_their_sql(spark, con, folder, name):
    from compare import compare

    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], folder)[0] == "ok"
