"""Corpus operators on text against brute force, on awkward small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import language, mixing, ngram_join, packing, pii, quality, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key int, row string, pii_base string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus() -> list[tuple]:
    a, b, c = words(1, 300), words(2, 200), words(3, 120)
    near = a.copy()
    near[150] = "changed"
    chain = near.copy()
    for i in range(0, 60, 12):
        chain[i] = f"other{i}"
    long = words(4, 40_000)
    texts = [
        None, "", "  \n", "!!! 123", "one", "one", "two words", " ".join(a), " ".join(a), " ".join(a).upper(), " ".join(near), " ".join(chain), " ".join(b), " ".join(c) + " " + " ".join(b), " ".join(long),
        "ü" * 900, "ab " * 500, " ".join(b[:100]) + "\n" + " ".join(c), "mail a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (554) 555-8958 +12", "9 " * 6000, "7" * 20_000,
    ]
    rows = [(i, t, "en" if i % 2 else None, ("s1", "s2", "é", None)[i % 4], i, "h", i, "r", "p") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, " ".join(b), None, None, 0, "h", 0, "r", "p"), (None, "", None, "s1", 0, "h", 0, "r", "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def jaccard_links(texts: list[str | None], threshold: float = 0.8) -> np.ndarray:
    sets = []
    for t in texts:
        w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(sets)
    return np.array([[i != j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 and bool(sets[i] & sets[j]) for j in range(n)] for i in range(n)])


def roots(link: np.ndarray) -> np.ndarray:
    root = np.arange(len(link))
    for _ in range(len(link)):
        root = np.minimum(root, np.where(link, root[None, :], len(link)).min(1, initial=len(link)))
    return root


def test_ngram_join_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    link = jaccard_links([r[1] for r in rows])
    root = roots(link)
    wanted = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        wanted[(r[0], min(ids) if ids else None, int(link[i].sum()))] += 1
    assert Counter(tuple(r) for r in ngram_join.ngram_jaccard_join(docs).collect()) == wanted


def test_ngram_join_splits_a_large_cluster_into_tiles(spark, monkeypatch):
    base = words(9, 200)
    rows = []
    for i in range(60):
        w = base.copy()
        w[i] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 59)} and len(got) == 60


def test_prefix_depth_meets_the_target_recall():
    assert ngram_join.prefix_depth(0.8, 28, 7, 0.9999) == 5
    assert ngram_join.prefix_depth(0.8, 28, 7, 0.9) == 7
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.8, 2, 8, 0.9999)


def test_prefixes_are_shortened_for_leaders_only(monkeypatch):
    r = np.random.default_rng(2)
    groups = r.integers(0, 256, (6, ngram_join.SKETCH)).astype(np.uint8)
    # 6 kinds of text; all share five hashes, kinds share six in pairs, members of a kind all seven
    path = np.repeat(np.array([0x0102030405000000 | (k // 2) << 8 | (k % 2) for k in range(6)], np.int64), 50)
    sketch = np.repeat(groups, 50, axis=0)
    met = []
    plain = ngram_join._leaders
    monkeypatch.setattr(ngram_join, "_leaders", lambda ids, sk, e: met.append(len(ids)) or plain(ids, sk, e))
    edges: list = []
    lead, ids, _ = ngram_join._climb(path, np.arange(300), sketch, edges, 2)
    assert met == [50] * 6 + [2] * 3 + [6]  # whole paths first, then the leaders under six hashes, then under five
    assert ids.tolist() == list(range(0, 300, 50)) and (lead == path[::50]).all()
    pairs = {tuple(p) for x, y in edges for p in np.stack([x, y], 1).tolist()}
    assert pairs == {(i, i - i % 50) for i in range(300) if i % 50}


def test_a_follower_meets_leaders_found_after_it():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, ngram_join.SKETCH).astype(np.uint8)
    b, c = a.copy(), a.copy()
    b[:12] += 1  # like a, and like c
    c[:24] += 1  # unlike a
    edges: list = []
    lead = ngram_join._leaders(np.array([7, 8, 9]), np.stack([a, b, c]), edges)
    assert lead.tolist() == [0, 2]
    assert {tuple(p) for x, y in edges for p in np.stack([x, y], 1).tolist()} == {(8, 7), (7, 9)}


def test_measured_recall_of_pairs_at_the_threshold(spark):
    rows = []
    for k in range(400):  # 100 words are 96 shingles; two changed words 40 apart leave 86 of 106: 0.811
        w = words(1000 + k, 100)
        rows.append((2 * k, " ".join(w)))
        w[20 + k % 20] = w[60 + k % 20] = f"new{k}"
        rows.append((2 * k + 1, " ".join(w)))
    link = jaccard_links([t for _, t in rows[:40]])
    assert link.sum() == 40  # each has its one partner
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(g.n_links == 1 and g.class_id == g.doc_id // 2 * 2 for g in got) == 800


def test_one_of_each_keeps_one_row_of_a_group(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    link = jaccard_links([r[1] for r in rows])
    assert not link.any()
    assert {r[0] for r in rows} >= {0, 1, 2, 7, 12, 13}  # without a word, and the first of each group
    assert Counter(r[0] for r in rows)[7] == 1


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_of(text: str | None) -> list[str]:
    out = []
    for kind, pattern in zip(pii.KINDS, BASE, strict=True):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def trees():
    """A hand-made model: phones of ten digits in three groups score 1, nothing else does."""
    return [([], np.inf), ([], np.inf), ([], np.inf), ([(0, 9, -1.0, (0, 10, 1.0, -1.0))], 0.5)]


def test_base_spans_and_added_spans(spark, docs, trees):
    extra = spark.createDataFrame([(100, "call 554 555-8958 now, or +1 (554) 555-8958"), (101, "jo@x.y " * 700)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    texts = table.collect()
    got = pii.pii_digest(table, trees).collect()
    wanted = Counter((r[0], hashlib.sha256(",".join(base_of(r[1])).encode()).hexdigest()) for r in texts)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == wanted
    one = {r.doc_id: r for r in got}
    assert one[100].spans == "phone:5:17,phone:26:43" and one[100].n_phone == 1
    assert one[101].n_email == 700
    clean = {r.doc_id: r.text for r in pii.redact(table, trees).collect()}
    assert clean[100] == "call [PHONE] now, or [PHONE]" and clean[0] is None


def test_a_candidate_stays_if_what_overlaps_it_goes(spark):
    """Addresses of 8 and 11 digits overlap a phone between them: the best drops the phone, so the first stays too."""
    model = [([], np.inf), ([(0, 9, 0.6, 2.0)], 0.5), ([], np.inf), ([1.0], 0.5)]
    table = spark.createDataFrame([(1, "at 12,34,56,78 90 55 12,134,156,179 up")], "doc_id long, text string")
    assert [r.spans for r in pii.pii_digest(table, model).collect()] == ["ip:3:14,ip:21:35"]
    assert [r.text for r in pii.redact(table, model).collect()] == ["at [IP] 90 55 [IP] up"]


def test_redaction_keeps_clashing_columns(docs, trees):
    got = pii.redact(docs, trees)
    assert got.columns == docs.columns
    assert {(r.row, r.pii_base, r.h) for r in got.collect()} == {("r", "p", "h")}


def test_boosting_learns_a_rule_and_calibrates(spark, empty):
    x = np.array([[a, b] for a in range(6) for b in range(6)], float)
    y = ((x[:, 0] > 2) & (x[:, 1] <= 3)).astype(float)
    trees = pii.boosted(np.concatenate([x, np.zeros((36, 8))], 1), y, np.full(36, 10.0))
    assert ((pii.predict(trees, np.concatenate([x, np.zeros((36, 8))], 1)) > 0) == (y > 0)).all()
    assert [t for _, t in pii.fit(empty)] == [np.inf] * 4  # nothing confirmed, nothing added
    assert pii.pii_digest(empty).count() == 0


def test_every_document_is_learnt_from(spark):
    """More documents than a sample held, each with one address, one of them with a form of its own."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to a"), F.col("id").cast("string"), F.when(F.col("id") == 777, "@b.c.d.e.org 4").otherwise("@b.org now")).alias("text"))
    got = pii.cells(docs).where("kind = 0 and disguised = 0 and y = 1").groupBy("dots").agg(F.sum("count")).collect()
    assert sorted(map(tuple, got)) == [(1, 24_999), (4, 1)]


def planted(rng: random.Random) -> tuple[str, str, bool]:
    """(kind, text, whether it is personal data): forms that no base rule finds."""
    kind = rng.choice(pii.KINDS)
    real = rng.random() < 0.7 or kind == "email"
    if kind == "email":
        name, host = rng.choice(["jo.day", "m_roe", "info", "lee77"]), rng.choice(["mail", "post-box", "acme"])
        return kind, rng.choice([f"{name} @ {host}.org", f"{name}(at){host}.org", f"{name} [at] {host} [dot] org"]), True
    if kind == "ip":
        parts = [rng.randrange(1, 256) for _ in range(4)]
        if not real:
            parts[rng.randrange(4)] = rng.randrange(256, 1000)
        return kind, rng.choice([",", ". "]).join(map(str, parts)), real
    if kind == "card":
        head = str(rng.randrange(10**14, 10**15))
        check = next(c for c in "0123456789" if luhn(head + c))
        number = head + (check if real else str((int(check) + rng.randrange(1, 10)) % 10))
        return kind, ".".join(number[i : i + 4] for i in range(0, 16, 4)), real
    if not real:
        return kind, f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", False
    a, b = rng.randrange(200, 999), rng.randrange(1000, 10000)
    return kind, rng.choice([f"1 ({a}) 555-{b}", f"1.{a}.555.{b}"]), True


def test_learned_model_finds_planted_variants_in_held_out_documents(spark):
    """Fitted on even documents; odd ones get one planted form each, between two of their words."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.fit(table.where("doc_id % 2 = 0"))
    rng, rows, truth = random.Random(5), [], {}
    for r in table.where("doc_id % 2 = 1 and text is not null").orderBy("doc_id").collect():
        kind, form, real = planted(rng)
        w = re.split("(?<=[a-z]) (?=[a-z])", r.text, maxsplit=1)
        if len(w) < 2:
            continue
        rows.append((r.doc_id, f"{w[0]} {form} {w[1]}"))
        truth[r.doc_id] = (kind, len(w[0]) + 1, len(w[0]) + 1 + len(form), real)
    good, wrong, missed = Counter(), Counter(), Counter()
    plain = {r.doc_id: set(r.spans.split(",")) for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string"), [([], np.inf)] * 4).collect()}
    for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        kind, s, e, real = truth[r.doc_id]
        added = set(r.spans.split(",")) - plain[r.doc_id]
        at = {x for x in added if int(x.split(":")[1]) < e and int(x.split(":")[2]) > s}
        hit = real and f"{kind}:{s}:{e}" in at
        good[kind] += hit
        missed[kind] += real and not hit
        for x in at - ({f"{kind}:{s}:{e}"} if real else set()):
            wrong[x.split(":")[0]] += 1
    print("found", dict(good), "missed", dict(missed), "wrong", dict(wrong))
    assert sum(good.values()) >= 0.9 * (sum(good.values()) + sum(missed.values()))
    assert sum(good.values()) >= 0.95 * (sum(good.values()) + sum(wrong.values()))
    assert all(good[k] >= 0.7 * (good[k] + missed[k]) for k in pii.KINDS)


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_meets_the_targets(spark, docs):
    got = mixing.mix_sources(spark, docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    target = brute_targets({r.source: sizes[r.source] for r in rows})
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    assert sorted((r.source_size, round(r.target, 4)) for r in got) == sorted((sizes[r.source], round(target[r.source], 4)) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[round(r.target, 4)] += r.taken
    for t, n in taken.items():
        assert abs(n - t) <= 4 * mixing.BLOCK
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(spark, docs.repartition(5)).collect()))


def test_mixing_gives_small_sources_their_words(spark):
    """A long tail of sources below one block, beside large ones: each gives the whole words of its target."""
    sizes = {f"s{i:03}": 10 + 7 * i for i in range(60)} | {"t1": 30_000, "t2": 9_000, "u": 1}
    table = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    target = brute_targets(sizes)
    got = {r.doc_id: r.taken for r in mixing.mix_sources(spark, table).collect()}
    assert [got[i] for i in range(len(sizes))] == [int(target[s] + 1e-6) for s in sizes]
    held = Counter()
    for r in mixing.mixed_documents(spark, table).collect():
        held[r.source] += len(r.text.split())
    assert [held[s] for s in sizes] == [int(target[s] + 1e-6) for s in sizes]
    slots = mixing.mixed_segments(spark, table).where("slot is not null").select("slot", "sid").distinct()
    assert slots.count() == slots.select("slot").distinct().count()


def test_mix_segments_read_each_source_in_order(spark, docs):
    seg = mixing.mixed_segments(spark, docs.where("source = 's1'"), block=64).where("slot is not null").collect()
    assert all(0 <= r.start < r.end <= r.size for r in seg)
    per_slot = Counter()
    for r in seg:
        per_slot[r.slot] += r.end - r.start
    assert set(per_slot.values()) - {64} == set() or len([v for v in per_slot.values() if v != 64]) == 1  # only the last is cut


@pytest.mark.parametrize("words", [1, 700, 20_000])
def test_each_source_has_its_slots_spread_over_the_schedule(spark, words):
    sizes = {0: 5 * words, 1: 2 * words, 2: words, 3: max(1, words // 40), 4: 0}
    targets = spark.createDataFrame([(s, float(t)) for s, t in sizes.items()], "sid long, target double")
    got = sorted(tuple(r) for r in mixing.schedule(spark, targets, block=16).collect())
    need = {s: -(-t // 16) for s, t in sizes.items()}
    length = sum(need.values())
    assert [slot for slot, *_ in got] == list(range(length))
    seen, worst = Counter(), 0.0
    for slot, sid, rank in got:
        assert rank == seen[sid]  # ranks follow the schedule
        seen[sid] += 1
        worst = max(worst, *(abs(seen[s] - (slot + 1) * n / length) for s, n in need.items()))
    assert dict(seen) == {s: n for s, n in need.items() if n} and worst <= np.log2(length + 1) + 1


def test_mixed_documents_hold_the_words_of_the_targets(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(30)), f"s{i % 3}", 7) for i in range(60)] + [(900, "a b\tc d", "s3", 7), (901, "lone " * 4000, "s4", 7)]
    rows += [rows[0], rows[0], (None, "x y z", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    wanted = {r.source: int(r.target) for r in mixing.mix_sources(spark, docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()}
    got = mixing.mixed_documents(spark, docs).collect()
    held = Counter()
    for r in got:
        held[r.source] += len(r.text.split())
        assert r.n_chars == (7 if r.text in {t for _, t, *_ in rows} else len(r.text))
    assert {s: held[s] for s in wanted} == wanted and all(r.text in next(t for i, t, *_ in rows if i == r.doc_id) for r in got)
    assert max(Counter(r.doc_id for r in got if r.doc_id not in (0, None)).values()) <= 3


def test_mixed_documents_and_empty_tables(spark, docs, empty):
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns and mixed.where("text is null or text = ''").count() == 0
    assert mixing.mix_sources(spark, empty).count() == 0 and mixing.mixed_documents(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_length_buckets_are_optimal(seed):
    r = random.Random(seed)
    lengths = np.array(sorted(r.sample(range(1, 60), 9)))
    counts = np.array([r.randint(1, 9) for _ in lengths])

    def waste(bounds):
        return sum(int(c) * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

    from itertools import combinations

    for k in (1, 2, 3, 4, 12):
        got = packing.bucket_bounds(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1]
        assert waste(got) == min(waste((*c, lengths[-1])) for j in range(min(k, 9)) for c in combinations(lengths[:-1], j))


def test_packing_fills_batches(spark, docs, empty):
    got = packing.pack(docs, buckets=4, budget=1000).collect()
    assert len(got) == docs.count()
    held = {}
    for r in got:
        if r.n_tokens == 0:
            assert (r.bucket, r.batch) == (-1, None)
            continue
        assert r.n_tokens + r.padding == r.bucket_bound
        held.setdefault(r.batch, []).append(r)
    for rows in held.values():
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or sum(r.bucket_bound for r in rows) <= 1000
    assert packing.pack(empty).count() == 0
    rows = spark.range(1, 1200).select(packing.length_bin(packing.F.col("id")).alias("b"), "id").collect()
    assert all(r.id <= r.b <= max(r.id, r.id * (1 + 2**-7)) for r in rows) and all(r.b == r.id for r in rows if r.id <= 256)


def test_a_bucket_is_as_long_as_its_longest_document(spark):
    rows = [(i, "w " * n) for i, n in enumerate([3, 259, 259, 517, 1030, 1031, 70_001])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3, budget=2100).collect()
    assert {max(r.n_tokens for r in got if r.bucket == b) for b in range(3)} == {r.bucket_bound for r in got}


def test_packing_shards_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    got = packing.pack(spark.range(95).selectExpr("id as doc_id", "'a b c' as text"), budget=12).collect()
    sizes = Counter(r.batch for r in got)
    assert max(sizes.values()) == 4 and len(got) == 95 and len({b.split("-")[1] for b in sizes}) > 5


def brute_repeats(rows: list[tuple]) -> Counter:
    seen, out = Counter(), Counter()
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in raw:
        seen.update(b[s : s + 400] for s in range(len(b) - 399))
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


def test_repeated_strings_equal_brute_force(spark, docs, empty):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij ") for _ in range(2500))
    texts = [base, "x" + base[100:499] + "y", "q" + base[1000:1401] + "é" + base[1300:1750], base[:399], base[:400] + base[:400], "The " * 300, base[600:1100] + "z" + base[601:1100] + base[50:460]]
    table = docs.where("length(text) < 20000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert Counter(tuple(x) for x in suffix_dedup.remove_repeats(table, keep_text=False).collect()) == brute_repeats(table.collect())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_survive_local_settling(spark, monkeypatch):
    """Many blocks under one suffix in one task: only a few are sent, none is lost."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50)
    r = random.Random(6)
    passage = "".join(r.choice("klmnopqrst ") for _ in range(700))
    rows = [(i, "".join(r.choice("abc") for _ in range(150)) + passage[r.randint(0, 120) : 700 - r.randint(0, 90)] + "".join(r.choice("xyz") for _ in range(90))) for i in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(tuple(x)[:5] for x in got.collect()) == brute_repeats(rows)


def test_a_single_context_beside_many_repeated_ones_is_looked_at(spark):
    """More block kinds under one suffix than a slice sends, all sent ones repeated: the one held back meets them still."""
    r = random.Random(7)
    rows = []
    for _ in range(25):
        passage = "".join(r.choice("klmnopqrst ") for _ in range(520))
        for context in range(9):
            text = "".join(r.choice("abcdefgh") for _ in range(60)) + passage + "".join(r.choice("uvwxyz") for _ in range(40))
            rows += [(len(rows) + i, text) for i in range(2 if context else 1)]
    for parts in (1, 3):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), keep_text=False)
        assert Counter(tuple(x) for x in got.collect()) == brute_repeats(rows)


def test_language_is_learnt_and_undetermined_without_letters(spark, docs, empty):
    r = random.Random(8)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !! 3", "aa"), (903, "abcde " * 30_000, None), (None, "vwxyz vwxyz", "bb")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    assert all(x.lang_pred == truth[x.doc_id] for x in got if x.doc_id is not None and x.doc_id < 900)
    late = {x.doc_id: x for x in got if x.doc_id is None or x.doc_id >= 900}
    assert [late[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"] and late[None].held_out
    assert all(0 <= x.score <= 1 for x in got) and late[900].score == 0
    assert language.identify(empty).count() == 0
    none = language.identify(docs.withColumn("lang", packing.F.lit(None).cast("string")), keep=tuple(docs.columns))
    assert {x.lang_pred for x in none.collect()} == {"und"}


@pytest.mark.parametrize("text", ["", "o", "ok", "ok!", "abcd", "abcde"])
def test_language_of_a_short_text_alone(spark, text):
    got = language.presence(np.frombuffer(text.encode(), np.uint8), np.array([0, 0, len(text), len(text)]), np.ones((4, language.SLOTS), np.uint8))
    grams = {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}
    assert got.sum(1).tolist() == [0, len(grams), 0]
    one = spark.createDataFrame([(1, text, "aa")], "doc_id long, text string, lang string").coalesce(1)
    assert [r.lang_pred for r in language.identify(one).collect()] == ["aa" if text else "und"]


def test_language_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.identify(docs, keep=("doc_id", "lang")).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_quality_model_and_its_features(spark, folder, empty):
    data = np.frombuffer(b"Ab cd! EF|\nab ab" + b"" + b"x", np.uint8)
    x = quality.features(data, np.array([0, 16, 16, 17]))
    named = dict(zip(quality.FEATURES, x.T, strict=True))
    assert named["words"].tolist() == [np.log1p(5), 0, np.log1p(1)] and named["repeats"].tolist() == [0.2, 0, 0]
    assert named["distinct_words"].tolist() == [0.8, 0, 1] and named["lines"].tolist() == [np.log1p(2), 0, np.log1p(1)]
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_quality(docs, quality.learn(docs, labels)).collect()}
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9 if bad else True
    none = quality.learn(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(empty, none).count() == 0
    odd = quality.score_quality(spark.createDataFrame([(1, None), (1, ""), (None, "a" * 100_000)], "doc_id long, text string"), none).collect()
    assert [r.score for r in odd] == [0.5] * 3 and not [r for r in odd if r.doc_id is None][0].held_out


def test_additive_model_with_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.9
    assert {(f, g) for f, g, _ in model.pairs} >= {(0, 1)}
