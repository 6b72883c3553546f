"""Brute-force comparisons, determinism and plan shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.operators import condense as C
from siteloom.operators import crawl as K
from siteloom.operators import extract as X
from siteloom.operators import near_duplicates as N
from siteloom.operators.near_duplicates import near_duplicate_pages
from siteloom.plans import REGISTRY
from siteloom.sources import tables as T


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = {}
    for g in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for c in range(12):
            words = list(base)
            if c % 3:
                words[rng.randrange(120)] = f"x{g}{c}"
            texts[g * 100 + c] = " ".join(words)
    for g in range(6, 14):  # chains: each close to the one before, not to the first
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for c in range(6):
            texts[g * 100 + c] = " ".join(words)
            for k in range(3):
                words[(c * 20 + k * 6) % 120] = f"y{g}{c}{k}"
    texts |= {2000: "", 2001: "two words", 2002: "two words"}
    rows = [("s", i, t) for i, t in texts.items()]
    got = {r.page_id: r.dup_of for r in near_duplicate_pages(spark.createDataFrame(rows, "site string, page_id long, text string")).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))}

    sets = {i: grams(t) for i, t in texts.items()}
    for i in texts:
        near = [j for j in texts if j < i and sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
        assert got.get(i) == min(near, default=None)


def test_near_duplicates_of_repeated_rows_and_of_any_threshold(spark):
    """Rows that come twice are one page, not a page whose sketch cancels out."""
    rng = random.Random(11)
    pages = []
    for k in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 6, 40, 150]))]
        pages += [base, [*base[:-1], f"z{k}"] if len(base) > 6 else [*base, f"z{k}"]]
    rows = [("s", i, " ".join(p)) for i, p in enumerate(pages) for _ in range(2)]
    sets = [{tuple(p[i : i + 3]) for i in range(max(len(p) - 2, 1))} for p in pages]
    texts = spark.createDataFrame(rows, "site string, page_id long, text string")
    for threshold in (0.25, 0.7):
        want = {}
        for i, a in enumerate(sets):
            near = [j for j in range(i) if a & sets[j] and len(a & sets[j]) / len(a | sets[j]) >= threshold]
            if near:
                want[i] = (near[0], round(len(a & sets[near[0]]) / len(a | sets[near[0]]), 6))
        assert {r.page_id: (r.dup_of, r.similarity) for r in near_duplicate_pages(texts, threshold).collect()} == want and len(want) > 10


def test_near_duplicates_deal_prefixes_and_drop_chance_pairs_before_sets_are_read(spark, monkeypatch):
    """Pages with a phrase in common meet, but neither sets nor sketches are read for two shared shingles."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = [" ".join([*words(40), "one", "rare", "phrase", "here", *words(40)]) for _ in range(80)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[:4]]
    kept = {}

    def stored(df, name, put=N.stored):
        kept.setdefault(name, []).append(put(df, name))
        return kept[name][-1]

    monkeypatch.setattr(N, "stored", stored)
    monkeypatch.setattr(N, "SAMPLE", 1)  # a single text knows of no shared shingle
    rows = [("s", i, t) for i, t in enumerate(texts)]
    got = {r.page_id: r.dup_of for r in near_duplicate_pages(spark.createDataFrame(rows, "site string, page_id long, text string")).collect()}
    assert got == {80 + i: i for i in range(4)}
    assert sum(p.count() for p in kept["near_pairs"]) <= 8 and sum(p.count() for p in kept["near_few"]) <= 16


def test_shingles_are_ordered_rarest_first_and_alike_on_every_page(spark):
    rare, often = list(range(1000, 1100)), list(range(10))
    texts = [often + rare[:20], rare[:20] + often + [7, 8, 9], [5, 6], [], [5, 6, 5, 6, 5, 6]]
    words = np.array([w for t in texts for w in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    known = (np.array(often, np.int64), np.full(10, 20))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    s, ends = N.ordered_sets(words, offsets, 3, known, none)
    sets = [s[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert [len(x) for x in sets] == [28, len({tuple(texts[1][i : i + 3]) for i in range(31)}), 1, 0, 2]
    both = [x for x in sets[0] if x in set(sets[1])]
    assert both == [x for x in sets[1] if x in set(sets[0])] and len(both) == 26
    alone = N.ordered_sets(np.array(rare[:20], np.int64), np.array([0, 20]), 3, none, none)[0]
    assert set(sets[0][:18]) == set(alone)
    again = N.ordered_sets(words, offsets, 3, known, (np.sort(alone), np.full(18, 8)))
    assert set(again[0][: again[1][1]][-18:].tolist()) == set(alone.tolist())


def test_unlike_holders_of_a_shared_shingle_are_cut_and_no_alike_pair_is(spark):
    """Pages that all hold one rare-looking passage and little else in common, beside real near copies."""
    rng = random.Random(3)
    pages = []
    for k in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 60, 200, 700]))]
        pages.append(own[:10] + ["one", "shared", "passage", "of", "words"] + own[10:])
        if k % 3 == 0:  # a near copy: some words at the end changed
            copy = pages[-1][:]
            for i in range(len(copy) // 20):
                copy[-1 - i] = f"c{k}-{i}"
            pages.append(copy)
    rows = [("s", i, " ".join(p)) for i, p in enumerate(pages)]
    sets = [{" ".join(p[i : i + 3]) for i in range(len(p) - 2)} for p in pages]
    alike = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if j < i and a & b}
    want = {}
    for (i, j), v in sorted(alike.items()):
        if v >= 0.8 and i not in want:
            want[i] = (j, round(v, 6))
    texts = spark.createDataFrame(rows, "site string, page_id long, text string")
    assert {r.page_id: (r.dup_of, r.similarity) for r in N.near_duplicate_pages(texts).collect()} == want and len(want) > 10
    hashed = texts.select("site", "page_id", F.split("text", " ").alias("words")).select("site", "page_id", N.shingles("words").alias("sh"))
    z = N.parity_sketches(hashed.select("site", "page_id", F.explode("sh").alias("s")))
    z = z.join(hashed.select("page_id", F.size("sh").alias("n")), "page_id").select("page_id", "n", "z")
    pairs = z.join(z.select(F.col("page_id").alias("dup_of"), F.col("n").alias("k"), F.col("z").alias("y")), F.col("dup_of") < F.col("page_id"))
    left = {(r.page_id, r.dup_of) for r in pairs.filter(N.may_be_close(F.col("n"), F.col("k"), F.col("z"), F.col("y"), 0.8)).collect()}
    assert left >= {p for p, v in alike.items() if v >= 0.8}
    assert len(left) < len(alike) / 10


def _near(a, b):
    """Edit distance of at most one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return len(large) - len(small) == 1 and any(large[:i] + large[i + 1 :] == small for i in range(len(large)))


def _greedy(pages):
    used, out = set(), []
    for pid, sig in pages:
        if pid in used:
            continue
        group = [pid]
        used.add(pid)
        for other, osig in pages:
            if other not in used and _near(sig, osig):
                group.append(other)
                used.add(other)
        if len(group) >= 3:
            out.append(sorted(group))
    return sorted(out)


def test_shape_clusters_equal_page_by_page_greedy(spark):
    rng = random.Random(3)
    for kinds, most, n in (("ab", 4, 25), ("ab", 6, 60), ("abc", 4, 80), ("a", 12, 40)):
        pages = [(i, tuple(rng.choice(kinds) for _ in range(rng.randrange(most)))) for i in range(n)]
        sig = spark.createDataFrame([("s", i, "/p", list(s)) for i, s in pages], "site string, page_id long, prefix string, signature array<string>")
        rows = C.cluster_pages(sig, C.shape_clusters(sig)).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r.cluster, []).append(r.page_id)
        assert sorted(sorted(g) for g in groups.values()) == _greedy(pages)


def test_crawl_order_equals_a_queue(spark):
    rng = random.Random(5)
    urls = [f"u{i}" for i in range(30)]
    links = [("s", a, b, k) for a in urls for k, b in enumerate(rng.sample(urls + ["gone"], 3))]
    order, seen, queue = [], {"u0"}, ["u0"]
    by = {a: [b for _, x, b, _ in links if x == a] for a in urls}
    while queue and len(order) < 10:
        u = queue.pop(0)
        order.append(u)
        for v in by[u]:
            if v not in seen and v != "gone":
                seen.add(v)
                queue.append(v)
    got = K.crawl_order(
        spark.createDataFrame(links, "site string, from_url string, to_url string, pos int"),
        spark.createDataFrame([("s", "u0", 0)], "site string, url string, pos int"),
        spark.createDataFrame([("s", u) for u in urls], "site string, url string"),
        cap=10,
    )
    assert [r.url for r in got.orderBy("place").collect()] == order


def test_sites_alone_equal_sites_together(spark, folder):
    docs = T.read_document_pages(spark, folder)
    whole = {tuple(r) for r in C.chrome_blocks(docs, ratio=0.05).filter("site = 'src3'").collect()}
    alone = {tuple(r) for r in C.chrome_blocks(docs.filter("site = 'src3'"), ratio=0.05).collect()}
    assert whole == alone


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["contradictions", "page_links", "robots_allowed", "platform_hits", "merge_hints", "chrome_blocks", "invalid_transitions", "deduped_pages"]
)
def test_no_cross_joins(spark, folder, name):
    text = plan(REGISTRY[name].run(spark, folder))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_are_pruned_and_top_k_is_limited_early(spark, folder):
    text = plan(T.read_pages(spark, folder).select("site", "page_id"))
    assert "html" not in text.split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(C.chrome_blocks(T.read_document_pages(spark, folder), top=20))


def test_columns_only_work_stays_out_of_python(spark, folder):
    rec = X.page_records(T.read_pages(spark, folder), tree_layouts=False)
    text = plan(X.content_hashes(rec))
    assert "Python" not in text and "Pandas" not in text and F is not None


def test_an_extraction_scans_once_without_a_join_and_makes_sections_once(spark, folder):
    rec = X.page_records(spark.read.parquet(f"{folder}/pages.parquet").selectExpr("'s' AS site", "page_id", "url", "'/' AS path", "200 AS http_status", "html"))
    text = plan(rec)
    assert text.count("FileScan") == 1 and "Join" not in text and "Exchange" not in text
    rows = plan(X.page_section_rows(rec))
    assert rows.count("ArrowEvalPython") == 1 and rows.index("Generate") < rows.index("ArrowEvalPython")
    assert "- Filter" not in rows[rows.index("Generate"):]  # no filter below makes the sections a second time


def test_only_small_tables_are_dealt_out(spark, folder):
    pages = T.table(spark, folder, "pages")
    assert "Exchange" in plan(T.spread_small(pages, "page_id"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert "Exchange" not in plan(T.spread_small(pages, "page_id"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_per_site_joins_spread_a_large_site(spark):
    from siteloom.operators.spread import join_per_site

    rows = spark.range(2000).selectExpr("if(id < 1900, 'big', concat('s', id)) AS site", "id AS page_id")
    few = spark.createDataFrame([("big", 1), ("big", 2), ("s1950", 3)], "site string, v int")
    got = join_per_site(rows, few, "page_id", "left")
    want = rows.join(few, "site", "left")
    cols = ["site", "page_id", "v"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert "_salt" in plan(got)
