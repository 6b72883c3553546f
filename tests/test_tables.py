"""Stored site tables: commits, repeats, changes; places and rule lookups over many rows."""

import random
import re

import pytest

from siteloom.operators import crawl as K
from siteloom.operators.spread import placed_within
from siteloom.sources.site_table import SiteTable

SCHEMA = "site string, page_id long, text string"


def rows_of(table):
    return sorted(map(tuple, table.read().select("site", "page_id", "text").collect()))


def files(table, run):
    fs, folder = table._fs(f"{table.root}/data/{run}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))


@pytest.fixture
def table(spark, tmp_path):
    t = SiteTable(spark, str(tmp_path / "pages"))
    t.replace(spark.createDataFrame([("a", i, f"a{i}") for i in range(50)] + [("b", 1, "b1"), ("c", 1, "c1")], SCHEMA), run="one")
    return t


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, table, monkeypatch):
    before = rows_of(table)
    monkeypatch.setattr(SiteTable, "_commit", lambda self, run: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.replace(spark.createDataFrame([("a", 9, "new")], SCHEMA), run="two")
    assert rows_of(table) == before and table.commits() == ["one"]
    monkeypatch.undo()
    assert table.replace(spark.createDataFrame([("a", 9, "new")], SCHEMA), run="two")  # the same run, begun again
    assert rows_of(table) == [("a", 9, "new"), ("b", 1, "b1"), ("c", 1, "c1")]


def test_a_repeated_run_is_no_second_commit(spark, table):
    again = spark.createDataFrame([("b", 7, "x")], SCHEMA)
    assert table.replace(again, run="two") and not table.replace(again, run="two") and not table.replace(again, run="one")
    assert table.commits() == ["one", "two"]


def test_a_crawl_without_pages_clears_its_site(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    assert table.replace(none, spark.createDataFrame([("a",), ("c",)], "site string"), run="two")
    assert rows_of(table) == [("b", 1, "b1")]
    assert table.replace(spark.createDataFrame([("a", 1, "back")], SCHEMA), run="three")
    assert rows_of(table) == [("a", 1, "back"), ("b", 1, "b1")]


def test_changes_touch_their_sites_only(spark, table):
    held = files(table, "one")
    changes = spark.createDataFrame([("b", 1, "b1", "delete"), ("b", 2, "b2", "upsert"), ("c", 1, "new", "upsert"), ("a", 3, "kept", "keep")], SCHEMA + ", change string")
    assert table.apply(changes, ["site", "page_id"], "two")
    assert rows_of(table) == sorted([("a", i, f"a{i}") for i in range(50)] + [("b", 2, "b2"), ("c", 1, "new")])
    assert files(table, "one") == held
    assert sorted(map(tuple, table.owners().collect())) == [("a", "one"), ("b", "two"), ("c", "two")]


def test_superseded_files_can_go(spark, table):
    table.replace(spark.createDataFrame([(s, 1, "x") for s in "abc"], SCHEMA), run="two")
    want = rows_of(table)
    assert table.vacuum() == ["one"] and rows_of(table) == want
    fs, folder = table._fs(f"{table.root}/data/one")
    assert not fs.exists(folder)


def test_empty_tables_and_odd_names_are_errors(spark, tmp_path):
    t = SiteTable(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="nothing was committed"):
        t.read()
    with pytest.raises(ValueError, match="file name"):
        t.replace(spark.createDataFrame([("a", 1, "x")], SCHEMA), run="a/b")


def test_places_equal_a_window_over_the_site(spark):
    r = random.Random(4)
    rows = [("big" if i % 3 else f"s{i % 11}", r.randrange(40), i) for i in range(3000)]
    got = placed_within(spark.createDataFrame(rows, "site string, k int, i long").repartition(7), ["site"], ["k", "i"]).collect()
    by = {}
    for s, _, i in sorted(rows):
        by.setdefault(s, []).append(i)
    assert len(got) == 3000 and all(by[g.site][g.place - 1] == g.i for g in got)


def test_many_robots_rules_equal_one_try_each(spark):
    r = random.Random(8)
    part = lambda: "".join(r.choice("ab/") for _ in range(r.randrange(1, 6)))
    rules = {s: [(r.random() < 0.4, "/" + part()) for _ in range(700)] + [(True, "/*a$"), (False, "/b*/a"), (False, "/c.d+")] for s in ("x", "y")}
    body = lambda s: "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules[s])
    paths = [(s, f"https://{s}.example/{part()}{part()}") for s in ("x", "y", "z") for _ in range(150)] + [("x", "https://x.example/c.d+e?q=1")]
    got = K.robots_allowed(spark.createDataFrame(paths, "site string, url string"), spark.createDataFrame([(s, body(s)) for s in rules], "site string, body string"))

    def allowed(site, url):
        path = url.split(".example", 1)[1]
        hits = [(len(p), a) for a, p in rules.get(site, []) if re.match("^" + re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path)]
        return max(hits)[1] if hits else True

    have = sorted((x.site, x.url, x.allowed) for x in got.collect())
    assert have == sorted((s, u, allowed(s, u)) for s, u in paths)
    assert {a for *_, a in have} == {True, False} and got.columns == ["site", "url", "allowed"]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_crawl_places_without_a_limit_equal_a_queue(spark):
    r = random.Random(6)
    urls = [f"u{i}" for i in range(40)]
    links = [("s", a, b, k) for a in urls for k, b in enumerate(r.sample([*urls, "gone"], 2))]
    by = {a: [b for _, x, b, _ in links if x == a and b != "gone"] for a in urls}
    queue, depth = ["u0"], {"u0": 0}
    for u in queue:
        for v in by[u]:
            if v not in depth:
                depth[v] = depth[u] + 1
                queue.append(v)
    got = K.crawl_order(
        spark.createDataFrame(links, "site string, from_url string, to_url string, pos int"),
        spark.createDataFrame([("s", "u0", 0)], "site string, url string, pos int"),
        spark.createDataFrame([("s", u) for u in urls], "site string, url string"),
    ).collect()
    assert [(x.url, x.depth) for x in sorted(got, key=lambda x: x.place)] == [(u, depth[u]) for u in queue]
    assert not any("adjacency" in t.name for t in spark.catalog.listTables())


def test_sites_crawled_at_once_equal_those_crawled_level_by_level(spark):
    """Ties, repeated and missing positions, several seeds, loops, and a chain whose depth costs no jobs when crawled at once."""
    r = random.Random(8)
    links = [(s, f"u{a}", f"u{r.randrange(30)}", r.choice([None, 0, 1, 1, 2])) for s in "ab" for a in range(25) for _ in range(r.randrange(4))]
    chain = [("c", f"v{i}", f"v{i + 1}", 0) for i in range(150)]
    args = (
        spark.createDataFrame([*links, *chain, (None, "u1", "u2", 0)], "site string, from_url string, to_url string, pos int"),
        spark.createDataFrame([("a", "u0", 0), ("b", "u3", 1), ("b", "u4", 1), ("b", "gone", 0), ("c", "v0", 0)], "site string, url string, pos int"),
        spark.createDataFrame([*[(s, f"u{a}") for s in "abd" for a in range(28)], *[("c", f"v{i}") for i in range(151)], ("a", None), (None, "u1")], "site string, url string"),
    )
    rows = lambda df: sorted(df.collect(), key=str)
    spark.sparkContext.setJobGroup("at-once", "")
    whole = K.crawl_order(*args)
    got = rows(whole)
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("at-once")) < 60
    assert [x.depth for x in sorted((x for x in got if x.site == "c"), key=lambda x: x.place)] == list(range(151))
    few = (args[0].filter("site <> 'c'"), *args[1:])
    for more in ({}, {"cap": 7}, {"places": False}):
        one, many = K.crawl_order(*few, **more), K.crawl_order(*few, **more, links_at_once=20)
        assert one.schema == many.schema and rows(one) == rows(many) != []
    assert whole.columns == ["site", "url", "depth", "place"]


def test_the_last_checkpoint_of_many_equals_a_scan(spark):
    from siteloom.operators.lifecycle import as_of_labels

    r = random.Random(9)
    marks = [(e, r.randrange(0, 10_000) / 100, f"m{i:04}") for e in ("x", "y") for i in range(800)] + [("y", -3.0, "below"), ("z", 50.0, "late")]
    asked = [(i, r.choice(["x", "y", "z", "none", None]), r.choice([None, 0.0, 12.5, 100.0, r.random() * 100])) for i in range(500)]
    got = as_of_labels(spark.createDataFrame(asked, "instance long, effect string, percent double"), spark.createDataFrame(marks, "effect string, at_percent double, label string"))
    for x in got.collect():
        below = [(at, label) for e, at, label in marks if e == x.effect and at <= (x.percent or 0)]
        assert x.step == (max(below)[1] if below else None)
    assert got.count() == 500 and got.columns == ["instance", "effect", "percent", "step"]
