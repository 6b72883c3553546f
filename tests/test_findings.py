"""Review findings: the regressions that matter."""

from siteloom.operators import findings as Q
from siteloom.operators import tasks as TK

ENT = "site string, page_id long, path string, url string, kind string, value string"


def ents(spark, *rows):
    return spark.createDataFrame([("s", i, p, f"https://s.example{p}", k, v) for i, p, k, v in rows], ENT)


def test_directory_listing_emails_are_no_contradiction(spark):
    df = ents(spark, *[(i, f"/members/{i}", "emails", f"m{i}@x.co") for i in range(6)])
    assert Q.contradictions(df).count() == 0


def test_formatting_is_no_contradiction(spark):
    df = ents(spark, (1, "/", "phones", "(03) 260 1566"), (2, "/contact", "phones", "032601566"))
    assert Q.contradictions(df).count() == 0


def test_competing_phones_are_one(spark):
    df = ents(
        spark, (1, "/", "phones", "(03) 260 1566"), (2, "/services", "phones", "032601566"), (3, "/x", "phones", "032601566"),
        (4, "/contact-us/", "phones", "(03) 111 2222"), (5, "/deep/page", "phones", "(03) 999 9999"),
    )
    q = Q.contradictions(df).first()
    assert q.options == ["032601566", "(03) 111 2222", Q.NONE_OF_THESE]
    assert q.prompt == 'This site lists different phone numbers across pages: "032601566", "(03) 111 2222". Which is correct?'
    assert q.required and q["rank"] == 100
    ev = Q.contradiction_evidence(df).collect()
    assert sorted((e.label, e.page_id) for e in ev) == [("(03) 111 2222", 4), ("032601566", 1), ("032601566", 2), ("032601566", 3)]
    assert Q.contradiction_evidence(df, pages=2).count() == 3


def test_shop_prices_are_no_contradiction(spark):
    df = ents(spark, (1, "/", "prices", "$1"), (2, "/", "prices", "$2"))
    assert Q.contradictions(df).count() == 0


def test_many_values_are_all_kept(spark):
    rows = [(2 * i + j, f"/p/{2 * i + j}", "emails", f"m{i:02d}@x.co") for i in range(30) for j in range(2)]
    df = ents(spark, *rows)
    assert Q.contradiction_values(df).count() == 30
    q = Q.contradictions(df).first()
    assert len(q.options) == 31 and all(f'"m{i:02d}@x.co"' in q.prompt for i in range(30))
    short = Q.contradictions(df, listed=20).first()
    assert " and 10 more." in short.prompt and short.options == q.options


def signals(spark, *rows):
    cols = (
        "site string, page_id long, path string, url string, http_status int, title string, words long, "
        "no_description boolean, bad_images long, phrase string, phrase_excerpt string, excerpt string"
    )
    return spark.createDataFrame(
        [("s", i, p, u, st, "t", w, nd, bad, ph, ph, "t") for i, p, u, st, w, nd, bad, ph in rows], cols
    )


def test_thin_url_variants_fold(spark):
    s = signals(
        spark, (1, "/login/", "https://s.example/login/", 200, 12, False, 0, None),
        (2, "/login/", "https://s.example/login/?out=1", 200, 14, False, 0, None), (3, "/x", "https://s.example/x", 200, 0, False, 0, None),
    )
    rows = Q.signal_rows(s)
    q = Q.page_questions(rows).collect()
    assert len(q) == 1 and q[0].prompt.startswith("/login/ has only 14 words (2 URL variants).")
    assert Q.page_evidence(rows).count() == 2


def test_error_pages_give_only_their_own_question(spark):
    s = signals(spark, (1, "/old", "https://s.example/old", 404, 5, True, 3, "Coming soon"))
    q = Q.page_questions(Q.signal_rows(s)).collect()
    assert [(x.finding, x.kind) for x in q] == [("http-error", "keep-or-kill")]


def test_fingerprint_ignores_row_order(spark):
    rows = [(i, f"/{i}", f"https://s.example/{i}", 200, 100, True, 0, None) for i in range(20)]
    a = Q.page_questions(Q.signal_rows(signals(spark, *rows))).first().fingerprint
    b = Q.page_questions(Q.signal_rows(signals(spark, *reversed(rows)).repartition(7))).first().fingerprint
    assert a == b


def test_overlap_and_rank(spark):
    cols = "site string, fingerprint string, kind string, required boolean, rank int, seq int"
    q = spark.createDataFrame(
        [("s", "a", "keep-or-kill", False, 40, 1), ("s", "b", "keep-or-kill", False, 48, 2), ("s", "c", "keep-or-kill", True, 0, 3),
         ("s", "d", "keep-or-kill", False, 80, 4), ("s", "e", "contradiction", True, 0, 5), ("s", "b", "keep-or-kill", False, 48, 9)], cols,
    )
    ev = spark.createDataFrame(
        [("s", f, f"https://s.example{p}") for f, ps in {"a": ["/1"], "b": ["/1", "/2?x=1"], "c": ["/2"], "d": ["/1", "/2"]}.items() for p in ps],
        "site string, fingerprint string, url string",
    )
    got = [(r.fingerprint, r.score) for r in Q.rank_questions(q, ev).orderBy("place").collect()]
    assert got == [("e", 100), ("c", 45), ("d", 80)]


def test_answers_become_tasks(spark):
    cols = "site string, fingerprint string, kind string, prompt string, answer string, spawns_tasks boolean, evidence_pages long"
    rows = [
        ("contradiction", "p", "a@b.co", "fix-contact"), ("contradiction", "p", "None of these — I will clarify", "custom"),
        ("authenticity", "p", "Keep — it is intentional", None), ("authenticity", "p", "Only rewrite home", "rewrite-placeholder"),
        ("keep-or-kill", "p", "Merge into another page", "custom"), ("keep-or-kill", "p", "Keep as-is", None),
        ("missing-info", "49 page(s) have no meta description", "Yes — generate meta descriptions", "generate-meta"),
        ("missing-info", "157 image(s) on 50 page(s) lack alt text", "No — skip", None), ("mapping", "p", "faq", "map-block"),
    ]
    df = spark.createDataFrame([("s", str(i), k, p, a, True, 3) for i, (k, p, a, _) in enumerate(rows)], cols)
    got = {int(r.fingerprint): r for r in TK.tasks_for_answer(df).collect()}
    assert {i for i, r in enumerate(rows) if r[3]} == set(got)
    for i, r in got.items():
        assert r.action == rows[i][3]
    assert got[6].page_count == 49 and got[3].title == "Rewrite placeholder copy (rewrite home)"


def test_questions_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    schema = "site string, finding string, key string, page_id long, path string, url string, http_status int, words int, bad_images long, phrase string, excerpt string"
    rows = spark.createDataFrame([("s", "missing-meta", "", i, f"/p{i}", f"https://s.example/p{i}", 200, 90, 0, None, "x") for i in range(10)], schema)
    (q,) = Q.page_questions(rows.mapInPandas(counted, schema)).collect()
    assert q.prompt.startswith("10 page(s)") and "/p0, /p1, /p2)" in q.prompt
    assert seen.value == 10


def test_collection_fields_extract_titles_once(spark, folder, monkeypatch):
    from siteloom.plans import REGISTRY
    from siteloom.plans import derived as V

    made, titled = [], V.titled_pages
    monkeypatch.setattr(V, "titled_pages", lambda *a: made.append(a) or titled(*a))
    plan = REGISTRY["collection_fields"].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "<title" not in plan
