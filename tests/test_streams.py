"""Streaming operators over several micro-batches equal their batch twins."""

import datetime as dt
import hashlib
import os
import time

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siteloom.plans import REGISTRY
from siteloom.plans import stream_queries as SQ
from siteloom.sources import tables as T
from siteloom.streaming import runner as R
from siteloom.streaming import streams as ST


@pytest.fixture(scope="module")
def parts(folder, tmp_path_factory):
    """The events in three files by time, the second repeating some rows of the first late."""
    out = tmp_path_factory.mktemp("parts")
    events = pd.read_parquet(f"{folder}/events.parquet").sort_values(["ts", "event_id"])
    third = len(events) // 3
    for i, rows in enumerate((events[:third], events[third : 2 * third], events[2 * third :])):
        path = out / f"part{i}.parquet"
        rows.to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))  # files arrive in this order
    return str(out)


def streamed(spark, parts):
    return R.read_stream(spark, parts, "part*.parquet", files_per_batch=1)


def test_progress_state_is_carried_over_batches(spark, folder, parts):
    got = R.run_to_table(ST.throttle_progress_stream(SQ.progress(streamed(spark, parts))), "progress", "update", on_batch=lambda b, i: b)
    assert got.select("batch").distinct().count() == 3
    want = ST.throttle_progress(SQ.progress(T.table(spark, folder, "events")))
    cols = ["instance", "effect", "event_id", "percent"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_hourly_sweep_closes_hours_between_batches(spark, folder, parts):
    got = R.run_to_table(ST.hourly_sweep(T.as_history(streamed(spark, parts))), "sweep")
    whole = R.run_to_table(ST.hourly_sweep(T.as_history(R.read_stream(spark, folder, "events.parquet"))), "sweep")
    cols = ["hour_ms", "events", "queued", "done", "failed"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))


def test_rows_behind_the_watermark_are_dropped(spark, parts, tmp_path):
    for i in range(3):
        rows = pd.read_parquet(f"{parts}/part{i}.parquet")
        if i == 2:  # one row of the very first hour comes with the last file
            late = pd.read_parquet(f"{parts}/part0.parquet")[:1].assign(event_id=10**9)
            rows = pd.concat([rows, late])
        path = tmp_path / f"part{i}.parquet"
        rows.to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    late = R.run_to_table(ST.hourly_sweep(T.as_history(streamed(spark, str(tmp_path)))), "sweep")
    plain = R.run_to_table(ST.hourly_sweep(T.as_history(streamed(spark, parts))), "sweep")
    assert late.agg(F.sum("events")).first()[0] == plain.agg(F.sum("events")).first()[0]


def test_repeated_pages_are_dropped_across_batches(spark, parts):
    pages = streamed(spark, parts).select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("site"), F.col("event_id").alias("page_id"), F.col("event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("seen_at")
    )
    out = R.run_to_table(ST.deduped_page_stream(pages, "60 days"), "pages", partition_by=["site"])
    assert out.count() == out.select("site", "content_hash").distinct().count() > 1


CHANGES = "site long, question_id long, draft boolean, event_id long, at timestamp, required boolean, answer string, deleted boolean"


def test_deleting_a_draft_uncovers_the_published_question(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [
        [(1, 1, False, 1, at(1), True, None, False), (1, 2, False, 2, at(1), True, "yes", False), (1, 3, True, 3, at(1), True, " ", False)],
        [(1, 1, True, 4, at(2), True, "drafted", False), (1, 2, True, 5, at(2), True, None, False), (1, 3, True, 6, at(3), True, None, True)],
        [(1, 1, True, 7, at(4), True, None, True), (1, 2, True, 8, at(4), False, None, False), (1, 3, True, 9, at(2), True, None, False)],  # the last one is late
    ]
    wanted = [2, 1, 1]  # questions 1 and 3; 2 (under 1's answered draft); 1 (uncovered)
    for i, rows in enumerate(batches):
        path = tmp_path / f"part{i}.parquet"
        pq.write_table(spark.createDataFrame(rows, CHANGES).toArrow(), path)
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    stream = streamed(spark, str(tmp_path)).withColumn("at", F.col("at").cast("timestamp"))
    got = R.run_to_table(ST.open_question_deltas(stream), "open", "update", on_batch=lambda b, i: b)
    by_batch = {r.batch: r.d for r in got.groupBy("batch").agg(F.sum("delta").alias("d")).collect()}
    assert [sum(by_batch.get(k, 0) for k in range(i + 1)) for i in range(3)] == wanted
    every = spark.createDataFrame([r for b in batches for r in b], CHANGES)
    assert [tuple(r) for r in ST.open_required(every).collect()] == [(1, 1)]


def test_open_questions_over_batches_equal_the_batch_twin(spark, folder, parts):
    deltas = R.run_to_table(ST.open_question_deltas(SQ.question_changes(streamed(spark, parts))), "open", "update", on_batch=lambda b, i: b)
    assert deltas.select("batch").distinct().count() == 3
    got = {tuple(r) for r in ST.open_questions(deltas).filter("open_required > 0").collect()}
    assert got == {tuple(r) for r in ST.open_required(SQ.question_changes(T.table(spark, folder, "events"))).collect()} != set()


def test_late_pages_are_refused_listed_and_leave_the_state(spark, tmp_path):
    """Eight files, one a micro-batch, ten hours apart: old state goes, late new content is listed, near repeats are dropped."""
    hour = 3600
    files = [[("a", 100 * i + k, f"h{i}-{k}", 10 * i * hour + 60 * k) for k in range(50)] for i in range(8)]
    files[1].append(("a", 801, "h1-3", 10 * hour + 50 * 60))  # a repeat within the delay
    files[6].append(("a", 802, "late", 5 * hour))  # behind the watermark, content not seen before
    files[6].append(("a", 803, "h0-1", 5 * hour))  # behind the watermark too, but its content is known
    files[7].append(("a", 804, "h0-2", 70 * hour))  # state of this content has gone: it comes again
    files[7].append(("a", 805, "h7-1", 69 * hour))  # out of order within the delay
    schema = "site string, page_id long, content_hash string, seconds long"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (part,) = (tmp_path / f"w{i}").glob("*.parquet")
        target = tmp_path / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    timed = lambda df: df.withColumn("seen_at", F.timestamp_seconds(F.col("seconds") + 1_700_000_000)).drop("seconds")
    reports = []
    pages = timed(R.read_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1))
    kept = R.run_to_table(ST.deduped_page_stream(pages, "2 hours"), "late-pages", progress=reports)
    ids = sorted(r.page_id for r in kept.collect())
    assert len(ids) == len(set(ids)) == 8 * 50 + 1 and 804 in ids
    assert not {801, 802, 803} & set(ids)
    assert len({701, 805} & set(ids)) == 1  # one of the two rows of h7-1
    every = timed(spark.read.parquet(str(tmp_path / "in")))
    assert [r.page_id for r in ST.refused_pages(every, kept).collect()] == [802]
    held = [r["stateOperators"][0]["numRowsTotal"] for r in reports if r["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 3 * 52  # never all 400
    assert sum(r["stateOperators"][0]["numRowsDroppedByWatermark"] for r in reports if r["stateOperators"]) == 2


def table_folder(spark, out, name, rows, schema, files):
    """``rows`` as a table's folder of that many part files, as a cluster writes it."""
    spark.createDataFrame(rows, schema).repartitionByRange(files, schema.split()[0]).write.parquet(f"{out}/{name}.parquet")


def test_pages_are_streamed_from_a_table_folder(spark, tmp_path):
    """Far repeats, late new content and nulls: every content of a site once, as the SQL has it."""
    rows = [(i, None if i % 50 == 7 else f"text {i % 400}", "en", ("web", "news")[i // 3 % 2], 6) for i in range(1000)]
    table_folder(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long", 5)
    got = [tuple(r) for r in REGISTRY["stream_pages"].run(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()[:32]
    assert set(got) == {(s, digest(t)) for _, t, _, s, _ in rows}


def test_contents_are_whole_over_many_micro_batches(spark, tmp_path):
    rows = [(i, f"text {i % 700}", "en", "web", 6) for i in range(1000)]
    table_folder(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long", 5)
    for k, part in enumerate(sorted((tmp_path / "documents.parquet").glob("part-*.parquet"), reverse=True)):
        os.utime(part, (1_700_000_000 + 60 * k,) * 2)  # the newest rows come first
    seen = lambda df: df.select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), F.md5("text").alias("content_hash"), F.timestamp_seconds(F.col("doc_id") * 60 + 60).alias("seen_at"))
    kept = R.run_to_table(ST.deduped_page_stream(seen(R.read_stream(spark, str(tmp_path), "documents.parquet", files_per_batch=1)), "2 hours"), "pages")
    every = seen(T.table(spark, str(tmp_path), "documents"))
    assert kept.select("site", "content_hash").distinct().count() < 700  # some came behind the watermark only
    assert ST.all_contents(every, kept).count() == 700


def test_redirects_are_streamed_from_a_table_folder(spark, tmp_path):
    paths = ["/", "/a/", "/a.html", "/b", "/c/d.html", "/c/d/"]
    rows = [(i, f"https://s{i % 2}.example{p}", "<p>x</p>") for i, p in enumerate(paths * 3)]
    table_folder(spark, tmp_path, "pages", rows, "page_id long, url string, html string", 3)
    got = {r.page_id: (r.path, r.status, r.location) for r in REGISTRY["stream_redirects"].run(spark, str(tmp_path)).collect()}
    wanted = {"/": ("/", 200, "/"), "/a/": ("/a/", 308, "/a"), "/a.html": ("/a.html", 301, "/a"), "/b": ("/b", 200, "/b"), "/c/d.html": ("/c/d.html", 301, "/c/d"), "/c/d/": ("/c/d/", 308, "/c/d")}
    assert got == {i: wanted[p] for i, p in enumerate(paths * 3)}


class HeldState(dict):
    """Map state of one key, and how often it was asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_a_call_of_the_progress_gate_takes_many_runs():
    held = HeldState()
    gate = ST.ProgressGate()
    gate.init(type("Handle", (), {"getMapState": lambda self, name, key, value: held})())
    rows = lambda part: pd.DataFrame([(f"r{i % 3}", str(i % 3), "e", i, i * 100, i * 100, 5.0 * (i // 3)) for i in part], columns=["run", "instance", "effect", "event_id", "at", "ms", "percent"])
    out = []
    for parts in ([range(9, 18), range(9)], [range(18, 30)]):  # two micro-batches, the first in two unordered Arrow batches
        out += [r for pdf in gate.handleInputRows((7,), iter([rows(p) for p in parts]), None) for r in pdf.itertuples(index=False, name=None)]
    assert sorted(out) == sorted((str(i % 3), "e", i, 5 * (i // 3)) for i in range(30) if i // 3 % 2 == 0)
    assert held.asked == 6 and held == {(f"r{k}",): (40, (24 + k) * 100) for k in range(3)}


def test_runs_with_null_keys_stay_apart(spark, tmp_path):
    rows = [(None, "e", 1, 5.0), (None, None, 2, 6.0), (1, None, 3, 7.0), (1, "e", 4, 8.0), (1, "e", 5, 9.0), (2**60 + 1, "null", 6, 9.0)]
    spark.createDataFrame(rows, "instance long, effect string, event_id long, percent double").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    timed = lambda df: df.withColumn("at", F.timestamp_millis("event_id"))
    got = R.run_to_table(ST.throttle_progress_stream(timed(R.read_stream(spark, str(tmp_path), "p.parquet"))), "nulls", "update", on_batch=lambda b, i: b).drop("batch")
    assert sorted(got.collect(), key=str) == sorted(((a, e, n, int(p)) for a, e, n, p in rows if n != 5), key=str)
    assert got.dtypes == [("instance", "bigint"), ("effect", "string"), ("event_id", "bigint"), ("percent", "bigint")]
