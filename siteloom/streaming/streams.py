"""Streaming twins of the batch operators, and the state machines batch cannot express."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from siteloom.operators.migrate import resolve_requests

HOUR_MS = 3_600_000


def _ms(stamp: pd.Timestamp) -> int:
    """Epoch milliseconds, cut like ``unix_millis``."""
    return pd.Timestamp(stamp).value // 1_000_000


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> Iterator:
    """Rows of one key in event order; a key's rows of a micro-batch arrive in Arrow batches."""
    parts = list(batches)
    if parts:
        yield from pd.concat(parts).sort_values(order).itertuples(index=False)


class OpenQuestionDelta(StatefulProcessor):
    """Keyed by question: +1 when it becomes an open required one, −1 when it stops being one.

    A question has up to two variants, the published one and a draft that lies over it: what counts is the draft while there
    is one, and deleting it uncovers the published variant. Of each variant the newest change is held; that of a deleted one
    only to know older changes that come after it, until the watermark passes it and no older change can come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        variant = StructType([StructField("draft", BooleanType())])
        stamp = [StructField("at", LongType()), StructField("event_id", LongType())]
        self.variants = handle.getMapState("variants", variant, StructType([*stamp, StructField("open", BooleanType())]))
        self.gone = handle.getMapState("gone", variant, StructType(stamp))

    def _open(self) -> bool:
        for draft in (True, False):
            if self.variants.containsKey((draft,)):
                return bool(self.variants.getValue((draft,))[2])
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was_open = self._open()
        for batch in rows:  # one Arrow batch at a time: the newest change of each variant is all that matters
            for r in batch.sort_values(["at", "event_id"]).groupby("draft").tail(1).itertuples(index=False):
                variant, stamp = (bool(r.draft),), (_ms(r.at), int(r.event_id))
                known = next((tuple(s.getValue(variant))[:2] for s in (self.variants, self.gone) if s.containsKey(variant)), None)
                if known is not None and stamp <= known:
                    continue
                if r.deleted:
                    self.variants.removeKey(variant)
                    self.gone.updateValue(variant, stamp)
                    self.handle.registerTimer(stamp[0])
                else:
                    self.gone.removeKey(variant)
                    self.variants.updateValue(variant, (*stamp, bool(r.required) and not (r.answer or "").strip()))
        delta = int(self._open()) - int(was_open)
        if delta:
            yield pd.DataFrame({"site": [key[0]], "question_id": [key[1]], "delta": [delta]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for draft in (True, False):
            if self.gone.containsKey((draft,)) and self.gone.getValue((draft,))[0] <= expiredTimerInfo.getExpiryTimeInMs():
                self.gone.removeKey((draft,))
        return iter(())

    def close(self) -> None:
        pass


def open_question_deltas(changes: DataFrame, delay: str = "30 days") -> DataFrame:
    """Question changes (site, question_id, draft, event_id, at, required, answer, deleted) → deltas per question.

    The state is keyed by question, so a large site spreads over all tasks; the open count of
    a site is the sum of its deltas. Changes more than ``delay`` older than the newest seen are refused.
    """
    return (
        changes.withWatermark("at", delay)
        .groupBy("site", "question_id")
        .transformWithStateInPandas(OpenQuestionDelta(), "site long, question_id long, delta long", "Update", "EventTime")
    )


def open_required(changes: DataFrame) -> DataFrame:
    """Batch twin: open required questions per site after all ``changes``, drafts laid over published variants."""
    newest = changes.groupBy("site", "question_id", "draft").agg(F.max_by(F.struct("required", "answer", "deleted"), F.struct("at", "event_id")).alias("r"))
    there = newest.where(~F.col("r.deleted"))
    shown = there.groupBy("site", "question_id").agg(F.max_by("r", F.col("draft").cast("int")).alias("r"))
    is_open = F.col("r.required") & (F.trim(F.coalesce("r.answer", F.lit(""))) == "")
    return shown.where(is_open).groupBy("site").agg(F.count("*").alias("open_required"))


def open_questions(deltas: DataFrame) -> DataFrame:
    """Open required questions per site from the delta table."""
    return deltas.groupBy("site").agg(F.sum("delta").alias("open_required"))


class OverdueVisit(StatefulProcessor):
    """Keyed by instance: a timer per open visit of the review stage."""

    def __init__(self, stage: str, hours: int):
        self.stage, self.limit = stage, hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = StructType([StructField("event_id", LongType()), StructField("entered", LongType())])
        self.visit = handle.getValueState("visit", schema)

    def _flag(self, key, visit) -> pd.DataFrame:
        return pd.DataFrame({"instance": [key[0]], "event_id": [visit[0]], "due_ms": [visit[1] + self.limit]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        visit = self.visit.get() if self.visit.exists() else None
        for r in _rows(rows, ["at", "event_id"]):
            at = _ms(r.at)
            if visit is not None and at >= visit[1]:
                self.handle.deleteTimer(visit[1] + self.limit)
                if at > visit[1] + self.limit:
                    yield self._flag(key, visit)
                visit = None
            if r.stage == self.stage:
                visit = (int(r.event_id), at)
        if visit is None:
            self.visit.clear()
        else:
            self.visit.update(visit)
            self.handle.registerTimer(visit[1] + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.visit.exists():
            visit = self.visit.get()
            if visit[1] + self.limit <= expiredTimerInfo.getExpiryTimeInMs():
                self.visit.clear()
                yield self._flag(key, visit)

    def close(self) -> None:
        pass


def overdue_visits(history: DataFrame, stage: str = "review", hours: int = 48, delay: str = "10 minutes") -> DataFrame:
    """Flag a review visit once, when event time passes its deadline while it is still open."""
    entered = history.filter("kind = 'stageEntered'").select("instance", "event_id", "at", "stage")
    return (
        entered.withWatermark("at", delay)
        .groupBy("instance")
        .transformWithStateInPandas(
            OverdueVisit(stage, hours), "instance long, event_id long, due_ms long", "Append", "EventTime"
        )
    )


def _emits(pct: int, at: int, last: tuple[int, int] | None) -> bool:
    """First report, ten points more, start or end, or three seconds later."""
    return last is None or pct in (0, 100) or pct - last[0] >= 10 or at - last[1] >= 3000


def _clamp(value: float) -> int:
    return max(0, min(100, int((value + 0.5) // 1)))


class ProgressGate(StatefulProcessor):
    """Keyed by a share of the runs: remembers the last emitted percentage and its time of each run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        run = StructType([StructField("run", StringType())])
        self.last = handle.getMapState("last", run, StructType([StructField("pct", LongType()), StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, last, known, out = None, None, None, []
        for r in _rows(rows, ["run", "at", "event_id"]):
            if r.run != run:
                self._keep(run, last, known)
                run = r.run
                last = known = self._known(run)
            pct = _clamp(r.percent)
            if _emits(pct, r.ms, last):
                last = (pct, r.ms)
                out.append((r.instance, r.effect, r.event_id, pct))
        self._keep(run, last, known)
        if out:
            yield pd.DataFrame(out, columns=["instance", "effect", "event_id", "percent"])

    def _known(self, run: str) -> tuple[int, int] | None:
        found = self.last.getValue((run,))
        return None if found is None else (found[0], found[1])

    def _keep(self, run: str | None, last: tuple[int, int] | None, known: tuple[int, int] | None) -> None:
        if last != known:
            self.last.updateValue((run,), last)

    def close(self) -> None:
        pass


PROGRESS_SCHEMA = "instance long, effect string, event_id long, percent long"


#: Shares of the runs; one call into Python takes the rows of a share, not those of one run.
RUN_SHARES = 4096


def throttle_progress_stream(progress: DataFrame) -> DataFrame:
    """Progress reports (instance, effect, event_id, at, percent) thinned per run."""
    run = F.to_json(F.struct("instance", "effect"))  # a null is left out, so no two runs are written alike
    timed = progress.select(
        F.pmod(F.xxhash64("instance", "effect"), F.lit(RUN_SHARES)).alias("share"), run.alias("run"), F.col("instance").cast("string").alias("instance"),
        "effect", "event_id", "at", F.unix_millis("at").alias("ms"), "percent",
    )
    out = timed.groupBy("share").transformWithStateInPandas(ProgressGate(), PROGRESS_SCHEMA.replace("instance long", "instance string"), "Update", "None")
    return out.withColumn("instance", F.col("instance").cast("long"))


def throttle_progress(progress: DataFrame) -> DataFrame:
    """Batch twin: Spark sorts each run inside its partition, Python carries one state along.

    Memory stays at one Arrow batch however many reports a run has.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.instance, r.effect) != key:
                    key, last = (r.instance, r.effect), None
                pct = _clamp(r.percent)
                if _emits(pct, r.ms, last):
                    last = (pct, r.ms)
                    out.append((r.instance, r.effect, r.event_id, pct))
            yield pd.DataFrame(out, columns=["instance", "effect", "event_id", "percent"])

    timed = progress.select("instance", "effect", "event_id", "at", F.unix_millis("at").alias("ms"), "percent")
    return (
        timed.repartition("instance", "effect")
        .sortWithinPartitions("instance", "effect", "at", "event_id")
        .drop("at")
        .mapInPandas(thin, PROGRESS_SCHEMA)
    )


class PendingChange(StatefulProcessor):
    """Keyed by instance: signals when its pending effects change and one is unclaimed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("pending", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in _rows(rows, ["at", "event_id"]):
            if r.pending != last and r.unclaimed > 0:
                out.append((key[0], int(r.event_id), int(r.unclaimed)))
            last = r.pending
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["instance", "event_id", "unclaimed"])

    def close(self) -> None:
        pass


def pending_work_signals(changes: DataFrame) -> DataFrame:
    """Instance changes (instance, event_id, at, pending text, unclaimed) → wake-up signals."""
    return changes.groupBy("instance").transformWithStateInPandas(
        PendingChange(), "instance long, event_id long, unclaimed long", "Update", "None"
    )


def deduped_page_stream(pages: DataFrame, delay: str) -> DataFrame:
    """First arrival of each (site, content_hash) within the watermark; ``pages`` has ``seen_at``."""
    return pages.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["site", "content_hash"])


def refused_pages(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose (site, content_hash) ``deduped_page_stream`` never let out: new content that came behind the watermark.

    ``pages`` is the stream's input read as a table, ``kept`` what it wrote. Null keys are compared as equal values, as the stream does.
    """
    p, k = pages.alias("p"), kept.select("site", "content_hash").distinct().alias("k")
    same = F.col("p.site").eqNullSafe(F.col("k.site")) & F.col("p.content_hash").eqNullSafe(F.col("k.content_hash"))
    return p.join(k, same, "left_anti")


def all_contents(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """Each (site, content_hash) of ``pages`` once, however its files were cut into micro-batches: what the stream
    let out, less repeats further apart than the delay, and what it refused behind the watermark."""
    keys = ["site", "content_hash"]
    return kept.select(*keys).unionByName(refused_pages(pages, kept).select(*keys)).distinct()


def redirect_batches(load_redirects: Callable[[], DataFrame], refresh_seconds: int = 60) -> Callable[[DataFrame, int], DataFrame]:
    """Micro-batch function: answer requests with a redirect table reloaded every 60 seconds."""
    cache: dict[str, object] = {"at": None, "table": None}

    def answer(batch: DataFrame, batch_id: int) -> DataFrame:
        now = time.monotonic()
        if cache["at"] is None or now - cache["at"] >= refresh_seconds:
            cache.update(at=now, table=load_redirects())
        return resolve_requests(batch, cache["table"])

    return answer


def hourly_sweep(history: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events, failures and waiting effects per hour (tumbling windows, closed by the watermark)."""
    return (
        history.withWatermark("at", delay)
        .groupBy(F.window("at", "1 hour").alias("w"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("kind") == "effectQueued").alias("queued"),
            F.count_if(F.col("status") == "done").alias("done"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .select(F.unix_millis("w.start").alias("hour_ms"), "events", "queued", "done", "failed")
    )
