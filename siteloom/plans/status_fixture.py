"""Small input tables of the lifecycle queries, made from the names of stages and effects.

Titles, labels, checkpoints, screens and wording belong to whoever runs a workflow; the operators take
them as tables. Each table is also written out as SQL VALUES for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteloom.operators.lifecycle import CASES
from siteloom.sources.tables import STAGE_EFFECT, STAGES

FAILED = STAGES[-1]
STAGE_ROWS = [(s, f"Stage {i}: {s}") for i, s in enumerate(STAGES, 1)]
EFFECT_ROWS = [(e, f"{e} ({s})") for s, e in STAGE_EFFECT.items()]
CHECKPOINT_ROWS = [(e, at, f"{e} from {at}%") for i, e in enumerate(STAGE_EFFECT.values()) for at in (0, 10 + 3 * i, 50, 95 - 4 * i)]
WORDING_ROWS = [(c, f"{c.replace('.', ': ')} [{{n}}] {{name}}") for c in CASES]
#: Forward steps, to the off-ramp from every stage that has an effect, and back from it.
EDGE_ROWS = list(zip(STAGES[:-2], STAGES[1:-1], strict=True)) + [(s, FAILED) for s in STAGE_EFFECT] + [(FAILED, s) for s in STAGE_EFFECT]
SCREEN_ROWS = [(s, f"screen {i // 2}") for i, s in enumerate(STAGES[:-1])]


def table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Inline rows, so their size is known to the optimiser and joins broadcast them."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return spark.sql(f"SELECT * FROM {values(rows)} AS t({names})")


def stages(spark: SparkSession) -> DataFrame:
    return table(spark, STAGE_ROWS, "stage string, title string")


def effects(spark: SparkSession) -> DataFrame:
    return table(spark, EFFECT_ROWS, "effect string, label string")


def checkpoints(spark: SparkSession) -> DataFrame:
    return table(spark, CHECKPOINT_ROWS, "effect string, at_percent int, label string")


def wording(spark: SparkSession) -> DataFrame:
    return table(spark, WORDING_ROWS, "case string, text string")


def edges(spark: SparkSession) -> DataFrame:
    return table(spark, EDGE_ROWS, "from_stage string, to_stage string")


def screens(spark: SparkSession) -> DataFrame:
    return table(spark, SCREEN_ROWS, "stage string, screen string")


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def recipes(spark: SparkSession) -> DataFrame:
    """A small recipe table: what an agent is asked to do for each automatic action, and the fields it may write."""
    rows = [
        ("generate-meta", "generate", "Summarise the page in a title and a description that fit a results list.", ["seoTitle", "seoDescription"]),
        ("generate-alt", "generate", "Say what each picture shows, for readers who cannot see it.", ["body[].image.alt", "body[].images[].alt"]),
        ("rewrite-placeholder", "transform", "Exchange stock phrases for sentences that the page's own facts support.", ["body"]),
    ]
    return spark.createDataFrame(rows, "action string, kind string, instruction string, fields array<string>")
