"""Analysis results without a model: routing of tasks, the deterministic stand-in, and judgements that take effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks that a small model does, the qualities of a news value in order, labels that may join, and how sure.
SMALL_TASKS = ["topic_classification", "content_type", "language_refinement", "basic_extraction", "draft_critic"]
QUALITIES = ["importance", "utility", "impact", "novelty", "urgency", "credibility"]
JOINING = ["SAME_EVENT", "MATERIAL_UPDATE"]
SURE = 0.8


def route(task: Column, small: str, strong: str) -> Column:
    return F.when(task.isin(SMALL_TASKS), small).otherwise(strong)


def seed(task: Column, prompt: Column, model: Column) -> Column:
    """The first 32 bits of the SHA-256 of task, prompt and model."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", task, prompt, model), 256), 1, 8), 16, 10).cast("long")


def stand_in_values(s: Column) -> list[Column]:
    """A score from 0.4 to 0.95 for each quality, from other bits of the seed."""
    bits = lambda i: (F.shiftright(s, i) % 10).cast("double") / 100
    return [F.round(F.least(F.lit(0.95), F.lit(0.4) + (s % 40).cast("double") / 100 + bits(i)), 4).alias(q) for i, q in enumerate(QUALITIES)]


def stand_in_topic(s: Column) -> Column:
    return F.round(F.lit(0.2) + (s % 30).cast("double") / 100, 4)


def judged(decisions: DataFrame) -> DataFrame:
    """decisions with status and applied. Of decision, candidate, label, confidence and assigned (the item has a story): only
    an ambiguous decision with a candidate is judged, and only a sure, joining judgement of an item without a story applies.
    A null label or confidence never applies."""
    open_ = (F.col("decision") == "ambiguous") & F.col("candidate").isNotNull()
    joins = F.col("label").isin(JOINING) & (F.col("confidence") >= SURE) & ~F.coalesce("assigned", F.lit(False))
    status = F.when(~F.coalesce(open_, F.lit(False)), "skipped").when(F.coalesce(joins, F.lit(False)), "applied").otherwise("held")
    return decisions.withColumn("status", status).withColumn("applied", F.col("status") == "applied")
