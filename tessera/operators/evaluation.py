"""Judging of answers: replies to scores, and their roll-up by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("correctness", "completeness", "grounding")


def _axis(found: Column, name: str) -> Column:
    """A whole number is clamped to 1..5; a missing axis is 1; anything else is 0."""
    raw = F.get_json_object(found, f"$.{name}")
    number = F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), raw.cast("double"))
    return F.when(raw.isNull(), 1).when(number.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.floor(number)))).cast("int")


def chosen(questions: DataFrame, difficulties: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """FLT18: questions (ord, difficulty, ...) of these difficulties, the first `limit` of them by ord."""
    rows = questions if not difficulties else questions.filter(F.col("difficulty").isin(difficulties))
    return rows.orderBy("ord").limit(limit) if limit else rows


def judge_scores(replies: DataFrame) -> DataFrame:
    """EVL1, EVL2: id, the axes and parse_failed from judges' replies (id, reply): the first {...} in them, read as JSON; no reply is a failure, not a score."""
    found = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\{.*?\}", 0)
    failed = F.try_parse_json(F.nullif(found, F.lit(""))).isNull()
    axes = [F.when(failed, 0).otherwise(_axis(found, a)).alias(a) for a in AXES]
    reason = F.when(failed, "").otherwise(F.substring(F.coalesce(F.get_json_object(found, "$.reason"), F.lit("")), 1, 300))
    return replies.select("id", *axes, reason.alias("reason"), failed.alias("parse_failed"))


def summary(scores: DataFrame, digits: int = 2) -> DataFrame:
    """AGG13, EVL4: by tier, and for ALL: per system the mean of each axis over parsed replies, their mean, counts, and graph_share.

    scores: tier, system, the axes, parse_failed, n_vector, n_graph. Scores are added up once, by tier; ALL adds the tiers' sums. Tiers without rows are absent.
    """
    by = scores.groupBy("system", "tier").agg(*[F.sum(F.when(~F.col("parse_failed"), F.col(a)).otherwise(0)).alias(a) for a in AXES], F.count_if(~F.col("parse_failed")).alias("scored"), F.count_if(F.col("parse_failed")).alias("failed"), F.sum("n_graph").alias("g"), F.sum("n_vector").alias("v"))
    every = by.unionByName(by.withColumn("tier", F.lit("ALL"))).groupBy("system", "tier").agg(*[F.sum(a).alias(a) for a in (*AXES, "scored", "failed", "g", "v")])
    axes = [F.when(F.col("scored") > 0, F.round(F.col(a) / F.col("scored"), digits)).otherwise(0.0) for a in AXES]
    overall = F.round(sum(axes[1:], axes[0]) / len(AXES), digits)
    share = F.when(F.col("g") + F.col("v") > 0, F.round(F.col("g") / (F.col("g") + F.col("v")), digits)).otherwise(0.0)
    return every.select("system", "tier", *[x.alias(a) for x, a in zip(axes, AXES)], overall.alias("overall"), "scored", "failed", share.alias("graph_share"))


def deltas(summaries: DataFrame, system: str, baseline: str, digits: int = 2) -> DataFrame:
    """AGG13, JOIN15: tier, both systems' overall marks and their difference."""
    a = summaries.filter(F.col("system") == system).select("tier", F.col("overall").alias("mark"))
    b = summaries.filter(F.col("system") == baseline).select("tier", F.col("overall").alias("baseline"))
    return a.join(b, "tier").select("tier", "mark", "baseline", F.round(F.col("mark") - F.col("baseline"), digits).alias("delta"))


def abort_at(runs: DataFrame, most: int = 3) -> DataFrame:
    """EVL3: the ord of the question at which a run of `most` questions without any answer ends; none, no row. runs: ord, empty."""
    w = Window.orderBy("ord")
    streak = F.min(F.col("empty").cast("int")).over(w.rowsBetween(-(most - 1), 0))
    return runs.withColumn("all_empty", streak).withColumn("n", F.row_number().over(w)).filter((F.col("all_empty") == 1) & (F.col("n") >= most)).agg(F.min("ord").alias("ord")).filter("ord is not null")


def markdown(summaries: DataFrame) -> DataFrame:
    """SNK10: one table row of Markdown per tier and system."""
    line = F.format_string("| %s | %s | %.2f | %d | %d |", "tier", "system", "overall", F.col("scored").cast("long"), F.col("failed").cast("long"))
    return summaries.select("tier", "system", line.alias("line"))
