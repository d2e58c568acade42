"""The whole corpus ranked anew: fit to a profile, freshness, rarity, and a small lift for companies that are known to hire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import scoring
from quarryline.operators import merge, people

LIFT = 0.05


def rescored(jobs: DataFrame, vectors: DataFrame, profile: list[float], boards: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """(job_uid, fit, freshness, rarity, discovery) of every posting. jobs: job_uid, posted, first_seen (epoch seconds), board_id,
    times_seen_elsewhere, is_internship, company_slug; vectors: job_uid, vector; boards: board_id, total_jobs_seen; companies:
    company_slug, notes (JSON; a filing's signal under disclosure lifts the company's internships, to 1 at most). A posting without a
    vector has fit 0, one without a board is rare by itself."""
    hiring = people.hiring_companies(companies).select("company_slug").distinct().withColumn("hiring", F.lit(True))
    fit = vectors.select("job_uid", scoring.clamp(scoring.cosine(F.col("vector"), F.array(*map(F.lit, profile))), 0.0, 1.0).alias("fit"))
    both = jobs.join(fit, "job_uid", "left").join(boards.select("board_id", "total_jobs_seen"), "board_id", "left").join(hiring, "company_slug", "left")
    posted = F.timestamp_seconds(F.coalesce("posted", "first_seen"))
    both = both.withColumns({"fit": F.coalesce("fit", F.lit(0.0)), "freshness": scoring.freshness(posted, now), "rarity": scoring.rarity(F.col("times_seen_elsewhere"), F.col("total_jobs_seen"))})
    lift = F.when(F.col("is_internship") & F.coalesce("hiring", F.lit(False)), LIFT).otherwise(0.0)
    return both.select("job_uid", "fit", "freshness", "rarity", F.least(F.lit(1.0), scoring.discovery(F.col("fit"), F.col("freshness"), F.col("rarity")) + lift).alias("discovery"))


def written_back(jobs: DataFrame, scores: DataFrame, ranked: DataFrame, model: str, input_hash: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs with discovery_score, scores): fits go to the scores of the profile's hash, where a known one keeps its scored_at."""
    fresh = ranked.select("job_uid", F.lit(input_hash).alias("input_hash"), F.col("fit").alias("fit_score"), F.lit(model).alias("model"), at.alias("scored_at"))
    own = jobs.join(ranked.select("job_uid", F.col("discovery").alias("_d")), "job_uid", "left")
    out = own.select(*(F.coalesce("_d", "discovery_score").alias(c) if c == "discovery_score" else F.col(c) for c in jobs.columns))
    return out, merge.merge_scores(scores, fresh.select(*(c for c in scores.columns if c in fresh.columns)))
