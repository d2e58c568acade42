"""Scores as Column expressions; the time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Base confidence of a reach channel by its source.
CHANNEL_BASE = {"email_match": 90.0, "github": 90.0, "keybase": 90.0, "gravatar": 85.0, "github_social": 85.0, "github_profile": 80.0, "bluesky_domain": 95.0, "site_relme": 80.0}


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def freshness(posted: Column, now: Column, half_life_days: float = 14.0) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(posted)) / 86400e6
    return F.when(posted.isNull() | (age < 0), 0.3).otherwise(clamp(F.pow(F.lit(0.5), age / half_life_days), 0.0, 1.0))


def rarity(seen_elsewhere: Column, board_total: Column) -> Column:
    spread = 1.0 / (1.0 + F.greatest(F.lit(0), seen_elsewhere))
    return F.when(board_total.isNull(), clamp(spread, 0.0, 1.0)).otherwise(clamp(0.5 * spread + 0.5 / (1.0 + F.greatest(F.lit(0), board_total) / 50.0), 0.0, 1.0))


def discovery(fit: Column, fresh: Column, rare: Column, weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> Column:
    total = sum(weights)
    if total <= 0:
        return F.lit(0.0)
    return clamp((weights[0] * fit + weights[1] * fresh + weights[2] * rare) / total, 0.0, 1.0)


def label(score: Column) -> Column:
    return F.when(score >= 85, "verified").when(score >= 55, "probable").otherwise("guessed")


def channel(source: Column, corroborators: Column) -> Column:
    """STRUCT(score, label) of a reach channel."""
    base = F.lit(50.0)
    for name, value in CHANNEL_BASE.items():
        base = F.when(source == name, value).otherwise(base)
    score = clamp(base + F.least(F.lit(15.0), 5.0 * corroborators), 0.0, 100.0)
    return F.struct(score.alias("score"), label(score).alias("label"))


EMAIL_FACTS = ["scraped", "github", "disclosure", "prior_only", "holehe", "github_account", "gravatar", "mailbox", "identity", "locked", "cross_channel", "smtp_valid", "smtp_rejected", "role_account", "mx_present", "spf_dmarc", "pgp"]


def email_confidence(facts: Column) -> Column:
    """STRUCT(score, label) of an address. facts: a struct of the booleans in EMAIL_FACTS, votes and channels (counts) and catch_all
    (null: unknown)."""
    f = {x: F.coalesce(facts[x], F.lit(False)) for x in EMAIL_FACTS}
    votes, catch_all = facts["votes"], facts["catch_all"]
    points = lambda hit, n: F.when(hit, F.lit(float(n))).otherwise(0.0)
    sourced = f["scraped"] | f["github"] | f["disclosure"]
    s = points(f["scraped"], 70) + points(f["github"], 65) + points(f["disclosure"], 65)
    s = s + F.when(votes >= 3, 50.0).when(votes == 2, 38.0).when(votes == 1, 15.0).when(f["prior_only"], 10.0).otherwise(0.0)
    s = s + points(f["github_account"], 22) + points(f["gravatar"], 20) + points(f["holehe"], 18)
    s = s + points(f["smtp_valid"] & F.coalesce(~catch_all, F.lit(False)), 25) + points(f["pgp"], 22) + points(f["spf_dmarc"], 5) + points(f["mailbox"], 45)
    floor = lambda s, hit, n: F.greatest(s, points(hit, n))
    s = floor(s, f["mailbox"] & ((votes >= 1) | sourced), 85)
    s = floor(s, f["mailbox"] & f["identity"], 88)
    s = floor(s, f["pgp"] & ((votes >= 2) | sourced), 85)
    s = floor(s, f["locked"], 55)
    s = s + F.when(f["cross_channel"], F.least(F.lit(15.0), 5.0 * facts["channels"])).otherwise(0.0)
    s = s - points(f["role_account"], 10)
    capped = F.coalesce(catch_all, F.lit(False)) & ~f["mailbox"]
    s = F.greatest(F.lit(0.0), F.least(F.when(capped, 60.0).otherwise(100.0), s - points(capped, 15)))
    dead = f["smtp_rejected"] | ~f["mx_present"]
    # through an array of one, so the score's long expression stands once in the generated code
    both = F.transform(F.array(F.when(dead, F.lit(None)).otherwise(s)), lambda x: F.struct(F.coalesce(x, F.lit(0.0)).alias("score"), F.when(x.isNull(), "invalid").otherwise(label(x)).alias("label")))
    return both[0]


def identity_confidence(corroborations: Column) -> Column:
    return F.when(corroborations >= 3, 90.0).when(corroborations == 2, 70.0).when(corroborations == 1, 40.0).otherwise(0.0)


def judged_value(prestige: Column, fit: Column) -> Column:
    """round(sqrt(prestige * fit)) of two whole numbers 0 to 100."""
    whole = lambda c: clamp(F.coalesce(c.try_cast("int"), F.lit(0)), 0, 100)
    return F.round(F.sqrt(whole(prestige) * whole(fit))).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return dot(a, b) / (norm(a) * norm(b))


def age_text(at: Column, now: Column) -> Column:
    """Minutes below 60, hours below 48, else days; the future is just posted."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 60)
    hours = F.floor(minutes / 60)
    return F.when(at.isNull(), "age unknown").when(minutes < 0, "just posted").when(minutes < 60, F.concat(F.lit("posted "), minutes, F.lit("m ago"))).when(hours < 48, F.concat(F.lit("posted "), hours, F.lit("h ago"))).otherwise(F.concat(F.lit("posted "), F.floor(hours / 24), F.lit("d ago")))


#: What a model may say of a posting.
VERDICTS = ["ok", "spam", "ghost", "agency", "mlm", "unclear"]


def judged_quality(reply: Column) -> Column:
    """STRUCT(verdict, legit, substance, confidence, score, flags, reason) of a model's JSON object; null without one. An unknown verdict is
    unclear, numbers are whole and 0 to 100, score is the mean of legit and substance to one place."""
    get = lambda k: F.get_json_object(reply, f"$.{k}")
    whole = lambda k: clamp(F.coalesce(get(k).try_cast("double").cast("int"), F.lit(0)), 0, 100)
    said = F.lower(F.trim(get("verdict")))
    flags = F.coalesce(F.from_json(get("flags"), "ARRAY<STRING>"), F.array().cast("array<string>"))
    return F.when(reply.isNotNull(), F.struct(
        F.when(said.isin(VERDICTS), said).otherwise("unclear").alias("verdict"), whole("legit").alias("legit"), whole("substance").alias("substance"), whole("confidence").cast("double").alias("confidence"),
        F.bround((whole("legit") + whole("substance")) / 2.0, 1).alias("score"), flags.alias("flags"), F.coalesce(get("reason"), F.lit("")).alias("reason"),
    ))


def with_quality(jobs, judged):
    """jobs after judgements (job_uid, q of judged_quality): verdict, confidence and score are replaced, flags joined; no judgement, no change."""
    q = F.col("q")
    new = {"quality_verdict": q["verdict"], "quality_confidence": q["confidence"], "quality_score": q["score"], "quality_flags": F.array_distinct(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), q["flags"]))}
    both = jobs.join(judged, "job_uid", "left")
    return both.select(*(F.when(q.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))
