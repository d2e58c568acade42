"""Target firms, connections and alerts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import classify, text


@dataclass(frozen=True)
class Targets:
    """Settings of one user: short lists, folded into expressions."""

    firms: list[tuple[str, str, list[str], str]] = field(default_factory=list)  # name, slug, domains, priority
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    remote_ok: bool = True
    enabled: bool = True


def _bare(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")


def domain_of(domain: Column, domains: list[str]) -> Column:
    d = _bare(domain)
    hit = F.lit(False)
    for x in domains:
        hit = hit | (d == x) | F.endswith(d, F.lit("." + x))
    return hit


def target_firm(company: Column, slug: Column, domain: Column, targets: Targets) -> Column:
    """STRUCT(name, priority) of the first firm, in the order of the settings, whose domain, slug or canonical name fits."""
    own, canonical = F.lower(F.coalesce(slug, F.lit(""))), text.canonical_company(company)
    out = []
    for name, firm_slug, domains, priority in targets.firms:
        key = "".join(w for w in firm_slug.split("-") if w not in text.CORPORATE_WORDS)
        fits = domain_of(domain, domains) | ((own != "") & (own == firm_slug)) | ((canonical != "") & (canonical == key))
        out.append(F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(priority).alias("priority"))))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<name:string,priority:string>")


def connection(company: Column, slug: Column, domain: Column, connections: list[tuple[str, list[str], list[str]]]) -> Column:
    """Name of the first connection (name, firms, domains), in the order given, whose domains or canonical firm names cover the company; null: none."""
    names = [text.canonical_company(company), text.canonical_company(slug)]
    out = []
    for name, firms, domains in connections:
        slugs = [re.sub("[^a-z0-9]+", "-", f.lower()).strip("-").split("-") for f in firms]
        keys = {"".join(w for w in x if w not in text.CORPORATE_WORDS) for x in slugs} - {""}
        fits = domain_of(domain, [d.lower().removeprefix("www.") for d in domains if d])
        for own in names:
            fits = fits | own.isin(*sorted(keys)) if keys else fits
        out.append(F.when(fits, F.lit(name)))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def location_ok(remote: Column, normalized: Column, raw: Column, targets: Targets) -> Column:
    if not targets.locations:
        return F.lit(True)
    place = F.lower(F.coalesce(F.nullif(normalized, F.lit("")), raw, F.lit("")))
    hit = F.lit(False)
    for x in targets.locations:
        hit = hit | F.contains(place, F.lit(x.lower()))
    return hit | (F.coalesce(remote, F.lit(False)) & F.lit(targets.remote_ok))


def evaluated(jobs: DataFrame, targets: Targets) -> DataFrame:
    """jobs with match: STRUCT(matched, firm, priority, reason). An excluded word refuses, then the place; then a firm needs an
    internship or a keyword, and a keyword is enough alone."""
    title = F.lower(F.coalesce("title", F.lit("")))
    first = lambda words: F.coalesce(*(F.when(F.contains(title, F.lit(w)), F.lit(w)) for w in words)) if words else F.lit(None).cast("string")
    jobs = jobs.withColumns({"_no": first(targets.exclude), "_yes": first(targets.include), "_firm": target_firm(F.col("company"), F.col("company_slug"), F.col("company_domain"), targets)})
    place = location_ok(F.col("is_remote"), F.col("location_normalized"), F.col("location_raw"), targets)
    firm = F.col("_firm").isNotNull() & (F.col("is_internship") | F.col("_yes").isNotNull())
    none = F.lit(None).cast("string")

    def verdict(matched: bool, name: Column, priority: Column, reason: Column) -> Column:
        return F.struct(F.lit(matched).alias("matched"), name.alias("firm"), priority.alias("priority"), reason.alias("reason"))

    keyword = F.concat(F.lit("keyword:"), F.col("_yes"))
    match = (
        F.when(F.lit(not targets.enabled), verdict(False, none, none, none))
        .when(F.col("_no").isNotNull(), verdict(False, none, none, F.concat(F.lit("excluded:"), F.trim("_no"))))
        .when(~place, verdict(False, none, none, F.lit("location")))
        .when(firm, verdict(True, F.col("_firm.name"), F.col("_firm.priority"), F.concat_ws(",", F.concat(F.lit("target-firm:"), F.col("_firm.name")), keyword)))
        .when(F.col("_yes").isNotNull(), verdict(True, none, none, keyword)).otherwise(verdict(False, none, none, none))
    )
    return jobs.withColumn("match", match).drop("_no", "_yes", "_firm")


def alerts(jobs: DataFrame, targets: Targets, *, now: int, lookback_s: int, min_fit: float, require_target: bool = False, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(delivered, overflow count): jobs never notified and seen within the lookback, no clear slop, that match a target or, unless
    vetoed, are internships of enough score; target firms of high priority first, then other firms, then by score."""
    fresh = jobs.where(F.col("notified_at").isNull() & (F.col("first_seen") >= now - lookback_s)).dropDuplicates(["job_uid"])
    fresh = fresh.where(~classify.clear_slop(F.col("quality_verdict"), F.col("quality_confidence")))
    judged = evaluated(fresh, targets)
    vetoed = F.coalesce(F.col("match.reason").rlike("^(excluded:|location$)"), F.lit(False))
    chosen = judged.where(F.col("match.matched") | (F.lit(not require_target) & ~vetoed & F.col("is_internship") & (F.col("discovery_score") >= min_fit)))
    bucket = F.when(F.col("match.priority") == "high", 0).when(F.col("match.firm").isNotNull(), 1).otherwise(2)
    ranked = chosen.withColumn("bucket", bucket)
    out = ranked.orderBy("bucket", F.desc(F.coalesce("discovery_score", F.lit(0.0))), "job_uid").limit(most)
    return out, ranked.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))


def mark_notified(jobs: DataFrame, delivered: DataFrame, now: Column) -> DataFrame:
    """notified_at is stamped for delivered jobs alone, once."""
    sent = delivered.select("job_uid").distinct().withColumn("_sent", F.lit(True))
    return jobs.join(sent, "job_uid", "left").withColumn("notified_at", F.coalesce("notified_at", F.when(F.col("_sent"), now))).drop("_sent")
