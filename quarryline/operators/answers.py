"""The read API: postings, contacts and companies as a client gets them, over joins instead of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import text
from quarryline.operators import relational

DESCRIPTION_CHARS = 6000


def _order() -> list[Column]:
    return [F.desc_nulls_last("priority"), F.desc_nulls_last("confidence"), F.asc("contact_id")]


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def latest_judgement(scores: DataFrame, prefix: str = "llm:") -> DataFrame:
    """(job_uid, fit_score, matched, missing, rationale) of each job's latest score among models of one prefix."""
    own = scores.where(F.startswith("model", F.lit(prefix))).select("job_uid", "fit_score", _given(scores, "matched", "array<string>").alias("matched"), _given(scores, "missing", "array<string>").alias("missing"), _given(scores, "rationale").alias("rationale"), "scored_at", "score_id")
    return relational.latest(own, ["job_uid"], ["scored_at", "score_id"]).select("job_uid", "fit_score", "matched", "missing", "rationale")


def job_view(jobs: DataFrame, scores: DataFrame | None = None, full: bool = False) -> DataFrame:
    """Postings as a client sees them: the company's slug stands in for its name, the raw place for the normalized one, scores are
    rounded to one place. With `full` also domain, tags, sectors, salary (JSON of what is known, null if nothing) and the description's
    first 6,000 characters."""
    empty = F.array().cast("array<string>")
    if scores is not None:
        jobs = jobs.join(latest_judgement(scores), "job_uid", "left")
    g = lambda n, k="string": _given(jobs, n, k)
    columns = [
        F.col("job_uid"), F.col("title"), F.coalesce(F.nullif("company", F.lit("")), "company_slug").alias("company"), F.col("company_slug"), F.col("url"), F.col("ats"),
        F.coalesce(F.nullif("location_normalized", F.lit("")), "location_raw").alias("location"), F.col("is_remote").alias("remote"), g("remote_scope").alias("remote_scope"), F.col("is_internship"), g("internship_kind").alias("internship_kind"),
        g("employment_type").alias("employment_type"), g("department").alias("department"), F.col("posted").alias("posted_at"), F.col("deadline").alias("deadline_at"), g("is_rolling", "boolean").alias("is_rolling"),
        F.round("discovery_score", 1).alias("discovery_score"), g("quality_verdict").alias("quality_verdict"),
    ]
    if scores is not None:
        judged = F.col("fit_score").isNotNull()
        columns += [F.round("fit_score", 1).alias("fit_score"), F.when(judged, F.coalesce("matched", empty)).alias("fit_matched"), F.when(judged, F.coalesce("missing", empty)).alias("fit_missing"), F.col("rationale").alias("fit_rationale")]
    if full:
        salary = F.to_json(F.struct(g("salary_min", "double").alias("min"), g("salary_max", "double").alias("max"), g("salary_currency").alias("currency"), g("salary_period").alias("period")), {"ignoreNullFields": "true"})
        columns += [g("company_domain").alias("company_domain"), F.coalesce(g("level_tags", "array<string>"), empty).alias("level_tags"), F.coalesce(g("sectors", "array<string>"), empty).alias("sectors"), F.nullif(salary, F.lit("{}")).alias("salary"), F.substring(F.coalesce("description_text", F.lit("")), 1, DESCRIPTION_CHARS).alias("description")]
    return jobs.select(*columns)


def contact_view(contacts: DataFrame, channels: DataFrame) -> DataFrame:
    """Contacts with other_channels, an array of kind, value, label and confidence of those that are no work address, by confidence."""
    own = channels.where("kind <> 'email'").select("contact_id", "kind", _given(channels, "value").alias("given"), "value_norm", _given(channels, "label").alias("label"), F.round("confidence", 0).alias("confidence"))
    nest = relational.nested(own.withColumn("value", F.coalesce("given", "value_norm")), ["contact_id"], ["kind", "value", "label", "confidence"], F.col("confidence"), "other_channels")
    g = lambda n: _given(contacts, n)
    both = contacts.join(nest, "contact_id", "left")
    none = F.expr("array()").cast(nest.schema["other_channels"].dataType)
    return both.select("contact_id", "company_slug", F.col("full_name").alias("name"), "title", g("role_category").alias("role"), "email", g("email_status").alias("email_status"), F.round("confidence", 0).alias("email_confidence"), g("email_label").alias("email_label"), g("linkedin_url").alias("linkedin"), g("github_login").alias("github"), g("person_source").alias("source"), F.coalesce("other_channels", none).alias("other_channels"), "priority", "confidence")


def top_contacts(contacts: DataFrame, channels: DataFrame, n: int | None) -> DataFrame:
    """The first n contacts of every company, by priority and confidence, with their channels; all if n is None. Cut before the channels
    are joined."""
    first = contacts if n is None else relational.top_per(contacts, ["company_slug"], _order(), n)
    return contact_view(first, channels.join(first.select("contact_id"), "contact_id", "left_semi"))


def job_contacts(jobs: DataFrame, contacts: DataFrame, channels: DataFrame, n: int | None = 8) -> DataFrame:
    """job_uid and contacts, an array of its company's first n, all if n is None, in order."""
    own = top_contacts(contacts.join(jobs.select("company_slug").distinct(), "company_slug", "left_semi"), channels, n)
    row = F.struct(F.struct(F.col("priority").isNull().alias("p"), (-F.coalesce("priority", F.lit(0.0))).alias("q"), F.col("confidence").isNull().alias("c"), (-F.coalesce("confidence", F.lit(0.0))).alias("d"), "contact_id").alias("o"), F.struct("contact_id", "name", "title", "email", "other_channels").alias("c"))
    nest = own.groupBy("company_slug").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"]).alias("contacts"))
    return jobs.select("job_uid", "company_slug").join(nest, "company_slug", "left").select("job_uid", F.coalesce("contacts", F.expr("array()").cast(nest.schema["contacts"].dataType)).alias("contacts"))


def job_detail(jobs: DataFrame, scores: DataFrame, contacts: DataFrame, channels: DataFrame, job_uid: str | None = None, url: str | None = None, n: int | None = 8) -> DataFrame:
    """One posting in full, found by uid or url, with its company's first n contacts, all if n is None; no row if there is no posting."""
    if not job_uid and not url:
        raise ValueError("job_uid or url")
    one = jobs.where(F.col("job_uid") == job_uid if job_uid else F.col("url") == url).orderBy("job_uid").limit(1)
    return job_view(one, scores, full=True).join(job_contacts(one, contacts, channels, n), "job_uid", "left")


def company_row(companies: DataFrame, name: str) -> DataFrame:
    """The company whose slug is `name`, or whose name has it within, whatever the case; of several the least slug."""
    asked = name.strip()
    return companies.where((F.col("company_slug") == asked) | F.col("name").ilike(f"%{asked}%")).orderBy("company_slug").limit(1)


def company_slug_of(companies: DataFrame, contacts: DataFrame, name: str, n: int = 10) -> DataFrame:
    """One row: the slug that a name stands for: of the company found; else the name itself if contacts have it; else the first slug of
    contacts that has it within; else the name."""
    spark, asked = companies.sparkSession, name.strip()
    steps = [
        company_row(companies, name).select("company_slug", F.lit(0).alias("step")),
        contacts.where(F.col("company_slug") == asked).select("company_slug").limit(1).withColumn("step", F.lit(1)),
        contacts.where(F.col("company_slug").ilike(f"%{asked}%")).select(F.min("company_slug").alias("company_slug")).where("company_slug IS NOT NULL").withColumn("step", F.lit(2)),
        spark.createDataFrame([(asked, 3)], "company_slug string, step int"),
    ]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.agg(F.min_by("company_slug", "step").alias("company_slug"))


def company_contacts(companies: DataFrame, contacts: DataFrame, channels: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """A company's first contacts, found by slug or name, with the company's profile beside each where it is known."""
    slug = company_slug_of(companies, contacts, name)
    own = contacts.join(F.broadcast(slug), "company_slug", "left_semi")  # one row
    found = top_contacts(own, channels, relational.clamp_limit(limit, 50))
    return found.join(company_row(companies, name).select("company_slug", F.col("name").alias("company_name"), "domain", _given(companies, "email_pattern").alias("email_pattern"), _given(companies, "headcount_band").alias("headcount_band")), "company_slug", "left")


def company_jobs(companies: DataFrame, jobs: DataFrame, scores: DataFrame, name: str, limit: int = 15) -> DataFrame:
    """A company's postings, by its slug or with the name within theirs, best judged first."""
    slug = company_row(companies, name).select(F.col("company_slug").alias("slug")).unionByName(companies.sparkSession.createDataFrame([(name.strip(),)], "slug string")).limit(1)
    own = jobs.crossJoin(F.broadcast(slug)).where((F.col("company_slug") == F.col("slug")) | F.col("company").ilike(f"%{name.strip()}%")).drop("slug")  # one row
    judged = own.join(relational.latest_fit(scores), "job_uid", "left").orderBy(F.desc_nulls_last("fit"), "job_uid").limit(relational.clamp_limit(limit, 50)).drop("fit")
    return job_view(judged, scores)


def overview(jobs: DataFrame, scores: DataFrame, companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row: jobs, internships, internships_rated (jobs with a judged score), companies, contacts."""
    own = jobs.agg(F.count("*").alias("jobs"), F.count_if("is_internship").alias("internships"), F.countDistinct("company_slug").alias("slugs"), F.count_if("is_remote").alias("remote"))
    rated = scores.where(F.startswith("model", F.lit("llm:"))).agg(F.countDistinct("job_uid").alias("internships_rated"))
    return own.crossJoin(rated).crossJoin(companies.agg(F.count("*").alias("companies"))).crossJoin(contacts.agg(F.count("*").alias("contacts")))


def borderline(jobs: DataFrame, n: int, below: float = 95.0) -> DataFrame:
    """Internships without a verdict and with a score below the bound or none, by discovery score; n of them, all if n is 0 or less."""
    own = jobs.where(F.col("is_internship") & F.col("quality_verdict").isNull() & (F.col("quality_score").isNull() | (F.col("quality_score") < below)))
    return best_first(own, n)


def best_first(jobs: DataFrame, n: int) -> DataFrame:
    out = jobs.orderBy(F.desc_nulls_last("discovery_score"), "job_uid")
    return out.limit(n) if n > 0 else out


def unjudged(jobs: DataFrame, scores: DataFrame, model: str, n: int = 0) -> DataFrame:
    """Internships that this very model hasn't scored, best first: where a batch takes up again."""
    done = scores.where(F.col("model") == model).select("job_uid").distinct()
    return best_first(jobs.where("is_internship").join(done, "job_uid", "left_anti"), n)


def notifiable(jobs: DataFrame, scores: DataFrame, slop: Column, min_fit: float, now: Column, days: int) -> DataFrame:
    """Postings to tell of: judged `min_fit` or better, or due within `days`, and no clear slop; one row a uid, best first. Times are
    epoch seconds."""
    due = (F.col("deadline") >= now) & (F.col("deadline") <= now + days * 86400)
    both = jobs.where(~F.coalesce(slop, F.lit(False))).join(relational.latest_fit(scores), "job_uid", "left")
    return both.where(F.coalesce(F.col("fit") >= min_fit, F.lit(False)) | F.coalesce(due, F.lit(False))).dropDuplicates(["job_uid"]).orderBy(F.desc_nulls_last("fit"), "job_uid")


def csv_date(seconds: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit(""))


def jobs_export(jobs: DataFrame) -> DataFrame:
    """The eight columns of the postings' table file, every cell safe for spreadsheets; dates as year-month-day, nothing for null."""
    cell = lambda c: text.csv_safe(F.coalesce(_given(jobs, c), F.lit("")))
    return jobs.select(cell("title").alias("title"), cell("company").alias("company"), cell("location_normalized").alias("location"), cell("internship_kind").alias("kind"), csv_date(F.col("posted")).alias("posted_at"), csv_date(F.col("deadline")).alias("deadline_at"), cell("ats").alias("ats"), cell("url").alias("url"))


CHANNEL_COLUMNS = ["personal_email", "x", "bluesky", "mastodon", "github", "site"]


def contacts_export(contacts: DataFrame, channels: DataFrame) -> DataFrame:
    """The ten columns of the contacts' table file and one for each kind of channel, its values by confidence with spaces between."""
    given = F.coalesce(_given(channels, "value"), F.col("value_norm"))
    row = F.struct(F.col("confidence").isNull().alias("n"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), given.alias("v"))
    wide = channels.groupBy("contact_id").pivot("kind", CHANNEL_COLUMNS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]), " "))
    cell = lambda c: text.csv_safe(F.coalesce(_given(contacts, c), F.lit("")))
    whole = lambda c: F.coalesce(F.bround(c, 0).cast("long").cast("string"), F.lit(""))
    both = contacts.join(wide, "contact_id", "left")
    return both.select(
        "contact_id", cell("company_slug").alias("company"), cell("full_name").alias("full_name"), cell("title").alias("title"), cell("role_category").alias("role"), cell("email").alias("email"), cell("email_status").alias("email_status"),
        whole(F.col("confidence")).alias("confidence"), cell("email_label").alias("label"), whole(_given(contacts, "identity_confidence", "double")).alias("identity_confidence"), cell("linkedin_url").alias("linkedin"),
        *(text.csv_safe(F.coalesce(k, F.lit(""))).alias(k) for k in CHANNEL_COLUMNS),
    )
