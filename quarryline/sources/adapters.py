"""Source formats as declarative specs, compiled to from_json, inline and a projection.

A payload table has token, company (null: unknown) and payload, the text as it came. A row that doesn't parse gives no postings; the
number of such payloads can be counted by `unparsed`. Specs name their rows by path and their fields by SQL over the row r, with
coalesce for fallbacks; the rest of a posting is derived alike for all formats by `finalized`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import classify, text, urls
from quarryline.sources import html


@dataclass(frozen=True)
class Spec:
    schema: str
    rows: str
    fields: dict[str, str]
    kind: str = "json"  # json, xml, script (JSON in a page after a marker), anchors or ld
    marker: str = ""
    tier: str = "B"
    more: dict[str, str] = field(default_factory=dict)


def _joined(*parts: str) -> str:
    return "nullif(concat_ws(', ', " + ", ".join(f"nullif(trim({p}), '')" for p in parts) + "), '')"


_LD = "STRUCT<title STRING, url STRING, description STRING, identifier STRUCT<value STRING>, datePosted STRING, employmentType STRING, hiringOrganization STRUCT<name STRING>, jobLocation ARRAY<STRUCT<address STRUCT<addressLocality STRING, addressRegion STRING, addressCountry STRING>>>>"
_LD_FIELDS = {"source_job_id": "r.identifier.value", "title": "r.title", "url": "r.url", "location": _joined("r.jobLocation[0].address.addressLocality", "r.jobLocation[0].address.addressRegion", "r.jobLocation[0].address.addressCountry"), "html": "r.description", "posted": "r.datePosted", "employment_type": "r.employmentType"}


def _anchors(pattern: str) -> Spec:
    return Spec("", pattern, {"source_job_id": f"regexp_extract(r.href, '{pattern}', 1)", "title": "r.text", "url": "r.href", "location": "cast(null as string)"}, "anchors")


SPECS = {
    "greenhouse": Spec("STRUCT<jobs ARRAY<STRUCT<id BIGINT, title STRING, updated_at STRING, absolute_url STRING, location STRUCT<name STRING>, content STRING, departments ARRAY<STRUCT<name STRING>>>>>", "p.jobs", {"source_job_id": "cast(r.id as string)", "title": "r.title", "url": "r.absolute_url", "location": "r.location.name", "html": "r.content", "posted": "r.updated_at", "department": "try_element_at(r.departments, 1).name"}, tier="A"),
    "lever": Spec("ARRAY<STRUCT<id STRING, text STRING, categories STRUCT<location STRING, team STRING, commitment STRING>, hostedUrl STRING, applyUrl STRING, createdAt BIGINT, descriptionPlain STRING, description STRING>>", "p", {"source_job_id": "r.id", "title": "r.text", "url": "coalesce(r.hostedUrl, r.applyUrl)", "location": "r.categories.location", "text": "r.descriptionPlain", "html": "r.description", "posted": "cast(r.createdAt as string)", "department": "r.categories.team", "employment_type": "map('full-time', 'full_time', 'full time', 'full_time', 'part-time', 'part_time', 'part time', 'part_time', 'contract', 'contract', 'intern', 'internship', 'internship', 'internship', 'temporary', 'temporary')[lower(trim(r.categories.commitment))]"}, tier="A"),
    "ashby": Spec("STRUCT<jobs ARRAY<STRUCT<id STRING, title STRING, location STRING, secondaryLocations ARRAY<STRUCT<location STRING>>, department STRING, team STRING, employmentType STRING, isRemote BOOLEAN, publishedAt STRING, jobUrl STRING, applyUrl STRING, descriptionHtml STRING, descriptionPlain STRING>>>", "p.jobs", {"source_job_id": "r.id", "title": "r.title", "url": "coalesce(r.jobUrl, r.applyUrl)", "location": "nullif(array_join(filter(concat(array(r.location), coalesce(transform(r.secondaryLocations, s -> s.location), array())), x -> x <> ''), ', '), '')", "text": "r.descriptionPlain", "html": "r.descriptionHtml", "posted": "r.publishedAt", "remote": "r.isRemote", "department": "coalesce(r.department, r.team)", "employment_type": "r.employmentType"}, tier="A"),
    "workable": Spec("STRUCT<jobs ARRAY<STRUCT<title STRING, shortcode STRING, code STRING, url STRING, application_url STRING, location STRUCT<location_str STRING, country STRING, region STRING, city STRING, telecommuting BOOLEAN>, created_at STRING, department STRING, employment_type STRING, description STRING>>>", "p.jobs", {"source_job_id": "coalesce(r.shortcode, r.code)", "title": "r.title", "url": "coalesce(nullif(r.url, ''), nullif(r.application_url, ''), concat('https://apply.workable.com/', token, '/j/', coalesce(r.shortcode, r.code), '/'))", "location": "coalesce(nullif(r.location.location_str, ''), " + _joined("r.location.city", "r.location.region", "r.location.country") + ")", "html": "r.description", "posted": "r.created_at", "remote": "r.location.telecommuting", "department": "r.department", "employment_type": "r.employment_type"}, tier="A"),
    "smartrecruiters": Spec("STRUCT<content ARRAY<STRUCT<id STRING, name STRING, releasedDate STRING, location STRUCT<city STRING, region STRING, country STRING, remote BOOLEAN>, department STRUCT<label STRING>, typeOfEmployment STRUCT<label STRING>>>>", "p.content", {"source_job_id": "r.id", "title": "r.name", "url": "concat('https://jobs.smartrecruiters.com/', token, '/', r.id)", "location": "nullif(concat_ws(', ', " + _joined("r.location.city", "r.location.region", "r.location.country") + ", CASE WHEN r.location.remote THEN 'Remote' END), '')", "posted": "r.releasedDate", "remote": "r.location.remote", "department": "r.department.label", "employment_type": "r.typeOfEmployment.label"}, tier="A"),
    "recruitee": Spec("STRUCT<offers ARRAY<STRUCT<id BIGINT, title STRING, careers_url STRING, careers_apply_url STRING, description STRING, requirements STRING, location STRING, city STRING, state_code STRING, country_code STRING, department STRING, created_at STRING, employment_type_code STRING, remote BOOLEAN>>>", "p.offers", {"source_job_id": "cast(r.id as string)", "title": "trim(r.title)", "url": "coalesce(r.careers_url, r.careers_apply_url)", "location": "coalesce(" + _joined("r.city", "r.state_code", "r.country_code") + ", r.location)", "html": "r.description", "posted": "r.created_at", "remote": "r.remote", "department": "r.department", "employment_type": "r.employment_type_code"}, tier="A"),
    "personio": Spec("STRUCT<id STRING, office STRING, department STRING, name STRING, employmentType STRING, createdAt STRING, jobDescriptions STRUCT<jobDescription ARRAY<STRUCT<name STRING, value STRING>>>>", "position", {"source_job_id": "r.id", "title": "r.name", "url": "concat('https://', token, '.jobs.personio.de/job/', r.id)", "location": "r.office", "html": "array_join(transform(r.jobDescriptions.jobDescription, x -> x.value), '\n')", "posted": "r.createdAt", "department": "r.department", "employment_type": "r.employmentType"}, "xml", tier="A"),
    "pinpoint": Spec("STRUCT<data ARRAY<STRUCT<id STRING, title STRING, url STRING, description STRING, employment_type STRING, workplace_type STRING, deadline_at STRING, location STRUCT<city STRING, name STRING, province STRING>, job STRUCT<department STRUCT<name STRING>>>>>", "p.data", {"source_job_id": "r.id", "title": "r.title", "url": "r.url", "location": "nullif(array_join(array_distinct(filter(array(r.location.name, r.location.city, r.location.province), x -> x <> '')), ', '), '')", "html": "r.description", "remote": "lower(r.workplace_type) in ('remote', 'hybrid')", "deadline": "r.deadline_at", "department": "r.job.department.name", "employment_type": "r.employment_type"}, tier="A"),
    "bamboohr": Spec("STRUCT<result ARRAY<STRUCT<id BIGINT, jobOpeningName STRING, departmentLabel STRING, employmentStatusLabel STRING, location STRUCT<city STRING, state STRING>, isRemote BOOLEAN, datePosted STRING>>>", "p.result", {"source_job_id": "cast(r.id as string)", "title": "r.jobOpeningName", "url": "concat('https://', token, '.bamboohr.com/careers/', r.id)", "location": _joined("r.location.city", "r.location.state"), "posted": "r.datePosted", "remote": "r.isRemote", "department": "r.departmentLabel", "employment_type": "r.employmentStatusLabel"}),
    "breezy": Spec("ARRAY<STRUCT<_id STRING, name STRING, type STRUCT<name STRING>, category STRUCT<name STRING>, location STRUCT<name STRING, city STRING, country STRUCT<name STRING>, is_remote BOOLEAN>, url STRING, description STRING, published_date STRING>>", "p", {"source_job_id": "r._id", "title": "r.name", "url": "coalesce(r.url, concat('https://', token, '.breezy.hr/p/', r._id))", "location": "coalesce(r.location.name, " + _joined("r.location.city", "r.location.country.name") + ")", "html": "r.description", "posted": "r.published_date", "remote": "r.location.is_remote", "department": "r.category.name", "employment_type": "r.type.name"}),
    "dover": Spec("STRUCT<results ARRAY<STRUCT<id STRING, title STRING, locations ARRAY<STRUCT<name STRING>>, isRemote BOOLEAN, jobPostingUrl STRING, publishedAt STRING>>>", "p.results", {"source_job_id": "r.id", "title": "r.title", "url": "coalesce(r.jobPostingUrl, concat('https://jobs.dover.com/companies/', token))", "location": "try_element_at(r.locations, 1).name", "posted": "r.publishedAt", "remote": "r.isRemote"}),
    "gem": Spec("STRUCT<jobs ARRAY<STRUCT<id STRING, title STRING, location STRING, remote BOOLEAN, applyUrl STRING, department STRING, createdAt STRING>>>", "p.jobs", {"source_job_id": "r.id", "title": "r.title", "url": "coalesce(r.applyUrl, concat('https://jobs.gem.com/', token, '/', r.id))", "location": "r.location", "posted": "r.createdAt", "remote": "r.remote", "department": "r.department"}),
    "rippling": Spec("ARRAY<STRUCT<id STRING, name STRING, workLocation STRUCT<label STRING>, department STRUCT<label STRING>, url STRING, isRemote BOOLEAN, postedAt STRING>>", "p", {"source_job_id": "r.id", "title": "r.name", "url": "coalesce(r.url, concat('https://', token, '.rippling-ats.com/jobs/', r.id))", "location": "r.workLocation.label", "posted": "r.postedAt", "remote": "r.isRemote", "department": "r.department.label"}),
    "workday": Spec("STRUCT<total INT, jobPostings ARRAY<STRUCT<title STRING, externalPath STRING, locationsText STRING, postedOn STRING, bulletFields ARRAY<STRING>>>>", "p.jobPostings", {"source_job_id": "try_element_at(r.bulletFields, 1)", "title": "r.title", "url": "concat('https://', split_part(token, '/', 1), '.wd1.myworkdayjobs.com/', split_part(token, '/', 2), r.externalPath)", "location": "r.locationsText", "posted": "r.postedOn"}, tier="C"),
    "oracle_cloud": Spec("STRUCT<items ARRAY<STRUCT<requisitionList ARRAY<STRUCT<Id STRING, Title STRING, PrimaryLocation STRING, PostedDate STRING>>>>>", "flatten(transform(p.items, i -> i.requisitionList))", {"source_job_id": "r.Id", "title": "r.Title", "url": "concat('https://', token, '.fa.oraclecloud.com/hcmUI/CandidateExperience/en/job/', r.Id)", "location": "r.PrimaryLocation", "posted": "r.PostedDate"}, tier="C"),
    "eightfold": Spec("STRUCT<positions ARRAY<STRUCT<id STRING, name STRING, title STRING, canonicalPositionUrl STRING, job_url STRING, location STRING, t_create BIGINT>>>", "p.positions", {"source_job_id": "r.id", "title": "coalesce(r.name, r.title)", "url": "coalesce(r.canonicalPositionUrl, r.job_url, concat('https://', token, '.eightfold.ai/careers?pid=', r.id))", "location": "r.location", "posted": "cast(r.t_create as string)"}, tier="C"),
    "phenom": Spec("STRUCT<jobs ARRAY<STRUCT<data STRUCT<title STRING, name STRING, applyUrl STRING, url STRING, jobId STRING, refNum STRING, cityState STRING, location STRING, postedDate STRING>, title STRING, name STRING, applyUrl STRING, url STRING, jobId STRING, refNum STRING, cityState STRING, location STRING, postedDate STRING>>>", "p.jobs", {"source_job_id": "coalesce(r.data.jobId, r.data.refNum, r.jobId, r.refNum)", "title": "coalesce(r.data.title, r.data.name, r.title, r.name)", "url": "coalesce(r.data.applyUrl, r.data.url, r.applyUrl, r.url)", "location": "coalesce(r.data.cityState, r.data.location, r.cityState, r.location)", "posted": "coalesce(r.data.postedDate, r.postedDate)"}, tier="C"),
    "ultipro": Spec("STRUCT<Id STRING, Title STRING, Location STRING, PostedDate STRING, Url STRING>", "Opportunity", {"source_job_id": "r.Id", "title": "r.Title", "url": "coalesce(r.Url, concat('https://recruiting.ultipro.com/', split_part(token, '/', 1), '/JobBoard/Jobs'))", "location": "r.Location", "posted": "r.PostedDate"}, "xml", tier="C"),
    "comeet": Spec("ARRAY<STRUCT<uid STRING, name STRING, department STRING, location STRUCT<name STRING, is_remote BOOLEAN>, url_comeet_hosted_page STRING, url_active_page STRING, employment_type STRING>>", "p", {"source_job_id": "r.uid", "title": "r.name", "url": "coalesce(r.url_comeet_hosted_page, r.url_active_page)", "location": "r.location.name", "remote": "r.location.is_remote", "department": "r.department", "employment_type": "r.employment_type"}, "script", "COMPANY_POSITIONS_DATA"),
    "paylocity": Spec("STRUCT<CompanyName STRING, Jobs ARRAY<STRUCT<JobId STRING, JobTitle STRING, LocationName STRING, PublishedDate STRING, IsRemote BOOLEAN, Description STRING>>>", "p.Jobs", {"source_job_id": "r.JobId", "title": "r.JobTitle", "url": "concat('https://recruiting.paylocity.com/Recruiting/Jobs/Details/', r.JobId)", "location": "r.LocationName", "html": "r.Description", "posted": "r.PublishedDate", "remote": "r.IsRemote"}, "script", "window.pageData", "C"),
    "jazzhr": _anchors("/apply/([A-Za-z0-9]+)"), "jobvite": _anchors("/job/([A-Za-z0-9]+)"), "zohorecruit": _anchors("/jobs/Careers/([0-9]+)"), "icims": _anchors("/jobs/([0-9]+)/"), "adp": _anchors("/jobs?/([A-Za-z0-9-]+)"),
    "teamtailor": Spec(_LD, "", _LD_FIELDS, "ld"), "successfactors": Spec(_LD, "", _LD_FIELDS, "ld", tier="C"), "taleo": Spec(_LD, "", _LD_FIELDS, "ld", tier="C"), "neogov": Spec(_LD, "", _LD_FIELDS, "ld", tier="C"),
}
FIELDS = ["source_job_id", "title", "url", "location", "text", "html", "posted", "deadline", "remote", "department", "employment_type"]


def rows_of(raw: DataFrame, ats: str) -> DataFrame:
    """(token, company, r): a row for each posting of every payload."""
    spec = SPECS[ats]
    if spec.kind == "json":
        return raw.select("token", "company", F.from_json("payload", spec.schema).alias("p")).select("token", "company", F.explode(F.expr(spec.rows)).alias("r"))
    if spec.kind == "xml":
        items = F.regexp_extract_all("payload", F.lit(rf"(?s)<{spec.rows}\b.*?</{spec.rows}>"), F.lit(0))
        return raw.select("token", "company", F.explode(items).alias("x")).select("token", "company", F.from_xml("x", spec.schema).alias("r"))
    if spec.kind == "script":
        found = F.from_json(html.embedded_json("payload", F.lit(spec.marker)), spec.schema)
        return raw.select("token", "company", found.alias("p")).select("token", "company", F.explode(F.expr(spec.rows)).alias("r"))
    pages = html.parsed(raw.select(F.struct("token", "company").alias("k"), "payload"), "k", "payload")
    if spec.kind == "anchors":
        return pages.select("k.token", "k.company", F.explode("links").alias("r")).where(F.col("r.href").rlike(spec.rows))
    return pages.select("k.token", "k.company", F.explode(html.job_postings("scripts")).alias("x")).select("token", "company", F.from_json("x", spec.schema).alias("r"))


def unparsed(raw: DataFrame, ats: str) -> DataFrame:
    """Payloads of a JSON format that don't parse."""
    return raw.where(F.from_json("payload", SPECS[ats].schema).isNull())


def normalized(raw: DataFrame, ats: str) -> DataFrame:
    """Postings of one format in the common schema."""
    spec = SPECS[ats]
    rows = rows_of(raw, ats)
    picked = [F.expr(spec.fields.get(f, "cast(null as string)")).alias(f) if f != "remote" else F.coalesce(F.expr(spec.fields.get(f, "false")), F.lit(False)).alias(f) for f in FIELDS]
    return finalized(rows.select(F.lit(ats).alias("ats"), "token", F.coalesce("company", "token").alias("company"), *picked))


def bare_text(markup: Column) -> Column:
    """Text of a fragment: scripts and styles dropped, tags turned to line breaks, lines trimmed, blank ones dropped."""
    t = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(t, r"\r?\n"), text.strip), lambda x: x != ""), "\n")


def finalized(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Identity, class, place, dates and slug, derived alike for every format."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    body = F.coalesce(F.nullif("text", F.lit("")), bare_text(F.replace(F.replace(F.col("html"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))), F.lit(""))
    df = rows.withColumns({"title": text.strip(F.coalesce("title", F.lit(""))), "description_text": body, "_place": text.location(F.col("location"))}).withColumn("_class", classify.classified(F.col("title"), F.col("description_text")))
    t, x = F.col("title"), F.col("description_text")
    return df.select(
        text.posting_uid(F.col("ats"), F.col("token"), F.col("source_job_id"), F.col("url")).alias("job_uid"), "ats", "token", "source_job_id", "url", text.url_hash(F.col("url")).alias("url_hash"), "company",
        text.company_slug(F.coalesce("company", "token")).alias("company_slug"), "title", text.title_key(t).alias("title_normalized"), "department", "employment_type", F.col("_class.is_internship").alias("is_internship"),
        F.col("_class.kind").alias("internship_kind"), F.col("_class.tags").alias("level_tags"), F.col("location").alias("location_raw"), F.col("_place.normalized").alias("location_normalized"), F.col("_place.country").alias("country"),
        F.col("_place.region").alias("region"), F.col("_place.city").alias("city"), (F.col("_place.is_remote") | F.col("remote")).alias("is_remote"), F.col("_place.remote_scope").alias("remote_scope"), "description_text", F.col("html").alias("description_html"),
        text.parsed_time(F.col("posted")).alias("posted_at"), F.coalesce(text.parsed_time(F.col("deadline")), text.deadline(x, as_of)).alias("deadline_at"), text.is_rolling(x).alias("is_rolling"),
    )


def listings(items: DataFrame, keep_early: bool = False, always: bool = False) -> DataFrame:
    """Postings of aggregators: items have title, company, url, location, posted, source, text and may have source_job_id. The board is
    read out of the url, else the format is listing and the token the company's slug; rows without title or url go. Internships alone
    stay, and founding roles where asked for; `always` takes every row for an internship."""
    b = urls.board(F.col("url"))
    own = F.col("source_job_id") if "source_job_id" in items.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    clean = items.withColumns({"title": text.strip("title"), "url": text.strip("url"), "company": F.nullif(text.strip("company"), F.lit(""))}).where("title <> '' AND url <> ''")
    rows = clean.select(
        F.coalesce(b["ats"], F.lit("listing")).alias("ats"), F.coalesce(b["token"], text.company_slug(F.col("company"))).alias("token"), "company", own.alias("source_job_id"), "title", "url", "location", "text",
        none.alias("html"), "posted", none.alias("deadline"), F.lit(False).alias("remote"), none.alias("department"), none.alias("employment_type"),
    )
    out = finalized(rows)
    if always:
        out = out.withColumn("is_internship", F.lit(True))
    out = out.withColumn("internship_kind", F.when(F.col("is_internship"), F.coalesce("internship_kind", F.lit("intern"))))
    early = classify.is_early_title(F.col("title"))
    if keep_early:
        out = out.withColumn("level_tags", F.when(early & ~F.col("is_internship"), F.array_distinct(F.concat("level_tags", F.array(F.lit("early-stage"))))).otherwise(F.col("level_tags")))
        return out.where(F.col("is_internship") | early)
    return out.where("is_internship")


def board_refs(postings: DataFrame) -> DataFrame:
    """Distinct boards (ats, token, company) that the postings' urls belong to; the company of the first posting by `ord` that has one of
    a board."""
    b = urls.board(F.col("url"))
    found = postings.select(b.alias("b"), "company", "ord").where("b IS NOT NULL")
    return found.groupBy("b.ats", "b.token").agg(F.min_by(F.struct("company"), "ord")["company"].alias("company"))


#: A row of each sample format as SQL over part, and what it must come to.
_SAMPLES = {
    "greenhouse": ("named_struct('jobs', collect_list(named_struct('id', p_partkey, 'title', p_name, 'absolute_url', u, 'location', named_struct('name', p_brand))))", "p_brand", "u"),
    "lever": ("collect_list(named_struct('id', cast(p_partkey as string), 'text', p_name, 'hostedUrl', CASE WHEN p_partkey % 2 = 0 THEN u END, 'applyUrl', u, 'categories', named_struct('location', p_brand)))", "p_brand", "u"),
    "smartrecruiters": ("named_struct('content', collect_list(named_struct('id', cast(p_partkey as string), 'name', p_name, 'location', named_struct('city', p_brand, 'region', '', 'country', 'us', 'remote', p_partkey % 2 = 0))))", "p_brand || ', us' || CASE WHEN p_partkey % 2 = 0 THEN ', Remote' ELSE '' END", "'https://jobs.smartrecruiters.com/' || token || '/' || p_partkey"),
    "recruitee": ("named_struct('offers', collect_list(named_struct('id', p_partkey, 'title', p_name, 'careers_url', u, 'city', p_brand, 'country_code', 'DE')))", "p_brand || ', DE'", "u"),
    "bamboohr": ("named_struct('result', collect_list(named_struct('id', p_partkey, 'jobOpeningName', p_name, 'location', named_struct('city', p_brand, 'state', 'TX'))))", "p_brand || ', TX'", "'https://' || token || '.bamboohr.com/careers/' || p_partkey"),
    "breezy": ("collect_list(named_struct('_id', cast(p_partkey as string), 'name', p_name, 'location', named_struct('city', p_brand, 'country', named_struct('name', 'Spain'))))", "p_brand || ', Spain'", "'https://' || token || '.breezy.hr/p/' || p_partkey"),
    "rippling": ("collect_list(named_struct('id', cast(p_partkey as string), 'name', p_name, 'url', u, 'workLocation', named_struct('label', p_brand)))", "p_brand", "u"),
    "workday": ("named_struct('total', 1, 'jobPostings', collect_list(named_struct('title', p_name, 'externalPath', '/job/' || cast(p_partkey as string), 'locationsText', p_brand, 'bulletFields', array(cast(p_partkey as string)))))", "p_brand", "'https://' || token || '.wd1.myworkdayjobs.com//job/' || p_partkey"),
    "ashby": ("named_struct('jobs', collect_list(named_struct('id', k, 'title', p_name, 'location', p_brand, 'secondaryLocations', array(named_struct('location', 'Rome')), 'applyUrl', u)))", "p_brand || ', Rome'", "u"),
    "workable": ("named_struct('jobs', collect_list(named_struct('title', p_name, 'shortcode', k, 'url', '', 'location', named_struct('city', p_brand, 'country', 'US'))))", "p_brand || ', US'", "'https://apply.workable.com/' || token || '/j/' || p_partkey || '/'"),
    "personio": ("'<workzag-jobs>' || array_join(collect_list('<position><id>' || k || '</id><office>' || p_brand || '</office><name>' || p_name || '</name></position>'), '') || '</workzag-jobs>'", "p_brand", "'https://' || token || '.jobs.personio.de/job/' || p_partkey", "text"),
    "pinpoint": ("named_struct('data', collect_list(named_struct('id', k, 'title', p_name, 'url', u, 'location', named_struct('city', 'Bern', 'name', p_brand, 'province', 'Bern'))))", "p_brand || ', Bern'", "u"),
    "comeet": ("'<script>COMPANY_POSITIONS_DATA = ' || to_json(collect_list(named_struct('uid', k, 'name', p_name, 'location', named_struct('name', p_brand), 'url_active_page', u))) || ';</script>'", "p_brand", "u", "text"),
    "dover": ("named_struct('results', collect_list(named_struct('id', k, 'title', p_name, 'locations', array(named_struct('name', p_brand)))))", "p_brand", "'https://jobs.dover.com/companies/' || token"),
    "gem": ("named_struct('jobs', collect_list(named_struct('id', k, 'title', p_name, 'location', p_brand)))", "p_brand", "'https://jobs.gem.com/' || token || '/' || p_partkey"),
    "oracle_cloud": ("named_struct('items', array(named_struct('requisitionList', collect_list(named_struct('Id', k, 'Title', p_name, 'PrimaryLocation', p_brand)))))", "p_brand", "'https://' || token || '.fa.oraclecloud.com/hcmUI/CandidateExperience/en/job/' || p_partkey"),
    "ultipro": ("'<x>' || array_join(collect_list('<Opportunity><Id>' || k || '</Id><Title>' || p_name || '</Title><Location>' || p_brand || '</Location><Url>' || u || '</Url></Opportunity>'), '') || '</x>'", "p_brand", "u", "text"),
    "paylocity": ("'<script>window.pageData = ' || to_json(named_struct('Jobs', collect_list(named_struct('JobId', k, 'JobTitle', p_name, 'LocationName', p_brand)))) || ';</script>'", "p_brand", "'https://recruiting.paylocity.com/Recruiting/Jobs/Details/' || p_partkey", "text"),
    "eightfold": ("named_struct('positions', collect_list(named_struct('id', k, 'title', p_name, 'location', p_brand)))", "p_brand", "'https://' || token || '.eightfold.ai/careers?pid=' || p_partkey"),
    "phenom": ("named_struct('jobs', collect_list(named_struct('data', CASE WHEN p_partkey % 2 = 0 THEN named_struct('name', p_name, 'url', u, 'refNum', k, 'location', p_brand) END, 'title', CASE WHEN p_partkey % 2 = 1 THEN p_name END, 'applyUrl', CASE WHEN p_partkey % 2 = 1 THEN u END, 'jobId', CASE WHEN p_partkey % 2 = 1 THEN k END, 'cityState', CASE WHEN p_partkey % 2 = 1 THEN p_brand END)))", "p_brand", "u"),
    "teamtailor": ("array_join(collect_list('<script type=\"application/ld+json\">' || to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'url', u, 'identifier', named_struct('value', k), 'jobLocation', array(named_struct('address', named_struct('addressLocality', p_brand, 'addressCountry', 'DE'))))) || '</script>'), '')", "p_brand || ', DE'", "u", "text"),
    "successfactors": ("array_join(collect_list('<script type=\"application/ld+json\">' || to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'url', u, 'identifier', named_struct('value', k), 'jobLocation', array(named_struct('address', named_struct('addressLocality', p_brand, 'addressCountry', 'DE'))))) || '</script>'), '')", "p_brand || ', DE'", "u", "text"),
    "taleo": ("array_join(collect_list('<script type=\"application/ld+json\">' || to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'url', u, 'identifier', named_struct('value', k), 'jobLocation', array(named_struct('address', named_struct('addressLocality', p_brand, 'addressCountry', 'DE'))))) || '</script>'), '')", "p_brand || ', DE'", "u", "text"),
    "neogov": ("array_join(collect_list('<script type=\"application/ld+json\">' || to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'url', u, 'identifier', named_struct('value', k), 'jobLocation', array(named_struct('address', named_struct('addressLocality', p_brand, 'addressCountry', 'DE'))))) || '</script>'), '')", "p_brand || ', DE'", "u", "text"),
    "jazzhr": ("array_join(collect_list('<a href=\"/apply/' || k || '\"> ' || p_name || ' </a><a href=\"/about\">x</a>'), '')", "NULL::varchar", "'/apply/' || p_partkey", "text"),
    "jobvite": ("array_join(collect_list('<a href=\"/job/' || k || '\"> ' || p_name || ' </a><a href=\"/about\">x</a>'), '')", "NULL::varchar", "'/job/' || p_partkey", "text"),
    "zohorecruit": ("array_join(collect_list('<a href=\"/jobs/Careers/' || k || '\"> ' || p_name || ' </a><a href=\"/about\">x</a>'), '')", "NULL::varchar", "'/jobs/Careers/' || p_partkey", "text"),
    "adp": ("array_join(collect_list('<a href=\"/jobs/' || k || '\"> ' || p_name || ' </a><a href=\"/about\">x</a>'), '')", "NULL::varchar", "'/jobs/' || p_partkey", "text"),
    "icims": ("array_join(collect_list('<a href=\"/jobs/' || k || '/job\"> ' || p_name || ' </a>'), '')", "NULL::varchar", "'/jobs/' || p_partkey || '/job'", "text"),
}


def sample_payloads(part: DataFrame, ats: str) -> DataFrame:
    """Payloads of a format made of parts, twenty to a board."""
    p = part.selectExpr("*", "cast(p_partkey as string) AS k", "'t' || cast(cast(floor(p_partkey / 20) as int) as string) AS token", "'https://x.example/' || cast(p_partkey as string) AS u")
    made = F.expr(_SAMPLES[ats][0])
    return p.groupBy("token").agg((made if _SAMPLES[ats][3:] == ("text",) else F.to_json(made)).alias("payload")).withColumn("company", F.lit(None).cast("string"))


def sample_sql(ats: str) -> str:
    place, url = _SAMPLES[ats][1:3]
    rows = f"SELECT token, p_partkey::varchar AS source_job_id, trim(p_name) AS title, {place} AS location_raw, {url} AS url FROM (SELECT *, 't' || (p_partkey // 20) AS token, 'https://x.example/' || p_partkey AS u FROM part)"
    return (
        f"SELECT *, sha1('{ats}|' || token || '|' || source_job_id || '|' || url) AS job_uid, sha1(url) AS url_hash, token AS company, token AS company_slug, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS title_normalized,"
        f" trim(split_part(location_raw, ',', 1)) AS city, '{ats}' AS ats, false AS is_internship, coalesce(regexp_matches(location_raw, 'Remote'), false) AS is_remote, '' AS description_text FROM ({rows})"
    )
