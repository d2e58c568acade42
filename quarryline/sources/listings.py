"""Aggregators and career sites of their own: formats as declarative specs that give one schema of listings.

A payload table has token (a channel, a subreddit, a company's page), company and payload. `items` gives title, company, url, location,
posted, source, text and source_job_id; adapters.listings makes postings of them, `ingested` the boards behind them as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import classify, text
from quarryline.operators import merge
from quarryline.sources import adapters, html

FIELDS = ["source_job_id", "title", "company", "url", "location", "posted", "source", "text"]


@dataclass(frozen=True)
class Listing:
    """rows: SQL path to the array of rows for json, the element for xml, the card's selector for cards. A field is SQL over r, token and
    company, or a function that gives a column."""

    kind: str  # json, xml, cards or ld
    rows: str
    fields: dict[str, str | Callable[[], Column]]
    schema: str = ""
    cards: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    where: str | Callable[[], Column] = ""
    once: bool = False  # the first row of a url in a page counts
    always: bool = False
    keep_early: bool = False


def _absolute(base: str, path: str, whole: bool = False) -> str:
    """SQL: a link of a page, without its query unless `whole`, made absolute."""
    bare = path if whole else f"split_part({path}, '?', 1)"
    return f"CASE WHEN {bare} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {bare} WHEN startswith({bare}, '//') THEN concat('https:', {bare}) WHEN startswith({bare}, '/') THEN concat('{base}', {bare}) ELSE concat('{base}/', {bare}) END"


def _filled(*columns: str) -> str:
    """SQL: the first of several texts that isn't blank, trimmed."""
    return "coalesce(" + ", ".join(f"nullif(trim({c}), '')" for c in columns) + ")"


#: Words of a title that a feed's rows must have.
GATE = r"(?i)\bintern\b|co-?op|apprentice"
_ANCHORS = {"title": ([""], "spaced"), "href": ([""], "@href")}

LISTINGS: dict[str, Listing] = {
    "community": Listing("json", "p", {"source_job_id": "r.id", "title": _filled("r.title", "r.role", "r.position"), "company": _filled("r.company_name", "r.company", "r.organization", "r.employer"), "url": _filled("r.url", "r.absolute_url", "r.application_link", "r.apply_link", "r.link"), "location": "nullif(array_join(slice(r.locations, 1, 3), ', '), '')", "posted": "r.date_posted"}, "ARRAY<STRUCT<id STRING, title STRING, role STRING, position STRING, company_name STRING, company STRING, organization STRING, employer STRING, url STRING, absolute_url STRING, application_link STRING, apply_link STRING, link STRING, locations ARRAY<STRING>, date_posted STRING, active BOOLEAN, is_visible BOOLEAN>>", where="r.active AND coalesce(r.is_visible, true)", always=True),
    "remotive": Listing("json", "p.jobs", {"title": "r.title", "company": "r.company_name", "url": "r.url", "location": "r.candidate_required_location", "posted": "r.publication_date"}, "STRUCT<jobs ARRAY<STRUCT<title STRING, company_name STRING, url STRING, candidate_required_location STRING, publication_date STRING>>>"),
    "jobicy": Listing("json", "p.jobs", {"title": "r.jobTitle", "company": "r.companyName", "url": "r.url", "location": "r.jobGeo", "posted": "r.pubDate"}, "STRUCT<jobs ARRAY<STRUCT<jobTitle STRING, companyName STRING, url STRING, jobGeo STRING, pubDate STRING>>>"),
    "arbeitnow": Listing("json", "p.data", {"title": "r.title", "company": "r.company_name", "url": "r.url", "location": "r.location", "posted": "cast(r.created_at as string)"}, "STRUCT<data ARRAY<STRUCT<title STRING, company_name STRING, url STRING, location STRING, created_at STRING>>>"),
    "themuse": Listing("json", "p.results", {"title": "r.name", "company": "r.company.name", "url": "r.refs.landing_page", "location": "try_element_at(r.locations, 1).name", "posted": "r.publication_date"}, "STRUCT<results ARRAY<STRUCT<name STRING, company STRUCT<name STRING>, refs STRUCT<landing_page STRING>, locations ARRAY<STRUCT<name STRING>>, publication_date STRING>>>"),
    "remoteok": Listing("json", "p", {"title": "r.position", "company": "nullif(r.company, '')", "url": "r.url"}, "ARRAY<STRUCT<id STRING, position STRING, company STRING, url STRING>>", where=lambda: F.expr("r.id IS NULL OR r.id <> 'ok'") & F.col("r.position").rlike(GATE)),
    "hn_whoishiring": Listing("json", r"""transform(regexp_extract_all(p.text, 'href="(https?://[^"]+)"[^>]*>([^<]+)</a>', 0), x -> named_struct('url', regexp_extract(x, 'href="([^"]+)"', 1), 'title', regexp_extract(x, '>([^<]+)</a>', 1)))""", {"title": "r.title", "url": "r.url"}, "STRUCT<text STRING>", where=lambda: F.col("r.title").rlike(GATE)),
    "weworkremotely": Listing("xml", "item", {"title": "trim(r.title)", "url": "trim(r.link)"}, "STRUCT<title STRING, link STRING>", where=lambda: F.col("r.title").rlike(GATE)),
    "linkedin": Listing("cards", "li", {"title": "r['title']", "company": "r['company']", "url": "split_part(r['href'], '?', 1)", "location": "r['location']", "posted": "r['posted']"}, cards={"title": ([".base-search-card__title", "h3"], "text"), "href": (["a.base-card__full-link", "a[href]"], "@href"), "company": ([".base-search-card__subtitle"], "text"), "location": ([".job-search-card__location"], "text"), "posted": (["time"], "@datetime")}, where="startswith(r['href'], 'http') AND r['title'] IS NOT NULL"),
    "usajobs": Listing("cards", "div.usajobs-search-result--core, li.usajobs-search-result--core", {"title": "r['title']", "company": _filled("r['agency']", "r['department']"), "url": _absolute("https://www.usajobs.gov", "r['href']"), "location": "r['location']"}, cards={"title": (["a.usajobs-search-result--core__title", "a[href*=/job/]"], "text"), "href": (["a.usajobs-search-result--core__title", "a[href*=/job/]"], "@href"), "agency": ([".usajobs-search-result--core__agency"], "text"), "department": ([".usajobs-search-result--core__department"], "text"), "location": ([".usajobs-search-result--core__location"], "text")}, where="r['href'] <> ''"),
    "usajobs_links": Listing("cards", "a[href*=/job/]", {"title": "r['title']", "url": _absolute("https://www.usajobs.gov", "r['href']")}, cards={"title": ([""], "text"), "href": ([""], "@href")}, where="r['href'] <> '' AND r['title'] <> ''", once=True),
    "google": Listing("json", "p.jobs", {"title": _filled("r.title", "r.job_title"), "company": "'Google'", "url": "coalesce(nullif(trim(r.apply_url), ''), concat('https://www.google.com/about/careers/applications/jobs/results/', nullif(r.id, '')))", "location": "try_element_at(r.locations, 1).display", "posted": "r.created"}, "STRUCT<jobs ARRAY<STRUCT<id STRING, title STRING, job_title STRING, apply_url STRING, locations ARRAY<STRUCT<display STRING>>, created STRING>>>"),
    "amazon": Listing("json", "p.jobs", {"title": _filled("r.title"), "company": "'Amazon'", "url": _absolute("https://www.amazon.jobs", "nullif(trim(r.job_path), '')", True), "location": _filled("r.normalized_location", "r.location"), "posted": "r.posted_date"}, "STRUCT<jobs ARRAY<STRUCT<title STRING, job_path STRING, normalized_location STRING, location STRING, posted_date STRING>>>"),
    "microsoft": Listing("json", "p.operationResult.result.jobs", {"title": _filled("r.title"), "company": "'Microsoft'", "url": "concat('https://jobs.careers.microsoft.com/global/en/job/', coalesce(nullif(r.jobId, ''), nullif(r.id, '')))", "location": "coalesce(try_element_at(r.properties.locations, 1), r.properties.primaryLocation)", "posted": "r.properties.postedDate"}, "STRUCT<operationResult STRUCT<result STRUCT<jobs ARRAY<STRUCT<title STRING, jobId STRING, id STRING, properties STRUCT<locations ARRAY<STRING>, primaryLocation STRING, postedDate STRING>>>>>>"),
    "apple": Listing("json", "p.res.searchResults", {"title": _filled("r.postingTitle", "r.transformedPostingTitle", "r.positionTitle"), "company": "'Apple'", "url": "concat('https://jobs.apple.com/en-us/details/', coalesce(nullif(r.positionId, ''), nullif(r.id, ''), nullif(r.reqId, '')))", "location": "try_element_at(r.locations, 1).name", "posted": "r.postDateInGMT"}, "STRUCT<res STRUCT<searchResults ARRAY<STRUCT<postingTitle STRING, transformedPostingTitle STRING, positionTitle STRING, positionId STRING, id STRING, reqId STRING, locations ARRAY<STRUCT<name STRING>>, postDateInGMT STRING>>>>"),
    "netflix": Listing("json", "p.positions", {"title": _filled("r.name", "r.title"), "company": "'Netflix'", "url": _filled("r.canonicalPositionUrl", "r.job_url"), "location": _filled("r.location"), "posted": "r.t_create"}, "STRUCT<positions ARRAY<STRUCT<name STRING, title STRING, canonicalPositionUrl STRING, job_url STRING, location STRING, t_create STRING>>>"),
    "indeed": Listing("cards", "div.job_seen_beacon, div.cardOutline", {"title": "r['title']", "company": "r['company']", "url": "CASE WHEN startswith(r['href'], '/') THEN concat('https://www.indeed.com', split_part(r['href'], '?', 1)) ELSE r['href'] END", "location": "r['location']"}, cards={"title": (["a.jcs-JobTitle", "h2.jobTitle a"], "text"), "href": (["a.jcs-JobTitle", "h2.jobTitle a"], "@href"), "company": (["[data-testid=company-name]", "span.companyName"], "text"), "location": (["[data-testid=text-location]", "div.companyLocation"], "text")}, where="r['href'] <> ''"),
    "handshake": Listing("cards", "a[href*=/stu/jobs/], a[href*=/jobs/]", {"title": "r['title']", "company": "r['company']", "url": _absolute("https://app.joinhandshake.com", "r['href']"), "location": "r['location']"}, cards={"title": (["[class*=title]", ""], "spaced"), "href": ([""], "@href"), "company": (["[class*=employer], [class*=company]"], "text"), "location": (["[class*=location]"], "text")}, where="r['title'] <> ''"),
    "bluesky": Listing("json", "transform(p.posts, x -> x.record)", {"title": lambda: text.title_line(F.col("r.text")), "company": lambda: text.hiring_company(F.col("r.text")), "url": lambda: F.coalesce(F.expr("try_element_at(filter(flatten(transform(r.facets, f -> coalesce(transform(f.features, x -> x.uri), array()))), u -> startswith(u, 'http')), 1)"), text.first_url(F.col("r.text"))), "posted": "r.createdAt", "text": "r.text"}, "STRUCT<posts ARRAY<STRUCT<record STRUCT<text STRING, createdAt STRING, facets ARRAY<STRUCT<features ARRAY<STRUCT<uri STRING>>>>>>>>"),
    "reddit": Listing("json", "transform(p.data.children, x -> x.data)", {"title": "trim(r.title)", "company": lambda: text.hiring_company(F.concat_ws("\n", F.trim("r.title"), F.coalesce("r.selftext", F.lit("")))), "url": lambda: F.coalesce(F.expr("CASE WHEN NOT contains(coalesce(nullif(r.url_overridden_by_dest, ''), r.url), 'reddit.com') THEN coalesce(nullif(r.url_overridden_by_dest, ''), r.url) END"), text.first_url(F.col("r.selftext")), F.expr("concat('https://old.reddit.com', nullif(r.permalink, ''))")), "posted": "cast(cast(r.created_utc as bigint) as string)", "source": "concat('reddit:', token)", "text": "coalesce(r.selftext, '')"}, "STRUCT<data STRUCT<children ARRAY<STRUCT<data STRUCT<title STRING, selftext STRING, url STRING, url_overridden_by_dest STRING, permalink STRING, created_utc DOUBLE>>>>>", where=lambda: classify.is_internship(F.trim("r.title"), F.coalesce("r.selftext", F.lit("")))),
    "telegram": Listing("cards", ".tgme_widget_message_text, .message", {"title": "trim(substring(r['title'], 1, 120))", "url": "regexp_replace(u, '[.,)]+$', '')", "source": "concat('telegram:', token)"}, cards={"title": ([""], "spaced"), "markup": ([""], "markup")}, where=lambda: F.col("r").getItem("title").rlike(GATE) & ~F.contains(F.regexp_replace("u", "[.,)]+$", ""), F.lit("t.me/")), once=True),
    "eures": Listing("json", "p.jvs", {"source_job_id": "cast(null as string)", "title": "r.title", "company": "r.employer.name", "url": "concat('https://europa.eu/eures/portal/jv-se/jv-details/', r.id, '?lang=en')", "location": "nullif(array_join(array_sort(map_keys(r.locationMap)), ', '), '')", "posted": "r.creationDate", "text": "coalesce(r.description, '')"}, "STRUCT<jvs ARRAY<STRUCT<id STRING, title STRING, employer STRUCT<name STRING>, locationMap MAP<STRING, STRING>, creationDate STRING, description STRING>>>", where="r.id IS NOT NULL"),
    "arbeitsagentur": Listing("json", "p.ergebnisliste", {"title": "trim(coalesce(nullif(r.stellenangebotsTitel, ''), r.titel))", "company": "coalesce(nullif(r.firma, ''), r.arbeitgeber)", "url": "coalesce(nullif(r.externeURL, ''), concat('https://www.arbeitsagentur.de/jobsuche/jobdetail/', coalesce(nullif(r.referenznummer, ''), nullif(r.refnr, ''))))", "location": "r.arbeitsort.ort", "posted": "coalesce(nullif(r.datumErsteVeroeffentlichung, ''), r.aktuelleVeroeffentlichungsdatum)"}, "STRUCT<ergebnisliste ARRAY<STRUCT<stellenangebotsTitel STRING, titel STRING, referenznummer STRING, refnr STRING, externeURL STRING, arbeitsort STRUCT<ort STRING>, datumErsteVeroeffentlichung STRING, aktuelleVeroeffentlichungsdatum STRING, firma STRING, arbeitgeber STRING>>>"),
    "idealist": Listing("json", "p.hits", {"title": "trim(r.name)", "company": "r.orgName", "url": _absolute("https://www.idealist.org", "r.url.en"), "location": "CASE WHEN r.remoteOk OR r.locationType = 'REMOTE' THEN 'Remote' ELSE nullif(concat_ws(', ', nullif(r.city, ''), nullif(r.stateStr, ''), nullif(r.country, '')), '') END", "posted": "r.published", "text": "coalesce(r.description, '')"}, "STRUCT<hits ARRAY<STRUCT<name STRING, url STRUCT<en STRING>, orgName STRING, remoteOk BOOLEAN, locationType STRING, city STRING, stateStr STRING, country STRING, published STRING, description STRING>>>", where="r.url.en IS NOT NULL"),
    "wellfound": Listing("ld", "", {"title": "trim(r.title)", "company": "coalesce(nullif(r.hiringOrganization.name, ''), company)", "url": "coalesce(r.url, r.applyUrl, token)", "location": "try_element_at(filter(transform(r.jobLocation, l -> concat_ws(', ', nullif(l.address.addressLocality, ''), nullif(l.address.addressRegion, ''), nullif(l.address.addressCountry, ''))), x -> x <> ''), 1)", "posted": "r.datePosted", "text": "coalesce(r.description, '')"}, "STRUCT<title STRING, url STRING, applyUrl STRING, description STRING, datePosted STRING, hiringOrganization STRUCT<name STRING>, jobLocation ARRAY<STRUCT<address STRUCT<addressLocality STRING, addressRegion STRING, addressCountry STRING>>>>", keep_early=True),
    "workatastartup": Listing("cards", "a[href*=/jobs/], a[href*=/companies/]", {"title": "r['title']", "url": _absolute("https://www.workatastartup.com", "r['href']")}, cards=_ANCHORS, where=r"length(r['title']) >= 4 AND r['title'] RLIKE '(?i)intern|co-?op'", keep_early=True),
}
#: A session's pages have the guests' cards.
LISTINGS["linkedin_session"] = LISTINGS["linkedin"]
GROUPS = {"job_apis": ["remotive", "jobicy", "arbeitnow", "themuse"], "feeds": ["remoteok", "hn_whoishiring", "weworkremotely"], "bigco": ["google", "amazon", "microsoft", "apple", "netflix"]}


def _column(x: str | Callable[[], Column]) -> Column:
    return F.expr(x) if isinstance(x, str) else x()


def items(raw: DataFrame, name: str) -> DataFrame:
    """Listings of one format: FIELDS. A payload that doesn't parse gives none."""
    spec = LISTINGS[name]
    if spec.kind == "json":
        rows = raw.select("token", "company", F.from_json("payload", spec.schema).alias("p")).select("token", "company", F.posexplode(F.expr(spec.rows)).alias("n", "r"))
    elif spec.kind == "xml":
        found = F.regexp_extract_all("payload", F.lit(rf"(?s)<{spec.rows}\b.*?</{spec.rows}>"), F.lit(0))
        rows = raw.select("token", "company", F.posexplode(found).alias("n", "x")).select("token", "company", "n", F.from_xml("x", spec.schema).alias("r"))
    elif spec.kind == "cards":
        rows = raw.select("token", "company", F.posexplode(html.card_rows(spec.rows, spec.cards)("payload")).alias("n", "r"))
        if "markup" in spec.cards:
            rows = rows.select("token", "company", "n", "r", F.explode(F.regexp_extract_all(F.col("r").getItem("markup"), F.lit(r"""https?://[^\s<>"']+"""), F.lit(0))).alias("u"))
    else:
        pages = html.parsed(raw.select(F.struct("token", "company").alias("k"), "payload"), "k", "payload")
        rows = pages.select("k.token", "k.company", F.posexplode(html.job_postings("scripts")).alias("n", "x")).select("token", "company", "n", F.from_json("x", spec.schema).alias("r"))
    if spec.where:
        rows = rows.where(_column(spec.where))
    own = {"source": f"'{name}'", "text": "''"} | spec.fields
    out = rows.select("token", "n", *(_column(own.get(f, "cast(null as string)")).alias(f) for f in FIELDS)).where("title IS NOT NULL AND trim(title) <> '' AND url IS NOT NULL AND trim(url) <> ''")
    if spec.once:
        rest = [f for f in FIELDS if f != "url"]
        out = out.groupBy("token", "url").agg(F.min_by(F.struct(*rest), F.struct("n", *rest)).alias("first")).select("url", "first.*")
    return out.select(*FIELDS)


def all_items(payloads: dict[str, DataFrame]) -> DataFrame:
    """The listings of several formats, one after the other."""
    out = None
    for name, raw in payloads.items():
        own = items(raw, name)
        out = own if out is None else out.unionByName(own)
    return out


def postings(raw: DataFrame, name: str) -> DataFrame:
    """Postings of one format in the common schema."""
    spec = LISTINGS[name]
    return adapters.listings(items(raw, name), spec.keep_early, spec.always)


def usajobs(raw: DataFrame) -> DataFrame:
    """Cards of a page, or its plain job links where it has no card."""
    found = items(raw, "usajobs")
    carded = raw.withColumn("n", F.size(html.card_rows(LISTINGS["usajobs"].rows, {"href": LISTINGS["usajobs"].cards["href"]})("payload")))
    return found.unionByName(items(carded.where("n = 0").drop("n"), "usajobs_links"))


def ingested(items_: DataFrame, known_boards: DataFrame, jobs: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, new boards behind their urls, summary). The summary has one row: entries, jobs and new_boards; with `jobs`, a snapshot
    of postings by url_hash, also inserted and updated."""
    found = adapters.listings(items_, **options)
    fresh = merge.new_boards(adapters.board_refs(found.withColumn("ord", F.col("url_hash"))), known_boards)
    counts = items_.agg(F.count("*").alias("entries")).crossJoin(found.agg(F.count("*").alias("jobs"))).crossJoin(fresh.agg(F.count("*").alias("new_boards")))
    if jobs is not None:
        keys = found.select("url_hash").distinct().join(jobs.select("url_hash").distinct().withColumn("old", F.lit(True)), "url_hash", "left")
        counts = counts.crossJoin(keys.agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if("old").alias("updated")))
    return found, fresh, counts
