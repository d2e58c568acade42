"""Queries of people, addresses, contact and company merges, dossiers, filings, settings and spreadsheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import contacts as names, scoring, text, urls
from quarryline.operators import dedup, dossier, filings, merge, people, relational
from quarryline.plans.answer_queries import _FIRMS, _PEOPLE, _ROWS, firms, people as bound_people, tracked
from quarryline.plans.base import Queries
from quarryline.plans.contact_queries import FIRST, LAST, _NAME, _PARTS, _RENDER
from quarryline.plans.tables import DAY0, case, table
from quarryline.sources import html, settings

QUERIES = Queries()

_TITLES = ["Ann Lee - Recruiter at Acme | LinkedIn", "Bo Ray – Head of Talent - Acme | LinkedIn", "Cy Doe | something", "", "Jane Roe (@jane) · GitHub"]
_LINKS = ["https://uk.linkedin.com/in/ann-lee?x=1", "https://x.example/p", "https://www.LinkedIn.com/in/cy/", "https://y.example", "https://github.com/jane"]


@QUERIES("q_search_leads", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Ray' WHEN 2 THEN 'Cy Doe' ELSE 'Jane Roe (@jane) · GitHub' END AS name, CASE doc_id % 5 WHEN 0 THEN 'Recruiter' WHEN 1 THEN 'Head of Talent - Acme' END AS title, CASE doc_id % 5 WHEN 0 THEN 'https://www.linkedin.com/in/ann-lee' WHEN 2 THEN 'https://www.LinkedIn.com/in/cy' END AS linkedin, CASE WHEN doc_id % 5 = 4 THEN 'Jane Roe:github' WHEN doc_id % 5 = 0 THEN 'Ann Lee:linkedin' WHEN doc_id % 5 = 2 THEN 'Cy Doe:linkedin' END AS social FROM documents WHERE doc_id % 5 <> 3")
def _(spark, d):
    x = table(spark, d, "documents").selectExpr("doc_id", f"{case('doc_id', _TITLES)} AS t", f"{case('doc_id', _LINKS)} AS u")
    lead, social = people.search_lead(F.col("t"), F.col("u")), people.social_lead(F.col("t"), F.col("u"))
    return x.select("doc_id", lead.alias("l"), social.alias("s")).where("l IS NOT NULL").select("doc_id", "l.name", "l.title", "l.linkedin", F.when(F.col("s").isNotNull(), F.concat_ws(":", "s.name", "s.kind")).alias("social"))


@QUERIES("q_registry_people", "SELECT 'u' || k || '@x.io' AS email, 'N' || k AS name FROM (SELECT DISTINCT s_suppkey % 20 AS k FROM supplier) UNION ALL SELECT 'm' || k || '@y.io', 'M' || k FROM (SELECT DISTINCT s_suppkey % 7 AS k FROM supplier)")
def _(spark, d):
    s = table(spark, d, "supplier")
    npm = s.selectExpr("s_suppkey AS ord", "to_json(named_struct('author', named_struct('name', 'N' || cast(s_suppkey % 20 AS string), 'email', 'U' || cast(s_suppkey % 20 AS string) || '@x.io '), 'maintainers', array(named_struct('name', 'i', 'email', 'info@x.io'), named_struct('name', 'r', 'email', '1+a@users.noreply.github.com')))) AS body")
    pypi = s.selectExpr("s_suppkey AS ord", "to_json(named_struct('info', named_struct('author', 'M' || cast(s_suppkey % 7 AS string), 'author_email', 'M <m' || cast(s_suppkey % 7 AS string) || '@y.io>', 'maintainer_email', 'none'))) AS body")
    return people.registry_people(people.npm_people(npm).unionByName(people.pypi_people(pypi))).select("email", "name")


@QUERIES("q_directory_emails", "SELECT s_suppkey AS ord, 'a' || s_suppkey || '@r.io' AS email FROM supplier UNION ALL SELECT s_suppkey, 'deep' || (s_suppkey % 3) || '@r.io' FROM supplier")
def _(spark, d):
    body = """'{"entities": [{"vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["email", {}, "text", "A' || cast(s_suppkey AS string) || '@r.io "]]], "entities": [{"entities": [{"vcardArray": ["vcard", [["EMAIL", {}, "text", "deep' || cast(s_suppkey % 3 AS string) || '@r.io"], ["tel", {}, "text", "x@y"]]]}]}]}, {"vcardArray": null}]}'"""
    return people.directory_emails(table(spark, d, "supplier").selectExpr("s_suppkey AS ord", f"{body} AS body"))


@QUERIES("q_commit_people", "SELECT 'f' || (o_custkey % 5) || '.com' AS domain, 'p' || (o_custkey % 50) || '@f' || (o_custkey % 5) || '.com' AS known_email, arg_min('N' || o_orderkey, o_orderkey) AS full_name FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1, 2")
def _(spark, d):
    lines = table(spark, d, "orders").selectExpr("o_orderkey AS ord", "'f' || cast(o_custkey % 5 AS string) || '.com' AS domain", "' N' || cast(o_orderkey AS string) || '|P' || cast(o_custkey % 50 AS string) || CASE WHEN o_orderkey % 4 = 3 THEN '@users.noreply.f.com' ELSE '@F' || cast(o_custkey % 5 AS string) || '.com' END AS value")
    return people.commit_people(people.commit_lines(lines), F.col("domain"), "git_commit").select("domain", "known_email", "full_name")


@QUERIES("q_listed_people", "SELECT 'Ann ' || k AS full_name, 'Boss' AS title FROM (SELECT DISTINCT s_suppkey % 9 AS k FROM supplier) UNION ALL SELECT 'Bo', NULL")
def _(spark, d):
    reply = """'Sure: {"people": [{"name": " Ann ' || cast(s_suppkey % 9 AS string) || '", "title": "Boss"}, {"name": "' || CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM {supplier}) THEN 'Bo' ELSE 'BO' END || '", "title": " "}, {"title": "x"}]} done'"""
    s = table(spark, d, "supplier")
    first = s.agg(F.min("s_suppkey")).first()[0]
    rows = s.selectExpr("s_suppkey AS ord", reply.replace("(SELECT min(s_suppkey) FROM {supplier})", str(first)) + " AS reply")
    return people.listed_people(rows).select("full_name", "title")


@QUERIES("q_company_people", "SELECT company_slug, 'Ann Lee' AS full_name, 'recruiter' AS role_category FROM (SELECT DISTINCT company_slug FROM jobs WHERE doc_id % 2 = 0) UNION ALL SELECT company_slug, 'Bo Ray', CASE WHEN bool_or(doc_id % 3 = 0) THEN 'hiring_manager' ELSE 'founder' END FROM jobs WHERE doc_id % 3 = 0 OR doc_id % 50 < 25 GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "jobs").selectExpr("company_slug", "ord", "CASE WHEN doc_id % 3 = 0 THEN 'Great team. Reporting to: Bo Ray in Paris' ELSE 'contact us NOW' END AS description_text", "CASE WHEN doc_id % 2 = 0 THEN ' Ann Lee ' ELSE 'ACME HR' END AS creator")
    officers = table(spark, d, "jobs").where("doc_id % 50 < 25").selectExpr("company_slug", "ord", "'Bo Ray' AS full_name", "'founder' AS role_hint")
    return people.company_people(j, officers).select("company_slug", "full_name", "role_category")


@QUERIES("q_disclosed_people", f"SELECT slug, CASE WHEN k % 2 = 0 THEN 'e' || k || '@x.io' END AS known_email, 'N' || k AS full_name FROM (SELECT company_slug AS slug, ord % 10 AS f FROM ({_FIRMS})) JOIN (SELECT DISTINCT s_suppkey % 20 AS k FROM supplier) ON f = k % 10")
def _(spark, d):
    own = firms(spark, d).selectExpr("company_slug AS slug", "'Acme ' || cast(ord % 10 AS string) || ' Holdings Inc' AS name")
    leads = table(spark, d, "supplier").selectExpr("s_suppkey AS ord", "'acme' || cast(s_suppkey % 10 AS string) AS company_slug", "'N' || cast(s_suppkey % 20 AS string) AS full_name", "'t' AS title", "CASE WHEN s_suppkey % 2 = 0 THEN 'e' || cast(s_suppkey % 20 AS string) || '@x.io' END AS email", "'hr' AS role_hint", "'oflc_lca' AS source")
    return people.disclosed_people(leads, own).select("slug", "known_email", "full_name")


@QUERIES("q_resolved_domain", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'own.com' WHEN 1 THEN 'acme' || (s_suppkey % 5) || '.io' ELSE 'acme' || (s_suppkey % 5) || '.com' END AS domain, CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.3 END::double AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'job_metadata' WHEN 1 THEN 'mx_validated' ELSE 'slug_fallback' END AS source FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'WWW.own.com' WHEN 1 THEN 'jobs.lever.co' END AS known", "'Acme ' || cast(s_suppkey % 5 AS string) AS name", "'acme-' || cast(s_suppkey % 5 AS string) AS slug", "CASE WHEN s_suppkey % 3 = 1 THEN array('zz.com', 'acme' || cast(s_suppkey % 5 AS string) || '.io') ELSE array() END AS mail")
    return s.select("s_suppkey", people.resolved_domain(F.col("known"), F.col("name"), F.col("slug"), F.col("mail")).alias("r")).select("s_suppkey", "r.*")


_N = "SELECT c_custkey, " + _PARTS + " FROM customer"
_CASES = "CASE c_custkey % 6 WHEN 0 THEN ('x' || c_custkey || '@gov.us', 'disclosure', 'gov:sbir', 65.0, 'probable') WHEN 1 THEN ('p' || c_custkey || '@acme.io', 'github', 'github_commit', 65.0, 'probable') WHEN 2 THEN (" + _RENDER["{f}{last}"] + " || '@acme.io', 'scraped', 'site_scrape', 70.0, 'probable') WHEN 3 THEN (" + _RENDER["{first}_{last}"] + " || '@acme.io', 'guessed', 'pattern:{first}_{last}', 55.0, 'probable') WHEN 4 THEN (" + _RENDER["{first}"] + " || '@acme.io', 'guessed', 'prior:{first}', 10.0, 'guessed') ELSE NULL END"


@QUERIES("q_found_email", f"SELECT c_custkey, r[1] AS email, r[2] AS status, r[3] AS source, r[4]::double AS score, r[5] AS label FROM (SELECT c_custkey, {_CASES} AS r FROM ({_N}))")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", f"CASE WHEN c_custkey % 6 = 5 THEN 'Prince' ELSE {_NAME} END AS name", "CASE c_custkey % 6 WHEN 0 THEN 'X' || cast(c_custkey AS string) || '@gov.us' WHEN 1 THEN 'p' || cast(c_custkey AS string) || '@ACME.io' WHEN 2 THEN 'p@other.io' END AS known", "CASE WHEN c_custkey % 6 = 0 THEN 'sbir' ELSE 'github' END AS src", "c_custkey % 6 AS k")
    parts = names.split_name(F.col("name"))
    published = F.when(F.col("k") == 2, F.array(F.lit("info@acme.io"), F.concat(names.rendered(F.lit("{f}{last}"), names.name_token(parts["first"]), names.name_token(parts["last"])), F.lit("@acme.io")))).otherwise(F.array().cast("array<string>"))
    template = F.when(F.col("k") == 3, "{first}_{last}")
    r = people.found_email(F.col("name"), F.lit("acme.io"), known_email=F.col("known"), person_source=F.col("src"), scraped=published, template=template, votes=F.lit(0), locked=F.col("k") == 3, band=F.lit("tiny"), provider=F.lit("google"), catch_all=F.lit(False))
    return c.select("c_custkey", r.alias("r")).select("c_custkey", "r.email", "r.status", "r.source", "r.score", "r.label")


@QUERIES("q_verified_email", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'invalid' WHEN s_suppkey % 2 = 0 THEN 'scraped' ELSE 'guessed' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 100 ELSE 38 END::double AS score, CASE WHEN s_suppkey % 4 = 0 THEN 'invalid' WHEN s_suppkey % 2 = 0 THEN 'verified' ELSE 'guessed' END AS label FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "named_struct('email', 'a@b.io', 'status', CASE WHEN s_suppkey % 2 = 0 THEN 'scraped' ELSE 'guessed' END) AS r", "s_suppkey % 4 <> 0 AS mx", "s_suppkey % 2 AS odd")
    facts = F.struct(*((F.col("mx") if x == "mx_present" else F.lit(x in ("holehe", "spf_dmarc"))).alias(x) for x in scoring.EMAIL_FACTS), F.lit(1).alias("votes"), F.lit(0).alias("channels"), F.lit(False).alias("catch_all"))
    return s.select("s_suppkey", people.verified(F.col("r"), facts).alias("v")).select("s_suppkey", "v.status", "v.score", "v.label")


_ROLE = ["university_recruiter", "hr", "ic_engineer", "recruiter", "unknown"]
_PRI = "CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.45 WHEN 3 THEN 0.8 ELSE 0.2 END::double"


@QUERIES("q_ranked_people", f"WITH p AS (SELECT c_custkey, c_nationkey, {_PRI} AS p, CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE (c_custkey * 7 % 100)::double / 100.0 END AS reach FROM customer), a AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p DESC, c_custkey) AS r FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p * (0.4::double + 0.6::double * reach) DESC, p DESC, c_custkey) AS s FROM a WHERE r <= 6) SELECT c_custkey FROM b WHERE s <= 3")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_nationkey AS string) AS company_slug", "c_custkey AS ord", f"{case('c_custkey', _ROLE)} AS role_category", "CASE WHEN c_custkey % 3 > 0 THEN 'a@b.io' END AS email", "cast(c_custkey * 7 % 100 AS double) AS score")
    return people.ranked(c, 3).select("c_custkey")


@QUERIES("q_person_channels", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 1 END AS backing, CASE s_suppkey % 3 WHEN 0 THEN 'github=90,x=90:verified,personal_email=60:probable' WHEN 1 THEN 'github=90' ELSE 'github=90,work_email=60:probable' END AS channels FROM supplier")
def _(spark, d):
    gh = "named_struct('kind', 'github', 'value', 'g', 'source', 'github', 'confidence', 90.0D, 'status', 'verified', 'label', cast(null as string))"
    x = "named_struct('kind', 'x', 'value', 'y', 'source', 'github_social', 'confidence', cast(null as double), 'status', 'guessed', 'label', cast(null as string))"
    s = table(spark, d, "supplier").selectExpr("s_suppkey", f"CASE WHEN s_suppkey % 3 = 0 THEN array({gh}, {x}) ELSE array({gh}) END AS c", "CASE s_suppkey % 3 WHEN 0 THEN 'me@home.net' WHEN 1 THEN 'P@acme.io' ELSE 'q@ACME.io' END AS known")
    out = people.person_channels(F.col("c"), F.col("known"), F.lit("p@acme.io"), F.lit("git_commit"), F.lit("acme.io"))
    told = F.array_join(F.transform(out, lambda c: F.concat_ws(":", F.concat(c["kind"], F.lit("="), c["confidence"].cast("int")), c["label"])), ",")
    return s.select("s_suppkey", people.corroboration(F.col("c")).alias("backing"), told.alias("channels"))


@QUERIES("q_alias_contacts", "SELECT 'f' || s_suppkey AS company_slug, a || '@f' || s_suppkey || '.com' AS email FROM supplier, (VALUES ('careers', 0), ('talent', 1)) v(a, k) WHERE s_suppkey % 3 = k")
def _(spark, d):
    s = table(spark, d, "supplier")
    published = s.selectExpr("CASE s_suppkey % 3 WHEN 0 THEN 'careers@f' WHEN 1 THEN 'talent@f' ELSE 'bob@f' END || cast(s_suppkey AS string) || '.com' AS email")
    return people.alias_contacts(s.selectExpr("'f' || cast(s_suppkey AS string) AS company_slug", "'f' || cast(s_suppkey AS string) || '.com' AS domain"), published).select("company_slug", "email")


@QUERIES("q_published_emails", "SELECT DISTINCT 'acme.com' AS domain, 'u' || (page_id % 30) || '@acme.com' AS email FROM pages")
def _(spark, d):
    p = table(spark, d, "pages").selectExpr("'<p>mail U' || cast(page_id % 30 AS string) || '@Acme.com or x@other.io</p>' AS html", "page_id")
    return people.published_emails(html.parsed(p, "page_id", "html"), F.lit("acme.com"))


@QUERIES("q_unenriched", f"WITH t AS (SELECT 'supplier-' || (doc_id % 60) AS company_slug, max(coalesce(discovery_score, 0)) AS best_score FROM jobs WHERE is_internship GROUP BY 1) SELECT company_slug FROM t WHERE company_slug NOT IN (SELECT company_slug FROM ({_FIRMS}) WHERE status = 'done') ORDER BY best_score DESC, company_slug LIMIT 10")
def _(spark, d):
    t = table(spark, d, "jobs").where("is_internship").groupBy(F.expr("'supplier-' || cast(doc_id % 60 AS string)").alias("company_slug")).agg(F.max(F.coalesce("discovery_score", F.lit(0.0))).alias("best_score"))
    return people.unenriched(t, firms(spark, d), 10).select("company_slug")


@QUERIES("q_contact_merge", "SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 4 = 0 THEN 'new title' ELSE 'old' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey || '@x.io' END AS email, c_custkey % 4 IN (0, 1, 3) AS seen FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + 1 + 4 * c_custkey, 'latest', 'fresh' || c_custkey || '@x.io', true FROM customer WHERE c_custkey % 10 = 0")
def _(spark, d):
    c = table(spark, d, "customer")
    none = {x: F.lit(None).cast("string") for x in people.CONTACT_FIELDS} | {"priority": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double")}
    slug = F.concat(F.lit("s"), F.col("c_nationkey")).alias("company_slug")
    old = c.select(F.col("c_custkey").alias("contact_id"), slug, *((none | {"title": F.lit("old"), "full_name": F.col("c_name"), "email": F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'e' || cast(c_custkey AS string) || '@x.io' END"), "linkedin_url": F.expr("CASE WHEN c_custkey % 4 = 1 THEN 'l' || cast(c_custkey AS string) END")})[x].alias(x) for x in people.CONTACT_FIELDS), F.lit(0).alias("last_seen_at"))

    def batch(where, ord_, **given):
        return c.where(where).select(F.expr(ord_).alias("ord"), slug, *((none | given)[x].alias(x) for x in people.CONTACT_FIELDS))

    new = (
        batch("c_custkey % 4 = 0", "c_custkey * 4 + 2", email=F.expr("'e' || cast(c_custkey AS string) || '@x.io'"), title=F.lit("new title"))
        .unionByName(batch("c_custkey % 4 = 1", "c_custkey * 4 + 2", linkedin_url=F.expr("'l' || cast(c_custkey AS string)"), title=F.lit("")))
        .unionByName(batch("c_custkey % 4 = 3", "c_custkey * 4 + 2", full_name=F.col("c_name"), email=F.lit("")))
        .unionByName(batch("c_custkey % 4 = 3", "c_custkey * 4 + 3", full_name=F.col("c_name")))
        .unionByName(batch("c_custkey % 10 = 0", "c_custkey * 4", email=F.expr("'fresh' || cast(c_custkey AS string) || '@x.io'"), title=F.lit("first"), linkedin_url=F.expr("'fl' || cast(c_custkey AS string)")))
        .unionByName(batch("c_custkey % 10 = 0", "c_custkey * 4 + 1", linkedin_url=F.expr("'fl' || cast(c_custkey AS string)"), title=F.lit("latest")))
    )
    return people.merge_contacts(old, new, F.lit(1)).select("contact_id", "title", "email", (F.col("last_seen_at") == 1).alias("seen"))


@QUERIES("q_company_merge", f"SELECT company_slug, CASE WHEN ord % 2 = 0 THEN 'New ' || ord ELSE name END AS name, CASE WHEN ord % 3 = 0 THEN domain WHEN ord % 2 = 0 THEN 'n.io' END AS domain FROM ({_FIRMS}) UNION ALL SELECT 'fresh-' || (ord % 4), max('New ' || ord), 'n.io' FROM ({_FIRMS}) WHERE ord % 4 = 1 GROUP BY 1")
def _(spark, d):
    f = firms(spark, d)
    new = f.where("ord % 2 = 0").selectExpr("ord", "company_slug", "'New ' || cast(ord AS string) AS name", "CASE WHEN ord % 3 = 0 THEN '' ELSE 'n.io' END AS domain").unionByName(f.where("ord % 4 = 1").selectExpr("ord", "'fresh-1' AS company_slug", "(SELECT 1) || '' AS name", "'n.io' AS domain").withColumn("name", F.concat(F.lit("New "), "ord")))
    last = new.where("company_slug = 'fresh-1'").agg(F.max("name")).first()[0]
    return people.merge_companies(f.select("company_slug", "name", "domain"), new.withColumn("name", F.when(F.col("company_slug") == "fresh-1", F.lit(last)).otherwise(F.col("name"))))


@QUERIES("q_company_signals", f"SELECT company_slug, CASE WHEN ord % 2 = 0 THEN ord END AS filings, CASE WHEN ord % 3 = 0 THEN 'v' || ord END AS kept, ord % 2 = 0 AS hiring FROM ({_FIRMS})")
def _(spark, d):
    f = firms(spark, d).withColumn("notes", F.expr("CASE WHEN ord % 3 = 0 THEN '{\"k\": \"v' || cast(ord AS string) || '\", \"n\": {\"a\": 1}}' END"))
    signals = f.where("ord % 2 = 0").selectExpr("'firm' || cast(ord AS string) AS key", "'{\"filings\":' || cast(ord AS string) || '}' AS signal")
    out = people.with_signals(f, signals)
    hiring = people.hiring_companies(out).select("company_slug", F.lit(True).alias("h"))
    return out.join(hiring, "company_slug", "left").select("company_slug", F.get_json_object("notes", "$.disclosure.filings").cast("long").alias("filings"), F.get_json_object("notes", "$.k").alias("kept"), F.coalesce("h", F.lit(False)).alias("hiring"))


# filings under their own column names
_FILED = "SELECT o_orderkey AS ord, o_custkey % 30 AS c, 'Acme ' || cast(o_custkey % 30 AS varchar(20)) || ' LLC' AS employer, CASE WHEN o_orderkey % 3 = 0 THEN '15-1252.00' ELSE '41-0000' END AS soc, CASE WHEN o_orderkey % 4 = 0 THEN 'Hr' || cast(o_custkey % 30 AS varchar(20)) || '@acme.io' WHEN o_orderkey % 4 = 1 THEN 'x@gmail.com' ELSE 'N/A' END AS email FROM orders"


def _filed(spark, d):
    return spark.sql(_FILED.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@QUERIES("q_filing_leads", f"SELECT DISTINCT ord, 'acme' || c AS company_slug, CASE WHEN ord % 4 = 0 THEN 'acme.io' END AS domain, lower(email) AS email, 'Ann Lee' AS full_name, 'HR Contact' AS title, '15-1252.00' AS soc, '2024-02-03' AS filed FROM ({_FILED}) WHERE ord % 3 = 0 AND ord % 4 < 2")
def _(spark, d):
    raw = _filed(spark, d).selectExpr("ord AS JOB_TITLE", "CASE WHEN ord % 2 = 0 THEN employer ELSE ' ' END AS EMPLOYER_NAME", "employer AS EMPLOYER_BUSINESS_DBA", "soc AS PW_SOC_CODE", "'none' AS EMPLOYER_POC_EMAIL", "email AS EMPLOYER_POINT_OF_CONTACT_EMAIL", "'Ann' AS EMPLOYER_POC_FIRST_NAME", "'Lee' AS EMPLOYER_POC_LAST_NAME", "'2024-02-03' AS DECISION_DATE")
    out = filings.filing_leads(filings.filing_columns(raw.withColumn("JOB_TITLE", F.col("JOB_TITLE").cast("string"))), ["15-"])
    return out.select(F.col("signal.job_title").cast("long").alias("ord"), "company_slug", "domain", "email", "full_name", "title", "signal.soc", F.date_format("filed_at", "yyyy-MM-dd").alias("filed"))


@QUERIES("q_filing_signals", f"SELECT 'acme' || c AS company_slug, count(*) AS filings, arg_max(employer, ord) AS name, max(CASE WHEN ord % 4 = 0 THEN 'acme.io' END) AS domain FROM ({_FILED}) WHERE ord % 3 = 0 GROUP BY 1")
def _(spark, d):
    return filings.hiring_signals(_filed(spark, d), ["15-"]).select("company_slug", "filings", "name", "domain")


@QUERIES("q_filing_ingest", f"WITH s AS (SELECT c, count(*) AS n FROM ({_FILED}) WHERE ord % 3 = 0 GROUP BY 1) SELECT 'firm-' || s_suppkey AS company_slug, n AS filings, (SELECT count(*) FROM ({_FILED}) WHERE ord % 3 = 0 AND ord % 4 < 2) AS leads FROM supplier LEFT JOIN s ON c = s_suppkey % 40")
def _(spark, d):
    companies = table(spark, d, "supplier").selectExpr("'firm-' || cast(s_suppkey AS string) AS company_slug", "'ACME ' || cast(s_suppkey % 40 AS string) || ', Inc.' AS name", "cast(null AS string) AS domain", "cast(null AS string) AS notes")
    rows = _filed(spark, d).withColumns({"first_name": F.lit("A"), "last_name": F.lit("B"), "title": F.lit(None).cast("string")})
    leads, marked = filings.ingested(rows, companies, ["15-"])
    n = leads.agg(F.count("*").alias("leads"))
    return marked.crossJoin(n).select("company_slug", F.get_json_object("notes", "$.disclosure.filings").cast("long").alias("filings"), "leads")


# dossiers
_BUNDLE = "named_struct('description', CASE WHEN k % 3 > 0 THEN 'We build rockets. We are a Series B company with 45 employees. Third.' END, 'pages', array('About us: Seed-stage team. Ships daily.'), 'facts', CASE WHEN k % 2 = 0 THEN map('team_size', '120') ELSE map() END, 'signals', CASE WHEN k % 4 > 0 THEN array(named_struct('title', 'S0', 'url', 'u0'), named_struct('title', 'S1', 'url', 'u1')) ELSE filter(array(named_struct('title', '', 'url', '')), x -> false) END)"


@QUERIES("q_synthesized", "SELECT k, CASE WHEN k % 3 > 0 THEN 'We build rockets. We are a Series B company with 45 employees.' ELSE 'About us: Seed-stage team. Ships daily.' END AS summary, CASE WHEN k % 3 > 0 THEN 'series b' ELSE 'seed' END AS stage, CASE WHEN k % 2 = 0 THEN '120' WHEN k % 3 > 0 THEN '45' END AS team_size, CASE WHEN k % 4 > 0 THEN 'S0' END AS signal FROM (SELECT s_suppkey AS k FROM supplier)")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k").withColumn("b", F.expr(_BUNDLE))
    return s.select("k", dossier.synthesized(F.col("b")).alias("s")).select("k", "s.summary", "s.stage", "s.team_size", F.col("s.signal.title").alias("signal"))


_SYNTH = ['{"summary": "A. B. C.", "stage": "Series B", "team_size": 45, "signal_index": 1, "why_fit": " because "}', '{"stage": "unicorn", "team_size": "9000", "signal_index": null}', '{"summary": 5, "signal_index": 7}']


@QUERIES("q_validated", "SELECT k, CASE WHEN k % 3 = 0 THEN 'A. B.' END AS summary, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 3 > 0 THEN 'series b' ELSE 'seed' END ELSE 'series b' END AS stage, CASE WHEN k % 2 = 0 THEN '120' WHEN k % 3 > 0 THEN '45' END AS team_size, CASE WHEN k % 4 > 0 THEN CASE k % 3 WHEN 0 THEN 'S1' WHEN 2 THEN 'S0' END END AS signal, CASE WHEN k % 3 = 0 THEN 'because' END AS why_fit FROM (SELECT s_suppkey AS k FROM supplier)")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS k", f"{case('s_suppkey', _SYNTH)} AS reply").withColumn("b", F.expr(_BUNDLE))
    return s.select("k", dossier.validated(F.col("reply"), F.col("b")).alias("s")).select("k", "s.summary", "s.stage", "s.team_size", F.col("s.signal.title").alias("signal"), "s.why_fit")


@QUERIES("q_dossier_contact", f"SELECT company_slug, arg_min((full_name, CASE WHEN email_status IN ('verified', 'probable') THEN email END, coalesce(linkedin_url, 'contacts:github')), (CASE role_category WHEN 'founder' THEN 0 WHEN 'recruiter' THEN 1 WHEN 'eng_manager' THEN 3 ELSE 5 END, -coalesce(priority, 0), contact_id)) AS b FROM ({_PEOPLE}) WHERE person_source IS NOT NULL GROUP BY 1".replace("SELECT company_slug, arg_min", "SELECT company_slug, b[1] AS name, b[2] AS email, b[3] AS source FROM (SELECT company_slug, arg_min") + ")")
def _(spark, d):
    return dossier.contact_of(bound_people(spark, d)).select("company_slug", "name", "email", "source")


@QUERIES("q_dossier_confidence", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'low' WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE s_suppkey % 3 WHEN 0 THEN 'https://b.io/x' WHEN 1 THEN 'https://acme.io/careers' ELSE 'https://api.b.io/y' END AS channel, CASE s_suppkey % 3 WHEN 0 THEN 'I fit Acme' WHEN 1 THEN 'Default for Acme' ELSE 'Second' END AS angle FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey % 5 = 0 AS thin", "CASE WHEN s_suppkey % 7 > 0 THEN 's' ELSE '' END AS summary", "CASE WHEN s_suppkey % 3 = 0 THEN 'https://b.io/x' ELSE 'https://api.b.io/y' END AS board", "CASE WHEN s_suppkey % 3 = 1 THEN 'acme.io' END AS domain", "CASE s_suppkey % 3 WHEN 0 THEN array('none', 'ai') WHEN 1 THEN array('none') ELSE array('blank', 'two', 'ai') END AS tags")
    lines = {"ai": " I fit {company}", "blank": "", "two": "Second", "default": "Default for {company} "}
    return s.select("s_suppkey", dossier.confidence(F.col("thin"), F.col("summary"), F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0).alias("confidence"), dossier.fallback_channel(F.col("board"), F.col("domain")).alias("channel"), dossier.angle(F.col("tags"), F.lit("Acme"), lines).alias("angle"))


@QUERIES("q_dossier_signals", f"SELECT 'acme-' || k AS slug, 'edgar' AS origin, strftime(to_timestamp(f) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date FROM (SELECT o_custkey % 9 AS k, arg_min({DAY0} + o_orderkey % 100 * 86400, o_orderkey) AS f FROM orders WHERE o_orderkey % 100 >= 40 GROUP BY 1) UNION ALL SELECT 'acme-' || k, 'disclosure', strftime(to_timestamp(f) AT TIME ZONE 'UTC', '%Y-%m-%d') FROM (SELECT o_custkey % 9 AS k, arg_min({DAY0} + o_orderkey % 100 * 86400, o_orderkey) AS f FROM orders WHERE o_orderkey % 100 >= 40 AND o_orderkey % 2 = 0 GROUP BY 1)")
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("'acme' || cast(o_custkey % 9 AS string) AS company_slug", "o_orderkey AS ord", f"{DAY0} + o_orderkey % 100 * 86400 AS filed_at", "'sbir' AS source")
    own = spark.range(9).selectExpr("'acme-' || cast(id AS string) AS slug", "'Acme ' || cast(id AS string) || ' Inc' AS name")
    return dossier.filed_signals(own, rows, rows.where("ord % 2 = 0"), F.lit(DAY0 + 100 * 86400), 60).select("slug", "origin", "date")


@QUERIES("q_dossier_recent", "WITH f AS (SELECT o_custkey % 20 AS slug, o_orderkey, 'u' || (o_orderkey % 50) AS url, (DATE '2024-01-01' + (o_orderkey % 90)::int)::varchar AS date FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY slug, url ORDER BY date DESC, o_orderkey) AS r FROM f WHERE date BETWEEN '2024-01-31' AND '2024-03-01') SELECT slug, url, date, row_number() OVER (PARTITION BY slug ORDER BY date DESC, o_orderkey) - 1 AS n FROM w WHERE r = 1")
def _(spark, d):
    s = table(spark, d, "orders").selectExpr("o_custkey % 20 AS slug", "o_orderkey AS ord", "'t' AS title", "'u' || cast(o_orderkey % 50 AS string) AS url", "cast(date_add(date'2024-01-01', cast(o_orderkey % 90 AS int)) AS string) AS date", "'blog' AS origin")
    return dossier.recent(s, F.to_date(F.lit("2024-03-01")), 30).select("slug", "url", "date", F.col("n").cast("long").alias("n"))


@QUERIES("q_dated_links", "SELECT page_id, 'https://h' || page_id || '.example' || CASE page_id % 4 WHEN 0 THEN '/p/' || page_id WHEN 1 THEN '/2024/03/07/x' ELSE '/news/' || page_id END AS link, CASE page_id % 4 WHEN 0 THEN '2024-02-0' || (1 + page_id % 9) WHEN 1 THEN '2024-03-07' ELSE '2024-04-05' END AS date FROM pages WHERE page_id % 4 <> 3")
def _(spark, d):
    item = """CASE page_id % 4 WHEN 0 THEN '<li><a href="/p/' || cast(page_id AS string) || '">A headline of the firm</a><time datetime="2024-02-0' || cast(1 + page_id % 9 AS string) || '">x</time></li>'
        WHEN 1 THEN '<div><a href="/2024/03/07/x">Another headline of it</a></div>' WHEN 2 THEN '<p>On Apr 5, 2024 <a href="https://h' || cast(page_id AS string) || '.example/news/' || cast(page_id AS string) || '">Words in the item date it</a></p>'
        ELSE '<p>2024-01-01 <a href="/a">Two links in one item, no</a> <a href="/b">Is this a question, maybe?</a></p>' END"""
    p = table(spark, d, "pages").selectExpr("'https://h' || cast(page_id AS string) || '.example/blog' AS url", "'blog' AS origin", f"'<nav><a href=\"/x\">Blog</a></nav>' || {item} || '<a href=\"https://else.example/2024/01/01/\">A link to another place</a>' AS html")
    return dossier.dated_links(p).select(F.regexp_extract("url", r"h(\d+)\.", 1).cast("long").alias("page_id"), "link", "date")


@QUERIES("q_page_facts", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Firm ' || page_id || ' & co' ELSE 'og' END AS description, CASE WHEN page_id % 3 = 0 THEN '42' WHEN page_id % 3 = 1 THEN '7' END AS team_size, CASE WHEN page_id % 3 = 0 THEN '1999' END AS founded FROM pages")
def _(spark, d):
    meta = """CASE WHEN page_id % 2 = 0 THEN '<meta content="Firm ' || cast(page_id AS string) || ' &amp; co" name=''description''>' ELSE '<meta name="description" content=" "><meta property="og:description" content="og">' END"""
    script = """CASE page_id % 3 WHEN 0 THEN '{"@graph": [{"@type": "Organization", "numberOfEmployees": {"value": 42}, "foundingDate": "1999"}]}' WHEN 1 THEN '{"x": {"@type": ["Corporation"], "numberOfEmployees": "7"}}' ELSE '{bad' END"""
    p = table(spark, d, "pages").selectExpr("page_id", f"{meta} || '<script type=\"application/ld+json\">' || {script} || '</script>' AS html")
    both = html.parsed(p, "page_id", "html").join(p, "page_id")
    return both.select("page_id", dossier.description(F.col("html")).alias("description"), dossier.org_facts("scripts").alias("f")).select("page_id", "description", F.col("f")["team_size"].alias("team_size"), F.col("f")["founded"].alias("founded"))


_D = "SELECT 'supplier-' || cast(s_suppkey AS varchar(20)) AS company_slug, 'Firm ' || cast(s_suppkey AS varchar(20)) AS company_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Ann Lee' END AS contact_name, CASE WHEN s_suppkey % 4 = 0 THEN 'ann@f.io' END AS contact_email, CASE WHEN s_suppkey % 3 = 0 THEN 'Raised' END AS signal_title, '2024-01-05' AS signal_date, CASE WHEN s_suppkey % 5 > 0 THEN 'They build.' END AS summary, CASE WHEN s_suppkey % 3 > 0 THEN 'I build too.' END AS why_fit FROM supplier WHERE s_suppkey < 30"


def _dossiers(spark, d):
    return spark.sql(_D.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, d, "supplier"))


_DRAFT = "'Hi ' || CASE WHEN k % 2 = 0 THEN 'Ann' ELSE 'Firm ' || k || ' team' END || ' — I just applied to your Role opening' || CASE WHEN k % 3 = 0 THEN ' — and saw the Raised news (2024-01-05)' ELSE '' END || '.' || chr(10) || CASE WHEN k % 5 > 0 AND k % 3 > 0 THEN 'I''m reaching out directly because what you''re building is squarely my lane: I build too.' || chr(10) WHEN k % 5 > 0 THEN 'I''m reaching out directly rather than waiting in the applicant pile.' || chr(10) WHEN k % 3 > 0 THEN 'The short version of why I fit: I build too.' || chr(10) ELSE '' END || 'Proof over promises: {{proof_link}} (recent shipped work).' || chr(10) || 'If it''d be useful I''d love 15 minutes — or I can send a one-page plan for what I''d ship in my first month.'"


@QUERIES("q_enriched", f"WITH a AS (SELECT a.*, k, k IS NOT NULL AS hit FROM ({_ROWS}) a LEFT JOIN (SELECT 'supplier-' || s_suppkey AS company_slug, s_suppkey AS k FROM supplier WHERE s_suppkey < 30) USING (company_slug)) SELECT id, CASE WHEN hit THEN company_slug END AS dossier_slug, CASE WHEN hit AND company IS NULL THEN 'Firm ' || k ELSE company END AS company, CASE WHEN hit AND k % 2 = 0 AND nullif(contact_name, '') IS NULL THEN 'Ann Lee' ELSE contact_name END AS contact_name, CASE WHEN hit AND k % 4 = 0 AND nullif(contact_name, '') IS NULL THEN 'ann@f.io' ELSE contact_email END AS contact_email, CASE WHEN hit AND NOT warm_intro AND outreach_draft IS NULL THEN {_DRAFT} ELSE outreach_draft END AS outreach_draft FROM a")
def _(spark, d):
    rows, own = tracked(spark, d), _dossiers(spark, d)
    hits = relational.cascade(rows.select("id", "company_slug"), [(own.select(F.col("company_slug").alias("dossier_slug")), F.col("dossier_slug") == F.col("company_slug"))], "id", "dossier_slug").select("id", "dossier_slug")
    return dossier.enriched(rows, own, hits).select("id", "dossier_slug", "company", "contact_name", "contact_email", "outreach_draft")


@QUERIES("q_dossier_markdown", "SELECT company_slug, '# Firm ' || k || ' — dossier' || chr(10) || '_built 2024-03-01 · confidence: **medium**_' || chr(10) || chr(10) || '## What they do' || chr(10) || CASE WHEN k % 5 > 0 THEN 'They build.' ELSE '_Not verified — public pages were unreachable or empty._' END || chr(10) || chr(10) || '## Stage & size' || chr(10) || '- Stage: not verified' || chr(10) || '- Team size: 12' || chr(10) || chr(10) || '## Recent signal' || chr(10) || CASE WHEN k % 3 = 0 THEN '- [Raised](u) — 2024-01-05' ELSE '- None found in the last window (checked 2024-03-01)' END || chr(10) || chr(10) || '## Likely contact' || chr(10) || CASE WHEN k % 2 = 0 THEN '**Ann Lee** — CTO' || CASE WHEN k % 4 = 0 THEN ' · ann@f.io' ELSE '' END || '  ' || chr(10) || 'source: s' ELSE 'No named person verified — do NOT guess one. Best channel: the posting itself' END || chr(10) || chr(10) || '## Why the candidate fits' || chr(10) || CASE WHEN k % 3 > 0 THEN 'I build too.' ELSE '_(no angle configured)_' END || chr(10) || chr(10) || CASE WHEN k % 2 = 1 THEN '## Notes' || chr(10) || 'n' || chr(10) || chr(10) ELSE '' END || '## Sources' || chr(10) || CASE WHEN k % 2 = 0 THEN '- u1 (page)' || chr(10) || '- u2 (blog)' ELSE '- (none fetched)' END || chr(10) AS md, '{\"company\":\"Firm ' || k || '\",\"confidence\":\"medium\",\"built_at\":\"2024-03-01\",\"contact\":' || CASE WHEN k % 2 = 0 THEN '\"Ann Lee\"' ELSE 'null' END || ',\"file\":\"supplier-' || k || '.md\"}' AS entry FROM (SELECT 'supplier-' || s_suppkey AS company_slug, s_suppkey AS k FROM supplier WHERE s_suppkey < 30)")
def _(spark, d):
    k = "cast(substring(company_slug, 10) AS int)"
    own = _dossiers(spark, d).selectExpr("*", "date'2024-03-01' AS built_on", "'medium' AS confidence", "cast(null AS string) AS stage", "'12' AS team_size", "'u' AS signal_url", "'CTO' AS contact_title", "'s' AS contact_source", "cast(null AS string) AS contact_channel", f"CASE WHEN {k} % 2 = 1 THEN 'n' END AS notes", f"CASE WHEN {k} % 2 = 0 THEN array(named_struct('url', 'u1', 'kind', cast(null AS string)), named_struct('url', 'u2', 'kind', 'blog')) END AS sources")
    return own.select("company_slug", dossier.markdown(own).alias("md")).join(dossier.index_entries(own), "company_slug")


@QUERIES("q_dossier_replace", "SELECT company_slug, CASE WHEN k % 2 = 0 THEN 'second' ELSE 'old' END AS summary FROM (SELECT 'supplier-' || s_suppkey AS company_slug, s_suppkey AS k FROM supplier)")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("'supplier-' || cast(s_suppkey AS string) AS company_slug", "s_suppkey AS k")
    old = s.selectExpr("company_slug", "0 AS built_at", "'old' AS summary")
    new = s.where("k % 2 = 0").selectExpr("company_slug", "1 AS built_at", "'first' AS summary").unionByName(s.where("k % 2 = 0").selectExpr("company_slug", "2 AS built_at", "'second' AS summary"))
    return dossier.replaced(old, new).select("company_slug", "summary")


@QUERIES("q_intro_draft", "SELECT c_custkey, 'Hi ' || CASE WHEN c_custkey % 2 = 0 THEN 'Ann' ELSE 'there' END || ' — hope you''re doing well! ' || CASE c_custkey % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Big Co' ELSE 'the company' END || ' just posted a Role role (u) and I''m planning to apply right away. Given ' || CASE WHEN c_custkey % 2 = 0 THEN 'our work' ELSE 'your connection to the team' END || ', would you be open to introducing me to someone on the team, or pointing me to the right person? Happy to send a two-line blurb and my resume to make it zero-effort. Thank you!' AS draft FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee' ELSE '' END AS name", "CASE WHEN c_custkey % 2 = 0 THEN 'our work' END AS rel", "CASE WHEN c_custkey % 3 = 0 THEN 'Acme' END AS company", "CASE WHEN c_custkey % 3 = 1 THEN 'big-co' ELSE '' END AS slug")
    return c.select("c_custkey", dossier.intro_draft(F.col("name"), F.col("rel"), F.col("company"), F.col("slug"), F.lit("Role"), F.lit("u")).alias("draft"))


# small functions and state
@QUERIES("q_people_functions", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'mastodon' WHEN 2 THEN 'github' ELSE 'site' END AS channel, 'https://a/b' AS value, s_suppkey % 2 = 0 AS same, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 70 ELSE 90 END::double AS identity, CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.2 ELSE 0.4 END::double AS priority, CASE s_suppkey % 3 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'google' END AS provider, s_suppkey % 2 = 0 AS role_account, 'One. Two!' AS two FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", f"{case('s_suppkey', ['Twitter', 'mastodon', 'x', 'generic'])} AS p", f"{case('s_suppkey', ['https://a', 'https://b', 'https://github.com/z', 'https://c'])} AS u", f"{case('s_suppkey', ['Ann Lee', 'Ann Ray'])} AS a", f"{case('s_suppkey', ['university_recruiter', 'zzz', 'hr'])} AS r", f"{case('s_suppkey', ['v=spf1 include:spf.protection.outlook.com', 'v=spf1 include:_spf.google.com', 'x'])} AS t", f"{case('s_suppkey', ['Info@x.io', 'ann@x.io'])} AS e")
    return s.select("s_suppkey", urls.channel_of(F.col("p"), F.col("u")).alias("channel"), urls.channel_value(F.lit(" HTTPS://a/B// ")).alias("value"), names.names_match(F.col("a"), F.lit("A. Lee")).alias("same"), scoring.identity_confidence(F.col("s_suppkey") % 4).alias("identity"), names.role_priority(F.col("r")).alias("priority"), urls.spf_provider(F.col("t")).alias("provider"), names.is_role_account(F.col("e")).alias("role_account"), text.two_sentences(F.lit(" One. Two! Three?")).alias("two"))


@QUERIES("q_duplicate_keys", "SELECT company_slug, trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS title_key, count(*) AS n FROM jobs GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "jobs").groupBy(*dedup.duplicate_key(F.col("company_slug"), F.col("title"))).agg(F.count("*").alias("n"))


@QUERIES("q_poll_summary", "SELECT count(*) AS polled, count(*) FILTER (o_orderkey % 7 = 0) AS failed, sum(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 11 ELSE 0 END)::bigint AS jobs, sum(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 ELSE 0 END)::bigint AS inserted FROM orders")
def _(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey % 7 <> 0 AS ok", "o_orderkey % 11 AS n_jobs", "o_orderkey % 2 AS n_internships", "o_orderkey % 3 AS n_inserted", "o_orderkey % 5 AS n_updated")
    return merge.poll_summary(p).select("polled", "failed", "jobs", "inserted")


@QUERIES("q_last_high_water", "SELECT arg_max(o_orderkey * 10, o_orderkey) AS high_water, max(o_custkey) FILTER (o_orderkey % 3 = 0) AS anchor FROM orders WHERE o_orderkey % 4 <> 1")
def _(spark, d):
    o = table(spark, d, "orders")
    runs = o.selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey % 4 = 1 THEN 'running' ELSE 'done' END AS status", "o_orderkey * 10 AS checkpoint")
    ids = o.where("o_orderkey % 4 <> 1").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN cast(o_custkey AS string) ELSE 'x' || cast(o_custkey AS string) END AS id")
    return merge.last_high_water(runs).crossJoin(merge.frontier_anchor(ids, "id"))


@QUERIES("q_board_polls", "WITH p AS (SELECT o_custkey % 60 AS b, o_orderkey, o_orderkey % 3 > 0 AS ok, o_orderkey % 5 AS n FROM orders), g AS (SELECT b, sum(CASE WHEN ok THEN n ELSE 0 END)::bigint AS seen, max(CASE WHEN ok THEN o_orderkey END) AS last_ok, max(CASE WHEN ok AND n > 0 THEN o_orderkey END) AS active FROM p GROUP BY 1), f AS (SELECT p.b, count(*) FILTER (NOT ok AND o_orderkey > coalesce(last_ok, -1)) AS fails, any_value(last_ok) AS last_ok FROM p JOIN g USING (b) GROUP BY 1) SELECT coalesce(s.b, g.b) AS token, coalesce(CASE WHEN s.b IS NOT NULL THEN 10 END, 0) + coalesce(seen, 0) AS total_jobs_seen, CASE WHEN g.b IS NULL THEN 2 WHEN f.last_ok IS NOT NULL THEN fails ELSE fails + CASE WHEN s.b IS NULL THEN 0 ELSE 2 END END AS consecutive_failures, active AS last_active FROM (SELECT DISTINCT s_suppkey % 80 AS b FROM supplier) s FULL JOIN g ON s.b = g.b LEFT JOIN f ON f.b = g.b")
def _(spark, d):
    boards = table(spark, d, "supplier").selectExpr("s_suppkey % 80 AS token").distinct().selectExpr("'lever' AS ats", "token", "10 AS total_jobs_seen", "2 AS consecutive_failures", "cast(null AS bigint) AS last_active", "'active' AS status")
    polls = table(spark, d, "orders").selectExpr("'lever' AS ats", "o_custkey % 60 AS token", "o_orderkey % 3 > 0 AS ok", "o_orderkey % 5 AS n_jobs", "o_orderkey AS at")
    return merge.board_health(boards, polls).select("token", F.col("total_jobs_seen").cast("long").alias("total_jobs_seen"), F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "last_active")


@QUERIES("q_score_merge", "SELECT job_uid, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.1 END::double AS fit_score, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 9 ELSE 7 END AS scored_at FROM jobs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, d):
    j = table(spark, d, "jobs")
    old = j.where("doc_id % 3 = 0").selectExpr("job_uid", "'h' AS input_hash", "0.1D AS fit_score", "'prefilter:a' AS model", "9 AS scored_at")
    new = j.where("doc_id % 2 = 0").selectExpr("job_uid", "'h' AS input_hash", "0.5D AS fit_score", "'prefilter:b' AS model", "7 AS scored_at")
    return merge.merge_scores(old, new).select("job_uid", "fit_score", "scored_at")


@QUERIES("q_alert_marks", f"SELECT job_uid, CASE WHEN notified_at IS NULL AND doc_id % 3 = 0 THEN {DAY0 + 5} ELSE notified_at END AS notified_at FROM jobs")
def _(spark, d):
    from quarryline.operators import targets

    j = table(spark, d, "jobs")
    return targets.mark_notified(j, j.where("doc_id % 3 = 0").select("job_uid"), F.lit(DAY0 + 5)).select("job_uid", "notified_at")


@QUERIES("q_embedding_plan", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'encode' WHEN vec_id % 7 = 0 THEN 'encode' ELSE 'cached' END AS action FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    size = len(e.select("embedding").first()[0])
    cache = e.where("vec_id % 3 > 0").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("key"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, size - 1)).otherwise(F.col("embedding")).alias("vector"))
    return dedup.embedding_plan(e.select("vec_id", F.col("vec_id").cast("string").alias("text")), cache, "text").select("vec_id", "action")


@QUERIES("q_ranked_jobs", "WITH p AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(embedding::double[], q::double[]))), 6) AS fit FROM embeddings, p ORDER BY list_cosine_similarity(embedding::double[], q::double[]) DESC, vec_id LIMIT 20")
def _(spark, d):
    e = table(spark, d, "embeddings")
    profile = e.orderBy("vec_id").select("embedding").first()[0]
    return dedup.ranked_jobs(e, [float(x) for x in profile], "embedding", "vec_id").limit(20).select("vec_id", F.round("fit", 6).alias("fit"))


@QUERIES("q_fetch_plan", f"SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'revalidate' ELSE 'fetch' END AS action FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "'u' || cast(s_suppkey AS string) AS url")
    cache = s.where("s_suppkey % 3 < 2").selectExpr("url", "'e' AS etag", "'b' AS body", "CASE WHEN s_suppkey % 3 = 0 THEN 95 ELSE 10 END AS fetched_at")
    return settings.fetch_plan(s, cache, F.lit(100), 10).join(s, "url").select("s_suppkey", "action")


@QUERIES("q_fetch_cache", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'new' ELSE 'old' END AS body, CASE s_suppkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 100 ELSE 5 END AS fetched_at FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "'u' || cast(s_suppkey AS string) AS url")
    cache = s.where("s_suppkey % 2 = 0").selectExpr("url", "'e' AS etag", "'old' AS body", "5 AS fetched_at")
    answers = s.selectExpr("url", "CASE s_suppkey % 4 WHEN 0 THEN 304 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE 404 END AS status", "'n' AS etag", "'new' AS body")
    return settings.fetched(cache, answers, F.lit(100)).join(s, "url").select("s_suppkey", "body", "fetched_at")


@QUERIES("q_robots", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 2, 3)")
def _(spark, d):
    u = table(spark, d, "supplier").selectExpr("s_suppkey", "cast(s_suppkey AS string) AS url", "CASE WHEN s_suppkey % 4 = 3 THEN 'free.io' ELSE 'h.io' END AS host", "CASE s_suppkey % 4 WHEN 0 THEN '/jobs/x' WHEN 1 THEN '/private/x' WHEN 2 THEN '/private/open/y' ELSE '/private' END AS path")
    robots = spark.createDataFrame([("h.io", "User-agent: bad\nDisallow: /\n\nUser-Agent: *\nDisallow: /private # no\nAllow: /private/open\n")], "host string, body string")
    return settings.allowed(u, robots).select("s_suppkey")


@QUERIES("q_polite_schedule", "SELECT s_suppkey, ((row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY lpad(s_suppkey::varchar, 9, '0')) - 1) // 2 * 1.5)::double AS starts FROM supplier")
def _(spark, d):
    u = table(spark, d, "supplier").selectExpr("s_suppkey", "lpad(cast(s_suppkey AS string), 9, '0') AS url", "cast(s_suppkey % 3 AS string) AS host")
    return settings.polite_schedule(u, 2, 1.5).select(F.col("url").cast("long").alias("s_suppkey"), F.col("starts").cast("double").alias("starts"))


@QUERIES("q_similar_companies", "SELECT b.vec_id, round(max(list_cosine_similarity(b.embedding::double[], a.embedding::double[])), 6) AS similarity FROM embeddings b, embeddings a WHERE b.vec_id % 2 = 0 AND b.vec_id % 37 > 0 AND a.vec_id % 37 = 0 GROUP BY 1 ORDER BY max(list_cosine_similarity(b.embedding::double[], a.embedding::double[])) DESC, 1 LIMIT 30")
def _(spark, d):
    e = table(spark, d, "embeddings")
    out = dedup.similar_companies(e, e.where("vec_id % 37 = 0"), e.where("vec_id % 2 = 0"), 30, "vec_id", "embedding")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@QUERIES("q_pending_applications", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'd' || id || '.com' END AS company_domain FROM ({_ROWS}) WHERE id % 3 > 0")
def _(spark, d):
    rows = tracked(spark, d).withColumn("dossier_slug", F.expr("CASE WHEN id % 3 = 0 THEN 'x' END"))
    jobs = rows.where("id % 4 = 0").selectExpr("job_uid", "'d' || cast(id AS string) || '.com' AS company_domain")
    return dossier.pending(rows, jobs).select("id", "company_domain")


@QUERIES("q_collapse_semantic", "WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4), r AS (SELECT vec_id AS node, vec_id AS label FROM embeddings UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node), g AS (SELECT node, min(label) AS label FROM r GROUP BY 1) SELECT arg_min(node, (CASE WHEN node % 2 = 0 THEN 0 ELSE 1 END, -node)) AS ord, arg_min(node % 3, (CASE WHEN node % 2 = 0 THEN 0 ELSE 1 END, -node)) + count(*) - 1 AS times_seen_elsewhere FROM g GROUP BY label")
def _(spark, d):
    e = table(spark, d, "embeddings")
    jobs = e.selectExpr("vec_id AS ord", "CASE WHEN vec_id % 2 = 0 THEN 'lever' ELSE 'listing' END AS ats", "-vec_id AS posted", "0 AS first_seen", "vec_id % 3 AS times_seen_elsewhere")
    return dedup.collapse_semantic(jobs, e.selectExpr("vec_id AS ord", "label AS company_slug", "embedding AS vector"), 0.4)


_PROFILE = [((i * 7) % 5 - 2) / 4.0 for i in range(64)]
_RESCORE = f"WITH v AS (SELECT vec_id, greatest(0, least(1, list_cosine_similarity(embedding::double[], list_resize({_PROFILE}::double[], len(embedding), 0.25)))) AS fit FROM embeddings), b AS (SELECT board_id, count(*) AS total FROM jobs GROUP BY 1), x AS (SELECT j.*, coalesce(fit, 0) AS fit, CASE WHEN coalesce(posted, first_seen) > {DAY0 + 200 * 86400} THEN 0.3 ELSE power(0.5, ({DAY0 + 200 * 86400} - coalesce(posted, first_seen)) / 86400.0 / 14) END AS f, 0.5 / (1.0 + seen_elsewhere) + 0.5 / (1.0 + total / 50.0) AS r FROM jobs j LEFT JOIN v ON vec_id = doc_id JOIN b USING (board_id))"


@QUERIES("q_rescored", f"{_RESCORE} SELECT job_uid, round(fit, 6) AS fit, round(f, 6) AS freshness, round(r, 6) AS rarity, round(least(1, 0.5 * fit + 0.25 * f + 0.25 * r + CASE WHEN is_internship AND doc_id % 50 % 3 = 0 THEN 0.05 ELSE 0 END), 6) AS discovery FROM x")
def _(spark, d):
    from quarryline.operators import rescore

    j, e = table(spark, d, "jobs"), table(spark, d, "embeddings")
    size = len(e.select("embedding").first()[0])
    profile = (_PROFILE + [0.25] * size)[:size]
    vectors = e.join(j.select(F.col("doc_id").alias("vec_id"), "job_uid"), "vec_id").select("job_uid", F.col("embedding").alias("vector"))
    companies = j.selectExpr("company_slug", "CASE WHEN doc_id % 50 % 3 = 0 THEN '{\"disclosure\": {\"filings\": 2}}' ELSE '{\"other\": 1}' END AS notes").distinct()
    boards = j.groupBy("board_id").agg(F.count("*").alias("total_jobs_seen"))
    out = rescore.rescored(j.withColumn("times_seen_elsewhere", F.col("seen_elsewhere")), vectors, profile, boards, companies, F.timestamp_seconds(F.lit(DAY0 + 200 * 86400)))
    return out.select("job_uid", *(F.round(c, 6).alias(c) for c in ("fit", "freshness", "rarity", "discovery")))
