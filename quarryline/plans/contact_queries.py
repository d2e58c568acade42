"""Queries of contacts, address patterns, identities, filings and source formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import classify, contacts as names, scoring, text, urls
from quarryline.operators import dedup, filings, relational
from quarryline.plans.base import Queries
from quarryline.plans.tables import case, table
from quarryline.sources import adapters, html

QUERIES = Queries()


@QUERIES("q_contact_channels", "SELECT contact_id, full_name, coalesce(string_agg(kind || '=' || value_norm, ';' ORDER BY channels.confidence DESC NULLS LAST, kind, value_norm), '') AS channels FROM contacts JOIN channels USING (contact_id) GROUP BY 1, 2")
def _(spark, d):
    own = relational.nested(table(spark, d, "channels"), ["contact_id"], ["kind", "value_norm"], F.col("confidence"), "c")
    both = table(spark, d, "contacts").join(own, "contact_id")
    return both.select("contact_id", "full_name", F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["kind"], x["value_norm"])), ";").alias("channels"))


@QUERIES("q_channels_pivot", "SELECT contact_id, coalesce(max(value_norm) FILTER (kind = 'linkedin'), '') AS linkedin, coalesce(max(value_norm) FILTER (kind = 'x'), '') AS x, coalesce(max(value_norm) FILTER (kind = 'github'), '') AS github FROM channels GROUP BY 1")
def _(spark, d):
    wide = table(spark, d, "channels").groupBy("contact_id").pivot("kind", ["linkedin", "x", "github"]).agg(F.max("value_norm"))
    return wide.select("contact_id", *(F.coalesce(k, F.lit("")).alias(k) for k in ("linkedin", "x", "github")))


_LABEL = "CASE email_label WHEN 'verified' THEN 0 WHEN 'probable' THEN 1 WHEN 'guessed' THEN 2 ELSE 3 END"


@QUERIES("q_best_contact", f"SELECT company_slug, contact_id, email FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY email IS NULL, CASE WHEN email IS NULL THEN 0 ELSE {_LABEL} END, priority DESC NULLS LAST, contact_id) AS r FROM contacts) WHERE r = 1")
def _(spark, d):
    rank = F.when(F.col("email").isNull(), 0).when(F.col("email_label") == "verified", 0).when(F.col("email_label") == "probable", 1).when(F.col("email_label") == "guessed", 2).otherwise(3)
    return relational.top_per(table(spark, d, "contacts"), ["company_slug"], [F.col("email").isNull().asc(), rank.asc(), F.desc_nulls_last("priority"), F.asc("contact_id")], 1).select("company_slug", "contact_id", "email")


@QUERIES("q_application_contact", f"SELECT id, contact_id FROM applications LEFT JOIN (SELECT company_slug, contact_id FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY {_LABEL}, priority DESC NULLS LAST, contact_id) AS r FROM contacts WHERE email IS NOT NULL) WHERE r = 1) USING (company_slug)")
def _(spark, d):
    rank = F.when(F.col("email_label") == "verified", 0).when(F.col("email_label") == "probable", 1).when(F.col("email_label") == "guessed", 2).otherwise(3)
    best = relational.top_per(table(spark, d, "contacts").where("email IS NOT NULL"), ["company_slug"], [rank.asc(), F.desc_nulls_last("priority"), F.asc("contact_id")], 1)
    return table(spark, d, "applications").join(best.select("company_slug", "contact_id"), "company_slug", "left").select("id", "contact_id")


@QUERIES("q_contacts_filter", "SELECT contact_id FROM contacts WHERE company_slug ILIKE '%supplier-1%' AND email IS NOT NULL AND email_label = 'verified' ORDER BY company_slug, priority DESC NULLS LAST, confidence DESC NULLS LAST, contact_id LIMIT 500")
def _(spark, d):
    c = table(spark, d, "contacts").where(F.col("company_slug").ilike("%supplier-1%") & F.col("email").isNotNull() & (F.col("email_label") == "verified"))
    return c.orderBy("company_slug", F.desc_nulls_last("priority"), F.desc_nulls_last("confidence"), "contact_id").limit(500).select("contact_id")


@QUERIES("q_dossier_cascade", "SELECT c_custkey, coalesce(CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c_custkey) THEN c_custkey END, (SELECT min(s_suppkey) FROM supplier s WHERE s.s_nationkey = c_nationkey AND s.s_suppkey % 10 = c_custkey % 10), (SELECT min(s_suppkey) FROM supplier s WHERE s.s_nationkey = c_nationkey)) AS hit FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hit"), "s_nationkey")
    return relational.cascade(c, [(s, F.col("hit") == F.col("c_custkey")), (s, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("hit") % 10 == F.col("c_custkey") % 10)), (s, F.col("s_nationkey") == F.col("c_nationkey"))], "c_custkey", "hit").select("c_custkey", "hit")


_FACTS = {x: f"(l_orderkey * {3 + i} + l_linenumber) % {2 + i % 5} = 0" for i, x in enumerate(scoring.EMAIL_FACTS)}
_FACTS["smtp_rejected"] = "l_orderkey % 11 = 0"
_FACTS["mx_present"] = "l_orderkey % 13 <> 0"
_P = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
_SOURCED = "(scraped OR github OR disclosure)"
_EMAIL = (
    "f AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"({v}) AS {k}" for k, v in _FACTS.items()) + ", (l_orderkey % 5)::int AS votes, (l_linenumber % 5)::int AS channels, CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS catch_all FROM lineitem), "
    f"a AS (SELECT *, {_P('scraped', 70)} + {_P('github', 65)} + {_P('disclosure', 65)} + CASE WHEN votes >= 3 THEN 50 WHEN votes = 2 THEN 38 WHEN votes = 1 THEN 15 WHEN prior_only THEN 10 ELSE 0 END + {_P('github_account', 22)} + {_P('gravatar', 20)} + {_P('holehe', 18)} + {_P('smtp_valid AND coalesce(NOT catch_all, false)', 25)} + {_P('pgp', 22)} + {_P('spf_dmarc', 5)} + {_P('mailbox', 45)} AS s FROM f), "
    f"b AS (SELECT * REPLACE (greatest(s, {_P(f'mailbox AND (votes >= 1 OR {_SOURCED})', 85)}, {_P('mailbox AND identity', 88)}, {_P(f'pgp AND (votes >= 2 OR {_SOURCED})', 85)}, {_P('locked', 55)}) AS s) FROM a), "
    f"c AS (SELECT *, s + CASE WHEN cross_channel THEN least(15, 5 * channels) ELSE 0 END - {_P('role_account', 10)} AS t, coalesce(catch_all, false) AND NOT mailbox AS capped FROM b), "
    f"e AS (SELECT *, CASE WHEN smtp_rejected OR NOT mx_present THEN 0 ELSE greatest(0, least(CASE WHEN capped THEN 60 ELSE 100 END, t - {_P('capped', 15)})) END AS u FROM c)"
)


@QUERIES("q_email_score", f"WITH {_EMAIL} SELECT l_orderkey, l_linenumber, u::double AS score, CASE WHEN smtp_rejected OR NOT mx_present THEN 'invalid' WHEN u >= 85 THEN 'verified' WHEN u >= 55 THEN 'probable' ELSE 'guessed' END AS label FROM e")
def _(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"({v}) AS {k}" for k, v in _FACTS.items()), "cast(l_orderkey % 5 AS int) AS votes", "cast(l_linenumber % 5 AS int) AS channels", "CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS catch_all")
    facts = F.struct(*scoring.EMAIL_FACTS, "votes", "channels", "catch_all").alias("f")
    return li.select("l_orderkey", "l_linenumber", facts).select("l_orderkey", "l_linenumber", scoring.email_confidence(F.col("f")).alias("r")).select("l_orderkey", "l_linenumber", "r.score", "r.label")


_BASE = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.CHANNEL_BASE.items()) + " ELSE 50 END"


@QUERIES("q_channel_score", f"SELECT contact_id, kind, s::double AS score, CASE WHEN s >= 85 THEN 'verified' WHEN s >= 55 THEN 'probable' ELSE 'guessed' END AS label FROM (SELECT contact_id, kind, least(100, {_BASE} + least(15, 5 * (contact_id % 5))) AS s FROM channels)")
def _(spark, d):
    return table(spark, d, "channels").select("contact_id", "kind", scoring.channel(F.col("source"), F.col("contact_id") % 5).alias("r")).select("contact_id", "kind", "r.score", "r.label")


FIRST, LAST = ["Ana", "Bob", "Zoë", "Carl"], ["Silva", "Stone", "Núñez", "Ray"]
FIRST_BARE, LAST_BARE = ["ana", "bob", "zoe", "carl"], ["silva", "stone", "nunez", "ray"]
_PARTS = f"{case('c_custkey', FIRST_BARE)} AS a, {case('c_custkey // 4', LAST_BARE)} AS b"
_RENDER = {"{first}.{last}": "a || '.' || b", "{f}{last}": "a[1] || b", "{first}{last}": "a || b", "{first}": "a", "{first}_{last}": "a || '_' || b", "{first}-{last}": "a || '-' || b", "{f}.{last}": "a[1] || '.' || b", "{first}{l}": "a || b[1]", "{last}.{first}": "b || '.' || a", "{last}{first}": "b || a", "{f}{l}": "a[1] || b[1]", "{last}": "b", "{last}.{f}": "b || '.' || a[1]", "{f}_{last}": "a[1] || '_' || b"}
_NAME = f"{case('c_custkey', FIRST)} || ' ' || {case('cast(floor(c_custkey / 4) AS int)', LAST)}"


@QUERIES("q_permutations", f"SELECT c_custkey, array_to_string([{', '.join(_RENDER[t] for t in names.TEMPLATES)}], ',') AS locals FROM (SELECT c_custkey, {_PARTS} FROM customer)")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", f"{_NAME} AS name").select("c_custkey", names.split_name(F.col("name")).alias("n"))
    return c.select("c_custkey", F.array_join(names.local_parts(F.col("n.first"), F.col("n.last")), ",").alias("locals"))


_WHICH = ["{first}.{last}", "{f}{last}", "{first}.{last}", "{first}", "{last}.{f}"]
_LOCAL = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN {_RENDER[t]}" for i, t in enumerate(_WHICH)) + " END"


def _pairs(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", f"{_NAME} AS name", f"{case('c_custkey', _WHICH)} AS t").select("*", names.split_name(F.col("name")).alias("n"))
    return c.withColumn("local", names.rendered(F.col("t"), names.name_token(F.col("n.first")), names.name_token(F.col("n.last"))))


_VOTES = "v AS (SELECT c_nationkey, c_custkey, t.t, t.o FROM (SELECT c_custkey, c_nationkey, " + _PARTS + " FROM customer) c, LATERAL (VALUES " + ", ".join(f"('{t}', {i}, {_RENDER[t]})" for i, t in enumerate(names.TEMPLATES)) + f") t(t, o, r) WHERE t.r = {_LOCAL})"


@QUERIES("q_email_pattern_votes", f"WITH {_VOTES} SELECT c_nationkey, t AS template, n AS votes FROM (SELECT c_nationkey, t, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey), min(o)) AS r FROM v GROUP BY 1, 2) WHERE r = 1")
def _(spark, d):
    hit = _pairs(spark, d).select("c_nationkey", "c_custkey", F.posexplode(names.matching_templates(F.col("n.first"), F.col("n.last"), F.col("local"))).alias("o", "template"))
    votes = hit.groupBy("c_nationkey", "template").agg(F.count("*").alias("votes"), F.min("c_custkey").alias("first"), F.min("o").alias("o"))
    return votes.groupBy("c_nationkey").agg(F.max_by(F.struct("template", "votes"), F.struct("votes", (-F.col("first")).alias("f"), (-F.col("o")).alias("o"))).alias("r")).select("c_nationkey", "r.template", "r.votes")


@QUERIES("q_pattern_lock", f"WITH {_VOTES}, one AS (SELECT c_nationkey, c_custkey, min(t) AS t FROM v GROUP BY 1, 2 HAVING count(*) = 1) SELECT c_nationkey, arg_min(t, c_custkey) AS template FROM one GROUP BY 1")
def _(spark, d):
    m = _pairs(spark, d).select("c_nationkey", "c_custkey", names.matching_templates(F.col("n.first"), F.col("n.last"), F.col("local")).alias("m")).where(F.size("m") == 1)
    return m.groupBy("c_nationkey").agg(F.min_by(F.col("m")[0], "c_custkey").alias("template"))


_MX = ["x.mail.protection.outlook.com", "aspmx.l.google.com", "mx.other.net", ""]
_BANDS = ["tiny", "mid", "large", ""]


@QUERIES("q_default_template", "WITH b AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'microsoft' WHEN 1 THEN 'google' WHEN 2 THEN 'other' ELSE 'unknown' END AS provider, CASE WHEN n <= 0 THEN NULL WHEN n < 3 THEN 'tiny' WHEN n < 15 THEN 'mid' ELSE 'large' END AS band FROM (SELECT s_suppkey, s_suppkey % 23 AS n FROM supplier)) SELECT s_suppkey, provider, CASE WHEN provider = 'microsoft' THEN '{first}.{last}' WHEN band = 'tiny' THEN '{first}' WHEN band = 'mid' THEN '{f}{last}' ELSE '{first}.{last}' END AS template, CASE band WHEN 'tiny' THEN 0.3 WHEN 'mid' THEN 0.4 ELSE 0.45 END::double AS prior FROM b")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", f"{case('s_suppkey', _MX)} AS mx", "s_suppkey % 23 AS n").select("s_suppkey", urls.mail_provider(F.col("mx")).alias("provider"), names.headcount_band(F.col("n")).alias("band"))
    return s.select("s_suppkey", "provider", names.default_template(F.col("band"), F.col("provider")).alias("template"), names.prior_confidence(F.col("band")).alias("prior"))


_SAME = "(a.gh IS NULL OR b.gh IS NULL OR a.gh = b.gh) AND (a.li IS NULL OR b.li IS NULL OR a.li = b.li) AND (a.gh = b.gh OR a.li = b.li OR (a.name = b.name AND coalesce(a.gh, a.li, b.gh, b.li) IS NOT NULL))"


@QUERIES("q_identity_merge", f"WITH RECURSIVE p AS (SELECT c_nationkey AS f, c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 200 END AS gh, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 150 END AS li, c_custkey % 97 AS name FROM customer), e AS (SELECT a.ord AS a, b.ord AS b FROM p a JOIN p b ON a.f = b.f AND a.ord <> b.ord WHERE {_SAME}), r AS (SELECT ord AS node, ord AS label FROM p UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node) SELECT node AS ord, min(label) AS leader FROM r GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "customer").select((F.col("c_nationkey")).cast("string").alias("company_slug"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("g"), F.col("c_custkey") % 200)).alias("gh"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("l"), F.col("c_custkey") % 150)).alias("li"), F.lit(None).cast("string").alias("em"), F.concat(F.lit("n"), F.col("c_custkey") % 97).alias("name"), F.array().cast("array<string>").alias("verified"))
    return dedup.merge_people(p)


@QUERIES("q_hiring_signal", "SELECT o_custkey, count(*) AS filings, arg_max(o_orderpriority, o_orderkey) AS soc FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").where(names.is_tech_occupation(F.col("o_orderpriority"), ["1", "2"]))
    return o.groupBy("o_custkey").agg(F.count("*").alias("filings"), F.max_by("o_orderpriority", "o_orderkey").alias("soc"))


_RAW = ["N/A", " ops@acme.io ", "none", "x@gmail.com", "bad", "#n/a"]
_MAIL = ["", "ops@acme.io", "", "x@gmail.com", "", ""]
_DOM = ["", "acme.io", "", "", "", ""]


@QUERIES("q_disclosure_leads", f"SELECT o_orderkey, nullif({case('o_orderkey', _MAIL)}, '') AS email, nullif({case('o_orderkey', _DOM)}, '') AS domain, CASE o_orderkey % 6 WHEN 1 THEN 'ops@acme.io' WHEN 3 THEN 'x@gmail.com' WHEN 4 THEN 'bad' ELSE 'fallback' END AS picked FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", f"{case('o_orderkey', _RAW)} AS v")
    return o.select("o_orderkey", names.valid_email(F.col("v")).alias("email"), names.email_domain(F.col("v")).alias("domain"), names.picked(F.col("v"), F.lit("fallback")).alias("picked"))


@QUERIES("q_award_leads", "SELECT 'acme' || (c_custkey % 5) AS company_slug, 'Acme ' || (c_custkey % 5) || ' LLC' AS company_name, CASE WHEN c_custkey % 2 = 0 THEN 'acme.com' WHEN r = 'hr' AND c_custkey % 3 = 0 THEN 'mail.acme.io' END AS domain, CASE WHEN r = 'hr' THEN NULL ELSE c_name END AS full_name, CASE WHEN r = 'hr' THEN 'Company Contact' ELSE 'Principal Investigator' END AS title, CASE WHEN r = 'hr' THEN 'p' || c_custkey || '@mail.acme.io' END AS email, r AS role_hint FROM customer, (VALUES ('hr'), ('hiring_manager')) v(r) WHERE CASE WHEN r = 'hr' THEN c_custkey % 3 = 0 ELSE c_custkey % 4 = 0 END")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "'Acme ' || cast(c_custkey % 5 AS string) || ' LLC' AS firm", "CASE WHEN c_custkey % 2 = 0 THEN 'https://www.acme.com:8080/x' ELSE 'n/a' END AS company_url", "'-' AS poc_name", "'none' AS poc_title", "CASE WHEN c_custkey % 3 = 0 THEN 'P' || cast(c_custkey AS string) || '@mail.acme.io' ELSE 'bad' END AS poc_email",
        "CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'NaN' END AS pi_name", "cast(null AS string) AS pi_title", "cast(null AS string) AS pi_email",
    )
    return filings.award_leads(c)


@QUERIES("q_logged_hosts", "SELECT DISTINCT h || '.example.org' AS host FROM (SELECT 's' || (s_suppkey % 30) AS h FROM supplier UNION ALL SELECT 't' || (s_suppkey % 20) FROM supplier)")
def _(spark, d):
    names = table(spark, d, "supplier").selectExpr(r"'*.S' || cast(s_suppkey % 30 AS string) || '.example.org\nt' || cast(s_suppkey % 20 AS string) || '.Example.org\nexample.org\nother.net' AS v")
    return filings.logged_hosts(names, "v", "example.org")


_REPLIES = ['{"a": 1} then {"verdict": "ok"}', "none", '{bad', 'x {"verdict": "spam", "n": {"k": "}"}}']
_VERDICTS = ["ok", "", "", "spam"]


@QUERIES("q_reply_json", f"SELECT conv_id, turn, nullif({case('turn', _VERDICTS)}, '') AS verdict FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{case('turn', _REPLIES)} AS reply")
    return c.select("conv_id", "turn", F.get_json_object(html.last_json_object("reply"), "$.verdict").alias("verdict"))


_DENY = ["acme.com", "www.github.com", "jobs.lever.co", "greenhouse.io", "", "my.x.com", "ax.com"]


@QUERIES("q_company_domain", "SELECT s_suppkey, s_suppkey % 7 IN (0, 6) AS own, array_to_string(list_transform(['.com', '.io', '.ai', '.co'], lambda t: 'acme' || (s_suppkey % 5) || t), ',') AS candidates FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", f"{case('s_suppkey', _DENY)} AS v", "'Acme ' || cast(s_suppkey % 5 AS string) AS name", "'acme-' || cast(s_suppkey % 5 AS string) AS slug")
    return s.select("s_suppkey", urls.is_company_domain(F.col("v")).alias("own"), F.array_join(names.candidate_domains(F.col("name"), F.col("slug")), ",").alias("candidates"))


@QUERIES("q_html_titles", "SELECT page_id, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) > 0 AS titled, (length(html) - length(replace(html, '<a href=', ''))) // 8 AS anchors FROM pages")
def _(spark, d):
    p = html.parsed(table(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    return p.select("page_id", (F.length("title") > 0).alias("titled"), F.size("links").cast("long").alias("anchors"))


@QUERIES("q_html_text")
def _(spark, d):
    return html.parsed(table(spark, d, "pages").select("page_id", "html"), "page_id", "html").select("page_id", F.sha1("text").alias("text_sha1"), F.length("text").alias("n"))


for _ats in adapters.SPECS:

    @QUERIES(f"q_adapter_{_ats}", adapters.sample_sql(_ats))
    def _(spark, d, ats=_ats):
        raw = adapters.sample_payloads(table(spark, d, "part"), ats)
        return adapters.normalized(raw, ats).select("token", "source_job_id", "title", "location_raw", "url", "job_uid", "url_hash", "company", "company_slug", "title_normalized", "city", "ats", "is_internship", "is_remote", "description_text")
