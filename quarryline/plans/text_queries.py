"""Queries of the scalar library: names, places, dates, urls, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import classify, scoring, text, urls
from quarryline.plans.base import Queries
from quarryline.plans.tables import DAY0, case, table

QUERIES = Queries()
NAMES = ["Acme, Inc.", "The Foo-Bar Group", "Labs Inc", "  Quux GmbH & Co ", "Élan Technologies", "ACME LLC", "x"]
DATES = ["2024-02-03", "3/4/2025", "March 3, 2026", "1st Dec 2024", "1704067200", "1704067200000", "2024-05-06T07:08:09Z", "soon", "", "Sept 9, 2025"]
URLS = [
    "https://boards.greenhouse.io/acme/jobs/1", "https://boards.greenhouse.io/embed/job_board?for=foo", "https://jobs.lever.co/bar-co/123", "https://api.lever.co/v0/postings/zed", "https://jobs.ashbyhq.com/Qux", "https://api.ashbyhq.com/posting-api/job-board/quux",
    "https://apply.workable.com/corge/j/X/", "https://grault.workable.com", "https://careers.smartrecruiters.com/Garply", "https://waldo.wd5.myworkdayjobs.com/en-US/External/job/1", "jobs.jobvite.com/careers/fred/jobs", "https://recruiting.paylocity.com/plugh",
    "https://xyzzy.recruitee.com/o/dev", "https://a.b.thud.bamboohr.com/jobs", "https://api.teamtailor.com/v1", "https://example.com/careers", "", "https://www.linkedin.com/in/a", "https://x.com/b", "https://gist.github.com/c", "https://hachyderm.io/@d", "https://bsky.app/profile/e",
]


@QUERIES("q_normalize_title", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_type || ' ' || p_name || '  (#1)')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_key(F.concat_ws(" ", "p_type", F.concat("p_name", F.lit("  (#1)")))).alias("key"))


_SLUG = "trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-')"
_CORP = ", ".join(f"'{w}'" for w in text.CORPORATE_WORDS)


@QUERIES("q_company_slugs", f"SELECT s_suppkey, {_SLUG} AS slug, array_to_string(list_filter(string_split({_SLUG}, '-'), lambda w: w <> '' AND NOT list_contains([{_CORP}], w)), '') AS canonical FROM (SELECT s_suppkey, {case('s_suppkey', NAMES)} || ' ' || s_name AS name FROM supplier)")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", f"{case('s_suppkey', NAMES)} || ' ' || s_name AS name")
    return s.select("s_suppkey", text.company_slug(F.col("name")).alias("slug"), text.canonical_company(F.col("name")).alias("canonical"))


_V = "nullif(trim(regexp_replace(location_raw, '\\s+', ' ', 'g')), '')"


@QUERIES("q_normalize_location", f"WITH v AS (SELECT job_uid, {_V} AS v, list_filter(list_transform(regexp_split_to_array({_V}, '[,/|]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM jobs), w AS (SELECT *, coalesce(regexp_matches(v, '{text.REMOTE[4:]}', 'i'), false) AS r, coalesce(regexp_matches(v, '{text.HYBRID[4:]}', 'i'), false) AS h FROM v) SELECT job_uid, p[1] AS city, p[2] AS region, p[3] AS country, v AS normalized, r AS is_remote, CASE WHEN r AND h THEN 'hybrid' WHEN r AND regexp_matches(v, '{text.REMOTE_ANYWHERE[4:]}', 'i') THEN 'remote_anywhere' WHEN r THEN 'fully_remote' WHEN h THEN 'hybrid' END AS remote_scope FROM w")
def _(spark, d):
    return table(spark, d, "jobs").select("job_uid", text.location(F.col("location_raw")).alias("l")).select("job_uid", "l.*")


_EPOCHS = ["1706918400", "1741046400", "1772496000", "1733011200", "1704067200", "1704067200", "1714979289", "", "", "1757376000"]


@QUERIES("q_parse_datetime", f"SELECT doc_id, nullif({case('doc_id', _EPOCHS)}, '')::bigint AS at FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{case('doc_id', DATES)} AS v")
    return docs.select("doc_id", F.unix_seconds(text.parsed_time(F.col("v"))).alias("at"))


_TEXTS = ["Apply by March 3, 2026. Thanks", "Deadline: 2025-01-31", "closing date 5th May", "deadline is soon", "No date here", "applications close on 12/24/2025!"]
_WHEN = ["1772496000", "1738281600", "1714867200", "", "", "1766534400"]


@QUERIES("q_deadline", f"SELECT doc_id, nullif({case('doc_id', _WHEN)}, '')::bigint AS at FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{case('doc_id', _TEXTS)} AS v")
    return docs.select("doc_id", F.unix_seconds(text.deadline(F.col("v"), F.timestamp_seconds(F.lit(DAY0)))).alias("at"))


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_C = "(title || chr(10) || description_text)"
_IS = f"CASE WHEN {_m('title', classify.STRONG_TITLE)} THEN true WHEN {_m('title', classify.INTERNSHIP)} THEN NOT {_m('title', classify.SENIOR)} ELSE {_m('description_text', classify.STRONG_TEXT)} AND NOT {_m('title', classify.SENIOR)} END"
_KIND = "CASE " + " ".join(f"WHEN {_m('title', p)} THEN '{n}'" for n, p in classify.KINDS) + " " + " ".join(f"WHEN {_m(_C, p)} THEN '{n}'" for n, p in classify.KINDS) + " END"


@QUERIES("q_classify_internship", f"SELECT job_uid, {_IS} AS is_intern, CASE WHEN {_IS} THEN {_KIND} END AS kind, concat_ws(',', " + ", ".join(f"CASE WHEN {_m(_C, p)} THEN '{n}' END" for n, p in classify.LEVEL_TAGS) + f") AS tags, {_m('title', classify.EARLY_TITLE)} AS early FROM jobs")
def _(spark, d):
    t, x = F.col("title"), F.col("description_text")
    both = table(spark, d, "jobs").select("job_uid", classify.classified(t, x).alias("c"), classify.is_early_title(t).alias("early"))
    return both.select("job_uid", F.col("c.is_internship").alias("is_intern"), "c.kind", F.array_join("c.tags", ",").alias("tags"), "early")


_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{n}')" for n in needles) + f" THEN '{name}'" for needles, name in classify.ROLES) + " ELSE 'other' END"


@QUERIES("q_role_classify", f"SELECT job_uid, {_ROLE} AS role FROM (SELECT job_uid, ' ' || lower(title) || ' ' AS low FROM jobs)")
def _(spark, d):
    return table(spark, d, "jobs").select("job_uid", classify.role(F.col("title")).alias("role"))


_BOARDS = ["greenhouse:acme", "greenhouse:foo", "lever:bar-co", "", "ashby:Qux", "ashby:quux", "workable:corge", "workable:grault", "smartrecruiters:Garply", "workday:waldo", "jobvite:fred", "paylocity:plugh", "recruitee:xyzzy", "bamboohr:thud", "", "", "", "", "", "", "", ""]
# api.lever.co/v0/postings/zed: the token would be the third path word
_BOARDS[3] = "lever:zed"
_CHANNELS = ["site"] * 17 + ["linkedin", "x", "github", "mastodon", "bluesky"]
_SITES = ["waldo/External" if "myworkdayjobs" in u else "" for u in URLS]


@QUERIES("q_url_fingerprint", f"SELECT doc_id, nullif(split_part({case('doc_id', _BOARDS)}, ':', 1), '') AS ats, nullif(split_part({case('doc_id', _BOARDS)}, ':', 2), '') AS token, {case('doc_id', _CHANNELS)} AS channel, nullif({case('doc_id', _SITES)}, '') AS site FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{case('doc_id', URLS)} AS u")
    u = F.col("u")
    return docs.select("doc_id", urls.board(u).alias("b"), urls.channel_kind(u).alias("channel"), urls.workday_site(u).alias("site")).select("doc_id", "b.ats", "b.token", "channel", "site")


@QUERIES("q_page_hosts", "SELECT lower(regexp_extract(url, '^[^/?#]*//([^/?#]*)', 1)) AS host, count(*) AS n, count(*) FILTER (regexp_matches(url, '^[^?#]*\\?(?:[^#]*&)?utm_source=')) AS tagged FROM pages GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), urls.query_value(F.col("url"), "utm_source").alias("tag"))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.count("tag").alias("tagged"))


@QUERIES("q_extract_emails", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){0,8}\\.[A-Za-z]{2,24}'), lambda e: lower(e)))), ',') AS emails FROM documents WHERE contains(text, '@')")
def _(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.array_join(text.emails(F.col("text")), ",").alias("emails"))


@QUERIES("q_all_urls", """SELECT job_uid, array_to_string(list_transform(regexp_extract_all(description_text, 'https?://[^\\s<>"'')]+', 0, 'i'), lambda u: regexp_replace(u, '[.,);]+$', '')), ' ') AS urls FROM jobs WHERE contains(description_text, '://')""")
def _(spark, d):
    return table(spark, d, "jobs").where(F.contains("description_text", F.lit("://"))).select("job_uid", F.array_join(text.all_urls(F.col("description_text")), " ").alias("urls"))


_SAYS = ["Acme Corp. is hiring interns", "We look for people at Foo & Bar, Inc today", "Zed hiring now", "nobody"]
_WHO = ["Acme Corp. is", "Foo & Bar", "Zed", ""]  # the words before "hiring", taken as they are


@QUERIES("q_social_posts", f"SELECT doc_id, nullif({case('doc_id', _WHO)}, '') AS company, substr({case('doc_id', _SAYS)}, 1, 140) AS title FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", rf"'  \n ' || {case('doc_id', _SAYS)} || '\nmore' AS v")
    return docs.select("doc_id", text.hiring_company(text.strip(F.col("v"))).alias("company"), text.title_line(F.col("v")).alias("title"))


@QUERIES("q_identities", "SELECT doc_id, sha1(trim(url)) AS url_hash, sha1('listing|board|' || CASE WHEN doc_id % 2 = 0 THEN doc_id::varchar ELSE '' END || '|' || url) AS uid, sha1(trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || chr(10) || substr(description_text, 1, 2000)) AS fingerprint FROM jobs")
def _(spark, d):
    source = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return table(spark, d, "jobs").select("doc_id", text.url_hash(F.concat(F.lit(" "), "url", F.lit("\n"))).alias("url_hash"), text.posting_uid(F.lit("listing"), F.lit("board"), source, F.col("url")).alias("uid"), text.content_fingerprint(text.title_key(F.col("title")), F.col("description_text")).alias("fingerprint"))


@QUERIES("q_age_text", f"SELECT doc_id, CASE WHEN m < 0 THEN 'just posted' WHEN m < 60 THEN 'posted ' || m || 'm ago' WHEN m < 2880 THEN 'posted ' || (m // 60) || 'h ago' ELSE 'posted ' || (m // 1440) || 'd ago' END AS age FROM (SELECT doc_id, (doc_id * 7 - 50) AS m FROM documents)")
def _(spark, d):
    at = F.timestamp_seconds(F.lit(DAY0) - (F.col("doc_id") * 7 - 50) * 60)
    return table(spark, d, "documents").select("doc_id", scoring.age_text(at, F.timestamp_seconds(F.lit(DAY0))).alias("age"))


@QUERIES("q_judged_value", "SELECT conv_id, turn, round(sqrt(least(100, (conv_id * 7) % 140) * least(100, (turn * 31) % 140)))::bigint AS value FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", scoring.judged_value((F.col("conv_id") * 7 % 140).cast("string"), F.col("turn") * 31 % 140).alias("value"))
