"""The engine's tables bound to the test tables. Each binding is SQL that Spark and DuckDB both read, so queries and their SQL start alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLES = [
    "Software Engineering Intern", "Senior Backend Engineer", "Data Science Internship (Summer 2026)", "Co-op Developer", "New Grad Software Engineer", "Campus Recruiter",
    "Engineering Manager", "Summer Analyst - PhD", "Staff Site Reliability Engineer II", "Apprentice Electrician, part-time", "Early Career Program Lead", "University Recruiter",
    "Founding Engineer", "Technical Sourcer", "Working Student (remote)", "People Ops Partner",
]
PLACES = ["Austin, TX, US", "Remote", "Hybrid, Berlin", "Remote / Hybrid", "Remote - Anywhere", "  ", "London | UK", "Paris"]
PHRASES = [
    "", " We act on behalf of our client.", " Commission only, be your own boss.", " Write to hr.team@gmail.com today.", " Join our talent community.", " You need 5+ years of experience.",
    " Applications are reviewed as they come, no deadline.", " This is an internship position. Message us on whatsapp only.", " Apply by March 3, 2026.", " See https://boards.greenhouse.io/acme and mail jobs@acme.com.",
]
SYSTEMS = ["greenhouse", "lever", "listing", "ashby", "remotive", "workable", "pinpoint"]


def case(key: str, values: list[str]) -> str:
    """A CASE that picks a text by a number modulo the list's length."""
    quoted = " ".join(f"WHEN {i} THEN '" + v.replace("'", "''") + "'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {quoted} END"


DAY0 = 1704067200  # 2024-01-01 in seconds
JOBS = f"""
SELECT doc_id, doc_id AS ord, sha1('doc|' || cast(doc_id AS varchar(20))) AS job_uid, {case('doc_id', SYSTEMS)} AS ats, 'Company ' || cast(doc_id % 50 AS varchar(20)) || ' Inc' AS company,
    'company-' || cast(doc_id % 50 AS varchar(20)) || '-inc' AS company_slug, 'www.company' || cast(doc_id % 50 AS varchar(20)) || '.com' AS company_domain, {case('doc_id', TITLES)} AS title,
    {case('doc_id', PLACES)} AS location_raw, nullif(trim({case('doc_id', PLACES)}), '') AS location_normalized, doc_id % 3 = 0 AS is_remote, doc_id % 16 IN (0, 2, 3, 4, 7, 9, 14) AS is_internship,
    text || {case('doc_id', PHRASES)} AS description_text, doc_id % 20 AS board_id, 'https://jobs.example.com/' || cast(doc_id AS varchar(20)) AS url,
    CASE WHEN doc_id % 17 <> 0 THEN {DAY0} + (doc_id % 365) * 86400 END AS posted, {DAY0} + (doc_id % 300) * 86400 + 3600 AS first_seen, {DAY0} + (doc_id % 300) * 86400 + (doc_id % 90) * 90000 AS last_seen,
    CASE WHEN doc_id % 4 <> 1 THEN {DAY0} + (doc_id % 200) * 86400 END AS deadline, CASE WHEN doc_id % 11 <> 0 THEN cast(doc_id * 7919 % 1000 AS double) / 1000 END AS discovery_score,
    cast(doc_id * 31 % 101 AS double) AS quality_score, {case('doc_id', ['spam', 'ok', 'ghost', 'unclear', 'agency', 'mlm', 'none'])} AS verdict_, doc_id % 5 AS five,
    CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 6 THEN NULL ELSE {case('doc_id', ['spam', 'ok', 'ghost', 'unclear', 'agency', 'mlm', 'none'])} END AS quality_verdict,
    CASE WHEN doc_id % 5 <> 4 THEN cast(doc_id * 13 % 101 AS double) END AS quality_confidence, CASE WHEN doc_id % 6 = 5 THEN {DAY0} END AS notified_at, cast(doc_id % 4 AS int) AS seen_elsewhere
FROM documents"""
SCORES = """
SELECT doc_id * 3 + k AS score_id, sha1('doc|' || cast(doc_id AS varchar(20))) AS job_uid, CASE WHEN k = 2 THEN 'prefilter:x' ELSE 'llm:x' END AS model, cast((doc_id * 37 + k * 50) % 101 AS double) AS fit_score,
    1704067200 + (doc_id * 11 + k * 977) % 5000 AS scored_at FROM labels CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n"""
STAGES = ["To Apply", "Applied", "Referral Requested", "Interviewing", "Offer", "Rejected"]
APPLICATIONS = f"""
SELECT o_orderkey AS id, 'job-' || cast(o_orderkey AS varchar(20)) AS job_uid, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {case('o_orderkey', STAGES[:5])} END AS status, 'supplier-' || cast(o_custkey % 40 AS varchar(20)) AS company_slug,
    CASE WHEN o_orderkey % 4 <> 0 THEN {DAY0} + (o_orderkey % 60) * 86400 END AS due, CASE WHEN o_orderkey % 3 = 0 THEN {DAY0} END AS applied_at, o_custkey FROM orders"""
CONTACTS = f"""
SELECT s_suppkey AS contact_id, 'supplier-' || cast(s_suppkey % 40 AS varchar(20)) AS company_slug, s_name AS full_name, {case('s_suppkey', TITLES)} AS title, CASE WHEN s_suppkey % 3 <> 0 THEN 'p' || cast(s_suppkey AS varchar(20)) || '@company.com' END AS email,
    {case('s_suppkey', ['verified', 'probable', 'guessed', 'other'])} AS email_label, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS priority, cast(s_suppkey * 17 % 101 AS double) AS confidence FROM supplier"""
CHANNELS = f"""
SELECT s_suppkey AS contact_id, {case('k', ['linkedin', 'x', 'github'])} AS kind, 'https://h' || cast(k AS varchar(20)) || '.example/' || cast(s_suppkey AS varchar(20)) AS value_norm, CASE WHEN (s_suppkey + k) % 4 <> 0 THEN cast((s_suppkey * 7 + k * 29) % 101 AS double) END AS confidence,
    (s_suppkey + k) % 2 = 0 AS verified, {case('s_suppkey + k', ['github', 'gravatar', 'other'])} AS source FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n"""
POLLS = "SELECT event_id AS ord, cast(user_id % 150 AS bigint) AS job_uid, ts, sha1(event_type) AS fingerprint FROM events"
VIEWS = {"jobs": JOBS, "scores": SCORES, "applications": APPLICATIONS, "contacts": CONTACTS, "channels": CHANNELS, "polls": POLLS}
SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a bound one by name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, used = VIEWS[name], {}
    for s in SOURCES:
        if f"FROM {s}" in sql:
            sql = sql.replace(f"FROM {s}", f"FROM {{{s}}}")
            used[s] = spark.read.parquet(f"{sf_dir}/{s}.parquet")
    return spark.sql(sql, **used)


def bound(sql: str) -> str:
    """DuckDB SQL with the bound tables it names as CTEs."""
    import re

    own = [f"{n} AS ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    sql = sql.strip()
    if not own:
        return sql
    start = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else "WITH "
    return start + ", ".join(own) + (", " + sql[len(start) :] if sql.upper().startswith("WITH ") else " " + sql)
