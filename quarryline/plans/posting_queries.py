"""Queries of the read path: search, dashboard, scores, alerts, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import classify, scoring, text
from quarryline.operators import dedup, relational, targets
from quarryline.plans.base import Queries
from quarryline.plans.tables import DAY0, STAGES, table

QUERIES = Queries()
NOW = DAY0 + 250 * 86400
_FIT = "fits AS (SELECT job_uid, arg_max(fit_score, (scored_at, score_id)) AS fit FROM scores WHERE starts_with(model, 'llm:') GROUP BY 1)"
_HIT = ["job_uid", "title", "company", "fit", "posted"]


def _search(name: str, where: str, order: str, **options):
    @QUERIES(name, f"WITH {_FIT} SELECT job_uid, title, company, fit, posted FROM jobs LEFT JOIN fits USING (job_uid) WHERE {where} ORDER BY {order}, job_uid LIMIT {options.get('limit', 25)}")
    def run(spark, d, own="jobs"):
        return relational.search(table(spark, d, "jobs"), table(spark, d, "scores"), **options).select(*_HIT)


_search("q_search_jobs_fit", "is_internship", "fit DESC NULLS LAST")
_search("q_search_jobs_text", "is_internship AND (title ILIKE '%intern%' OR description_text ILIKE '%intern%') AND NOT is_remote", "posted DESC NULLS LAST", query="intern", remote=False, sort="recent", limit=100)
_search("q_search_jobs_place", "(location_normalized ILIKE '%berlin%' OR location_raw ILIKE '%berlin%') AND ats = 'listing'", "discovery_score DESC NULLS LAST", location="berlin", ats=" Listing ", internships_only=False, sort="discovery", limit=50)
_search("q_search_jobs_deadline", "is_internship AND deadline IS NOT NULL AND (company ILIKE '%ny 1%' OR company_slug ILIKE '%ny 1%')", "deadline ASC", company="ny 1", sort="deadline")
_search("q_search_jobs_min_fit", "is_internship AND fit >= 60", "fit DESC NULLS LAST", min_fit=60.0, limit=100)

_GOOD = "(quality_verdict IS NULL OR quality_verdict NOT IN ('spam', 'ghost', 'agency', 'mlm') OR quality_confidence < 70)"


@QUERIES("q_dashboard_hide_low_quality", f"SELECT job_uid, quality_verdict, quality_confidence FROM jobs WHERE is_internship AND title ILIKE '%engineer%' AND is_remote AND {_GOOD}")
def _(spark, d):
    return relational.dashboard(table(spark, d, "jobs"), query="engineer", remote=True, hide_low_quality=True).select("job_uid", "quality_verdict", "quality_confidence")


for _sort, _order in (("company", "company ASC NULLS FIRST"), ("deadline", "deadline ASC NULLS LAST"), ("quality", "quality_score DESC NULLS LAST"), ("unknown", "posted DESC NULLS LAST")):

    @QUERIES(f"q_dashboard_sort_{_sort}", f"SELECT job_uid, company, posted FROM jobs WHERE is_internship ORDER BY {_order}, job_uid LIMIT 40")
    def _(spark, d, sort=_sort):
        return relational.dashboard(table(spark, d, "jobs")).orderBy(*relational.dashboard_order(sort)).select("job_uid", "company", "posted").limit(40)


@QUERIES("q_page_2", "SELECT id, status, due FROM applications ORDER BY due NULLS LAST, id LIMIT 25 OFFSET 25")
def _(spark, d):
    return relational.page(table(spark, d, "applications").select("id", "status", "due"), [F.asc_nulls_last("due"), F.asc("id")], 2, 25)


@QUERIES("q_latest_score", "SELECT job_uid, arg_max(fit_score, (scored_at, score_id)) AS fit_score, arg_max(model, (scored_at, score_id)) AS model FROM scores GROUP BY 1")
def _(spark, d):
    return relational.latest(table(spark, d, "scores"), ["job_uid"], ["scored_at", "score_id"]).select("job_uid", "fit_score", "model")


@QUERIES("q_unscored_anti", "SELECT job_uid FROM jobs WHERE is_internship AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_uid = jobs.job_uid AND s.model = 'llm:x')")
def _(spark, d):
    scored = table(spark, d, "scores").where("model = 'llm:x'").select("job_uid")
    return table(spark, d, "jobs").where("is_internship").join(scored, "job_uid", "left_anti").select("job_uid")


@QUERIES("q_tracked_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS tracked FROM customer")
def _(spark, d):
    tracked = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("t", F.lit(True))
    return table(spark, d, "customer").join(tracked, "c_custkey", "left").select("c_custkey", F.coalesce("t", F.lit(False)).alias("tracked"))


@QUERIES("q_company_targets", "SELECT company_slug, max(company) AS company, max(company_domain) AS domain, max(coalesce(discovery_score, 0)) AS best, count(*) AS n FROM jobs WHERE is_internship GROUP BY 1 HAVING max(coalesce(discovery_score, 0)) >= 0.5")
def _(spark, d):
    own = table(spark, d, "jobs").where("is_internship").groupBy("company_slug").agg(F.max("company").alias("company"), F.max("company_domain").alias("domain"), F.max(F.coalesce("discovery_score", F.lit(0.0))).alias("best"), F.count("*").alias("n"))
    return own.where("best >= 0.5")


@QUERIES("q_stats", "SELECT count(*) AS jobs, count(*) FILTER (is_internship) AS internships, count(DISTINCT company_slug) AS companies, count(*) FILTER (is_remote) AS remote FROM jobs")
def _(spark, d):
    return table(spark, d, "jobs").agg(F.count("*").alias("jobs"), F.count_if("is_internship").alias("internships"), F.countDistinct("company_slug").alias("companies"), F.count_if("is_remote").alias("remote"))


@QUERIES("q_stats_by_source", "SELECT coalesce(ats, 'total') AS ats, count(*) AS n FROM jobs WHERE is_internship GROUP BY ROLLUP (ats)")
def _(spark, d):
    return table(spark, d, "jobs").where("is_internship").rollup("ats").agg(F.count("*").alias("n")).select(F.coalesce("ats", F.lit("total")).alias("ats"), "n")


@QUERIES("q_tracker_summary", "SELECT s.status, s.ord::integer AS ord, count(a.id) AS n FROM (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(STAGES)) + ") s(status, ord) LEFT JOIN applications a ON coalesce(a.status, 'To Apply') = s.status GROUP BY 1, 2")
def _(spark, d):
    return relational.zero_filled(table(spark, d, "applications"), "status", STAGES, "To Apply")


_RANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + " ELSE 9 END"


@QUERIES("q_tracker_list", f"SELECT id, status, due FROM applications ORDER BY {_RANK}, coalesce(due, 253370764800), id LIMIT 100")
def _(spark, d):
    rank = F.lit(9)
    for i, s in enumerate(STAGES):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    return table(spark, d, "applications").orderBy(rank, F.coalesce("due", F.lit(253370764800)), "id").select("id", "status", "due").limit(100)


@QUERIES("q_due_status", f"SELECT id, CASE WHEN days < 0 THEN 'overdue' WHEN days <= 7 THEN 'soon' ELSE '' END AS due_status FROM (SELECT id, floor((due - {DAY0 + 20 * 86400}) / 86400.0) AS days FROM applications)")
def _(spark, d):
    days = F.floor((F.col("due") - (DAY0 + 20 * 86400)) / 86400)
    return table(spark, d, "applications").select("id", F.when(days < 0, "overdue").when(days <= 7, "soon").otherwise("").alias("due_status"))


_TS = lambda c: F.timestamp_seconds(c)
_FRESH = f"CASE WHEN posted IS NULL OR posted > {NOW} THEN 0.3 ELSE pow(0.5, ({NOW} - posted) / 86400.0 / 14.0) END"
_RARE = "0.5 / (1.0 + seen_elsewhere) + 0.5 / (1.0 + total / 50.0)"


@QUERIES("q_score_jobs", f"SELECT job_uid, round({_FRESH}, 6) AS freshness, round({_RARE}, 6) AS rarity, round(least(1, 0.5 * coalesce(discovery_score, 0) + 0.25 * ({_FRESH}) + 0.25 * ({_RARE}) + CASE WHEN is_internship AND hiring THEN 0.05 ELSE 0 END), 6) AS discovery FROM jobs JOIN (SELECT board_id, count(*) AS total FROM jobs GROUP BY 1) b USING (board_id) JOIN (SELECT company_slug, max(doc_id % 7) = 6 AS hiring FROM jobs GROUP BY 1) h USING (company_slug)")
def _(spark, d):
    jobs = table(spark, d, "jobs")
    boards = jobs.groupBy("board_id").agg(F.count("*").alias("total"))
    hiring = jobs.groupBy("company_slug").agg((F.max(F.col("doc_id") % 7) == 6).alias("hiring"))
    now = F.timestamp_seconds(F.lit(NOW))
    fresh, rare = scoring.freshness(_TS("posted"), now), scoring.rarity(F.col("seen_elsewhere"), F.col("total"))
    both = jobs.join(boards, "board_id").join(hiring, "company_slug").withColumns({"fresh": fresh, "rare": rare})
    boost = F.when(F.col("is_internship") & F.col("hiring"), 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), scoring.discovery(F.coalesce("discovery_score", F.lit(0.0)), F.col("fresh"), F.col("rare")) + boost)
    return both.select("job_uid", F.round("fresh", 6).alias("freshness"), F.round("rare", 6).alias("rarity"), F.round(score, 6).alias("discovery"))


_START = "CASE WHEN posted IS NOT NULL AND posted > last_seen THEN first_seen ELSE coalesce(posted, first_seen) END"
_DAYS = f"greatest(0, floor((last_seen - ({_START})) / 86400.0))::bigint"


@QUERIES("q_days_open", f"SELECT job_uid, {_DAYS} AS days FROM jobs")
def _(spark, d):
    return table(spark, d, "jobs").select("job_uid", classify.days_open(_TS("posted"), _TS("first_seen"), _TS("last_seen"), F.timestamp_seconds(F.lit(NOW))).alias("days"))


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_BOTH = "(title || chr(10) || description_text)"
_FLAGS = [
    ("content_free", "length(trim(description_text)) < 300", "CASE WHEN low THEN 30 ELSE 20 END"), ("agency", _m(_BOTH, classify.AGENCY), "25"), ("mlm_scam", f"({_m(_BOTH, classify.SCAM)} OR {_m(_BOTH, classify.CONTACT_ONLY)})", "45"),
    ("personal_email_apply", _m("description_text", classify.PERSONAL_EMAIL), "CASE WHEN low THEN 20 ELSE 8 END"), ("ghost_language", _m(_BOTH, classify.GHOST), "20"), ("ghost_duration", "days > 45", "least(25, 10 + (days - 45) / 6.0)"),
    ("requirement_incoherence", f"({_m('title', classify.ENTRY_TITLE)} AND (coalesce(try_cast(regexp_extract(description_text, '{classify.YEARS}', 1, 'i') AS int) >= 4, false) OR {_m('title', classify.SENIOR)}))", "15"), ("rolling", _m("description_text", text.ROLLING[4:]), "2"),
]


@QUERIES("q_quality_flags", "WITH q AS (SELECT *, ats IN ('listing','remotive','jobicy','arbeitnow','themuse','hackernews') AS low, " + _DAYS + " AS days FROM jobs), f AS (SELECT *, " + ", ".join(f"({c}) AS {n}" for n, c, _ in _FLAGS) + " FROM q) SELECT job_uid, round(greatest(0, least(100, 100.0 - " + " - ".join(f"CASE WHEN {n} THEN {c} ELSE 0 END" for n, _, c in _FLAGS) + ")), 6)::double AS score, concat_ws(',', " + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n, _, _ in _FLAGS) + ") AS flags, CASE WHEN mlm_scam OR (agency AND content_free) THEN 'suspect' WHEN " + " OR ".join(n for n, _, _ in _FLAGS[:-1]) + " THEN 'unclear' ELSE 'ok' END AS hint FROM f")
def _(spark, d):
    days = classify.days_open(_TS("posted"), _TS("first_seen"), _TS("last_seen"), F.timestamp_seconds(F.lit(NOW)))
    q = table(spark, d, "jobs").withColumn("q", classify.quality(F.col("title"), F.col("description_text"), F.col("ats"), days, text.is_rolling(F.col("description_text"))))
    return q.select("job_uid", F.round("q.score", 6).alias("score"), F.array_join("q.flags", ",").alias("flags"), F.col("q.hint").alias("hint"))

TARGETS = targets.Targets([("Firm One", "company-1-inc", ["company1.com"], "high"), ("Firm Two", "company-22", ["jobs.company22.com", "company23.com"], "low")], ["intern", "engineer"], ["senior", "staff"], ["berlin", "austin"])
_DOMAIN = "regexp_replace(company_domain, '^www\\.', '')"
_FIRM = f"CASE WHEN {_DOMAIN} = 'company1.com' OR ends_with({_DOMAIN}, '.company1.com') OR company_slug = 'company-1-inc' THEN 'Firm One' WHEN {_DOMAIN} IN ('jobs.company22.com', 'company23.com') OR company_slug IN ('company-22', 'company-22-inc') THEN 'Firm Two' END"
_EVAL = f"e AS (SELECT *, {_FIRM} AS hit, CASE WHEN contains(lower(title), 'senior') THEN 'senior' WHEN contains(lower(title), 'staff') THEN 'staff' END AS bad, CASE WHEN contains(lower(title), 'intern') THEN 'intern' WHEN contains(lower(title), 'engineer') THEN 'engineer' END AS kw, is_remote OR contains(lower(coalesce(location_normalized, location_raw)), 'berlin') OR contains(lower(coalesce(location_normalized, location_raw)), 'austin') AS place FROM jobs), m AS (SELECT *, bad IS NULL AND place AND ((hit IS NOT NULL AND (is_internship OR kw IS NOT NULL)) OR kw IS NOT NULL) AS matched, CASE WHEN bad IS NULL AND place AND (is_internship OR kw IS NOT NULL) THEN hit END AS firm, CASE WHEN bad IS NOT NULL THEN 'excluded:' || bad WHEN NOT place THEN 'location' WHEN hit IS NOT NULL AND (is_internship OR kw IS NOT NULL) THEN concat_ws(',', 'target-firm:' || hit, 'keyword:' || kw) WHEN kw IS NOT NULL THEN 'keyword:' || kw END AS reason FROM e)"


@QUERIES("q_target_match", f"WITH {_EVAL} SELECT job_uid, matched, firm, reason FROM m")
def _(spark, d):
    return targets.evaluated(table(spark, d, "jobs"), TARGETS).select("job_uid", "match.matched", "match.firm", "match.reason")


CONNECTIONS = [("Ann", ["Company 3, LLC", "Company 4"], []), ("Bob", ["Company 4 Inc."], ["company5.com"]), ("Cid", [], ["www.company6.com"])]


@QUERIES("q_connection_match", f"SELECT job_uid, CASE WHEN company_slug IN ('company-3-inc', 'company-4-inc') THEN 'Ann' WHEN {_DOMAIN} = 'company5.com' THEN 'Bob' WHEN {_DOMAIN} = 'company6.com' THEN 'Cid' END AS connection FROM jobs")
def _(spark, d):
    return table(spark, d, "jobs").select("job_uid", targets.connection(F.col("company"), F.col("company_slug"), F.col("company_domain"), CONNECTIONS).alias("connection"))


_ALERT = f"{_EVAL}, a AS (SELECT *, CASE firm WHEN 'Firm One' THEN 0 WHEN 'Firm Two' THEN 1 ELSE 2 END AS bucket FROM m WHERE notified_at IS NULL AND first_seen >= {NOW - 60 * 86400} AND NOT coalesce(quality_verdict IN ('spam','ghost','agency','mlm') AND quality_confidence >= 70, false) AND (matched OR (coalesce(reason NOT LIKE 'excluded:%' AND reason <> 'location', true) AND is_internship AND discovery_score >= 0.7)))"


@QUERIES("q_alerts", f"WITH {_ALERT} SELECT job_uid, bucket, discovery_score FROM a ORDER BY bucket, coalesce(discovery_score, 0) DESC, job_uid LIMIT 20")
def _(spark, d):
    out, _ = targets.alerts(table(spark, d, "jobs"), TARGETS, now=NOW, lookback_s=60 * 86400, min_fit=0.7)
    return out.select("job_uid", "bucket", "discovery_score")


@QUERIES("q_alerts_overflow", f"WITH {_ALERT} SELECT greatest(count(*) - 20, 0) AS overflow FROM a")
def _(spark, d):
    return targets.alerts(table(spark, d, "jobs"), TARGETS, now=NOW, lookback_s=60 * 86400, min_fit=0.7)[1]


@QUERIES("q_exact_dedup", "SELECT url_hash, min(ord) AS ord FROM (SELECT sha1('u' || (doc_id % 97)::varchar) AS url_hash, ord FROM jobs) GROUP BY 1")
def _(spark, d):
    jobs = table(spark, d, "jobs").select(F.sha1(F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string"))).alias("url_hash"), "ord")
    return dedup.exact_first(jobs)


@QUERIES("q_fuzzy_collapse")
def _(spark, d):
    jobs = table(spark, d, "jobs").select("ord", text.url_hash(F.col("url")).alias("url_hash"), "company_slug", text.title_key(F.col("title")).alias("title_key"), F.col("location_normalized").alias("place"), "is_remote", "ats", "posted", "first_seen")
    return dedup.collapse(jobs)


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@QUERIES("q_similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.35")
def _(spark, d):
    return dedup.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@QUERIES("q_semantic_groups", f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.4), r AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node) SELECT node, min(label) AS label FROM r GROUP BY 1")
def _(spark, d):
    return dedup.semantic_groups(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.4)


@QUERIES("q_nearest_seed", f"SELECT b.vec_id, round(max({_COS}), 6) AS similarity FROM embeddings b CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id < 20) a WHERE b.vec_id >= 20 GROUP BY 1 ORDER BY max({_COS}) DESC, 1 LIMIT 50")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return dedup.nearest_seed(e.where("vec_id >= 20"), e.where("vec_id < 20"), "vec_id", "embedding", 50).select("vec_id", F.round("similarity", 6).alias("similarity"))


@QUERIES("q_cosine_topk", f"SELECT query, vec_id, round(c, 6) AS similarity, place::int AS place FROM (SELECT a.vec_id AS query, b.vec_id, {_COS} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE place <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return dedup.cosine_topk(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


@QUERIES("q_top_per_supplier", "SELECT l_suppkey, l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def _(spark, d):
    own = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    return relational.top_per(own, ["l_suppkey"], [F.desc("l_discount"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3)


@QUERIES("q_postings_at_scale", "SELECT p_brand AS brand, s_name AS company, count(*) AS n, max(l_discount) AS best, min(l_shipdate) AS first_deadline FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
    both = li.join(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.col("p_brand").alias("brand"), F.col("s_name").alias("company")).agg(F.count("*").alias("n"), F.max("l_discount").alias("best"), F.min("l_shipdate").alias("first_deadline")).where("n >= 2")


@QUERIES("q_jobs_export", "SELECT CASE WHEN regexp_matches(cell, '^[=+\\-@]') THEN '''' || cell ELSE cell END AS title, job_uid, coalesce(company, company_slug) AS company FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '=' || title WHEN 1 THEN '-' || title ELSE title END AS cell, * FROM jobs) WHERE is_internship")
def _(spark, d):
    cell = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("="), "title")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("-"), "title")).otherwise(F.col("title"))
    return table(spark, d, "jobs").where("is_internship").select(text.csv_safe(cell).alias("title"), "job_uid", F.coalesce("company", "company_slug").alias("company"))
