"""Queries of incremental state: merges, sightings, board health, checkpoints, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import merge, relational
from quarryline.plans.base import Queries
from quarryline.plans.tables import DAY0, table
from quarryline.streaming import sightings

QUERIES = Queries()


@QUERIES("q_upsert_merge", """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_totalprice AS score, o_custkey AS seen FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS k, 'new' AS title, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + 1 END AS score, o_custkey + 1 AS seen FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN n.title ELSE o.title END AS title, CASE WHEN o.k IS NULL THEN n.score ELSE coalesce(n.score, o.score) END AS score, coalesce(n.seen, o.seen) AS seen FROM o FULL JOIN n ON o.k = n.k""")
def _(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("score"), F.col("o_custkey").alias("seen"))
    new = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1).alias("score"), (F.col("o_custkey") + 1).alias("seen"))
    return merge.keyed_merge(old, new, ["k"], {"score": "new_if_set", "seen": "take"})


@QUERIES("q_channel_merge", """WITH n AS (SELECT contact_id, kind, value_norm, (contact_id * 41 + length(kind)) % 101 AS confidence, contact_id % 2 = 1 AS verified, CASE WHEN contact_id % 3 <> 0 THEN 'fresh' END AS source FROM channels WHERE contact_id % 2 = 0)
SELECT c.contact_id, c.kind, c.value_norm, CASE WHEN n.contact_id IS NULL OR n.confidence < coalesce(c.confidence, 0) THEN c.confidence ELSE n.confidence END::double AS confidence, CASE WHEN n.contact_id IS NULL OR n.confidence < coalesce(c.confidence, 0) THEN c.verified ELSE c.verified OR n.verified END AS verified,
    CASE WHEN n.contact_id IS NULL OR n.confidence < coalesce(c.confidence, 0) THEN c.source ELSE coalesce(n.source, c.source) END AS source FROM channels c LEFT JOIN n USING (contact_id, kind, value_norm)""")
def _(spark, d):
    old = table(spark, d, "channels")
    new = old.where("contact_id % 2 = 0").select("contact_id", "kind", "value_norm", ((F.col("contact_id") * 41 + F.length("kind")) % 101).cast("double").alias("confidence"), (F.col("contact_id") % 2 == 1).alias("verified"), F.when(F.col("contact_id") % 3 != 0, "fresh").alias("source"))
    return merge.channel_merge(old, new)


@QUERIES("q_blank_fill", """WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END AS k2, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name FROM supplier)
SELECT k, k2, coalesce(nullif(name, ''), 'filled') AS name FROM o""")
def _(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 7).alias("k2"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"))
    return merge.keyed_merge(old, old.withColumn("name", F.lit("filled")), ["k", "k2"], {"name": "fill_blank"}, null_safe=True)


@QUERIES("q_map_merge", "SELECT n_nationkey, n_name AS a, 'new' AS b, n_regionkey::varchar AS c FROM nation")
def _(spark, d):
    old, new = F.create_map(F.lit("a"), "n_name", F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("n_regionkey").cast("string"))
    m = table(spark, d, "nation").select("n_nationkey", merge.merged_map(old, new).alias("m"))
    return m.select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@QUERIES("q_flag_union", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'agency,rolling,llm:x' WHEN 1 THEN 'rolling,agency' ELSE 'llm:x,rolling' END AS flags FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    old = F.when(k == 0, F.array(F.lit("agency"), F.lit("rolling"))).when(k == 1, F.array(F.lit("rolling"))).otherwise(F.array(F.lit("llm:x")))
    new = F.when(k == 0, F.array(F.lit("rolling"), F.lit("llm:x"))).when(k == 1, F.array(F.lit("agency"), F.lit("rolling"))).otherwise(F.array(F.lit("rolling")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(merge.POLICIES["union"](old, new), ",").alias("flags"))


@QUERIES("q_sightings", """WITH l AS (SELECT *, lag(ts) OVER w AS b, lag(fingerprint) OVER w AS f FROM polls WINDOW w AS (PARTITION BY job_uid ORDER BY ts, ord))
SELECT job_uid, count(*) AS poll_count, count(*) FILTER (floor((epoch_us(ts) - epoch_us(b)) / 86400000000.0) >= 7 AND fingerprint = f) AS reappearances, max(ts) AS last_present, arg_max(fingerprint, (ts, ord)) AS fingerprint FROM l GROUP BY 1""")
def _(spark, d):
    return sightings.sightings(table(spark, d, "polls"))


_BOARDS = "b AS (SELECT s_suppkey AS token, (s_suppkey * 3 % 50)::bigint AS total_jobs_seen, (s_suppkey % 7)::integer AS consecutive_failures FROM supplier)"


@QUERIES("q_board_health", f"""WITH {_BOARDS} SELECT token, total_jobs_seen + CASE WHEN token % 3 = 0 THEN token % 5 ELSE 0 END AS total_jobs_seen, CASE WHEN token % 4 = 3 THEN consecutive_failures WHEN token % 3 = 0 THEN 0 ELSE consecutive_failures + 1 END AS consecutive_failures,
CASE WHEN token % 4 = 3 THEN NULL WHEN token % 3 = 0 AND token % 5 > 0 THEN {DAY0} END AS last_active, CASE WHEN (CASE WHEN token % 4 = 3 THEN consecutive_failures WHEN token % 3 = 0 THEN 0 ELSE consecutive_failures + 1 END) >= 6 THEN 'retired' ELSE 'active' END AS status FROM (SELECT * REPLACE (token AS token) FROM b) WHERE token % 4 <> 3
UNION ALL SELECT token, total_jobs_seen, consecutive_failures, NULL, CASE WHEN consecutive_failures >= 6 THEN 'retired' ELSE 'active' END FROM b WHERE token % 4 = 3""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.lit("x").alias("ats"), F.col("s_suppkey").alias("token"))
    boards = s.select("ats", "token", (F.col("token") * 3 % 50).alias("total_jobs_seen"), (F.col("token") % 7).cast("int").alias("consecutive_failures"), F.lit(None).cast("int").alias("last_active"), F.lit("active").alias("status"))
    polls = s.where("token % 4 <> 3").select("ats", "token", (F.col("token") % 3 == 0).alias("ok"), (F.col("token") % 5).alias("n_jobs"), F.lit(DAY0).alias("at"))
    return merge.board_health(boards, polls).drop("ats")


@QUERIES("q_high_water", "SELECT greatest(100, min(event_id) FILTER (event_id % 997 = 996) - 1) AS high_water, 'partial' AS status FROM events")
def _(spark, d):
    frontier = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 997 != 996).alias("ok"))
    return merge.high_water(frontier, F.lit(100).cast("long"))


@QUERIES("q_new_boards", "SELECT DISTINCT 'x' AS ats, regexp_extract(url, '//([^/?#]*)', 1) AS token FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '//([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '//([^/?#]*)', 1) FROM pages WHERE page_id % 2 = 1)")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.lit("x").alias("ats"), F.regexp_extract("url", "//([^/?#]*)", 1).alias("token"))
    return merge.new_boards(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1").distinct())


@QUERIES("q_union_distinct", "SELECT lang AS tag, source FROM documents UNION SELECT 'page', regexp_extract(url, '\\.([a-z]+)/', 1) FROM pages")
def _(spark, d):
    p = table(spark, d, "pages").select(F.lit("page").alias("tag"), F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("source"))
    return table(spark, d, "documents").select(F.col("lang").alias("tag"), "source").unionByName(p).distinct()


@QUERIES("q_set_stage", f"SELECT id, CASE WHEN id % 5 = 0 THEN 'Applied' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN coalesce(applied_at, {DAY0 + 5}) ELSE applied_at END AS applied_at FROM applications")
def _(spark, d):
    a = table(spark, d, "applications").withColumn("applied_at", F.col("applied_at").cast("long"))
    changes = a.where("id % 5 = 0").select("job_uid", F.lit("Applied").alias("stage"))
    return merge.set_stage(a, changes, F.lit(DAY0 + 5).cast("long")).select("id", "status", F.col("applied_at").cast("int").alias("applied_at"))


@QUERIES("q_track_insert_absent", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'To Apply' END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return merge.insert_absent(o.where("k % 2 = 0"), o.where("k % 3 = 0").withColumn("status", F.lit("To Apply")), ["k"])


@QUERIES("q_tracker_delete", "SELECT id FROM applications WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return merge.delete(table(spark, d, "applications"), gone, ["id"]).select("id")


@QUERIES("q_recent_signals", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1997-12-31') WHERE r = 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderdate").where(F.col("day").between("1996-01-01", "1997-12-31"))
    return relational.top_per(o, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", "o_orderkey", "day")


@QUERIES("q_stale_firms", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS built FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE built IS NULL OR built < TIMESTAMP '1997-06-01'")
def _(spark, d):
    built = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("built"))
    return table(spark, d, "customer").join(built, F.col("c_custkey") == F.col("o_custkey"), "left").where("built IS NULL OR built < TIMESTAMP_NTZ '1997-06-01 00:00:00'").select("c_custkey")
