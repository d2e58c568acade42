from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quarryline.operators import dedup, graph, merge, relational, targets
from quarryline.plans.tables import table
from quarryline.sources import boards
from quarryline.streaming import sightings


def test_fuzzy_groups_equal_the_sequential_rule(spark):
    titles = ["software engineer intern", "software engineering intern", "data intern", "software engineer intern", "data interns", "x", "software engineering interns"]
    rows = [("c" if i % 4 else "d", i, titles[i % 7], [None, "berlin", "paris"][i % 3], i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "company_slug string, ord long, title_key string, place string, is_remote boolean")
    got = {r.ord: r.leader for r in dedup.fuzzy_groups(df).collect()}
    groups = []
    for r in rows:
        for g in groups:
            if any(m[0] == r[0] and SequenceMatcher(None, r[2], m[2]).ratio() >= 0.9 and (r[4] or m[4] or not r[3] or not m[3] or r[3] == m[3]) for m in g):
                g.append(r)
                break
        else:
            groups.append([r])
    assert got == {m[1]: g[0][1] for g in groups for m in g}


def test_merge_people(spark):
    rows = [("a", 0, "g1", None, None, "ann", []), ("a", 1, None, "l1", None, "ann", []), ("a", 2, None, None, None, "bob", []), ("a", 3, None, None, None, "bob", []), ("a", 4, "g2", "l1", None, "ann", []), ("b", 5, "g1", None, None, "ann", []), ("a", 6, None, None, "e", None, ["v"]), ("a", 7, None, None, None, None, ["v"])]
    df = spark.createDataFrame(rows, "company_slug string, ord long, gh string, li string, em string, name string, verified array<string>")
    assert {r.ord: r.leader for r in dedup.merge_people(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6, 7: 6}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 1)], "a long, b long")
    got = {r.node: r.label for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keyed_merge_edges(spark):
    old = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "k int, k2 int, v string")
    new = spark.createDataFrame([(1, None, "", 1), (1, None, "z", 2), (2, 5, "n", 3), (None, None, "c", 4)], "k int, k2 int, v string, ord int")
    got = merge.keyed_merge(old, new, ["k", "k2"], {"v": "new_if_filled"}, null_safe=True, ordinal="ord").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, "a"), (2, 5, "n"), (None, None, "c")], key=repr)


def test_page_clamps(spark):
    df = spark.range(10)
    assert [r.id for r in relational.page(df, [F.asc("id")], 9, 4).collect()] == [8, 9]
    assert [r.id for r in relational.page(df, [F.asc("id")], 0, 4).collect()] == [0, 1, 2, 3]
    assert relational.clamp_limit(0) == 1 and relational.clamp_limit(1000) == 100


def test_streaming_sightings_equal_batch(spark, data, tmp_path):
    polls = table(spark, data, "polls").where("job_uid < 40").withColumn("ts", F.col("ts").cast("timestamp"))
    polls.repartitionByRange(1, "ts").write.parquet(str(tmp_path / "in"))
    stream = sightings.sightings_stream(spark.readStream.schema(polls.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.job_uid: (r.poll_count, r.reappearances, r.fingerprint) for r in spark.table("seen").collect()}
    assert got == {r.job_uid: (r.poll_count, r.reappearances, r.fingerprint) for r in sightings.sightings(polls).collect()}


def test_streaming_merge(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    sightings.merge_batches(stream, str(tmp_path / "out"), ["k"], {"v": "take"}, str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    sightings.merge_batches(stream, str(tmp_path / "out"), ["k"], {"v": "take"}, str(tmp_path / "c")).awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out/v1")).collect()} == {(1, "a"), (2, "z"), (3, "c")}
    spark.createDataFrame([(3, "n"), (3, "m"), (4, "d")], "k int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    sightings.merge_batches(stream, str(tmp_path / "out"), ["k"], {"v": "take"}, str(tmp_path / "c"), "v").awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out/v2")).collect()} == {(1, "a"), (2, "z"), (3, "m"), (4, "d")}
    assert not (tmp_path / "out/v0").exists()


def test_filters_and_columns_reach_the_scan(spark, data):
    from quarryline.plans import registry

    plan = registry.queries()["q_postings_at_scale"](spark, data)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


def test_vector_search_takes_seeds_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    similar = unit @ unit.T
    got = [(r.id, round(r.similarity, 9)) for r in dedup.nearest_seed(df.where("id >= 25"), df.where("id < 25"), "id", "v", 8, block=10).collect()]
    best = similar[25:, :25].max(1)
    assert got == [(int(i) + 25, round(float(best[i]), 9)) for i in np.argsort(-best)[:8]]
    np.fill_diagonal(similar, -2)
    top = {(r.query, r.place): r.id for r in dedup.cosine_topk(df.where("id % 5 = 0"), df, "id", "v", 3, block=5).collect()}
    assert top == {(q, n + 1): int(i) for q in range(0, 60, 5) for n, i in enumerate(np.argsort(-similar[q])[:3])}


def test_more_seeds_than_a_block(spark):
    seeds = spark.range(10_001).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    rows = spark.createDataFrame([(-1, [1.0, 10_000.0]), (-2, [1.0, -5.0])], "id long, v array<double>")
    got = dedup.nearest_seed(rows, seeds, "id", "v", 1).collect()
    assert [r.id for r in got] == [-1] and round(got[0].similarity, 9) == 1


def test_connection(spark):
    known = [("Ann", ["Foo Bar LLC"], []), ("Bob", ["", "Inc"], ["www.Zed.com"]), ("Cid", ["foobar", "qux"], ["zed.com"])]
    rows = [("Foo-Bar, Inc.", None, None, "Ann"), (None, "foo-bar-inc", None, "Ann"), ("Other", None, "WWW.zed.com", "Bob"), ("x", "", "jobs.zed.com", "Bob"), ("Qux", "", "", "Cid"), ("Inc", "inc", "notzed.com", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "company string, slug string, domain string, want string")
    got = df.select("want", targets.connection(F.col("company"), F.col("slug"), F.col("domain"), known).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert df.select(targets.connection(F.col("company"), F.col("slug"), F.col("domain"), []).alias("c")).where("c IS NOT NULL").count() == 0


def people_by_pairs(rows):
    """leader of each record by comparing all pairs of a company: rows of (company, ord, gh, li, em, name, verified)."""
    parent = {r[:2]: r[:2] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] != b[0] or any(x and y and x != y for x, y in zip(a[2:5], b[2:5], strict=True)):
                continue
            identified = any(a[2:5]) or a[6] or any(b[2:5]) or b[6]
            if any(x and x == y for x, y in zip(a[2:5], b[2:5], strict=True)) or set(a[6] or ()) & set(b[6] or ()) or a[5] and a[5] == b[5] and identified:
                x, y = find(a[:2]), find(b[:2])
                parent[max(x, y)] = min(x, y)
    return {r[:2]: find(r[:2])[1] for r in rows}


def test_people_merge_equals_all_pairs(spark):
    import random

    from quarryline.operators import dedup

    pick = random.Random(3)
    some = lambda xs, p: pick.choice(xs) if pick.random() < p else pick.choice([None, ""])
    for n_ids in (3, 12):
        rows = [(pick.choice("st"), i, some([f"g{k}" for k in range(n_ids)], 0.4), some([f"l{k}" for k in range(n_ids)], 0.4), some([f"e{k}" for k in range(n_ids)], 0.3), some(["ann", "bo", "cy", "di"], 0.6), pick.choice([None, [], [], [f"v{pick.randrange(n_ids)}"]])) for i in range(70)]
        df = spark.createDataFrame(rows, "company_slug string, ord long, gh string, li string, em string, name string, verified array<string>")
        assert {r.ord: r.leader for r in dedup.merge_people(df).collect()} == {k[1]: v for k, v in people_by_pairs(rows).items()}


def test_collapse_equals_the_plain_rule(spark):
    """First of each url, then each posting in input order to the first group with a like member; the best of a group stays."""
    import random
    from difflib import SequenceMatcher

    from quarryline.operators import dedup

    pick = random.Random(5)
    words = ["software", "engineer", "intern", "data", "science", "summer", "2026", "backend", "platform"]
    rows = []
    for i in range(160):
        title = " ".join(pick.choices(words, k=pick.randint(2, 4))) if i < 40 else rows[pick.randrange(40)][3] + pick.choice(["", "s", " i", " ing"])
        rows.append((i, f"u{pick.randrange(140)}", pick.choice("ab"), title, pick.choice([None, "paris", "rome"]), pick.random() < 0.2, pick.choice(["lever", "listing"]), pick.choice([None, i % 7]), i % 5))
    kept = list({r[1]: r for r in reversed(rows)}.values())
    groups: dict[str, list[list[tuple]]] = {}
    for r in sorted(kept):
        own = groups.setdefault(r[2], [])
        like = lambda m: (r[5] or m[5] or r[4] is None or m[4] is None or r[4] == m[4]) and SequenceMatcher(None, r[3], m[3]).ratio() >= 0.9
        for g in own:
            if any(like(m) for m in g):
                g.append(r)
                break
        else:
            own.append([r])
    best = lambda g: min(g, key=lambda r: (r[6] not in dedup.TIER_A, 1 << 62 if r[7] is None else r[7], r[8], r[0]))
    want = {(best(g)[0], len(g) - 1) for own in groups.values() for g in own}
    df = spark.createDataFrame(rows, "ord long, url_hash string, company_slug string, title_key string, place string, is_remote boolean, ats string, posted long, first_seen long")
    assert {(r.ord, r.times_seen_elsewhere) for r in dedup.collapse(df).collect()} == want and len(want) < len(kept)


def test_sitemap_links_come_whole_or_cut(spark):
    """Every place by file and order, over sitemaps of sitemaps; `most` cuts within a file."""
    place = lambda *n: "<urlset>" + "".join(f"<url><loc>p{i}</loc></url>" for i in n) + "<url><loc> </loc></url></urlset>"
    maps = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    files = [("r", maps("b", "a", "r", "none")), ("a", place(3, 1)), ("b", maps("c") + place(2)), ("c", place(*range(10, 6010)) + maps("d")), ("d", place(9)), ("e", None), ("f", place())]
    roots = spark.createDataFrame([("s", "r"), ("t", "a"), ("u", "e"), ("u", "f")], "site string, url string")
    whole = [("s", i, f"p{n}") for i, n in enumerate([3, 1, 2, *range(10, 6010)])] + [("t", 0, "p3"), ("t", 1, "p1")]
    for most in (None, 5000, 4, 3, 1):
        got = boards.sitemap_links(roots, spark.createDataFrame(files, "url string, body string"), most=most).collect()
        assert sorted(tuple(r) for r in got) == [r for r in whole if most is None or r[1] < most], most
