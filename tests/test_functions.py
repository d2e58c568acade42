import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.functions import classify, contacts, scoring, text, urls
from quarryline.sources import adapters, html

NOW = dt.datetime(2026, 1, 10)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Remote", ("Remote", None, None, "Remote", True, "fully_remote")), ("Remote - Anywhere", ("Remote - Anywhere", None, None, "Remote - Anywhere", True, "remote_anywhere")),
        ("Hybrid, Berlin", ("Hybrid", "Berlin", None, "Hybrid, Berlin", False, "hybrid")), ("Remote / Hybrid", ("Remote", "Hybrid", None, "Remote / Hybrid", True, "hybrid")),
        ("Austin,  TX, US", ("Austin", "TX", "US", "Austin, TX, US", False, None)), ("  ", (None, None, None, None, False, None)), (None, (None, None, None, None, False, None)),
    ],
)
def test_location(spark, raw, expected):
    assert tuple(one(spark, text.location(F.lit(raw).cast("string")))) == expected


def test_names(spark):
    assert one(spark, text.canonical_company(F.lit("The Acme Labs, Inc."))) == "acme"
    assert one(spark, text.canonical_company(F.lit("Labs Inc"))) == ""
    assert one(spark, text.title_key(F.lit(" Développeur / C++  (Intern) "))) == "d veloppeur c intern"
    assert one(spark, contacts.name_token(F.lit("Núñez-O'Neil"))) == "nunezoneil"
    assert one(spark, contacts.local_parts(F.lit("Anne-Marie"), F.lit("Ray")))[:3] == ["annemarie.ray", "anne.ray", "aray"]


def test_internship_words(spark):
    f = lambda t, x="": one(spark, classify.is_internship(F.lit(t), F.lit(x)))
    assert f("Senior Software Intern") and not f("Interns manager") and not f("Campus Lead") and f("Campus Recruiter")
    assert f("Analyst", "this is an internship") and not f("Senior Analyst", "this is an internship")


def test_dates(spark):
    f = lambda v: one(spark, text.parsed_time(F.lit(v)))
    assert f("1e99") is None and f("9" * 18) is None and f("Sept 9, 2025") == dt.datetime(2025, 9, 9)
    assert one(spark, text.deadline(F.lit("apply by May 5th. deadline: 2027-01-02"), F.lit(NOW))) == dt.datetime(2026, 5, 5)
    assert one(spark, text.deadline(F.lit("deadline is soon"), F.lit(NOW))) is None


@pytest.mark.parametrize("verdict,confidence,shown,slop", [(None, None, True, False), ("ok", None, True, False), ("spam", 80.0, False, True), ("spam", 60.0, True, False), ("spam", None, None, False)])
def test_three_valued_quality(spark, verdict, confidence, shown, slop):
    v, c = F.lit(verdict).cast("string"), F.lit(confidence).cast("double")
    assert one(spark, classify.shown_on_dashboard(v, c)) is shown and one(spark, classify.clear_slop(v, c)) is slop


def test_scores(spark):
    now = F.lit(NOW)
    assert one(spark, scoring.freshness(F.lit(NOW - dt.timedelta(days=14)), now)) == pytest.approx(0.5)
    assert one(spark, scoring.freshness(F.lit(NOW + dt.timedelta(days=1)), now)) == 0.3
    assert one(spark, scoring.rarity(F.lit(-3), F.lit(None).cast("int"))) == 1.0
    assert one(spark, scoring.judged_value(F.lit("150"), F.lit("x"))) == 0


def test_urls(spark):
    assert tuple(one(spark, urls.board(F.lit("https://boards.greenhouse.io/embed/job_board?for=foo&x=1")))) == ("greenhouse", "foo")
    assert one(spark, urls.board(F.lit("https://api.teamtailor.com/jobs"))) is None
    found = one(spark, urls.boards_in_html(F.lit('<a href="https://jobs.lever.co/acme/1?a=1&amp;b=2">x</a> https://jobs.lever.co/acme/2')))
    assert [tuple(x) for x in found] == [("lever", "acme")]


def test_html():
    r = html.read('<title>T &amp; U</title><style>a{}</style><p> x <a href="/jobs/1/">Dev</a></p><script>var a="<b>"</script><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"I"}]}</script>')
    assert r["text"].splitlines() == ["T & U", "x", "Dev"] and r["links"] == [{"href": "/jobs/1/", "text": "Dev"}]
    assert len(html._parsed_postings(r["scripts"])) == 1 and html._parsed_postings(["{bad"]) == []
    assert html._last_object('a {"x": 1} b {"y": {"z": "}"}} {bad') == '{"y": {"z": "}"}}'


PAYLOADS = {
    "personio": "<x><position><id>1</id><name>Intern</name><office>Berlin</office><jobDescriptions><jobDescription><name>a</name><value>Text</value></jobDescription></jobDescriptions></position></x>",
    "ultipro": "<r><Opportunity><Id>1</Id><Title>Intern</Title><Location>Berlin</Location></Opportunity></r>",
    "oracle_cloud": '{"items":[{"requisitionList":[{"Id":"1","Title":"Intern","PrimaryLocation":"Berlin"}]}]}',
    "comeet": '<script>COMPANY_POSITIONS_DATA = [{"uid":"1","name":"Intern","location":{"name":"Berlin"}}];</script>',
    "paylocity": '<script>window.pageData = {"Jobs":[{"JobId":"1","JobTitle":"Intern","LocationName":"Berlin"}]};</script>',
    "icims": '<a href="https://x/jobs/1/intern">Intern</a><a href="/about">no</a>', "jazzhr": '<a href="/apply/1/x">Intern</a>', "jobvite": '<a href="/acme/job/1">Intern</a>', "zohorecruit": '<a href="/jobs/Careers/1">Intern</a>', "adp": '<a href="/job/1">Intern</a>',
    "teamtailor": '<script type="application/ld+json">{"@type":"JobPosting","title":"Intern","identifier":{"value":"1"},"jobLocation":[{"address":{"addressLocality":"Berlin"}}]}</script>',
    "ashby": '{"jobs":[{"id":"1","title":"Intern","location":"Berlin","secondaryLocations":[{"location":"Paris"}]}]}', "workable": '{"jobs":[{"shortcode":"1","title":"Intern","location":{"city":"Berlin"}}]}',
    "pinpoint": '{"data":[{"id":"1","title":"Intern","url":"u","location":{"name":"Berlin","city":"Berlin"}}]}', "dover": '{"results":[{"id":"1","title":"Intern","locations":[{"name":"Berlin"}]}]}', "gem": '{"jobs":[{"id":"1","title":"Intern","location":"Berlin"}]}',
    "eightfold": '{"positions":[{"id":"1","name":"Intern","location":"Berlin"}]}', "phenom": '{"jobs":[{"data":{"jobId":"1","title":"Intern","cityState":"Berlin","url":"u"}}]}',
}
for _k in ("successfactors", "taleo", "neogov"):
    PAYLOADS[_k] = PAYLOADS["teamtailor"]


@pytest.mark.parametrize("ats", sorted(PAYLOADS))
def test_adapter(spark, ats):
    raw = spark.createDataFrame([("acme", None, PAYLOADS[ats]), ("bad", None, "{oops"), ("none", None, None)], "token string, company string, payload string")
    rows = adapters.normalized(raw, ats).select("source_job_id", "title", "is_internship", "company_slug", "city").collect()
    assert [(r.source_job_id, r.title, r.is_internship, r.company_slug) for r in rows] == [("1", "Intern", True, "acme")]
    assert rows[0].city in (None, "Berlin")


def test_every_adapter_is_covered():
    assert set(adapters.SPECS) == set(PAYLOADS) | set(adapters._SAMPLES)
    assert len(adapters.SPECS) == 29


def test_listings(spark):
    items = spark.createDataFrame([("Data Intern", "Acme", "https://jobs.lever.co/acme/1"), ("Founding Engineer", "B", "https://b.example"), ("CTO", "C", "https://c.example")], "title string, company string, url string").selectExpr("*", "cast(null as string) as location", "cast(null as string) as posted", "'feed' as source", "'' as text")
    assert [(r.ats, r.token) for r in adapters.listings(items).collect()] == [("lever", "acme")]
    assert {r.title for r in adapters.listings(items, keep_early=True).collect()} == {"Data Intern", "Founding Engineer"}


@pytest.mark.parametrize("n", [0, 1, 2, 298, 299, 300, 301])
@pytest.mark.parametrize("least", [1, 2, 300])
def test_content_free_counts_what_stands_between_the_ends(spark, n, least):
    inner = ("a" + "é \n" * n)[: n - 1] + "z" if n > 1 else "a" * n
    text = "\u2003 \n" + inner + "\t " * 400
    q = spark.createDataFrame([(text,)], "t string").select(classify.quality(F.lit("Role"), F.col("t"), F.lit("lever"), F.lit(0), F.lit(False), least_chars=least).alias("q")).first().q
    assert ("content_free" in q.flags) == (len(text.strip()) < least)
