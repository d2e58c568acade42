"""Settings files, registries, workbooks, and files that are written."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryline.operators import dossier, merge, tracker
from quarryline.sources import boards, html, settings


def test_targets_and_connections(tmp_path):
    (tmp_path / "t.yaml").write_text("enabled: true\nfirms:\n  - name: Acme Inc\n    domains: [www.Acme.com]\n    priority: high\n  - {name: ''}\nkeywords: {include: [Python], exclude: sales}\nlocations: [Berlin]\nremote_ok: false\n")
    t = settings.load_targets(tmp_path / "t.yaml")
    assert t.firms == [("Acme Inc", "acme-inc", ["acme.com"], "high")] and t.include == ["python"] and t.exclude == ["sales"] and t.locations == ["berlin"] and not t.remote_ok and t.enabled
    (tmp_path / "bad.yaml").write_text("a: [b\n")
    (tmp_path / "list.yaml").write_text("- a\n")
    assert not settings.load_targets(tmp_path / "bad.yaml").enabled and not settings.load_targets(tmp_path / "list.yaml").enabled and not settings.load_targets(tmp_path / "none.yaml").enabled
    (tmp_path / "c.yaml").write_text("connections:\n  - {name: Ann Lee, relationship: ex-colleague, firms: Acme, domains: [www.acme.com]}\n  - 5\n  - {firms: [x]}\n")
    assert [(c.name, c.firms, c.domains, c.relationship) for c in settings.load_connections(tmp_path / "c.yaml")] == [("Ann Lee", ["Acme"], ["acme.com"], "ex-colleague")]
    assert settings.load_connections(tmp_path / "bad.yaml") == []


def test_profile_and_resume(tmp_path):
    (tmp_path / "p.yaml").write_text("skills: [a, {x: b}]\nrole: c\nother: d\n")
    assert settings.load_profile(tmp_path / "p.yaml", ["role", "skills", "none"]) == "c. a. b"
    (tmp_path / "cv.txt").write_text("  text ")
    assert settings.load_resume(tmp_path / "cv") == "text" and settings.load_resume(tmp_path / "none") is None


def test_registry_lines(spark, tmp_path):
    path = str(tmp_path / "boards")
    settings.append_boards(spark.createDataFrame([("lever", "a", "A"), ("ashby", "b", None)], "ats string, token string, company string"), path)
    (tmp_path / "boards" / "bad.json").write_text('{"ats": "lever"\n{"ats": "lever", "token": ""}\n')
    assert {tuple(r) for r in settings.load_boards(spark, path).collect()} == {("lever", "a", "A"), ("ashby", "b", None)}
    assert [r.token for r in settings.load_boards(spark, path, "ashby").collect()] == ["b"]
    found = spark.createDataFrame([("lever", "a", None), ("lever", "c", "C"), ("lever", "c", "B")], "ats string, token string, company string")
    known = spark.createDataFrame([("lever", "a", "active", 5, 1)], "ats string, token string, status string, total_jobs_seen int, consecutive_failures int")
    assert {tuple(r) for r in merge.merge_boards(known, found).collect()} == {("lever", "a", "active", 5, 1), ("lever", "c", "discovered", 0, 0)}
    (tmp_path / "urls.jsonl").write_text('{"url": "https://a"}\n{bad\n{"url": "ftp://x"}\n{"url": "http://b"}\n')
    assert [r.url for r in settings.load_urls(spark, str(tmp_path / "urls.jsonl")).orderBy("ord").collect()] == ["https://a", "http://b"]


def workbook(rows):
    """A workbook of shared, inline and plain cells, some left out."""
    strings, cells = [], []
    for i, row in enumerate(rows, 1):
        out = []
        for j, v in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, int):
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif j % 2:
                out.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                strings.append(v)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
        cells.append(f'<row r="{i}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return buffer.getvalue()


def test_workbooks(spark, tmp_path):
    rows = [["NAME", "SOC", "NAME", None, "N"], ["a", "15", "second", None, 1], [None, "16", None, None, 2]]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.xlsx").write_bytes(workbook(rows))
    with zipfile.ZipFile(tmp_path / "w" / "two.zip", "w") as z:
        z.writestr("in/x.xlsx", workbook(rows[:2]))
        z.writestr("readme.txt", "x")
    got = settings.read_workbooks(spark, str(tmp_path / "w"), ["NAME", "NAME__1", "SOC", "N", "OTHER"]).collect()
    assert sorted(((r.file.rsplit("/", 1)[1], r.ord, r.NAME, r.NAME__1, r.SOC, r.N, r.OTHER) for r in got), key=lambda r: r[:2]) == [("one.xlsx", 0, "a", "second", "15", "1", None), ("one.xlsx", 1, None, None, "16", "2", None), ("two.zip", 0, "a", "second", "15", "1", None)]
    assert settings.read_workbooks(spark, str(tmp_path / "w"), ["NAME"], most_rows=1).count() == 2


def lines(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_feed_and_dossier_files(spark, tmp_path):
    from xml.etree import ElementTree

    jobs = spark.createDataFrame([("a", "T & co", "https://x/1", "Acme", 1704067200), ("b", "U", "https://x/2", None, None)], "job_uid string, title string, url string, company string, posted long")
    tracker.feed(jobs, "Own", "https://own", "New", str(tmp_path / "feed"))
    root = ElementTree.fromstring(lines(tmp_path / "feed"))
    assert [(i.find("title").text, i.find("description").text) for i in root.iter("item")] == [("T & co", "T & co at Acme"), ("U", "U at unknown")] and root.find("channel/item/pubDate").text == "Mon, 01 Jan 2024 00:00:00 +0000"
    d = spark.createDataFrame([("s1", "Firm 1", "low", "Ann"), ("s2", "Firm 2", "high", None)], "company_slug string, company_name string, confidence string, contact_name string").withColumn("built_on", F.to_date(F.lit("2024-03-01")))
    for c in ("summary", "stage", "team_size", "signal_title", "signal_url", "signal_date", "contact_title", "contact_email", "contact_source", "contact_channel", "why_fit", "notes"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    dossier.write_files(d.withColumn("sources", F.lit(None).cast("array<struct<url:string,kind:string>>")), str(tmp_path / "d"))
    index = json.loads(lines(tmp_path / "d" / "index"))
    assert index["s1"] == {"company": "Firm 1", "confidence": "low", "built_at": "2024-03-01", "contact": "Ann", "file": "s1.md"} and index["s2"]["contact"] is None
    assert lines(tmp_path / "d" / "documents" / "company_slug=s2").startswith("# Firm 2 — dossier\n_built 2024-03-01")


def test_cards():
    page = '<div class="a b"><h3>One <b>x</b></h3><a href="/u?q" data-k="v w">L</a><p class="c">t</p></div><div class="a"><ul><li><a href="/2">M</a><li>N</ul></div>'
    got = html.cards(page, "div.a", {"title": (["h3"], "spaced"), "joined": (["h3"], "text"), "href": (["a[data-k*=w]", "a[href]"], "@href"), "own": ([""], "@class"), "none": (["h9"], "text"), "markup": (["p.c"], "markup")})
    assert got[0] == {"title": "One x", "joined": "Onex", "href": "/u?q", "own": "a b", "markup": '<p class="c">t</p>'} and got[1] == {"href": "/2", "own": "a"}
    assert [c["t"] for c in html.cards(page, "li", {"t": ([""], "text")})] == ["M", "N"] and html.cards(page, "div.a li a", {"h": ([""], "@href")}) == [{"h": "/2"}] and html.cards(None, "a", {}) == []


@pytest.mark.parametrize("url, want", [("https://boards.greenhouse.io/embed/job_board?for=acme", ("greenhouse", "acme")), ("https://boards-api.greenhouse.io/v1/boards/acme", None), ("https://boards.greenhouse.io/v1/boards/acme/jobs", ("greenhouse", "acme")), ("https://api.lever.co/v0/postings/xy", ("lever", "xy")), ("https://acme.workable.com/j/1", ("workable", "acme")), ("https://jobs.lever.co/jobs", None), ("https://x.example/y", None), (None, None)])
def test_board_rules(spark, url, want):
    from quarryline.functions import urls

    got = spark.createDataFrame([(url,)], "u string").select(urls.board(F.col("u")).alias("b")).first().b
    assert (got and tuple(got)) == want


def test_reresolved_and_first_urls(spark):
    links = spark.createDataFrame([(2, "https://jobs.lever.co/ab/2"), (1, "https://jobs.lever.co/ab/1"), (3, None)], "ord int, url string")
    assert [tuple(r) for r in boards.found(links).collect()] == [("lever", "ab", "https://jobs.lever.co/ab/1")]
