"""Channels that find boards: rows of an index, a search, a certificate log or a page come to distinct (ats, token).

Every function takes what a channel has answered as a table; fetching is left to the caller. A board's first url in input order is kept
as source_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarryline.functions import text, urls
from quarryline.operators import filings, graph
from quarryline.sources import html

#: Names of services below a board system's domain that are no company's board.
INFRASTRUCTURE = [
    "s3", "www", "api", "cdn", "assets", "static", "img", "images", "media", "files", "mail", "smtp", "imap", "pop", "ftp", "ns1", "ns2", "mx", "email", "blog", "status", "help", "support", "docs", "app", "apps", "admin", "dev",
    "staging", "stage", "test", "demo", "go", "get", "info", "download", "downloads", "cname", "track", "links", "link", "auth", "login", "sso", "id", "account", "accounts", "portal", "secure", "vpn",
]
#: Words of a careers host, and the hosts to try for a company.
CAREERS = r"(?i)\b(careers?|jobs?|talent|apply|recruit(?:ing)?|work|hiring)\b"
CAREER_HOSTS = ["careers", "jobs", "apply", "work", "talent", "join"]
#: Hosts that a portfolio links to beside its companies.
NO_PORTFOLIO = ["twitter.com", "x.com", "linkedin.com", "facebook.com", "youtube.com", "instagram.com", "github.com", "medium.com", "crunchbase.com", "apple.com", "google.com"]
FUND = r"(?i)fund|investment|pooled|spv"


def found(links: DataFrame, url: str = "url", order: str = "ord", workday_sites: bool = False) -> DataFrame:
    """(ats, token, source_url): the distinct boards of urls. A workday board is its tenant, or tenant/site where asked for and given."""
    b = urls.board(F.col(url))
    if workday_sites:
        site = urls.workday_site(F.col(url))
        b = F.when(site.isNotNull(), F.struct(F.lit("workday").alias("ats"), site.alias("token"))).otherwise(b)
    each = links.select(b.alias("b"), F.col(url).alias("source_url"), F.col(order).alias("ord")).where("b IS NOT NULL")
    return each.groupBy("b.ats", "b.token").agg(F.min_by("source_url", F.struct("ord", "source_url")).alias("source_url"))


def index_lines(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """(ord, url) of a crawl index's JSON lines. answers: ord, body. Lines that don't parse are left out; `limit` bounds each answer's."""
    line = answers.select("ord", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).select("ord", "n", F.from_json(F.trim("line"), "STRUCT<url STRING, _corrupt_record STRING>", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), F.trim("line").alias("line"))
    read = line.where("line <> '' AND r IS NOT NULL AND r._corrupt_record IS NULL")
    if limit is not None:
        read = read.groupBy("ord").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "r.url"))), 1, limit).alias("rows")).select("ord", F.explode("rows").alias("x")).select("ord", "x.n", "x.url")
    else:
        read = read.select("ord", "n", "r.url")
    return read.where("url IS NOT NULL").select(F.struct("ord", "n").alias("ord"), "url")


def archive_rows(answers: DataFrame) -> DataFrame:
    """(ord, url) of a web archive's answers: JSON arrays of rows, of which the first is a header."""
    rows = answers.select("ord", F.posexplode(F.from_json("body", "ARRAY<ARRAY<STRING>>")).alias("n", "r"))
    return rows.where("n > 0 AND size(r) > 0").select(F.struct("ord", "n").alias("ord"), F.col("r")[0].alias("url"))


def scan_results(answers: DataFrame) -> DataFrame:
    """(ord, url) of url scans: each result's task and page."""
    rows = answers.select("ord", F.posexplode(F.from_json("body", "STRUCT<results ARRAY<STRUCT<task STRUCT<url STRING>, page STRUCT<url STRING>>>>").getField("results")).alias("n", "r"))
    return rows.select("ord", "n", F.posexplode(F.array("r.task.url", "r.page.url")).alias("k", "url")).where("url IS NOT NULL").select(F.struct("ord", "n", "k").alias("ord"), "url")


def search_results(answers: DataFrame) -> DataFrame:
    """(ord, url) of a search engine's answers."""
    rows = answers.select("ord", F.posexplode(F.from_json("body", "STRUCT<results ARRAY<STRUCT<url STRING>>>").getField("results")).alias("n", "r"))
    return rows.where("r.url IS NOT NULL").select(F.struct("ord", "n").alias("ord"), F.col("r.url").alias("url"))


def comment_links(comments: DataFrame, root: Column, depth: int = 100) -> DataFrame:
    """(ord, url): the urls in the texts of a thread and of all answers below it, down to `depth`. comments: id, parent (one), body. Each
    round takes one level of answers; a level without any ends it."""
    answers = comments.select("id", "parent")
    level = graph.cut(comments.where(root).select("id"))
    seen = level
    for _ in range(depth):
        level = graph.cut(answers.join(level.select(F.col("id").alias("parent")), "parent").select("id"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    plain = F.col("body")
    for name, char in (("&#x2F;", "/"), ("&#x27;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return comments.join(seen.distinct(), "id").select("id", F.posexplode(text.all_urls(plain)).alias("n", "url")).select(F.struct("id", "n").alias("ord"), "url")


def quad_links(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ord, url) of N-Quads lines whose predicate names a posting's url, its apply url or its company."""
    own = lines.where(F.col(column).rlike(r"(?i)schema\.org/(?:url|applyUrl|sameAs|hiringOrganization)"))
    links = F.transform(F.regexp_extract_all(F.col(column), F.lit(r'https?://[^\s<>"]+'), F.lit(0)), lambda u: F.regexp_replace(u, "[>.,]+$", ""))
    return own.select(F.col(column).alias("line"), F.posexplode(links).alias("n", "url")).select(F.struct("line", "n").alias("ord"), "url")


def careers_hosts(names: DataFrame, column: str, domain: str) -> DataFrame:
    """Distinct hosts below a company's domain that a careers word names."""
    hosts = filings.logged_hosts(names, column, domain)
    return hosts.where(F.expr("substring(host, 1, length(host) - {n})".format(n=len(domain) + 1)).rlike(CAREERS))


def boards_of_hosts(names: DataFrame, column: str, domain: str) -> DataFrame:
    """Boards of the hosts below a board system's domain, those of its own services left out."""
    hosts = filings.logged_hosts(names, column, domain).select(F.concat(F.lit("https://"), "host").alias("url"), F.col("host").alias("ord"))
    return found(hosts).where(~F.lower("token").isin(INFRASTRUCTURE) & (F.length("token") >= 2))


def named_hosts(domains: DataFrame, aliases: DataFrame, hops: int = 5) -> DataFrame:
    """(domain, ord, url) of the careers hosts of each domain and of up to `hops` names that each stands for. aliases: name, target, one
    row a name. Every hop is an equi-join."""
    hosts = domains.select("domain", F.posexplode(F.array(*map(F.lit, CAREER_HOSTS))).alias("sub", "label")).select("domain", "sub", F.concat_ws(".", "label", "domain").alias("host"))
    steps = [hosts.withColumns({"hop": F.lit(0), "path": F.array(F.lit("").cast("string"))})]
    alias = aliases.select(F.lower(F.regexp_replace("name", r"\.+$", "")).alias("host"), F.lower(F.regexp_replace("target", r"\.+$", "")).alias("target"))
    for hop in range(1, hops + 1):
        last = steps[-1]
        steps.append(last.join(alias, "host").where((F.col("target") != "") & ~F.array_contains("path", F.col("target"))).select("domain", "sub", F.col("target").alias("host"), F.lit(hop).alias("hop"), F.concat("path", F.array("target")).alias("path")))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.select("domain", F.struct("domain", "sub", "hop").alias("ord"), F.concat(F.lit("https://"), "host").alias("url"))


def robots_sitemaps(robots: DataFrame, column: str = "body") -> DataFrame:
    """(site, url) of the sitemaps that robots files name, or the usual place where they name none. robots: site, body (null: no file)."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\r?\n"), F.trim), lambda x: F.startswith(F.lower(x), F.lit("sitemap:")))
    named = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 9, 1 << 20))), lambda x: x != "")
    return robots.select("site", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.concat("site", F.lit("/sitemap.xml"))))).alias("url"))


def sitemap_links(roots: DataFrame, files: DataFrame, depth: int = 2, most: int | None = 5000) -> DataFrame:
    """(site, ord, url): the places that a site's sitemaps give, over sitemaps of sitemaps down to `depth`, by file and place in it; the
    first `most` of each site, all if it is None. A window counts the places of the files before, so no site is gathered in a row.
    roots: site, url; files: url, body."""
    inner = lambda tag: F.transform(F.regexp_extract_all("body", F.lit(rf"(?s)<{tag}>\s*<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    read = files.select("url", inner("sitemap").alias("maps"), F.filter(inner("url"), lambda u: u != "").alias("places"))
    level, seen = roots.select("site", "url").distinct(), None
    for _ in range(depth + 1):
        own = level.join(read, "url")
        seen = own if seen is None else seen.unionByName(own)
        level = own.select("site", F.explode("maps").alias("url")).distinct().join(seen.select("site", "url"), ["site", "url"], "left_anti")
    before = F.sum(F.size("places")).over(Window.partitionBy("site").orderBy("url", "places").rowsBetween(Window.unboundedPreceding, -1))
    each = seen.where("size(places) > 0").withColumn("before", F.coalesce(before, F.lit(0)))
    if most is not None:
        each = each.where(F.col("before") < most).withColumn("places", F.slice("places", 1, (most - F.col("before")).cast("int")))
    return each.select("site", "before", F.posexplode("places").alias("n", "url")).select("site", (F.col("before") + F.col("n")).alias("ord"), "url")


def posting_links(pages: DataFrame) -> DataFrame:
    """(page, ord, url): the links of a page's JSON-LD postings (url, applyUrl, sameAs, the organisation's sameAs), then the page itself.
    pages: url, html."""
    read = html.parsed(pages, "url", "html").select(F.col("url").alias("page"), F.from_json(F.concat(F.lit("["), F.array_join(html.job_postings("scripts"), ","), F.lit("]")), "ARRAY<STRUCT<url STRING, applyUrl STRING, sameAs STRING, hiringOrganization STRUCT<sameAs STRING>>>").alias("p"))
    own = F.flatten(F.transform("p", lambda p: F.concat(F.filter(F.array(p["url"], p["applyUrl"], p["sameAs"]), lambda u: F.startswith(u, F.lit("http"))), F.filter(F.array(p["hiringOrganization"]["sameAs"]), lambda u: u.isNotNull()))))
    return read.select("page", F.posexplode(F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array("page")))).alias("ord", "url"))


def searched_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Boards of a search's results: of the url itself where it belongs to one, else of the JSON-LD of its page. results: ord, url; pages: url, html."""
    own = results.select("ord", "url", urls.board(F.col("url")).isNotNull().alias("direct")).groupBy("url").agg(F.min("ord").alias("ord"), F.first("direct").alias("direct"))
    read = posting_links(pages.join(own.where("NOT direct").select("url"), "url", "left_semi"))
    links = read.join(own.select(F.col("url").alias("page"), F.col("ord").alias("o")), "page").select(F.struct("o", F.col("ord").alias("n")).alias("ord"), "url")
    return found(own.where("direct").select(F.struct(F.col("ord").alias("o"), F.lit(0).alias("n")).alias("ord"), "url").unionByName(links))


def active_companies(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Active companies with a site, hiring ones first, in input order. companies: ord, name, status, website, isHiring."""
    out = companies.where("status = 'Active' AND website IS NOT NULL").orderBy(F.coalesce("isHiring", F.lit(False)).desc(), "ord")
    return out if limit is None else out.limit(limit)


def portfolio_sites(pages: DataFrame) -> DataFrame:
    """Distinct sites that portfolio pages link to, other than their own and those of networks. pages: url, html."""
    links = html.parsed(pages, "url", "html").select(F.col("url").alias("page"), F.explode("links").alias("l")).where(F.startswith("l.href", F.lit("http")))
    host = urls.host(F.col("l.href"))
    skip = host == ""
    for x in NO_PORTFOLIO:
        skip = skip | F.contains(host, F.lit(x))
    return links.where(~skip & (host != urls.host(F.col("page")))).select(F.concat(F.lit("https://"), host).alias("site")).distinct()


def first_path(pages: DataFrame) -> DataFrame:
    """(site, ats, token): the boards of the first of a site's careers pages that has any. pages: site, ord, html."""
    read = pages.select("site", "ord", urls.boards_in_html(F.col("html")).alias("b")).where("size(b) > 0")
    return read.groupBy("site").agg(F.min_by("b", "ord").alias("b")).select("site", F.explode("b").alias("b")).select("site", "b.ats", "b.token")


def offerings(filings_: DataFrame, column: str = "xml") -> DataFrame:
    """entity, industry and officers (array of names) of Form D filings, those of funds left out; other columns stay."""
    one = lambda c, tag: F.trim(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    tag = lambda c, name: F.nullif(one(c, name), F.lit(""))
    people = F.regexp_extract_all(column, F.lit(r"(?s)<relatedPersonName>(.*?)</relatedPersonName>"), F.lit(1))
    names = F.filter(F.transform(people, lambda p: F.concat_ws(" ", tag(p, "firstName"), tag(p, "middleName"), tag(p, "lastName"))), lambda n: n != "")
    out = filings_.withColumns({"entity": tag(F.col(column), "entityName"), "industry": tag(F.col(column), "industryGroupType"), "officers": names}).drop(column)
    return out.where("entity IS NOT NULL").where(~F.coalesce(F.col("industry").rlike(FUND), F.lit(False)))


def code_links(answers: DataFrame) -> DataFrame:
    """Boards of a code search: of each item's url, then of the fragments that matched. answers: ord, body."""
    rows = answers.select("ord", F.posexplode(F.from_json("body", "STRUCT<items ARRAY<STRUCT<html_url STRING, text_matches ARRAY<STRUCT<fragment STRING>>>>>").getField("items")).alias("n", "r"))
    inside = F.flatten(F.transform("r.text_matches", lambda m: urls.boards_in_html(m["fragment"])))
    both = F.concat(F.array(urls.board(F.col("r.html_url"))), F.coalesce(inside, F.expr("array()").cast("array<struct<ats:string,token:string>>")))
    each = rows.select("ord", "n", F.posexplode(both).alias("k", "b")).where("b IS NOT NULL")
    return each.groupBy("b.ats", "b.token").agg(F.min(F.struct("ord", "n", "k")).alias("first")).select("ats", "token")


def reresolved(jobs: DataFrame, pages: DataFrame, limit: int = 2000) -> DataFrame:
    """Distinct boards behind postings whose format is listing: of the url, or of any url in its page. jobs: ats, url; pages: url, html."""
    links = jobs.where("ats = 'listing'").select("url").distinct().orderBy("url").limit(limit)
    both = links.join(pages, "url", "left").select(F.explode(F.concat(F.array(urls.board(F.col("url"))), F.coalesce(urls.boards_in_html(F.col("html")), F.expr("array()").cast("array<struct<ats:string,token:string>>")))).alias("b"))
    return both.where("b IS NOT NULL").select("b.ats", "b.token").distinct()
