"""Boards, hosts and channels read out of urls: chains of rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Path words that are never a board's token.
RESERVED = ["embed", "job_board", "jobs", "postings", "posting-api", "api", "v0", "v1", "boards", "job-board", "companies", "accounts", "careers", "o", "j", "search", "apply"]
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9_-]{1,62}$"
#: Fixed values: (host, path word before the token, board system).
AFTER_WORD = [
    ("jobs.jobvite.com", "careers", "jobvite"), ("jobs.dover.com", "companies", "dover"), ("careers.icims.com", "jobs", "icims"), ("jobs.adp.com", "company", "adp"),
    ("www.comeet.com", "jobs", "comeet"), ("www.comeet.co", "jobs", "comeet"), ("www.governmentjobs.com", "careers", "neogov"), ("governmentjobs.com", "careers", "neogov"),
]
#: Fixed values: (host, board system); the token is the first path word.
FIRST_WORD = [("recruiting.ultipro.com", "ultipro"), ("recruiting.paylocity.com", "paylocity")]
#: Fixed values: (host suffix, board system); the token is the label before it.
SUBDOMAINS = [
    (".fa.oraclecloud.com", "oracle_cloud"), (".recruitee.com", "recruitee"), (".jobs.personio.de", "personio"), (".jobs.personio.com", "personio"), (".breezy.hr", "breezy"),
    (".applytojob.com", "jazzhr"), (".bamboohr.com", "bamboohr"), (".rippling-ats.com", "rippling"), (".zohorecruit.com", "zohorecruit"), (".pinpointhq.com", "pinpoint"),
    (".teamtailor.com", "teamtailor"), (".eightfold.ai", "eightfold"), (".phenompeople.com", "phenom"), (".successfactors.com", "successfactors"), (".successfactors.eu", "successfactors"), (".taleo.net", "taleo"),
]
#: Parts of hosts of federated servers.
FEDERATED = ["mastodon", "fosstodon", "hachyderm", "infosec.exchange", "mas.to", "fediverse", "ioc.exchange", "techhub.social", "social."]
PROVIDERS = {"twitter": "x", "mastodon": "mastodon", "bluesky": "bluesky", "linkedin": "linkedin", "generic": "site"}
#: Hosts that are never a company's own.
NOT_A_COMPANY = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "recruitee.com", "personio.com", "breezy.hr", "applytojob.com", "bamboohr.com", "jobvite.com",
    "zohorecruit.com", "dover.com", "rippling-ats.com", "myworkdayjobs.com", "icims.com", "ultipro.com", "adp.com", "paylocity.com", "linkedin.com", "indeed.com", "glassdoor.com",
    "github.com", "google.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "crunchbase.com", "wellfound.com", "angel.co", "themuse.com",
]


def host(url: Column) -> Column:
    """Lower-case host with port, of a url with or without a scheme; null: empty."""
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.coalesce(F.regexp_extract(full, r"^[^/?#]*//([^/?#]*)", 1), F.lit("")))


def path_words(url: Column) -> Column:
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.filter(F.split(F.regexp_extract(full, r"^[^/?#]*//[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]+)", 1), F.lit(""))


def token(c: Column) -> Column:
    """The token, or null if it is empty, reserved or of the wrong form."""
    c = F.regexp_replace(F.trim(c), "^/+|/+$", "")
    return F.when(c.rlike(TOKEN) & ~F.lower(c).isin(RESERVED), c)


def word(parts: Column, n: int) -> Column:
    return F.try_element_at(parts, F.lit(n))


def word_after(parts: Column, name: str) -> Column:
    at = F.array_position(parts, name)
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def board(url: Column) -> Column:
    """STRUCT(ats, token) of the board that a url belongs to, null if none. The first rule that gives a token wins.

    Host and path are read once, as the variable of a function over an array of one: inlined into every rule they would fill the plan."""
    read = F.struct(host(url).alias("h"), path_words(url).alias("p"), query_value(url, "for").alias("asked"))
    return F.transform(F.array(read), _board)[0]


def _board(x: Column) -> Column:
    h, parts, asked = x["h"], x["p"], x["asked"]
    in_ = lambda n: F.contains(h, F.lit(n))
    starts = lambda n: F.startswith(h, F.lit(n))
    api = lambda n, *versions: starts(n) & (F.size(parts) >= 2) & word(parts, 1).isin(*versions)
    skipped = word(parts, 1).isin("embed", "v1").cast("int")
    skipped = F.coalesce(skipped, F.lit(0)) + F.coalesce((F.try_element_at(parts, F.coalesce(skipped, F.lit(0)) + 1) == "boards").cast("int"), F.lit(0))
    #: (system, condition, word that should be the token)
    rules = [
        ("greenhouse", in_("greenhouse.io") & (asked.isNotNull() | ~F.coalesce(api("boards-api", "v1"), F.lit(False))), F.coalesce(asked, F.try_element_at(parts, skipped + 1))),
        ("lever", in_("lever.co"), F.when(api("api.lever.co", "v0", "v1"), word(parts, 3)).otherwise(word(parts, 1))),
        ("ashby", in_("ashbyhq.com"), F.when(starts("api.ashbyhq.com"), word_after(parts, "job-board")).otherwise(word(parts, 1))),
        ("smartrecruiters", in_("smartrecruiters.com"), F.when(starts("api.smartrecruiters.com"), word_after(parts, "companies")).otherwise(word(parts, 1))),
        ("workable", in_("workable.com"), F.when(starts("apply.workable.com"), word(parts, 1)).when(starts("www.workable.com") | starts("workable.com"), word_after(parts, "accounts")).otherwise(F.split_part(h, F.lit(".workable.com"), F.lit(1)))),
        ("workday", F.endswith(h, F.lit(".myworkdayjobs.com")), F.split_part(h, F.lit("."), F.lit(1))),
    ]
    rules += [(ats, (h == n) | F.endswith(h, F.lit("." + n)), word_after(parts, w)) for n, w, ats in AFTER_WORD]
    rules += [(ats, (h == n) | F.endswith(h, F.lit("." + n)), word(parts, 1)) for n, ats in FIRST_WORD]
    rules += [(ats, F.endswith(h, F.lit(n)), F.substring_index(F.substring(h, F.lit(1), F.length(h) - len(n)), ".", -1)) for n, ats in SUBDOMAINS]
    meant = F.filter(F.array(*(F.when(hit, F.struct(F.lit(ats).alias("ats"), t.alias("token"))) for ats, hit, t in rules)), lambda c: c["token"].isNotNull())
    trimmed = F.transform(meant, lambda c: F.struct(c["ats"].alias("ats"), F.regexp_replace(F.trim(c["token"]), "^/+|/+$", "").alias("token")))
    return F.try_element_at(F.filter(trimmed, lambda c: c["token"].rlike(TOKEN) & ~F.lower(c["token"]).isin(RESERVED)), F.lit(1))


def workday_site(url: Column) -> Column:
    """tenant/site of a workday url: the first path word that is no locale and not wday."""
    h = host(url)
    site = word(F.filter(path_words(url), lambda p: ~p.rlike("^[a-z]{2}-[A-Za-z]{2}$") & (F.lower(p) != "wday")), 1)
    tenant = F.split_part(h, F.lit("."), F.lit(1))
    ok = F.endswith(h, F.lit(".myworkdayjobs.com")) & (F.size(F.split(h, r"\.")) >= 4) & tenant.rlike(TOKEN) & site.rlike(TOKEN)
    return F.when(ok, F.concat_ws("/", tenant, site))


def boards_in_html(markup: Column) -> Column:
    """Distinct boards of all urls in a page, in order of first appearance."""
    plain = markup
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    urls = F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(r"""(?i)https?://[^\s"'<>)]+"""), F.lit(0))
    return F.array_distinct(F.filter(F.transform(F.array_distinct(urls), board), lambda b: b.isNotNull()))


def channel_kind(url: Column) -> Column:
    h = F.regexp_replace(host(F.trim(F.coalesce(url, F.lit("")))), r"^www\.", "")
    in_ = lambda x: F.contains(h, F.lit(x))
    federated = in_(FEDERATED[0])
    for x in FEDERATED[1:]:
        federated = federated | in_(x)
    return (
        F.when(in_("linkedin.com"), "linkedin").when(h.isin("x.com", "twitter.com", "t.co") | F.endswith(h, F.lit(".twitter.com")), "x")
        .when(in_("github.com"), "github").when(in_("bsky.") | in_("bluesky"), "bluesky").when(federated, "mastodon").otherwise("site")
    )


def channel_of(provider: Column, url: Column) -> Column:
    named = None
    for k, v in PROVIDERS.items():
        named = F.when(F.lower(provider) == k, v) if named is None else named.when(F.lower(provider) == k, v)
    return F.coalesce(named, channel_kind(url))


def channel_value(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")


def is_company_domain(domain: Column) -> Column:
    d = F.regexp_replace(F.lower(domain), r"^www\.", "")
    bad = d.isin(NOT_A_COMPANY)
    for x in NOT_A_COMPANY:
        bad = bad | F.endswith(d, F.lit("." + x))
    return F.coalesce((d != "") & ~bad, F.lit(False))


def mail_provider(mx: Column) -> Column:
    m = F.lower(mx)
    return (
        F.when(mx.isNull() | (mx == ""), "unknown").when(F.contains(m, F.lit("outlook.com")), "microsoft")
        .when(F.endswith(m, F.lit("google.com")) | F.endswith(m, F.lit("googlemail.com")) | F.contains(m, F.lit("aspmx")), "google").otherwise("other")
    )


def spf_provider(record: Column) -> Column:
    t = F.lower(record)
    return F.when(F.startswith(t, F.lit("v=spf1")), F.when(F.contains(t, F.lit("include:spf.protection.outlook.com")), "microsoft").when(F.contains(t, F.lit("include:_spf.google")), "google"))
