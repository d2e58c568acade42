"""Company dossiers: facts and dated links out of pages, synthesis held to its material, contacts, confidence, drafts and files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quarryline.functions import text
from quarryline.operators import relational
from quarryline.sources import html

_STAGE = r"(?i)\b(pre-?seed|seed(?:\s+round|\s+stage)?|series\s+[a-f]|public(?:ly traded)?|bootstrapped|ipo)\b"
_TEAM = r"(?i)\b(\d{1,3}(?:,\d{3})?)\+?\s*(?:people|employees|person team)\b"
#: Roles in the order in which a dossier names a contact.
CONTACT_ROLES = ["founder", "recruiter", "hiring_manager", "eng_manager", "engineer"]


def _org_nodes(data, depth: int = 0):
    if depth > 6:
        return
    if isinstance(data, dict):
        kinds = data.get("@type")
        if any(isinstance(x, str) and x.lower() in ("organization", "corporation") for x in (kinds if isinstance(kinds, list) else [kinds])):
            yield data
        for value in data.values():
            yield from _org_nodes(value, depth + 1)
    elif isinstance(data, list):
        for x in data:
            yield from _org_nodes(x, depth + 1)


def _facts(scripts) -> dict[str, str]:
    out: dict[str, str] = {}
    for script in [] if scripts is None else scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        for node in _org_nodes(data):
            team = node.get("numberOfEmployees")
            team = team.get("value") if isinstance(team, dict) else team
            if team:
                out.setdefault("team_size", str(team))
            if isinstance(node.get("foundingDate"), str) and node["foundingDate"]:
                out.setdefault("founded", node["foundingDate"])
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def org_facts(scripts: pd.Series) -> pd.Series:
    """team_size and founded out of a page's JSON-LD organisations."""
    return scripts.map(_facts)


def description(markup: Column) -> Column:
    """A page's own description: the first filled meta tag of description, og:description, twitter:description."""
    metas = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
    both = lambda tag, name: F.concat(value(tag, name), other(tag, name))
    first = lambda name, key: F.nullif(text.strip(both(F.try_element_at(F.filter(metas, lambda m: F.lower(both(m, name)) == key), F.lit(1)), "content")), F.lit(""))
    plain = F.coalesce(first("name", "description"), first("property", "og:description"), first("name", "twitter:description"))
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return plain


_ITEMS = {"title": (["a[href]"], "spaced"), "href": (["a[href]"], "@href"), "time": (["time"], "@datetime"), "stamp": (["time"], "text"), "whole": ([""], "spaced"), "markup": ([""], "markup")}


def dated_links(pages: DataFrame, item: str = "li, article, p, div.post, div.item") -> DataFrame:
    """(url, ord, title, link, date, origin): a page's links of 15 characters or more, no questions, on its own host, that carry a date: of
    a time element or a date in the words of the item around them, or in the link's path. The first of a link counts. pages: url, html,
    origin. An item with more than one link dates none by its words."""
    cards = html.card_rows(item, _ITEMS)
    links = html.card_rows("a[href]", {"title": ([""], "spaced"), "href": ([""], "@href")})
    around = pages.select("url", "origin", F.posexplode(cards("html")).alias("n", "r")).select("url", "origin", "n", *(F.col("r").getItem(k).alias(k) for k in _ITEMS))
    plain = pages.select("url", "origin", F.posexplode(links("html")).alias("n", "r")).select("url", "origin", F.col("n").alias("ord"), F.col("r").getItem("title").alias("title"), F.col("r").getItem("href").alias("href"))
    day = lambda c: F.date_format(text.parsed_time(c), "yyyy-MM-dd")
    named = F.nullif(F.regexp_extract("whole", r"\b(?:\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+20\d{2})\b", 0), F.lit(""))
    alone = F.size(F.regexp_extract_all("markup", F.lit(r"(?is)<a\b[^>]*\bhref\b"), F.lit(0))) == 1
    tight = around.where(F.col("href").isNotNull() & alone).groupBy("url", "href").agg(F.min_by(F.struct(F.coalesce(day(F.nullif("time", F.lit(""))), day(F.nullif("stamp", F.lit("")))).alias("timed"), day(F.regexp_replace(named, r"\.", "")).alias("named")), F.length("whole")).alias("i"))
    year, month, dom = (F.nullif(F.regexp_extract("href", r"/(20\d{2})/(\d{1,2})(?:/(\d{1,2}))?(?:/|$)", k), F.lit("")) for k in (1, 2, 3))
    by_path = F.when(year.isNotNull(), F.date_format(F.try_to_timestamp(F.concat_ws("-", year, month, F.coalesce(dom, F.lit("1"))), F.lit("yyyy-M-d")), "yyyy-MM-dd"))
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    link = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat(host, "href")).otherwise(F.concat(F.regexp_replace("url", r"[^/]*$", ""), "href"))
    both = plain.where((F.length("title") >= 15) & ~F.endswith(F.rtrim("title"), F.lit("?"))).join(tight, ["url", "href"], "left").withColumns({"link": link, "date": F.coalesce("i.timed", by_path, "i.named"), "h": F.lower(host)})
    own = both.where((F.lower(F.regexp_extract("link", r"^([A-Za-z]+://[^/?#]+)", 1)) == F.col("h")) & F.col("date").isNotNull())
    return own.groupBy("url", "link").agg(F.min_by(F.struct("ord", F.substring("title", 1, 180).alias("title"), "date", "origin"), "ord").alias("x")).select("url", "x.ord", "x.title", "link", "x.date", "x.origin")


def recent(signals: DataFrame, today: Column, days: int, key: str = "slug") -> DataFrame:
    """Signals of the window, newest first, the first of each url. signals: key, ord, title, url, date (ISO), origin; n is their place."""
    own = signals.where((F.col("date") >= F.date_format(F.date_sub(today, days), "yyyy-MM-dd")) & (F.col("date") <= F.date_format(today, "yyyy-MM-dd")))
    first = own.groupBy(key, "url").agg(F.min_by(F.struct("title", "date", "origin", "ord"), F.struct((-F.unix_date(F.to_date("date"))).alias("d"), "ord")).alias("x")).select(key, "url", "x.*")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date"), "ord")) - 1)


def filed_signals(firms: DataFrame, officers: DataFrame, leads: DataFrame, now: Column, days: int) -> DataFrame:
    """(slug, ord, title, url, date, origin): a recent fundraising notice and a recent filing of each firm, one of each at most. firms: slug,
    name; officers and leads: company_slug (canonical), ord, filed_at (epoch seconds), leads also source."""
    own = firms.select("slug", text.canonical_company(F.col("name")).alias("company_slug"))
    since = now - days * 86400
    day = F.date_format(F.timestamp_seconds("filed_at"), "yyyy-MM-dd")
    o = officers.where(F.col("filed_at") >= since).join(own, "company_slug").groupBy("slug", "company_slug").agg(F.min_by("filed_at", "ord").alias("filed_at"))
    o = o.select("slug", F.lit(0).alias("ord"), F.lit("Filed SEC Form D (new fundraising round)").alias("title"), F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&company="), "company_slug").alias("url"), day.alias("date"), F.lit("edgar").alias("origin"))
    x = leads.where(F.col("filed_at") >= since).join(own, "company_slug").groupBy("slug").agg(F.min_by(F.struct("filed_at", "source"), "ord").alias("x")).select("slug", "x.*")
    x = x.select("slug", F.lit(1).alias("ord"), F.concat(F.lit("Government filing signal ("), "source", F.lit(")")).alias("title"), F.when(F.contains("source", F.lit("sbir")), "https://www.sbir.gov/awards").otherwise("https://www.dol.gov/agencies/eta/foreign-labor/performance").alias("url"), day.alias("date"), F.lit("disclosure").alias("origin"))
    return o.unionByName(x)


def material(description_: Column, pages: Column, facts: Column) -> Column:
    """What a synthesis may rest on: description, page texts, facts, line by line."""
    told = F.transform(F.array_sort(F.map_entries(F.coalesce(facts, F.expr("map()").cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.coalesce(description_, F.lit("")), F.array_join(F.coalesce(pages, F.array().cast("array<string>")), "\n"), F.array_join(told, "\n"))


def stage_in(c: Column) -> Column:
    return F.nullif(F.trim(F.replace(F.lower(F.regexp_extract(c, _STAGE, 0)), F.lit("-"), F.lit(" "))), F.lit(""))


def team_in(c: Column, facts: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(facts, F.lit("team_size")), F.lit("")), F.nullif(F.regexp_extract(c, _TEAM, 1), F.lit("")))


def synthesized(bundle: Column) -> Column:
    """STRUCT(summary, stage, team_size, signal, why_fit) without a model. bundle: a struct of description, pages (array of texts), facts
    (map) and signals (array of struct, newest first)."""
    own = material(bundle["description"], bundle["pages"], bundle["facts"])
    first = F.nullif(text.two_sentences(F.coalesce(bundle["description"], F.lit(""))), F.lit(""))
    return F.struct(F.coalesce(first, F.nullif(text.two_sentences(F.try_element_at(bundle["pages"], F.lit(1))), F.lit(""))).alias("summary"), stage_in(own).alias("stage"), team_in(own, bundle["facts"]).alias("team_size"), F.try_element_at(bundle["signals"], F.lit(1)).alias("signal"), F.lit(None).cast("string").alias("why_fit"))


def validated(reply: Column, bundle: Column) -> Column:
    """A model's synthesis (JSON) held to its material: stage and team size stay only if the material has them word for word, else come
    from it; a signal is taken by its index, none if the index is null outright, the newest if it is missing or no index."""
    own = material(bundle["description"], bundle["pages"], bundle["facts"])
    low, get = F.lower(own), lambda k: F.get_json_object(reply, f"$.{k}")
    quoted = lambda k: reply.rlike(rf'"{k}"\s*:\s*"')
    stage, team = F.lower(text.strip(get("stage"))), text.strip(get("team_size"))
    index = get("signal_index")
    number, signals = F.when(index.rlike(r"^-?\d{1,9}$") & ~quoted("signal_index"), index.cast("int")), bundle["signals"]
    signal = F.when((number >= 0) & (number < F.size(signals)), F.try_element_at(signals, number + 1)).when(reply.rlike(r'"signal_index"\s*:\s*null'), F.lit(None)).otherwise(F.try_element_at(signals, F.lit(1)))
    return F.struct(
        F.when(quoted("summary"), F.nullif(text.two_sentences(get("summary")), F.lit(""))).alias("summary"), F.when(quoted("stage") & (stage != "") & F.contains(low, stage), stage).otherwise(stage_in(own)).alias("stage"),
        F.when((team != "") & F.contains(low, F.lower(team)), team).otherwise(team_in(own, bundle["facts"])).alias("team_size"), signal.alias("signal"), F.when(quoted("why_fit"), F.nullif(text.strip(get("why_fit")), F.lit(""))).alias("why_fit"),
    )


def contact_of(contacts: DataFrame) -> DataFrame:
    """(company_slug, name, title, email, source): the person a dossier names, by role, then priority; only people with a name and a source,
    and only addresses that are verified or probable."""
    rank = F.lit(len(CONTACT_ROLES))
    for i, r in enumerate(CONTACT_ROLES):
        rank = F.when(F.col("role_category") == r, F.lit(i)).otherwise(rank)
    own = contacts.where("nullif(full_name, '') IS NOT NULL AND nullif(person_source, '') IS NOT NULL")
    best = own.groupBy("company_slug").agg(F.min_by(F.struct("full_name", "title", "email", "email_status", "linkedin_url", "person_source"), F.struct(rank.alias("r"), (-F.coalesce("priority", F.lit(0.0))).alias("p"), "contact_id")).alias("b"))
    return best.select("company_slug", F.col("b.full_name").alias("name"), "b.title", F.when(F.col("b.email_status").isin("verified", "probable"), F.col("b.email")).alias("email"), F.coalesce(F.nullif("b.linkedin_url", F.lit("")), F.concat(F.lit("contacts:"), "b.person_source")).alias("source"))


def fallback_channel(board_url: Column, domain: Column) -> Column:
    """Where to turn without a person: the board's page unless it is an API's, else the domain's careers page, else the board's."""
    return F.coalesce(F.when(~F.contains(board_url, F.lit("api.")), board_url), F.concat(F.lit("https://"), F.nullif(domain, F.lit("")), F.lit("/careers")), board_url)


def confidence(thin: Column, summary: Column, has_signal: Column, has_contact: Column) -> Column:
    return F.when(thin | F.nullif(summary, F.lit("")).isNull(), "low").when(has_signal & has_contact, "high").otherwise("medium")


def angle(tags: Column, company: Column, angles: dict[str, str]) -> Column:
    """The line of the first tag that has one, else the default line, with {company} filled in; empty without."""
    held = F.create_map(*(F.lit(x) for pair in angles.items() for x in pair)) if angles else F.expr("map()").cast("map<string,string>")
    lines = F.filter(F.transform(tags, lambda t: F.try_element_at(held, t)), lambda x: F.nullif(x, F.lit("")).isNotNull())
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(angles.get("default", "")))
    return F.replace(text.strip(line), F.lit("{company}"), company)


def intro_draft(name: Column, relationship: Column, company: Column, slug: Column, title: Column, url: Column) -> Column:
    """A request for an introduction."""
    filled = lambda c: F.nullif(c, F.lit(""))
    firm = F.coalesce(filled(company), filled(F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))), F.lit("the company"))
    first = F.coalesce(filled(F.split_part(text.strip(name), F.lit(" "), F.lit(1))), F.lit("there"))
    return F.concat(
        F.lit("Hi "), first, F.lit(" — hope you're doing well! "), firm, F.lit(" just posted a "), title, F.lit(" role ("), url, F.lit(") and I'm planning to apply right away. Given "), F.coalesce(filled(relationship), F.lit("your connection to the team")),
        F.lit(", would you be open to introducing me to someone on the team, or pointing me to the right person? Happy to send a two-line blurb and my resume to make it zero-effort. Thank you!"),
    )


def cold_draft(role: Column, company: Column, d: Column, proof: str = "recent shipped work") -> Column:
    """A first message out of a dossier d (a struct; null: no draft): company_name, contact_name, signal_title, signal_date, summary, why_fit."""
    filled = lambda c: F.nullif(c, F.lit(""))
    firm = F.coalesce(filled(d["company_name"]), company)
    person = filled(F.regexp_replace(F.split_part(text.strip(d["contact_name"]), F.lit(" "), F.lit(1)), "^,+|,+$", ""))
    news = F.when(filled(d["signal_title"]).isNotNull() & filled(d["signal_date"]).isNotNull(), F.concat(F.lit(" — and saw the "), d["signal_title"], F.lit(" news ("), d["signal_date"], F.lit(")"))).otherwise("")
    why = filled(F.regexp_replace(text.strip(F.coalesce(d["why_fit"], F.lit(""))), r"\.+$", ""))
    second = (
        F.when(filled(d["summary"]).isNotNull() & why.isNotNull(), F.concat(F.lit("I'm reaching out directly because what you're building is squarely my lane: "), why, F.lit(".")))
        .when(filled(d["summary"]).isNotNull(), F.lit("I'm reaching out directly rather than waiting in the applicant pile.")).when(why.isNotNull(), F.concat(F.lit("The short version of why I fit: "), why, F.lit(".")))
    )
    return F.when(d.isNotNull(), F.concat_ws("\n", F.concat(F.lit("Hi "), F.coalesce(person, F.concat(firm, F.lit(" team"))), F.lit(" — I just applied to your "), role, F.lit(" opening"), news, F.lit(".")), second, F.lit(f"Proof over promises: {{{{proof_link}}}} ({proof})."), F.lit("If it'd be useful I'd love 15 minutes — or I can send a one-page plan for what I'd ship in my first month.")))


def pending(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications without a dossier, with the domain of their posting's company (null: no such posting)."""
    own = jobs.groupBy("job_uid").agg(F.min("company_domain").alias("company_domain"))
    return applications.where("dossier_slug IS NULL").join(own, "job_uid", "left")


def enriched(applications: DataFrame, dossiers: DataFrame, hits: DataFrame, proof: str = "recent shipped work") -> DataFrame:
    """Pending applications (dossier_slug null) filled from their dossiers; nothing a user wrote is overwritten. hits: id and dossier_slug,
    as relational.cascade finds them. Rows without a dossier stay pending."""
    d = dossiers.select(F.col("company_slug").alias("hit"), F.struct(*dossiers.columns).alias("d"))
    both = applications.join(hits.select("id", F.col("dossier_slug").alias("hit")), "id", "left").join(d, "hit", "left")
    take = F.col("dossier_slug").isNull() & F.col("d").isNotNull()
    blank = lambda c: F.nullif(c, F.lit("")).isNull()
    person = take & blank(F.col("contact_name")) & ~blank(F.col("d.contact_name"))
    company = F.when(take & ~blank(F.col("d.company_name")) & (blank(F.col("company")) | (F.col("company") == F.col("company_slug"))), F.col("d.company_name")).otherwise(F.col("company"))
    new = {
        "dossier_slug": F.when(take, F.col("hit")).otherwise(F.col("dossier_slug")), "company": company, "contact_name": F.when(person, F.col("d.contact_name")).otherwise(F.col("contact_name")),
        "contact_email": F.when(person & ~blank(F.col("d.contact_email")), F.col("d.contact_email")).otherwise(F.col("contact_email")),
        "outreach_draft": F.when(take & ~F.coalesce("warm_intro", F.lit(False)) & F.col("outreach_draft").isNull(), cold_draft(F.col("role"), company, F.col("d"), proof)).otherwise(F.col("outreach_draft")),
    }
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in applications.columns))


def markdown(d: DataFrame, who: str = "the candidate") -> Column:
    """A dossier as a document. d: company_name, built_on (date), confidence, summary, stage, team_size, signal_title, signal_url,
    signal_date, contact_name, contact_title, contact_email, contact_source, contact_channel, why_fit, notes, sources (array of struct
    url, kind)."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    day = F.date_format("built_on", "yyyy-MM-dd")
    signal = F.when(filled("signal_title").isNotNull() & filled("signal_url").isNotNull(), say("- [", F.col("signal_title"), "](", F.col("signal_url"), ") — ", F.coalesce("signal_date", F.lit("None")))).otherwise(say("- None found in the last window (checked ", day, ")"))
    title, mail = F.coalesce(say(" — ", filled("contact_title")), F.lit("")), F.coalesce(say(" · ", filled("contact_email")), F.lit(""))
    contact = F.when(filled("contact_name").isNotNull(), say("**", F.col("contact_name"), "**", title, mail, "  \nsource: ", F.coalesce("contact_source", F.lit("None")))).otherwise(say("No named person verified — do NOT guess one. Best channel: ", F.coalesce(filled("contact_channel"), F.lit("the posting itself"))))
    sources = F.when(F.size(F.coalesce("sources", F.expr("array()").cast("array<struct<url:string,kind:string>>"))) > 0, F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s["url"], F.lit(" ("), F.coalesce(s["kind"], F.lit("page")), F.lit(")"))), "\n")).otherwise("- (none fetched)")
    lines = [
        say("# ", F.col("company_name"), " — dossier"), say("_built ", day, " · confidence: **", F.col("confidence"), "**_"), F.lit(""), F.lit("## What they do"), F.coalesce(filled("summary"), F.lit("_Not verified — public pages were unreachable or empty._")), F.lit(""),
        F.lit("## Stage & size"), say("- Stage: ", F.coalesce(filled("stage"), F.lit("not verified"))), say("- Team size: ", F.coalesce(filled("team_size"), F.lit("not verified"))), F.lit(""), F.lit("## Recent signal"), signal, F.lit(""), F.lit("## Likely contact"), contact, F.lit(""),
        F.lit(f"## Why {who} fits"), F.coalesce(filled("why_fit"), F.lit("_(no angle configured)_")), F.lit(""), F.when(filled("notes").isNotNull(), say("## Notes\n", F.col("notes"), "\n")), F.lit("## Sources"), sources,
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def index_entries(dossiers: DataFrame) -> DataFrame:
    """(company_slug, entry): the JSON entry of each dossier in the index."""
    entry = F.to_json(F.struct(F.col("company_name").alias("company"), "confidence", F.date_format("built_on", "yyyy-MM-dd").alias("built_at"), F.col("contact_name").alias("contact"), F.concat("company_slug", F.lit(".md")).alias("file")), {"ignoreNullFields": "false"})
    return dossiers.select("company_slug", entry.alias("entry"))


def write_files(dossiers: DataFrame, folder: str, who: str = "the candidate") -> None:
    """A document for each dossier, in a folder for each slug, and index as text parts that make one JSON object in order."""
    docs = dossiers.select("company_slug", F.regexp_replace(markdown(dossiers, who), r"\n\z", "").alias("value"))  # the writer ends the last line
    docs.write.mode("overwrite").partitionBy("company_slug").text(f"{folder}/documents")
    own = index_entries(dossiers).select(F.lit(1).alias("part"), "company_slug", F.concat(F.to_json(F.array("company_slug")).substr(F.lit(2), F.length(F.to_json(F.array("company_slug"))) - 2), F.lit(": "), "entry").alias("value"))
    last = Window.partitionBy("part").orderBy(F.desc("company_slug"))
    rows = own.withColumn("value", F.concat("value", F.when(F.row_number().over(last) > 1, ",").otherwise(""))).unionByName(dossiers.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, company_slug string, value string"))
    rows.repartitionByRange("part", "company_slug").sortWithinPartitions("part", "company_slug").select("value").write.mode("overwrite").text(f"{folder}/index")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dossiers after a build: a new one takes the place of its company's whole row; of several the last by built_at."""
    last = relational.latest(new, ["company_slug"], ["built_at"]).select(*old.columns)
    return old.join(last, "company_slug", "left_anti").select(*old.columns).unionByName(last)
