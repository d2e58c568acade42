"""People and addresses: leads read out of answers, the cascade that finds an address, ranks, channels, and contacts merged into a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import contacts as names, scoring, text, urls
from quarryline.operators import graph, relational

#: Sources of a channel that stand for the person's own word.
STRONG_SOURCES = ["gravatar", "github", "github_social", "github_profile", "email_match", "keybase"]
FILING_SOURCES = ["oflc_lca", "oflc_perm", "sbir"]
_MANAGER = r"(?i:hiring manager|reporting to|reports? to|you(?:'ll| will) report to|contact)\s*[:\-]?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})"
_NAME = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}$"


def search_lead(title: Column, url: Column) -> Column:
    """STRUCT(name, title, linkedin) of a search result on a profile, null if it gives neither a name nor a profile."""
    profile = F.nullif(F.regexp_extract(url, r"(?i)linkedin\.com/in/[^/?#\s\"']+", 0), F.lit(""))
    whole = r"(?i)^([^|\-–]+?)\s*[\-–]\s*(.+?)(?:\s+(?:at|@)\s+.+)?\s*[|\-–]\s*LinkedIn"
    both = title.rlike(whole)
    name = F.when(both, text.strip(F.regexp_extract(title, whole, 1))).otherwise(F.nullif(text.strip(F.regexp_extract(title, r"^[^|\-–]*", 0)), F.lit("")))
    role = F.when(both, F.regexp_replace(text.strip(F.regexp_extract(title, whole, 2)), r"[ |\-–]+$", ""))
    return F.when(F.nullif(name, F.lit("")).isNotNull() | profile.isNotNull(), F.struct(name.alias("name"), role.alias("title"), F.concat(F.lit("https://www."), profile).alias("linkedin")))


def social_lead(title: Column, url: Column) -> Column:
    """STRUCT(name, kind, value) of a search result on a network's page; null for other sites and names under three characters."""
    name, kind = text.strip(F.regexp_extract(title, r"^[^|\-–·@(]*", 0)), urls.channel_kind(url)
    return F.when((kind != "site") & (F.length(name) >= 3), F.struct(name.alias("name"), kind.alias("kind"), url.alias("value")))


def npm_people(packages: DataFrame, column: str = "body") -> DataFrame:
    """(ord, n, name, email): author and maintainers of npm answers. packages: ord, body."""
    schema = "STRUCT<author STRUCT<name STRING, email STRING>, maintainers ARRAY<STRUCT<name STRING, email STRING>>>"
    both = F.from_json(column, schema)
    each = packages.select("ord", F.posexplode(F.concat(F.array(both["author"]), F.coalesce(both["maintainers"], F.expr("array()").cast("array<struct<name:string,email:string>>")))).alias("n", "p"))
    return each.where("p.email IS NOT NULL").select("ord", "n", "p.name", "p.email")


def pypi_people(packages: DataFrame, column: str = "body") -> DataFrame:
    """(ord, n, name, email): author and maintainer of PyPI answers; of "Name <address>" the address."""
    info = F.from_json(column, "STRUCT<info STRUCT<author STRING, author_email STRING, maintainer STRING, maintainer_email STRING>>")["info"]
    address = lambda c: F.when(F.contains(c, F.lit("<")), F.regexp_replace(F.substring_index(c, "<", -1), r"^[ <>]+|[ <>]+$", "")).otherwise(text.strip(c))
    pairs = F.array(F.struct(info["author"].alias("name"), info["author_email"].alias("email")), F.struct(info["maintainer"].alias("name"), info["maintainer_email"].alias("email")))
    return packages.select("ord", F.posexplode(pairs).alias("n", "p")).where(F.contains("p.email", F.lit("@"))).select("ord", "n", "p.name", address(F.col("p.email")).alias("email"))


def registry_people(pairs: DataFrame) -> DataFrame:
    """Distinct addresses of (ord, n, name, email), lower case; no role accounts, no relays. The first name of an address counts."""
    mail = F.lower(text.strip("email"))
    own = pairs.select("ord", "n", "name", mail.alias("email")).where(~names.is_role_account(mail) & ~F.contains(mail, F.lit("noreply")))
    return own.groupBy("email").agg(F.min_by("name", F.struct("ord", "n")).alias("name")).select("name", "email", F.lit("registry").alias("person_source"))


def directory_emails(answers: DataFrame, column: str = "body", depth: int = 6) -> DataFrame:
    """(ord, email): addresses of the vCards of a registration's entities, nested ones too, down to `depth`. answers: ord, body."""
    out, level = None, answers.select("ord", F.get_json_object(column, "$.entities").alias("e"))
    for _ in range(depth):
        each = level.select("ord", F.explode(F.from_json("e", "ARRAY<STRING>")).alias("x"))
        card = F.from_json(F.get_json_object("x", "$.vcardArray[1]"), "ARRAY<ARRAY<STRING>>")
        mails = F.transform(F.filter(card, lambda p: (F.size(p) >= 4) & (F.lower(p[0]) == "email") & F.contains(p[3], F.lit("@"))), lambda p: F.lower(text.strip(p[3])))
        own = each.select("ord", F.explode(mails).alias("email"))
        out = own if out is None else out.unionByName(own)
        level = each.select("ord", F.get_json_object("x", "$.entities").alias("e")).where("e IS NOT NULL")
    return out.distinct()


def commit_people(commits: DataFrame, domain: Column, source: str) -> DataFrame:
    """First author of each address at the domain, relays left out. commits: ord, name, email and what `domain` reads."""
    mail = F.lower(text.strip("email"))
    own = commits.select("ord", F.nullif(text.strip("name"), F.lit("")).alias("name"), mail.alias("email"), F.lower(domain).alias("domain")).where(F.endswith("email", F.concat(F.lit("@"), "domain")) & ~F.contains("email", F.lit("noreply")))
    return own.groupBy("domain", "email").agg(F.min_by(F.struct("name"), "ord")["name"].alias("full_name")).select("domain", "full_name", F.lit("Engineer").alias("title"), F.col("email").alias("known_email"), F.lit(source).alias("person_source"))


def commit_lines(logs: DataFrame, column: str = "value") -> DataFrame:
    """(ord, name, email) of name|address lines; other columns stay."""
    return logs.select(*(c for c in logs.columns if c != column), F.split_part(column, F.lit("|"), F.lit(1)).alias("name"), F.regexp_extract(column, r"^[^|]*\|(.*)$", 1).alias("email")).where("email <> ''")


def listed_people(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(ord, full_name, title): people of a model's reply {"people": [{"name", "title"}]}, the first of a name whatever the case. replies: ord, reply."""
    inner = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    each = replies.select("ord", F.posexplode(F.from_json(inner, "STRUCT<people ARRAY<STRUCT<name STRING, title STRING>>>")["people"]).alias("n", "p"))
    own = each.select("ord", "n", text.strip("p.name").alias("full_name"), F.nullif(text.strip("p.title"), F.lit("")).alias("title")).where("full_name <> ''")
    return own.groupBy(F.lower("full_name").alias("k")).agg(F.min_by(F.struct("ord", "full_name", "title"), F.struct("ord", "n")).alias("x")).select("x.*")


def named_people(description: Column, creator: Column) -> Column:
    """ARRAY of STRUCT(full_name, role_category, person_source): a posting's creator, then managers its text names."""
    row = lambda n, role, source: F.struct(n.alias("full_name"), F.lit(role).alias("role_category"), F.lit(source).alias("person_source"))
    made = text.strip(creator)
    first = F.filter(F.array(F.when(made.rlike(_NAME), row(made, "recruiter", "ats_creator"))), lambda x: x.isNotNull())
    told = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(_MANAGER), F.lit(1))
    return F.concat(first, F.transform(F.filter(told, lambda n: n.rlike(_NAME)), lambda n: row(text.strip(n), "hiring_manager", "ats_description")))


def company_people(jobs: DataFrame, officers: DataFrame) -> DataFrame:
    """People of a company's postings and of its filings: the first of each name, postings before officers. jobs: company_slug, ord,
    description_text, creator; officers: company_slug, ord, full_name, role_hint."""
    told = jobs.select("company_slug", "ord", F.posexplode(named_people(F.col("description_text"), F.col("creator"))).alias("n", "p")).select("company_slug", F.struct(F.lit(0).alias("t"), "ord", "n").alias("o"), "p.*")
    filed = officers.select("company_slug", F.struct(F.lit(1).alias("t"), "ord", F.lit(0).alias("n")).alias("o"), "full_name", F.coalesce("role_hint", F.lit("other")).alias("role_category"), F.lit("edgar_officer").alias("person_source"))
    both = told.unionByName(filed)
    return both.groupBy("company_slug", F.lower("full_name").alias("k")).agg(F.min_by(F.struct("full_name", "role_category", "person_source"), "o").alias("x")).select("company_slug", "x.*")


def disclosed_people(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Filing leads of companies by canonical name, the first of each address, or name where it has none. leads: ord, company_slug
    (canonical), full_name, title, email, role_hint, source; companies: slug, name (null: the slug)."""
    own = companies.select("slug", F.explode(F.array_distinct(F.array(text.canonical_company(F.col("slug")), text.canonical_company(F.coalesce("name", "slug"))))).alias("company_slug")).where("company_slug <> ''")
    key = F.coalesce(F.nullif(F.lower("email"), F.lit("")), F.concat(F.lit("name:"), F.lower(F.coalesce("full_name", F.lit("")))))
    both = leads.join(own, "company_slug").withColumn("k", key)
    row = F.struct("full_name", "title", F.coalesce("role_hint", F.lit("other")).alias("role_category"), F.col("source").alias("person_source"), F.col("email").alias("known_email"))
    return both.groupBy("slug", "k").agg(F.min_by(row, "ord").alias("x")).select("slug", "x.*")


def resolved_domain(known: Column, name: Column, slug: Column, with_mail: Column) -> Column:
    """STRUCT(domain, confidence, source): the known domain if it is a company's, else the first candidate among `with_mail` (domains that
    take mail), else the first candidate."""
    candidates = names.candidate_domains(name, slug)
    live = F.try_element_at(F.filter(candidates, lambda c: F.array_contains(with_mail, c)), F.lit(1))
    row = lambda d, c, s: F.struct(d.alias("domain"), F.lit(c).alias("confidence"), F.lit(s).alias("source"))
    bare = F.regexp_replace(F.lower(known), r"^www\.", "")
    return F.when(urls.is_company_domain(known), row(bare, 1.0, "job_metadata")).when(live.isNotNull(), row(live, 0.7, "mx_validated")).otherwise(row(F.try_element_at(candidates, F.lit(1)), 0.3, "slug_fallback"))


def _facts(**given: Column) -> Column:
    """The struct that scoring.email_confidence reads; facts not given are false, mail is taken to arrive."""
    own = {x: F.lit(x == "mx_present") for x in scoring.EMAIL_FACTS} | {"votes": F.lit(0), "channels": F.lit(0), "catch_all": F.lit(False)} | given
    return F.struct(*(v.alias(k) for k, v in own.items()))


def found_email(name: Column, domain: Column, *, known_email: Column, person_source: Column, scraped: Column, template: Column, votes: Column, locked: Column, band: Column, provider: Column, catch_all: Column) -> Column:
    """STRUCT(email, status, source, score, label): a known address (a filing's, or at the domain), else a published one that a pattern
    gives, else the domain's pattern, else the pattern to expect by size and provider, of which the score is bound by its prior. scraped
    is an array of addresses; template, votes and locked describe the domain's pattern (null: none). Null if the name can't be split."""
    row = lambda e, status, source, facts: (lambda r: F.struct(e.alias("email"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), source.alias("source"), r["score"].alias("score"), r["label"].alias("label")))(scoring.email_confidence(facts))
    filed, mail = person_source.isin(FILING_SOURCES), F.nullif(F.lower(known_email), F.lit(""))
    at = lambda local: F.concat(local, F.lit("@"), domain)
    n = names.split_name(name)
    first, last = n["first"], n["last"]
    published = F.transform(scraped, lambda e: F.lower(F.split_part(e, F.lit("@"), F.lit(1))))
    hit = F.try_element_at(F.filter(names.local_parts(first, last), lambda x: F.array_contains(published, x)), F.lit(1))
    drawn = F.nullif(names.rendered(template, names.name_token(first), names.name_token(last)), F.lit(""))
    usual = names.default_template(band, provider)
    guess = F.nullif(names.rendered(usual, names.name_token(first), names.name_token(last)), F.lit(""))
    prior = scoring.email_confidence(_facts(prior_only=F.lit(True), catch_all=catch_all))
    least = F.least(prior["score"], names.prior_confidence(band) * 100.0)
    role = names.is_role_account(at(drawn))
    return (
        F.when(mail.isNotNull() & filed, row(mail, "disclosure", F.concat(F.lit("gov:"), person_source), _facts(disclosure=F.lit(True), catch_all=catch_all)))
        .when(mail.isNotNull() & F.endswith(mail, F.concat(F.lit("@"), F.lower(domain))), row(mail, "github", F.lit("github_commit"), _facts(github=F.lit(True), catch_all=catch_all)))
        .when(hit.isNotNull(), row(at(hit), "scraped", F.lit("site_scrape"), _facts(scraped=F.lit(True), catch_all=catch_all)))
        .when(n.isNull(), F.lit(None))
        .when(template.isNotNull() & drawn.isNotNull(), row(at(drawn), "guessed", F.concat(F.lit("pattern:"), template), _facts(votes=F.coalesce(votes, F.lit(0)), locked=F.coalesce(locked, F.lit(False)), role_account=role, catch_all=catch_all)))
        .when(guess.isNotNull(), F.struct(at(guess).alias("email"), F.lit("guessed").alias("status"), F.concat(F.lit("prior:"), usual).alias("source"), least.alias("score"), F.when(least >= 55, "probable").otherwise("guessed").alias("label")))
    )


def verified(result: Column, facts: Column) -> Column:
    """An address scored anew once the facts of its checks are known: STRUCT(email, status, score, label). facts: what
    scoring.email_confidence reads; scraped, github and disclosure follow from the status. No mail server: invalid, score 0."""
    own = F.struct(*((result["status"] == s).alias(n) if (s := {"scraped": "scraped", "github": "github", "disclosure": "disclosure"}.get(n)) else facts[n].alias(n) for n in [*scoring.EMAIL_FACTS, "votes", "channels", "catch_all"]))
    r = scoring.email_confidence(own)
    dead = ~F.coalesce(facts["mx_present"], F.lit(True))
    return F.struct(result["email"].alias("email"), F.when(dead, "invalid").otherwise(result["status"]).alias("status"), F.when(dead, 0.0).otherwise(r["score"]).alias("score"), F.when(dead, "invalid").otherwise(r["label"]).alias("label"))


def ranked(people: DataFrame, most: int) -> DataFrame:
    """Each company's `most` best people: twice as many by role first, of those by role and how well they can be reached (score of the
    address over 100, 0.1 without one). people: company_slug, ord, role_category, email, score."""
    p = people.withColumn("role_priority", names.role_priority(F.col("role_category")))
    first = relational.top_per(p, ["company_slug"], [F.desc("role_priority"), F.asc("ord")], 2 * most)
    reach = F.when(F.col("email").isNotNull(), F.col("score") / 100.0).otherwise(0.1)
    rank = first.withColumn("rank", F.col("role_priority") * (0.4 + 0.6 * reach))
    return relational.top_per(rank, ["company_slug"], [F.desc("rank"), F.desc("role_priority"), F.asc("ord")], most)


def corroboration(channels: Column) -> Column:
    """How many of a person's channels are verified or come from the person's own word."""
    return F.size(F.filter(channels, lambda c: (c["status"] == "verified") | c["source"].isin(STRONG_SOURCES)))


_CHANNEL = "struct<kind:string,value:string,source:string,confidence:double,status:string,label:string>"


def person_channels(channels: Column, known_email: Column, chosen_email: Column, source: Column, domain: Column) -> Column:
    """A person's channels, a known address beside the chosen one added; those without a score get one: 60 and probable for addresses, by
    source and corroboration for others. channels: ARRAY of STRUCT(kind, value, source, confidence, status, label)."""
    other = F.nullif(known_email, F.lit("")).isNotNull() & (F.lower(known_email) != F.lower(F.coalesce(chosen_email, F.lit(""))))
    kind = F.when(F.endswith(F.lower(known_email), F.concat(F.lit("@"), F.lower(domain))), "work_email").otherwise("personal_email")
    none = F.lit(None)
    more = F.when(other, F.array(F.struct(kind.alias("kind"), known_email.alias("value"), source.alias("source"), none.cast("double").alias("confidence"), F.lit("guessed").alias("status"), none.cast("string").alias("label")).cast(_CHANNEL))).otherwise(F.expr("array()").cast(f"array<{_CHANNEL}>"))
    backing = F.greatest(F.lit(0), corroboration(channels) - 1)

    def scored(c: Column) -> Column:
        mail, r = c["kind"].isin("work_email", "personal_email"), scoring.channel(c["source"], backing)
        score = F.when(mail, 60.0).otherwise(r["score"])
        label = F.when(mail, "probable").otherwise(r["label"])
        return F.struct(c["kind"].alias("kind"), c["value"].alias("value"), c["source"].alias("source"), F.coalesce(c["confidence"], score).alias("confidence"), F.coalesce(c["status"], F.when(c["confidence"].isNull() & mail, "guessed")).alias("status"), F.when(c["confidence"].isNull(), label).otherwise(c["label"]).alias("label"))

    return F.transform(F.concat(channels, more), scored)


def alias_contacts(companies: DataFrame, published: DataFrame) -> DataFrame:
    """Recruiting addresses of a company's domain that are published: contacts of their own. companies: company_slug, domain; published: email."""
    alias = companies.where("domain IS NOT NULL").select("company_slug", "domain", F.explode(F.array(*map(F.lit, names.RECRUITING_ALIASES))).alias("alias")).withColumn("email", F.concat_ws("@", "alias", "domain"))
    return alias.join(published.select("email").distinct(), "email", "left_semi").select("company_slug", "domain", "email", F.lit("Recruiting inbox").alias("title"), F.lit("recruiter").alias("role_category"), F.lit(0.7).alias("priority"), F.lit("scraped").alias("email_status"), F.lit("recruiting_alias").alias("email_source"), F.lit(80.0).alias("confidence"), F.lit("verified").alias("email_label"), F.lit("alias").alias("person_source"))


def published_emails(pages: DataFrame, domain: Column, column: str = "text") -> DataFrame:
    """(domain, email): distinct addresses at a domain in page texts, role accounts too."""
    return pages.select(domain.alias("domain"), F.explode(text.emails(F.col(column), domain)).alias("email")).distinct()


def unenriched(targets: DataFrame, companies: DataFrame, limit: int | None = 50) -> DataFrame:
    """Companies to enrich: those done are left out before the cut. targets: company_slug, best_score ..., companies: company_slug, status."""
    out = targets.join(companies.where("status = 'done'").select("company_slug"), "company_slug", "left_anti").orderBy(F.desc("best_score"), "company_slug")
    return out if limit is None else out.limit(limit)


#: What a contact's new values overwrite where they are given.
CONTACT_FIELDS = ["company_domain", "full_name", "title", "role_category", "priority", "linkedin_url", "github_login", "email", "email_status", "email_source", "confidence", "label", "person_source"]


def _given(c: str, kind: str) -> Column:
    return F.nullif(F.col(c), F.lit("")) if kind == "string" else F.col(c)


def _matched(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with contact_id of the row it updates: by address, else profile, else (without either) name among rows without an address."""
    steps = [
        ("_a", old.where("email IS NOT NULL"), ["company_slug", "email"], F.lit(True)),
        ("_b", old.where("linkedin_url IS NOT NULL"), ["company_slug", "linkedin_url"], F.lit(True)),
        ("_c", old.where("email IS NULL AND full_name IS NOT NULL"), ["company_slug", "full_name"], F.coalesce(F.nullif("linkedin_url", F.lit("")), F.lit("")) == ""),
    ]
    out = new
    for name, table, keys, _ in steps:
        out = out.join(table.groupBy(*keys).agg(F.min("contact_id").alias(name)), keys, "left")
    return out.withColumn("contact_id", F.coalesce(*(F.when(when, F.col(name)) for name, _, _, when in steps))).drop(*(s[0] for s in steps))


def merge_contacts(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The snapshot after a batch: values given overwrite, in the order of `ord`; rows that match none are inserted. Rows of a batch that
    stand for one new contact follow each other: in each round those go in that share no key with an earlier one. old: contact_id (long),
    company_slug, CONTACT_FIELDS, last_seen_at; new: ord and the same without contact_id and last_seen_at."""
    kinds = {c: old.schema[c].dataType.simpleString() for c in CONTACT_FIELDS}
    left, snapshot = new.select("ord", "company_slug", *(_given(c, kinds[c]).alias(c) for c in CONTACT_FIELDS)), old
    while True:
        both = graph.cut(_matched(left, snapshot))
        known, fresh = both.where("contact_id IS NOT NULL"), both.where("contact_id IS NULL").drop("contact_id")
        changes = known.groupBy("contact_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"n_{c}") for c in CONTACT_FIELDS), F.lit(True).alias("seen"))
        snapshot = snapshot.join(changes, "contact_id", "left").select("contact_id", "company_slug", *(F.coalesce(f"n_{c}", c).alias(c) for c in CONTACT_FIELDS), F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
        if fresh.isEmpty():
            return snapshot.select(*old.columns)
        # a row goes in if no earlier one has one of its keys
        keys = fresh.select("ord", F.explode(F.filter(F.array(F.concat_ws("\x01", F.lit("e"), "company_slug", "email"), F.when(F.col("linkedin_url").isNotNull(), F.concat_ws("\x01", F.lit("l"), "company_slug", "linkedin_url")), F.when(F.col("full_name").isNotNull(), F.concat_ws("\x01", F.lit("n"), "company_slug", "full_name"))), lambda k: k.isNotNull())).alias("k")).where("NOT (startswith(k, 'e') AND size(split(k, '\x01')) < 3)")
        later = keys.join(keys.groupBy("k").agg(F.min("ord").alias("first")), "k").where("ord > first").select("ord").distinct()
        enter = fresh.join(later, "ord", "left_anti")
        top = snapshot.agg(F.coalesce(F.max("contact_id"), F.lit(0)).alias("top"))
        placed = enter.crossJoin(F.broadcast(top)).withColumns({"contact_id": F.col("top") + 1 + F.col("ord"), "last_seen_at": now}).drop("top", "ord")  # one row
        snapshot = graph.cut(snapshot.unionByName(placed.select(*snapshot.columns)))
        left = fresh.join(later, "ord", "left_semi")
        if left.isEmpty():
            return snapshot.select(*old.columns)


#: What a company's new values overwrite where they are given; the confidence of its domain isn't among them.
COMPANY_FIELDS = ["name", "domain", "email_pattern", "email_pattern_conf", "is_catch_all", "linkedin_url", "github_org", "headcount_band", "enriched_at", "status", "notes"]


def merge_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by slug: given values overwrite, in the order of `ord`; others are inserted."""
    kinds = {c: old.schema[c].dataType.simpleString() for c in old.columns}
    fields = [c for c in COMPANY_FIELDS if c in old.columns]
    last = new.groupBy("company_slug").agg(*(F.max_by(c, F.when(_given(c, kinds[c]).isNotNull(), F.col("ord"))).alias(f"n_{c}") for c in fields), *(F.min_by(c, "ord").alias(f"i_{c}") for c in old.columns if c not in ("company_slug", *fields)))
    both = old.withColumn("_old", F.lit(True)).join(last, "company_slug", "full")
    return both.select(*(F.col(c) if c == "company_slug" else F.coalesce(F.when(F.col(f"n_{c}").isNotNull(), F.col(f"n_{c}")), F.col(c)).alias(c) if c in fields else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"i_{c}")).alias(c) for c in old.columns))


def hiring_companies(companies: DataFrame, notes: str = "notes") -> DataFrame:
    """Companies whose notes, a JSON object, have a filing's signal."""
    return companies.where(F.get_json_object(notes, "$.disclosure").isNotNull())


def with_signals(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """companies with the filing signal of their canonical name put into their notes under disclosure. signals: key (canonical), signal (JSON).
    Other notes stay; notes are flat or nested JSON objects."""
    key = text.canonical_company(F.coalesce(F.nullif("name", F.lit("")), "company_slug"))
    both = companies.withColumn("_k", key).join(signals.select(F.col("key").alias("_k"), "signal"), "_k", "left")
    held = F.coalesce(F.map_filter(F.from_json("notes", "MAP<STRING, STRING>"), lambda k, _: k != "disclosure"), F.expr("map()").cast("map<string,string>"))
    # values of the map are strings as they stand; only plain strings need quotes again
    quoted = F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.when(e["value"].rlike(r"^(\{.*\}|\[.*\]|-?\d+(\.\d+)?|true|false|null)$"), e["value"]).otherwise(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))), ",")
    merged = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(quoted, F.lit("")), F.concat(F.lit('"disclosure":'), F.col("signal"))), F.lit("}"))
    return both.withColumn("notes", F.when(F.col("signal").isNotNull(), merged).otherwise(F.col("notes"))).select(*companies.columns)
