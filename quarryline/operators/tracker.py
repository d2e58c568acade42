"""The application tracker: stages, rows as shown, orders, exports, inline changes, feeds and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.functions import scoring, text
from quarryline.operators.answers import csv_date

#: Stages in order, and other names they go by.
STAGES = ["To Apply", "Applied", "Referral Requested", "Interviewing", "Offer", "Rejected"]
STAGE_NAMES = {
    "found": "To Apply", "to-apply": "To Apply", "to apply": "To Apply", "applied": "Applied", "apply": "Applied", "referral-requested": "Referral Requested", "referral requested": "Referral Requested",
    "referral": "Referral Requested", "interview": "Interviewing", "interviewing": "Interviewing", "offer": "Offer", "rejected": "Rejected", "reject": "Rejected",
}


def stage(c: Column) -> Column:
    """The stage that a word means, null if none."""
    raw = text.strip(c)
    named = F.create_map(*(F.lit(x) for pair in STAGE_NAMES.items() for x in pair))
    return F.when(raw.isin(STAGES), raw).otherwise(F.try_element_at(named, F.lower(raw)))


def as_bool(c: Column, default: bool = False) -> Column:
    """A form's flag: absent is the default, an empty one false."""
    return F.when(c.isNull(), F.lit(default)).otherwise(F.lower(text.strip(c)).isin("1", "true", "on", "yes"))


def as_date(c: Column) -> Column:
    """Midnight of a form's year-month-day; blank or malformed: null."""
    return F.try_to_timestamp(F.nullif(text.strip(c), F.lit("")), F.lit("yyyy-MM-dd"))


def stage_rank(c: Column, other: int = 9) -> Column:
    out = F.lit(other)
    for i, s in enumerate(STAGES):
        out = F.when(c == s, F.lit(i)).otherwise(out)
    return out


def order(sort: str = "due") -> list[Column]:
    """Total order of tracker rows. Undated rows come last, by due date as by applied and added ones; an unknown key sorts by due date."""
    if sort == "company":
        return [F.lower(F.coalesce("company", F.lit(""))).asc(), F.asc("id")]
    if sort == "status":
        return [stage_rank(F.col("status")).asc(), F.asc_nulls_last("due"), F.asc("id")]
    if sort in ("applied", "added"):
        return [F.desc_nulls_last({"applied": "applied_at", "added": "created_at"}[sort]), F.asc("id")]
    return [F.asc_nulls_last("due"), F.asc("id")]


def best_contacts(contacts: DataFrame) -> DataFrame:
    """(company_slug, live_name, live_email): with an address first, then the best kind of address, then priority."""
    rank = F.when(F.col("email").isNull(), 9).when(F.col("email_label") == "verified", 0).when(F.col("email_label") == "probable", 1).when(F.col("email_label") == "guessed", 2).otherwise(3)
    least = F.struct(rank.alias("r"), (-F.coalesce("priority", F.lit(0.0))).alias("p"), "contact_id")
    return contacts.groupBy("company_slug").agg(F.min_by(F.struct("full_name", "email"), least).alias("b")).select("company_slug", F.col("b.full_name").alias("live_name"), F.col("b.email").alias("live_email"))


def rows_shown(applications: DataFrame, contacts: DataFrame, today: Column) -> DataFrame:
    """applications with cname, cemail (the row's own, else its company's live contact) and due_status. today is a date; times are epoch seconds."""
    own = F.nullif("contact_name", F.lit("")).isNotNull() | F.nullif("contact_email", F.lit("")).isNotNull()
    days = F.datediff(F.to_date(F.timestamp_seconds("due")), today)
    both = applications.join(best_contacts(contacts), "company_slug", "left")
    return both.withColumns({
        "cname": F.coalesce(F.when(own, F.col("contact_name")).otherwise(F.col("live_name")), F.lit("")),
        "cemail": F.coalesce(F.when(own, F.col("contact_email")).otherwise(F.col("live_email")), F.lit("")),
        "due_status": F.coalesce(F.when(days < 0, "overdue").when(days <= 7, "soon"), F.lit("")),
    }).drop("live_name", "live_email")


def _cell(name: str) -> Column:
    return text.csv_safe(F.coalesce(name, F.lit("")))


def table_file(applications: DataFrame, contacts: DataFrame, today: Column) -> DataFrame:
    """The eleven columns of the tracker's table file, cells safe for spreadsheets."""
    rows = rows_shown(applications, contacts, today)
    return rows.select("id", _cell("company").alias("company"), _cell("role").alias("role"), _cell("location").alias("location"), csv_date(F.col("due")).alias("due_date"), _cell("status").alias("status"), F.when(F.col("emailed"), "yes").otherwise("no").alias("emailed"), _cell("cname").alias("contact_name"), _cell("cemail").alias("contact_email"), _cell("link").alias("link"), csv_date(F.col("applied_at")).alias("applied_on"), _cell("notes").alias("notes"))


def plain_file(applications: DataFrame) -> DataFrame:
    """The eleven other columns of the tracker's plain export; line breaks in notes become spaces."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return applications.select("id", blank("company").alias("company"), blank("role").alias("role"), blank("location").alias("location"), blank("status").alias("status"), F.when(F.col("warm_intro"), "warm").otherwise("cold").alias("warm_intro"), blank("connection_name").alias("connection_name"), csv_date(F.col("due")).alias("due_date"), csv_date(F.col("applied_at")).alias("applied_at"), blank("link").alias("link"), F.replace(blank("notes"), F.lit("\n"), F.lit(" ")).alias("notes"))


def changed(applications: DataFrame, forms: DataFrame, now: Column) -> DataFrame:
    """applications after inline changes. forms: id and fields, a map of the inputs that were sent: an empty one clears its column, an
    absent one leaves it. A status must be a stage; the first Applied stamps applied_at. Times are epoch seconds."""
    both = applications.join(forms.groupBy("id").agg(F.first("fields").alias("f")), "id", "left")
    f = F.coalesce("f", F.expr("map()").cast("map<string,string>"))
    sent, value = (lambda n: F.map_contains_key(f, n)), (lambda n: F.try_element_at(f, F.lit(n)))
    status = F.when(value("status").isin(STAGES), value("status")).otherwise(F.col("status"))
    stamped = F.when((value("status") == "Applied") & F.col("applied_at").isNull(), now).otherwise(F.col("applied_at"))
    date = lambda n: F.unix_seconds(as_date(value(n)))
    new = {"status": status, "emailed": F.when(sent("emailed"), as_bool(value("emailed"))).otherwise(F.col("emailed")), "due": F.when(sent("due_date"), date("due_date")).otherwise(F.col("due")), "applied_at": F.when(sent("applied_at"), date("applied_at")).otherwise(stamped)}
    for n in ("contact_name", "contact_email", "notes"):
        new[n] = F.when(sent(n), F.nullif(text.strip(value(n)), F.lit(""))).otherwise(F.col(n))
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in applications.columns))


def safe_url(c: Column) -> Column:
    """A url of http or https as it is, any other #."""
    return F.when(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), c).otherwise("#")


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_items(jobs: DataFrame) -> DataFrame:
    """job_uid and item: a posting as an RSS element. posted is epoch seconds."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>"))
    about = F.concat(F.col("title"), F.lit(" at "), F.coalesce(F.nullif("company", F.lit("")), F.lit("unknown")))
    day = F.coalesce(tag("pubDate", F.date_format(F.timestamp_seconds("posted"), "EEE, dd MMM yyyy HH:mm:ss '+0000'")), F.lit(""))
    return jobs.select("job_uid", F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("url")), tag("description", about), tag("guid", F.col("url")), day, F.lit("</item>")).alias("item"))


def feed(jobs: DataFrame, title: str, link: str, about: str, folder: str) -> None:
    """Writes the feed as text parts that make one document in order: head, items by posting date, end."""
    spark = jobs.sparkSession
    head = spark.createDataFrame([(0, 0, "", f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link><description>{about}</description>'), (2, 0, "", "</channel></rss>")], "part int, at long, job_uid string, value string")
    items = feed_items(jobs).join(jobs.select("job_uid", "posted"), "job_uid").select(F.lit(1).alias("part"), F.coalesce(-F.col("posted"), F.lit(1 << 62)).alias("at"), "job_uid", F.col("item").alias("value"))
    head.unionByName(items).repartitionByRange("part", "at", "job_uid").sortWithinPartitions("part", "at", "job_uid").select("value").write.mode("overwrite").text(folder)


def messages(jobs: DataFrame, now: Column) -> DataFrame:
    """A posting's part in each way to tell of it: telegram (a message of its own, HTML), discord (an embed as JSON), ntfy and mail (a
    line) and mail_html (a list item). Times are epoch seconds; reasons is an array, connection a struct of name, relationship and
    contact (null: none)."""
    g = lambda n, k="string": F.col(n) if n in jobs.columns else F.lit(None).cast(k)
    filled = lambda c: F.nullif(c, F.lit(""))
    who, place = F.coalesce(filled(F.col("company")), F.col("company_slug")), F.coalesce(filled(F.col("location_normalized")), filled(g("location_raw")), F.lit("location n/a"))
    age = scoring.age_text(F.timestamp_seconds(F.coalesce("posted", "first_seen")), F.timestamp_seconds(now))
    quoted = F.replace(F.replace(xml_text(F.col("url")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    known = g("connection", "struct<name:string,relationship:string,contact:string>")
    reasons = F.coalesce(g("reasons", "array<string>"), F.array().cast("array<string>"))
    telegram = F.concat_ws(
        "\n", F.concat(F.lit("<b>"), xml_text(F.col("title")), F.lit("</b> @ "), xml_text(who)), F.concat(xml_text(place), F.when(F.col("is_remote"), " · remote-ok").otherwise("")), age,
        F.concat(F.lit('<a href="'), quoted, F.lit('">Apply directly</a>')), F.concat(F.lit("score "), F.format_number("discovery_score", 2)), F.when(F.size(reasons) > 0, xml_text(F.array_join(reasons, " · "))),
        F.when(known.isNull(), "❄️ Cold apply").otherwise(F.concat(F.lit("🤝 <b>Warm intro:</b> "), xml_text(known["name"]), F.lit(" — "), xml_text(F.coalesce(filled(known["relationship"]), F.lit("your network"))))),
        F.concat(F.lit("reach: "), xml_text(filled(known["contact"]))),
    )
    field = lambda name, value: F.when(filled(value).isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline")))
    fields = F.filter(F.array(field("Company", F.col("company")), field("Location", F.col("location_normalized")), field("Deadline", F.date_format(F.timestamp_seconds("deadline"), "yyyy-MM-dd'T'HH:mm:ss"))), lambda x: x.isNotNull())
    named = F.coalesce(filled(F.col("company")), F.lit("unknown"))
    return jobs.select(
        "job_uid", telegram.alias("telegram"), F.to_json(F.struct("title", "url", fields.alias("fields"))).alias("discord"), F.concat(F.col("title"), F.lit(" @ "), named, F.lit(" — "), F.col("url")).alias("ntfy"),
        F.concat(F.lit("- "), F.col("title"), F.lit(" @ "), named, F.lit(": "), F.col("url")).alias("mail"), F.concat(F.lit('<li><a href="'), quoted, F.lit('">'), xml_text(F.col("title")), F.lit("</a> @ "), xml_text(named), F.lit("</li>")).alias("mail_html"),
    )


def digest(parts: DataFrame, order: str = "ord") -> DataFrame:
    """One row: the payloads of a run's postings together (discord, ntfy, mail, mail_html). A run's number of alerts is bounded, see targets."""
    n = F.count("*")
    head = F.concat(n.cast("string"), F.lit(" new internship match(es)"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])
    return parts.agg(
        F.concat(F.lit('{"content":"'), head, F.lit('","embeds":['), F.array_join(listed("discord"), ","), F.lit("]}")).alias("discord"), F.concat_ws("\n", head, F.array_join(listed("ntfy"), "\n")).alias("ntfy"),
        F.concat_ws("\n", head, F.array_join(listed("mail"), "\n")).alias("mail"), F.concat(F.lit("<h2>"), head, F.lit("</h2><ul>"), F.array_join(listed("mail_html"), ""), F.lit("</ul>")).alias("mail_html"),
    )
