"""Names, titles, locations and free text as Column expressions; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Corporate words that a canonical company key leaves out.
CORPORATE_WORDS = ["inc", "llc", "l-l-c", "corp", "corporation", "co", "ltd", "limited", "lp", "llp", "plc", "gmbh", "ag", "sa", "srl", "bv", "nv", "pte", "pvt", "holdings", "group", "technologies", "technology", "labs", "the"]
#: Patterns for remote work, rolling admission and deadlines.
REMOTE = r"(?i)\b(remote|work from home|wfh|distributed|anywhere|telecommute)\b"
HYBRID = r"(?i)\bhybrid\b"
REMOTE_ANYWHERE = r"(?i)\b(anywhere|global|worldwide)\b"
ROLLING = r"(?i)\b(rolling basis|reviewed on a rolling|applications? (are )?reviewed as|until filled|open until filled|no (fixed |set )?deadline)\b"
URL = r"""(?i)https?://[^\s<>"')]+"""
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"


#: White space that strip takes off the ends.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def squeezed(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def company_slug(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 joined by hyphens; null: empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def canonical_company(c: Column) -> Column:
    """The slug without corporate words and hyphens: one key for differently written names."""
    return F.array_join(F.filter(F.split(company_slug(c), "-"), lambda w: (w != "") & ~w.isin(CORPORATE_WORDS)), "")


def title_key(c: Column) -> Column:
    """Lower case, other than a-z, 0-9 and space turned to a space, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9 ]+", " "), " +", " "))


def location(c: Column) -> Column:
    """STRUCT(city, region, country, normalized, is_remote, remote_scope) of a raw location."""
    value = F.nullif(squeezed(c), F.lit(""))
    remote, hybrid = value.rlike(REMOTE), value.rlike(HYBRID)
    scope = F.when(remote & hybrid, "hybrid").when(remote & value.rlike(REMOTE_ANYWHERE), "remote_anywhere").when(remote, "fully_remote").when(hybrid, "hybrid")
    parts = F.filter(F.transform(F.split(value, "[,/|]"), strip), lambda p: p != "")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("city"), F.try_element_at(parts, F.lit(2)).alias("region"), F.try_element_at(parts, F.lit(3)).alias("country"),
        value.alias("normalized"), F.coalesce(remote, F.lit(False)).alias("is_remote"), scope.alias("remote_scope"),
    )


def is_rolling(c: Column) -> Column:
    return F.coalesce(c.rlike(ROLLING), F.lit(False))


def all_urls(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))


def first_url(c: Column) -> Column:
    return F.try_element_at(all_urls(c), F.lit(1))


def hiring_company(c: Column) -> Column:
    """The company of "X is hiring" at a line's start, else of "at X"."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.regexp_replace(strip(F.coalesce(found(r"(?m)^([A-Z][\w&.\- ]{1,40})\s+(?:is\s+)?hiring"), found(r"(?m)\bat\s+([A-Z][\w&.\- ]{1,40})"))), "[.,]+$", "")


def title_line(c: Column, most: int = 140) -> Column:
    """The first line with other than white space, trimmed and cut at `most`."""
    return F.coalesce(F.substring(F.try_element_at(F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), strip), lambda x: x != ""), F.lit(1)), 1, most), F.lit(""))


def emails(c: Column, domain: Column | None = None) -> Column:
    """Distinct lower-case addresses in order; with a domain only those at it."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower)))
    if domain is None:
        return found
    return F.filter(found, lambda e: F.endswith(e, F.concat(F.lit("@"), F.lower(domain))))


def two_sentences(c: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: s != ""), 1, 2), " ")


def url_hash(url: Column) -> Column:
    return F.sha1(strip(url))


def posting_uid(ats: Column, token: Column, source_id: Column, url: Column) -> Column:
    return F.sha1(F.concat_ws("|", ats, token, F.coalesce(source_id, F.lit("")), strip(url)))


def content_fingerprint(title: Column, text: Column, most: int | None = 2000) -> Column:
    """SHA-1 of title and text; of the text `most` characters (the reference's rule), or all of it."""
    return F.sha1(F.concat(title, F.lit("\n"), F.substring(text, 1, most) if most else text))


def csv_safe(c: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading quote."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def parsed_time(c: Column) -> Column:
    """Timestamp of an ISO date or time, a day/month/year by US order, a month name with day and year, or an epoch in seconds or, over
    1e12, milliseconds; others null."""
    v = strip(c)
    number = F.try_to_number(v, F.lit("9" * 18)).cast("double")
    epoch = F.when(number > 1e12, number / 1000).otherwise(number)
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
    plain = F.initcap(F.regexp_replace(F.regexp_replace(v, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\bsept\b", "Sep"))
    text = F.coalesce(*(F.try_to_timestamp(v if "T" in f else plain, F.lit(f)) for f in formats))
    return F.when(v.rlike(r"^\d{1,18}$"), F.when(epoch < 253402300800, F.timestamp_millis((epoch * 1000).cast("long")))).otherwise(text)


_MONTH = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DATE = rf"(?:(?:{_MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s*\d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})(?:,?\s*\d{{4}})?|\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})"
#: Words that announce a deadline, then a date.
DEADLINE = rf"(?i)(?:apply by|application deadline|applications? close(?:s)?(?: on)?|deadline(?: is| to apply)?|closing date|last date to apply|apply before)\s*[:\-]?\s*({_DATE})"


def deadline(c: Column, as_of: Column) -> Column:
    """The first announced date that parses; one without a year is in the year of as_of."""
    year = F.year(as_of).cast("string")
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(DEADLINE), F.lit(1))
    dated = F.transform(found, lambda d: parsed_time(F.when(d.rlike(r"\d{4}|[/-]"), F.regexp_replace(d, r"\.", "")).otherwise(F.concat_ws(" ", F.regexp_replace(d, r"[.,]", ""), year))))
    return F.try_element_at(F.filter(dated, lambda t: t.isNotNull()), F.lit(1))
