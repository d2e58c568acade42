"""Names, address patterns and roles as Column expressions over given tables; nothing here looks anything up."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from quarryline.functions.text import strip

#: Address patterns by how common they are.
TEMPLATES = ["{first}.{last}", "{f}{last}", "{first}{last}", "{first}", "{first}_{last}", "{first}-{last}", "{f}.{last}", "{first}{l}", "{last}.{first}", "{last}{first}", "{f}{l}", "{last}", "{last}.{f}", "{f}_{last}"]
#: The pattern to expect by mail provider and head count.
BY_PROVIDER = {"microsoft": {"tiny": "{first}.{last}", "mid": "{first}.{last}", "large": "{first}.{last}"}, "google": {"tiny": "{first}", "mid": "{f}{last}", "large": "{first}.{last}"}}
BY_BAND = {"tiny": "{first}", "mid": "{f}{last}", "large": "{first}.{last}"}
PRIOR = {"tiny": 0.30, "mid": 0.40, "large": 0.45}
#: Weight of a role as a contact.
ROLE_PRIORITY = {"university_recruiter": 1.0, "technical_recruiter": 0.85, "recruiter": 0.8, "hiring_manager": 0.65, "eng_manager": 0.6, "ic_engineer": 0.45, "hr": 0.4, "other": 0.2}
ROLE_ACCOUNTS = ["info", "support", "admin", "sales", "contact", "no-reply", "noreply", "postmaster", "webmaster", "abuse", "marketing"]
RECRUITING_ALIASES = ["careers", "jobs", "recruiting", "recruitment", "talent", "university", "universityrecruiting", "campus", "internships", "hr", "people", "hello"]
GENERIC_DOMAINS = ["gmail.com", "yahoo.com", "ymail.com", "outlook.com", "hotmail.com", "aol.com", "proton.me", "protonmail.com", "icloud.com", "me.com", "mac.com", "live.com", "msn.com", "gmx.com", "mail.com", "hey.com", "comcast.net", "verizon.net", "sbcglobal.net", "att.net"]
SENTINELS = ["", "na", "n/a", "n.a.", "none", "null", "nan", "#n/a", "(blank)", "-"]
def _marked() -> tuple[str, str]:
    """Lower-case letters with marks below U+2000, and what canonical decomposition leaves of them without the marks."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and c == c.lower():
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


_MARKED, _BARE = _marked()


def looked_up(c: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def role_priority(role: Column) -> Column:
    return looked_up(F.coalesce(role, F.lit("other")), ROLE_PRIORITY, 0.2)


def split_name(name: Column) -> Column:
    """STRUCT(first, last) of the outer words of a name, null if it has fewer than two."""
    words = F.filter(F.split(F.replace(name, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.struct(words[0].alias("first"), F.element_at(words, -1).alias("last")))


def name_token(c: Column) -> Column:
    """Letters and digits, lower case, without marks on letters of any alphabet."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _BARE), r"[^\p{L}\p{N}]", "")


def _variants(c: Column) -> Column:
    both = F.array(name_token(F.replace(c, F.lit("-"), F.lit(""))), name_token(F.split_part(c, F.lit("-"), F.lit(1))))
    return F.filter(F.array_distinct(F.when(F.contains(c, F.lit("-")), both).otherwise(F.array(name_token(c)))), lambda x: x != "")


def rendered(template: Column, first: Column, last: Column) -> Column:
    out = template
    for name, value in (("{first}", first), ("{last}", last), ("{f}", F.substring(first, 1, 1)), ("{l}", F.substring(last, 1, 1))):
        out = F.replace(out, F.lit(name), value)
    return out


def name_variants(first: Column, last: Column) -> Column:
    """ARRAY of STRUCT(first, last): hyphenated parts joined, or their first segment."""
    return F.flatten(F.transform(_variants(first), lambda a: F.transform(_variants(last), lambda b: F.struct(a.alias("first"), b.alias("last")))))


def local_parts(first: Column, last: Column, templates: list[str] = TEMPLATES) -> Column:
    """Every pattern over every variant, distinct, by the order of patterns."""
    variants = name_variants(first, last)
    return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, templates)), lambda t: F.transform(variants, lambda p: rendered(t, p["first"], p["last"])))))


def matching_templates(first: Column, last: Column, local: Column) -> Column:
    """The patterns that give this local part."""
    variants = name_variants(first, last)
    return F.filter(F.array(*map(F.lit, TEMPLATES)), lambda t: F.exists(variants, lambda p: rendered(t, p["first"], p["last"]) == local))


def default_template(band: Column, provider: Column) -> Column:
    band = F.coalesce(band, F.lit("large"))
    out = looked_up(band, BY_BAND, "{first}.{last}")
    for name, table in BY_PROVIDER.items():
        out = F.when(provider == name, looked_up(band, table, "{first}.{last}")).otherwise(out)
    return out


def prior_confidence(band: Column) -> Column:
    return looked_up(F.coalesce(band, F.lit("large")), PRIOR, 0.40)


def headcount_band(n: Column) -> Column:
    return F.when(n <= 0, None).when(n < 3, "tiny").when(n < 15, "mid").when(n.isNotNull(), "large")


def candidate_domains(name: Column, slug: Column) -> Column:
    bases = F.filter(F.array_distinct(F.transform(F.array(F.coalesce(slug, F.lit("")), F.coalesce(name, F.lit(""))), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))), lambda x: x != "")
    return F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, [".com", ".io", ".ai", ".co"])), lambda t: F.concat(b, t))))


def is_role_account(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(1))).isin(ROLE_ACCOUNTS)


def valid_email(c: Column) -> Column:
    e = F.lower(strip(c))
    return F.when(e.rlike(r"^[^@]*@.*\."), e)


def email_domain(c: Column) -> Column:
    """Domain of a company address; null for generic providers and malformed ones."""
    d = F.regexp_replace(F.lower(strip(F.regexp_extract(c, "^[^@]*@(.*)$", 1))), r"\.+$", "")
    return F.when(d.rlike(r"\.[^.]{2,}$") & ~d.isin(GENERIC_DOMAINS), d)


def picked(*columns: Column) -> Column:
    """The first value that is no stand-in for nothing, trimmed."""
    return F.coalesce(*(F.when(~F.lower(strip(c.cast("string"))).isin(SENTINELS), strip(c.cast("string"))) for c in columns))


def names_match(a: Column, b: Column) -> Column:
    """Same last word and same first letter."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.coalesce((F.element_at(words(a), -1) == F.element_at(words(b), -1)) & (F.substring(words(a)[0], 1, 1) == F.substring(words(b)[0], 1, 1)), F.lit(False))


def is_tech_occupation(code: Column, prefixes: list[str]) -> Column:
    c = F.replace(strip(code), F.lit("."), F.lit("-"))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))
