"""Posting and title classification, quality heuristics: ordered rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Kinds of early-career postings, first match wins.
KINDS = [
    ("co-op", r"\bco[\s\-]?op\b"), ("summer-analyst", r"\bsummer\s+analyst\b"), ("rotational", r"\brotational\b|\brotation(?:al)?\s+program\b"),
    ("apprentice", r"\bapprentice(?:ship)?\b"), ("new-grad", r"\bnew\s*grad(?:uate)?\b"), ("university-program", r"\buniversity\s+(?:program|graduate|hire|recruit)"),
    ("campus", r"\bcampus\b|\bon[\s\-]?campus\b"), ("early-career", r"\bearly[\s\-]?career\b|\bentry[\s\-]?level\b"), ("intern", r"\bintern(?:ship)?\b"),
]
#: Tags, all that match, in this order.
LEVEL_TAGS = [
    ("summer", r"\bsummer\b"), ("fall", r"\bfall\b|\bautumn\b"), ("spring", r"\bspring\b"), ("winter", r"\bwinter\b"), ("phd", r"\bph\.?d\b|\bdoctoral\b"),
    ("masters", r"\bmaster'?s?\b|\bmsc\b|\bm\.?s\.?\b"), ("undergrad", r"\bundergrad(?:uate)?\b|\bbachelor'?s?\b|\bbsc\b"), ("entry-level", r"\bentry[\s\-]?level\b"),
    ("paid", r"\bpaid\b"), ("part-time", r"\bpart[\s\-]?time\b"), ("full-time", r"\bfull[\s\-]?time\b"), ("remote", r"\bremote\b"),
]
#: Words of early-career titles and texts, of seniority, of founding roles.
INTERNSHIP = r"\bintern(?:ship)?\b|\bco[\s\-]?op\b|\bsummer\s+analyst\b|\bapprentice(?:ship)?\b|\bnew\s*grad(?:uate)?\b|\bearly[\s\-]?career\b|\bcampus\b|\brotational\b|\buniversity\s+(?:program|graduate|hire|recruit)|\bplacement\b|\bworking\s+student\b|\bgraduate\s+(?:program|scheme|trainee)\b"
STRONG_TITLE = r"\bintern(?:ship)?\b|\bco[\s\-]?op\b|\bsummer\s+analyst\b|\bapprentice(?:ship)?\b|\bworking\s+student\b"
STRONG_TEXT = r"\bsummer\s+intern(?:ship)?\b|\bintern(?:ship)?\s+program\b|\bintern(?:ship)?\s+(?:position|role|opportunity)\b|\bco[\s\-]?op\s+program\b|\bis\s+an?\s+intern(?:ship)?\b"
SENIOR = r"\b(senior|sr|staff|principal|lead|manager|director|head\s+of|vp|vice\s+president|architect|chief|ii|iii|iv)\b"
EARLY_TITLE = r"\b(founding (engineer|team|designer|scientist)|first (engineer|hire)|entrepreneur in residence)\b"
#: Role words looked for in the padded lower-case title; first group wins.
ROLES = [
    (["university recruit", "campus", "early career", "early talent", "student program"], "university_recruiter"),
    (["technical recruit", "tech recruit", "sourcer", "technical sourcer"], "technical_recruiter"),
    (["recruit", "talent acquisition", "talent partner", "talent advisor"], "recruiter"),
    (["engineering manager", "eng manager", "em,", "head of engineering"], "eng_manager"),
    (["hiring manager", "director", "vp ", "head of", "lead "], "hiring_manager"),
    (["people ops", "people operations", "hr ", "human resources", "people partner"], "hr"),
    (["engineer", "developer", "swe", "software", "programmer", "intern"], "ic_engineer"),
]
#: Quality cues.
AGENCY = r"\b(our client|on behalf of (?:our|a) client|confidential client|staffing agency|recruitment agency|recruiting firm|consultancy|we are a (?:staffing|recruiting))\b"
SCAM = r"\b(commission[\s-]?only|unlimited earning|be your own boss|financial freedom|no experience (?:needed|required|necessary)|pay a fee|registration fee|starter kit|upfront (?:payment|fee)|earn \$?\d{3,}/(?:day|week))\b"
CONTACT_ONLY = r"\b(whatsapp|telegram|signal)\b.{0,40}\b(only|us|me|apply|contact|message)\b"
PERSONAL_EMAIL = r"\b[\w.+-]+@(gmail|yahoo|hotmail|outlook|protonmail)\.com\b"
GHOST = r"\b(always hiring|evergreen|general application|talent (?:community|pool|network)|future openings|join our (?:talent|pipeline)|expression of interest|we are always looking)\b"
ENTRY_TITLE = r"\b(intern(?:ship)?|co[\s-]?op|new\s*grad|entry)\b"
YEARS = r"\b(\d{1,2})\+?\s*years?(?:\s+of)?\s+(?:experience|exp)\b"
LOW_TRUST = ["listing", "remotive", "jobicy", "arbeitnow", "themuse", "hackernews"]
QUALITY_FLAGS = ["content_free", "agency", "mlm_scam", "personal_email_apply", "ghost_language", "ghost_duration", "requirement_incoherence", "rolling"]
BAD_VERDICTS = ["spam", "ghost", "agency", "mlm"]


def needed(pattern: str) -> list[str]:
    """For each alternative of a pattern a run of letters that any match has; nothing if one has none. Groups, classes and optional
    letters count for nothing."""
    whole = re.fullmatch(r"\\b\((?!\?)(.*)\)\\b", pattern)
    inner = whole[1] if whole else pattern
    parts, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if depth < 0:  # the outer brackets weren't one group
            return needed(f"(?:){pattern}")
        if c == "|" and not depth:
            parts.append(inner[at:i])
            at = i + 1
    out = []
    for part in [*parts, inner[at:]]:
        bare = re.sub(r"\[[^\]]*\][?*+]?", " ", part)
        while "(" in bare:
            bare = re.sub(r"\([^()]*\)[?*+]?", " ", bare)
        runs = re.findall(r"[a-z]{3,}", re.sub(r"\\.[?*+]?|\{[^}]*\}|.[?*]", " ", bare))
        if not runs:
            return []
        out.append(max(runs, key=len))
    return list(dict.fromkeys(out))


def has(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern is found, whatever the case. With the lower-cased text given, the pattern runs only where that has a run of letters
    that a match needs, which is looked for far faster."""
    found = F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))
    words = needed(pattern) if low is not None else []
    if not words:
        return found
    gate = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        gate = gate | F.contains(low, F.lit(w))
    return F.when(gate, found).otherwise(False)


def first_label(c: Column, rules: list[tuple[str, str]], low: Column | None = None) -> Column:
    return F.coalesce(*(F.when(has(c, p, low), F.lit(name)) for name, p in rules))


def all_labels(c: Column, rules: list[tuple[str, str]], low: Column | None = None) -> Column:
    return F.filter(F.array(*(F.when(has(c, p, low), F.lit(name)) for name, p in rules)), lambda x: x.isNotNull())


def is_internship(title: Column, text: Column, low: Column | None = None) -> Column:
    """A strong word in the title decides; a weak one needs a title that isn't senior; so does a strong phrase in the text (low: lower-cased)."""
    senior = has(title, SENIOR)
    return F.when(has(title, STRONG_TITLE), True).when(has(title, INTERNSHIP), ~senior).otherwise(~senior & has(text, STRONG_TEXT, low))


def internship_kind(title: Column, text: Column) -> Column:
    return F.when(is_internship(title, text), F.coalesce(first_label(title, KINDS), first_label(F.concat_ws("\n", title, text), KINDS)))


def level_tags(title: Column, text: Column) -> Column:
    return all_labels(F.concat_ws("\n", title, text), LEVEL_TAGS)


def classified(title: Column, text: Column) -> Column:
    """STRUCT(is_internship, kind, tags): the three together, each pattern once in the plan."""
    read = F.struct(title.alias("title"), text.alias("text"), F.concat_ws("\n", title, text).alias("both"))
    low = lambda x: F.struct(x["title"].alias("title"), x["both"].alias("both"), F.lower(x["both"]).alias("low"), x["text"].alias("text"))
    is_ = lambda x: F.struct(is_internship(x["title"], x["text"], x["low"]).alias("is"), x["title"].alias("title"), x["both"].alias("both"), x["low"].alias("low"))
    kind = lambda x: F.when(x["is"], F.coalesce(first_label(x["title"], KINDS), first_label(x["both"], KINDS, x["low"])))
    out = lambda x: F.struct(x["is"].alias("is_internship"), kind(x).alias("kind"), all_labels(x["both"], LEVEL_TAGS, x["low"]).alias("tags"))
    return F.transform(F.transform(F.transform(F.array(read), low), is_), out)[0]


def is_early_title(title: Column) -> Column:
    return has(title, EARLY_TITLE)


def role(title: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    out = None
    for needles, name in ROLES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(title.isNull() | (title == ""), "other").otherwise(out.otherwise("other"))


def days_open(posted: Column, first_seen: Column, last_seen: Column, now: Column) -> Column:
    """Whole days from posting, or first sight where the posting date is null or after the last sight, to the last sight."""
    last = F.coalesce(last_seen, now)
    start = F.when(posted.isNotNull() & (posted > last), first_seen).otherwise(F.coalesce(posted, first_seen))
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_seconds(last) - F.unix_seconds(start)) / 86400)), F.lit(0)).cast("long")


def quality(title: Column, text: Column, ats: Column, open_days: Column, rolling: Column, least_chars: int = 300, ghost_days: int = 45) -> Column:
    """STRUCT(score, flags, hint): 100 less the penalty of every flag that holds, 0 to 100; flags in the order of the rules."""
    read = F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), ats.isin(LOW_TRUST).alias("low"), open_days.alias("days"), F.coalesce(rolling, F.lit(False)).alias("rolling"))

    # from the first character that is no white space to the last: least_chars at least
    enough = rf"(?sU)\A\s*+\S.{{{least_chars - 2}}}.*?\S" if least_chars > 1 else r"(?U)\S" if least_chars == 1 else ""

    def with_low(x: Column) -> Column:
        both = F.concat_ws("\n", x["title"], x["text"])
        return F.struct(*(x[c].alias(c) for c in ("title", "text", "low", "days", "rolling")), both.alias("both"), F.lower(both).alias("lower"))

    def rules(x: Column) -> Column:
        """For each rule its cost where it holds, else null."""
        both, lower = x["both"], x["lower"]
        years = F.regexp_extract(x["text"], "(?i)" + YEARS, 1).try_cast("int")
        return F.array(
            F.when(~x["text"].rlike(enough), F.when(x["low"], 30.0).otherwise(20.0)),
            F.when(has(both, AGENCY, lower), F.lit(25.0)),
            F.when(has(both, SCAM, lower) | (F.rlike(lower, F.lit("whatsapp|telegram|signal")) & has(both, CONTACT_ONLY)), F.lit(45.0)),
            F.when(F.contains(x["text"], F.lit("@")) & has(x["text"], PERSONAL_EMAIL, lower), F.when(x["low"], 20.0).otherwise(8.0)),
            F.when(has(both, GHOST, lower), F.lit(20.0)),
            F.when(x["days"] > ghost_days, F.least(F.lit(25.0), 10.0 + (x["days"] - ghost_days) / 6.0)),
            F.when(has(x["title"], ENTRY_TITLE) & (F.coalesce(years >= 4, F.lit(False)) | has(x["title"], SENIOR)), F.lit(15.0)),
            F.when(x["rolling"], F.lit(2.0)),
        )

    def judged(costs: Column) -> Column:
        score = F.aggregate(costs, F.lit(100.0), lambda s, c: s - F.coalesce(c, F.lit(0.0)))
        flags = F.filter(F.transform(costs, lambda c, i: F.when(c.isNotNull(), F.array(*map(F.lit, QUALITY_FLAGS))[i])), lambda x: x.isNotNull())
        hint = F.when(costs[2].isNotNull() | (costs[1].isNotNull() & costs[0].isNotNull()), "suspect").when(F.size(F.array_remove(flags, "rolling")) > 0, "unclear").otherwise("ok")
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), flags.alias("flags"), hint.alias("hint"))

    # functions over arrays of one: each pattern stands once in the plan and runs once a row
    return F.transform(F.transform(F.transform(F.array(read), with_low), rules), judged)[0]


def shown_on_dashboard(verdict: Column, confidence: Column) -> Column:
    """Hide-low-quality: a bad verdict without confidence gives null, so a filter hides it."""
    return verdict.isNull() | ~verdict.isin(BAD_VERDICTS) | (confidence < 70)


def clear_slop(verdict: Column, confidence: Column) -> Column:
    """Kept out of alerts: a bad verdict of known confidence 70 or more."""
    return F.coalesce(verdict.isin(BAD_VERDICTS) & confidence.isNotNull() & (confidence >= 70), F.lit(False))
