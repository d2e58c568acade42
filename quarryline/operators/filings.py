"""Leads from government filings, and hosts from certificate logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarryline.functions import contacts, text, urls


def award_leads(awards: DataFrame) -> DataFrame:
    """Up to two leads of each award: the firm's contact and the principal investigator, where an address or a name is given. The domain
    is that of the firm's site, else of the address. awards: firm, company_url and poc_ and pi_ name, title and email."""
    c = F.col

    def lead(prefix: str, role: str, title: str):
        email = contacts.valid_email(contacts.picked(c(f"{prefix}_email")))
        return F.struct(
            contacts.picked(c(f"{prefix}_name")).alias("full_name"), F.coalesce(contacts.picked(c(f"{prefix}_title")), F.lit(title)).alias("title"), email.alias("email"), F.lit(role).alias("role_hint"), contacts.email_domain(email).alias("mail_domain")
        )

    both = F.filter(F.array(lead("poc", "hr", "Company Contact"), lead("pi", "hiring_manager", "Principal Investigator")), lambda x: x["email"].isNotNull() | x["full_name"].isNotNull())
    site = F.nullif(F.split_part(F.regexp_replace(urls.host(contacts.picked(c("company_url"))), r"^www\.", ""), F.lit(":"), F.lit(1)), F.lit(""))
    firm = contacts.picked(c("firm"))
    rows = awards.where(firm.isNotNull()).select(text.canonical_company(firm).alias("company_slug"), firm.alias("company_name"), site.alias("site"), F.explode(both).alias("l"))
    return rows.select("company_slug", "company_name", F.coalesce("site", "l.mail_domain").alias("domain"), "l.full_name", "l.title", "l.email", "l.role_hint")


#: The names that a filing's columns go by, in order.
FILING_COLUMNS = {
    "employer": ["EMPLOYER_NAME", "EMPLOYER_BUSINESS_DBA"], "soc": ["SOC_CODE", "PW_SOC_CODE", "LCA_CASE_SOC_CODE"], "email": ["EMPLOYER_POC_EMAIL", "EMPLOYER_POINT_OF_CONTACT_EMAIL"],
    "first_name": ["EMPLOYER_POC_FIRST_NAME", "EMPLOYER_POINT_OF_CONTACT_FIRST_NAME"], "last_name": ["EMPLOYER_POC_LAST_NAME", "EMPLOYER_POINT_OF_CONTACT_LAST_NAME"],
    "title": ["EMPLOYER_POC_JOB_TITLE", "EMPLOYER_POINT_OF_CONTACT_JOB_TITLE"], "wage": ["WAGE_RATE_OF_PAY_FROM_1", "WAGE_RATE_OF_PAY_FROM", "WAGE_OFFER_FROM_9089", "PW_AMOUNT_9089", "PREVAILING_WAGE"],
    "phone": ["EMPLOYER_POC_PHONE", "EMPLOYER_PHONE"], "soc_title": ["SOC_TITLE", "PW_SOC_TITLE"], "job_title": ["JOB_TITLE", "JOB_INFO_JOB_TITLE", "JOB_TITLE_1"], "filed": ["RECEIVED_DATE", "CASE_RECEIVED_DATE", "DECISION_DATE"],
}


def filing_columns(rows: DataFrame) -> DataFrame:
    """A filing file's rows under the names of FILING_COLUMNS: the first column that has a value; stand-ins for nothing count as none."""
    held = {c.upper(): c for c in rows.columns}
    own = lambda names: [F.col(f"`{held[n]}`") for n in names if n in held] or [F.lit(None).cast("string")]
    return rows.select(*(c for c in rows.columns if c == "ord"), *(contacts.picked(*own(names)).alias(k) for k, names in FILING_COLUMNS.items()))


def tech_filings(filings: DataFrame, prefixes: list[str]) -> DataFrame:
    """(company_slug, employer, soc): filings of technical occupations, with or without a contact."""
    own = filings.where(F.col("employer").isNotNull() & contacts.is_tech_occupation(F.col("soc"), prefixes))
    return own.select(text.canonical_company(F.col("employer")).alias("company_slug"), "employer", "soc")


def filing_leads(filings: DataFrame, prefixes: list[str], source: str = "oflc_lca") -> DataFrame:
    """A lead for each technical filing with an address of the employer's own contact; agents' addresses aren't taken. filings: employer,
    soc, first_name, last_name, title, email and what else FILING_COLUMNS names."""
    g = lambda n: contacts.picked(F.col(n)) if n in filings.columns else F.lit(None).cast("string")
    employer, email = g("employer"), contacts.valid_email(g("email"))
    name = F.nullif(F.concat_ws(" ", g("first_name"), g("last_name")), F.lit(""))
    rows = filings.where(employer.isNotNull() & contacts.is_tech_occupation(F.col("soc"), prefixes) & email.isNotNull())
    signal = F.struct(g("soc").alias("soc"), g("soc_title").alias("soc_title"), g("job_title").alias("job_title"), g("wage").alias("wage"), F.lit(True).alias("tech"))
    return rows.select(
        text.canonical_company(employer).alias("company_slug"), employer.alias("company_name"), contacts.email_domain(email).alias("domain"), name.alias("full_name"), F.coalesce(g("title"), F.lit("HR Contact")).alias("title"), email.alias("email"),
        g("phone").alias("phone"), F.lit("hr").alias("role_hint"), F.lit(source).alias("source"), signal.alias("signal"), text.parsed_time(g("filed")).alias("filed_at"),
    )


def hiring_signals(filings: DataFrame, prefixes: list[str], ord_: str = "ord") -> DataFrame:
    """(company_slug, filings, soc, domain, name): a company's technical filings, their number, and of the last ones the occupation, the
    employer's name and the domain of a contact's address where one has any. filings: `ord` and FILING_COLUMNS."""
    own = filings.where(F.col("employer").isNotNull() & contacts.is_tech_occupation(F.col("soc"), prefixes))
    domain = contacts.email_domain(contacts.valid_email(F.col("email")))
    keyed = own.select(text.canonical_company(F.col("employer")).alias("company_slug"), "employer", "soc", domain.alias("domain"), F.col(ord_).alias("o"))
    return keyed.groupBy("company_slug").agg(F.count("*").alias("filings"), F.max_by("soc", "o").alias("soc"), F.max_by("domain", F.when(F.col("domain").isNotNull(), F.col("o"))).alias("domain"), F.max_by("employer", "o").alias("name"))


def ingested(filings: DataFrame, companies: DataFrame, prefixes: list[str], source: str = "oflc_lca") -> tuple[DataFrame, DataFrame]:
    """(leads, companies): the leads of a filing file, and the companies known already with the signal of theirs in their notes under
    disclosure and its domain where they have none. companies: company_slug, name, domain, notes (JSON)."""
    from quarryline.operators import people

    signal = hiring_signals(filings, prefixes)
    told = signal.select(F.col("company_slug").alias("key"), F.to_json(F.struct("filings", "soc", "name")).alias("signal"), F.col("domain").alias("d"))
    marked = people.with_signals(companies, told)
    key = text.canonical_company(F.coalesce(F.nullif("name", F.lit("")), "company_slug"))
    both = marked.withColumn("_k", key).join(told.select(F.col("key").alias("_k"), "d"), "_k", "left")
    return filing_leads(filings, prefixes, source), both.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), "d")).select(*companies.columns)


def logged_hosts(names: DataFrame, column: str, domain: str) -> DataFrame:
    """Distinct lower-case hosts below a domain, of certificate names line by line, without leading stars and dots."""
    line = F.explode(F.split(column, r"\r?\n")).alias("v")
    host = F.lower(F.regexp_replace(F.trim("v"), r"^[*.]+", ""))
    return names.select(line).select(host.alias("host")).where(F.endswith("host", F.lit("." + domain)) & ~F.contains("host", F.lit(" "))).distinct()
