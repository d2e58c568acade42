"""Selections, ranks, nests and pages: the read path as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarryline.functions import classify


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order; an aggregate, so counted before the shuffle. Order columns must make rows unique."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key in input order: first-wins distinct."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows of each key before the shuffle as well."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def nested(df: DataFrame, keys: list[str], row: list[str], order: Column, name: str) -> DataFrame:
    """Rows of each key as an array of structs, by descending order (null last), then by the row itself."""
    item = F.struct((-F.coalesce(order.cast("double"), F.lit(-1e308))).alias("_o"), *row)
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in row))).alias(name))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; the number is clamped to the pages there are. order must be total."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def clamp_limit(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))




def search(
    jobs: DataFrame, scores: DataFrame, *, query: str | None = None, remote: bool | None = None, location: str | None = None, ats: str | None = None,
    company: str | None = None, min_fit: float | None = None, internships_only: bool = True, sort: str = "fit", limit: int = 25,
) -> DataFrame:
    """Filtered postings with the latest judged fit, sorted and cut. % and _ in the texts are wildcards."""
    out = jobs
    if internships_only:
        out = out.where("is_internship")
    if query:
        out = out.where(F.col("title").ilike(f"%{query}%") | F.col("description_text").ilike(f"%{query}%"))
    if remote is not None:
        out = out.where(F.col("is_remote") == remote)
    if location:
        out = out.where(F.col("location_normalized").ilike(f"%{location}%") | F.col("location_raw").ilike(f"%{location}%"))
    if ats:
        out = out.where(F.col("ats") == ats.strip().lower())
    if company:
        out = out.where(F.col("company").ilike(f"%{company}%") | F.col("company_slug").ilike(f"%{company}%"))
    out = out.join(latest_fit(scores), "job_uid", "left")
    if min_fit is not None:
        out = out.where(F.col("fit") >= min_fit)
    if sort == "deadline":
        out = out.where("deadline IS NOT NULL")
    order = {"recent": F.desc_nulls_last("posted"), "discovery": F.desc_nulls_last("discovery_score"), "deadline": F.asc_nulls_last("deadline")}.get(sort, F.desc_nulls_last("fit"))
    return out.orderBy(order, "job_uid").limit(clamp_limit(limit))


def latest_fit(scores: DataFrame, prefix: str = "llm:") -> DataFrame:
    """Latest score of a job among models of one prefix: (job_uid, fit)."""
    return scores.where(F.startswith("model", F.lit(prefix))).groupBy("job_uid").agg(F.max_by("fit_score", F.struct("scored_at", "score_id")).alias("fit"))


def dashboard(jobs: DataFrame, *, query: str | None = None, ats: str | None = None, remote: bool = False, hide_low_quality: bool = False) -> DataFrame:
    out = jobs.where("is_internship")
    if query:
        out = out.where(F.col("title").ilike(f"%{query}%") | F.col("company").ilike(f"%{query}%"))
    if ats:
        out = out.where(F.col("ats") == ats)
    if remote:
        out = out.where("is_remote")
    if hide_low_quality:
        out = out.where(classify.shown_on_dashboard(F.col("quality_verdict"), F.col("quality_confidence")))
    return out


def dashboard_order(sort: str) -> list[Column]:
    """Total order of the dashboard; an unknown key sorts by posting date."""
    if sort == "company" or sort == "title":
        return [F.asc_nulls_first(sort), F.asc("job_uid")]
    if sort == "deadline":
        return [F.asc_nulls_last("deadline"), F.asc("job_uid")]
    return [F.desc_nulls_last({"fit": "fit", "discovery": "discovery_score", "quality": "quality_score"}.get(sort, "posted")), F.asc("job_uid")]


def zero_filled(df: DataFrame, column: str, values: list[str], null_as: str) -> DataFrame:
    """Counts of every value in the list, 0 where there is none; null counts as `null_as`."""
    spark = df.sparkSession
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(null_as)).alias(column)).agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{column}` string, ord int")
    return all_.join(counts, column, "left").select(column, "ord", F.coalesce("n", F.lit(0)).alias("n"))


def cascade(left: DataFrame, steps: list[tuple[DataFrame, Column]], key: str, value: str) -> DataFrame:
    """left with `value` from the first step that matches. A step is (table of one `value` column beside its keys, condition); of
    several matches the least counts. Every step is an equi-join of its own."""
    out = left
    for i, (table, condition) in enumerate(steps):
        hits = left.join(table, condition).groupBy(left[key]).agg(F.min(table[value]).alias(f"_{i}"))
        out = out.join(hits, key, "left")
    return out.withColumn(value, F.coalesce(*(F.col(f"_{i}") for i in range(len(steps))))).drop(*(f"_{i}" for i in range(len(steps))))
