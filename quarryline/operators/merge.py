"""Keyed merges of a new batch into a snapshot, with a policy for every column. The result is a new snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarryline.operators.relational import first_per

#: What a matched row takes: see POLICIES' functions.
POLICIES = {
    "keep": lambda old, new: old,
    "take": lambda old, new: new,
    "new_if_set": lambda old, new: F.coalesce(new, old),
    "new_if_filled": lambda old, new: F.coalesce(F.nullif(new, F.lit("")), old),
    "fill_blank": lambda old, new: F.coalesce(F.nullif(old, F.lit("")), new),
    "add": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "sticky_or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "union": lambda old, new: F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))),
    "merge_map": lambda old, new: merged_map(old, new),
}


def merged_map(old: Column, new: Column) -> Column:
    """Shallow merge; the new side wins, whatever the session's policy for repeated keys."""
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], *, null_safe: bool = False, when: Column | None = None, ordinal: str | None = None) -> DataFrame:
    """Full outer join on the keys. Columns without a policy keep the old value; `when`, over structs o and n, limits which matches
    change at all. With `ordinal`, the first of several new rows of a key counts."""
    if ordinal:
        new = first_per(new, keys, ordinal).drop(ordinal)
    columns = old.columns
    o = old.select(F.struct(*columns).alias("o"), *(F.col(k).alias(f"o_{k}") for k in keys))
    n = new.select(F.struct(*(c for c in columns if c in new.columns)).alias("n"), *(F.col(k).alias(f"n_{k}") for k in keys))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) if null_safe else F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    both = o.join(n, reduce(lambda a, b: a & b, on), "full")
    out = []
    for c in columns:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        changed = POLICIES[policies.get(c, "keep")](was, now)
        if when is not None:
            changed = F.when(when, changed).otherwise(was)
        out.append(F.when(F.col("o").isNull(), now).when(F.col("n").isNull(), was).otherwise(changed).alias(c))
    return both.select(*out)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def new_boards(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (ats, token) not known yet."""
    return found.select("ats", "token").distinct().join(known.select("ats", "token"), ["ats", "token"], "left_anti")


def board_health(boards: DataFrame, polls: DataFrame, retire_at: int = 6) -> DataFrame:
    """boards after polls (ats, token, ok, n_jobs, at), one row a board: a success resets failures and adds its jobs, a failure adds one, in
    the order of at. A polled board not known yet comes in as active."""
    last_ok = polls.groupBy("ats", "token").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    own = polls.join(last_ok, ["ats", "token"])
    counted = own.groupBy("ats", "token").agg(
        F.sum(F.when(F.col("ok"), F.col("n_jobs")).otherwise(0)).alias("seen"), F.max(F.when(F.col("ok") & (F.col("n_jobs") > 0), F.col("at"))).alias("active"), F.max(F.col("last_ok").isNotNull()).alias("healed"),
        F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).alias("fails"),
    )
    both = boards.withColumn("_known", F.lit(True)).join(counted, ["ats", "token"], "full")
    failures = F.when(F.col("fails").isNull(), F.col("consecutive_failures")).when(F.col("healed"), F.col("fails")).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + F.col("fails"))
    return both.select(
        "ats", "token", (F.coalesce("total_jobs_seen", F.lit(0)) + F.coalesce("seen", F.lit(0))).cast(boards.schema["total_jobs_seen"].dataType).alias("total_jobs_seen"),
        failures.cast(boards.schema["consecutive_failures"].dataType).alias("consecutive_failures"),
        F.coalesce("active", "last_active").alias("last_active"), F.when(failures >= retire_at, "retired").otherwise(F.coalesce("status", F.lit("active"))).alias("status"),
    )


def merge_boards(boards: DataFrame, found: DataFrame) -> DataFrame:
    """boards with those found that aren't known, as discovered. found: ats, token, company."""
    fresh = found.groupBy("ats", "token").agg(F.min("company").alias("company")).join(boards.select("ats", "token"), ["ats", "token"], "left_anti")
    return boards.unionByName(fresh.withColumns({"status": F.lit("discovered"), "total_jobs_seen": F.lit(0), "consecutive_failures": F.lit(0)}).select(*(c for c in [*fresh.columns, "status", "total_jobs_seen", "consecutive_failures"] if c in boards.columns)), allowMissingColumns=True)


def poll_summary(polls: DataFrame) -> DataFrame:
    """One row over a run's polls (ok, n_jobs, n_internships, n_inserted, n_updated): polled, failed and the sums of the others that went well."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).cast("long")
    return polls.agg(F.count("*").alias("polled"), F.count_if(~F.col("ok")).alias("failed"), total("n_jobs").alias("jobs"), total("n_internships").alias("internships"), total("n_inserted").alias("inserted"), total("n_updated").alias("updated"))


def last_high_water(runs: DataFrame) -> DataFrame:
    """One row: high_water, the checkpoint of the latest run that isn't running; null if there is none."""
    return runs.where("status <> 'running'").agg(F.max_by("checkpoint", "run_id").alias("high_water"))


def frontier_anchor(postings: DataFrame, column: str) -> DataFrame:
    """One row: anchor, the greatest id that is a whole number."""
    return postings.agg(F.max(F.when(F.col(column).rlike(r"^\d{1,18}$"), F.col(column)).cast("long")).alias("anchor"))


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores by (job_uid, input_hash): fit and model are replaced, scored_at of a known one stays."""
    return keyed_merge(old, new, ["job_uid", "input_hash"], {"fit_score": "take", "model": "take"})


def high_water(frontier: DataFrame, checkpoint: Column) -> DataFrame:
    """From (id, ok): the next high-water mark and status. Errors hold the mark just below the least failed id."""
    failed = F.min(F.when(~F.col("ok"), F.col("id")))
    best = F.max("id")
    mark = F.when(failed.isNull(), F.greatest(checkpoint, best)).otherwise(F.greatest(checkpoint, failed - 1))
    return frontier.agg(mark.alias("high_water"), F.when(failed.isNull(), "done").otherwise("partial").alias("status"))


def channel_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Channels by (contact_id, kind, value_norm): replaced only by an equal or greater confidence; verified stays."""
    wins = F.coalesce(F.col("n.confidence"), F.lit(0.0)) >= F.coalesce(F.col("o.confidence"), F.lit(0.0))
    return keyed_merge(old, new, ["contact_id", "kind", "value_norm"], {"confidence": "take", "label": "take", "status": "take", "verified": "sticky_or", "source": "new_if_set"}, when=wins)


def set_stage(applications: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Applications with the stage of changes (job_uid, stage); the first move to Applied stamps applied_at."""
    both = applications.join(changes, "job_uid", "left")
    moved = F.coalesce("stage", "status")
    return both.withColumn("applied_at", F.when((moved == "Applied") & F.col("applied_at").isNull() & F.col("stage").isNotNull(), now).otherwise(F.col("applied_at"))).withColumn("status", moved).select(*applications.columns)
