"""Sightings of postings: polls counted, reappearances after a gap. A batch form over history and a streaming form with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

GAP_DAYS = 7


def sightings(polls: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """From (job_uid, ts, fingerprint, ord): poll_count, reappearances (a gap of whole days with equal content), last_present, fingerprint."""
    w = Window.partitionBy("job_uid").orderBy("ts", "ord")
    seen = polls.select("job_uid", "ts", "ord", "fingerprint", F.lag("ts").over(w).alias("before"), F.lag("fingerprint").over(w).alias("was"))
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 86400000000)
    back = (days >= gap_days) & (F.col("fingerprint") == F.col("was"))
    return seen.groupBy("job_uid").agg(F.count("*").alias("poll_count"), F.count_if(back).alias("reappearances"), F.max("ts").alias("last_present"), F.max_by("fingerprint", F.struct("ts", "ord")).alias("fingerprint"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    count, back, last, fingerprint = state.get if state.exists else (0, 0, None, None)
    rows = pd.concat(batches).sort_values(["ts", "ord"])
    at, prints = rows["ts"].to_numpy("datetime64[us]").astype("int64"), rows["fingerprint"].to_numpy(object)
    # each poll against the one before it, the first against the state
    gone = (np.diff(at, prepend=at[0] if last is None else last) // 86_400_000_000 >= GAP_DAYS) & (prints == np.concatenate([[fingerprint], prints[:-1]]))
    gone[0] &= last is not None
    count, back, last, fingerprint = count + len(at), back + int(gone.sum()), int(at[-1]), prints[-1]
    state.update((count, back, last, fingerprint))
    yield pd.DataFrame({"job_uid": [key[0]], "poll_count": [count], "reappearances": [back], "last_present_us": [last], "fingerprint": [fingerprint]})


def sightings_stream(polls: DataFrame) -> DataFrame:
    """The same counts over a stream of polls, one row a job and batch that saw it; a batch is taken in time order."""
    kind = polls.schema["job_uid"].dataType.simpleString()
    return polls.groupBy("job_uid").applyInPandasWithState(_step, f"job_uid {kind}, poll_count long, reappearances long, last_present_us long, fingerprint string", "poll_count long, reappearances long, last long, fingerprint string", "update", "NoTimeout")


def merge_batches(stream: DataFrame, path: str, keys: list[str], policies: dict[str, str], checkpoint: str, ordinal: str | None = None):
    """A sink that merges every batch into a snapshot folder, v0, v1 and so on; a batch that runs again writes the same version again. Of
    several rows of a key in a batch the first by `ordinal` counts (by a hash of the row if it is left out). Each version has all rows; the
    version before it stays until the next, for a batch that runs again, older ones go."""
    from quarryline.operators.merge import keyed_merge
    from quarryline.operators.relational import first_per

    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("_ord", F.col(ordinal) if ordinal else F.xxhash64(*batch.columns))
        new = first_per(placed, keys, "_ord").drop("_ord")
        if number:
            new = keyed_merge(spark.read.parquet(f"{path}/v{number - 1}"), new, keys, policies)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
