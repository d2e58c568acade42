"""Dedup of postings: exact, fuzzy by title within a company, semantic by vectors, and identities of people."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quarryline.functions import scoring, text
from quarryline.operators import graph
from quarryline.operators.relational import first_per

#: Sources that win as the canonical posting.
TIER_A = ["greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "personio"]


def _alike(a: str, b: str, least: float) -> bool:
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def fuzzy_groups(jobs: DataFrame, least: float = 0.9) -> DataFrame:
    """(ord, leader): each posting, in input order within its company, joins the first group that has a like member: title ratio of
    `least` or more and compatible place (remote, unknown or equal). leader is the group's first ord.

    The rule is sequential in a company, so one task takes a company; only keys travel there, no texts. Equal postings (title,
    place, remote) after the first join the group that their like joins first, found by comparing distinct keys alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        groups: list[tuple[int, list[tuple[str, str | None, bool]], set]] = []
        out = []
        for ord_, title, place, remote in zip(pdf["ord"], pdf["title_key"], pdf["place"], pdf["is_remote"], strict=True):
            place = None if pd.isna(place) else place
            key = (title, place, bool(remote))
            for leader, members, known in groups:
                if key in known or any((remote or m[2] or place is None or m[1] is None or place == m[1]) and _alike(title, m[0], least) for m in members):
                    if key not in known:
                        known.add(key)
                        members.append(key)
                    out.append((ord_, leader))
                    break
            else:
                groups.append((ord_, [key], {key}))
                out.append((ord_, ord_))
        return pd.DataFrame(out, columns=["ord", "leader"])

    return jobs.select("company_slug", "ord", "title_key", "place", "is_remote").groupBy("company_slug").applyInPandas(run, "ord long, leader long")


def duplicate_key(slug, title) -> list:
    """Columns that postings of one title in one company share."""
    return [slug.alias("company_slug"), text.title_key(title).alias("title_key")]


def exact_first(jobs: DataFrame) -> DataFrame:
    """First posting of each url_hash in input order."""
    return first_per(jobs, ["url_hash"], "ord")


def collapse(jobs: DataFrame, least: float = 0.9) -> DataFrame:
    """Canonical postings: first of each url, then the best of each fuzzy group (tier, date of posting, first sight), with the number
    of others in times_seen_elsewhere. jobs: ord, url_hash, company_slug, title_key, place, is_remote, ats, posted, first_seen."""
    kept = exact_first(jobs)
    grouped = kept.join(fuzzy_groups(kept, least), "ord")
    rank = F.struct(F.when(F.col("ats").isin(TIER_A), 0).otherwise(1), F.coalesce("posted", F.lit(1 << 62)), "first_seen", "ord")
    return grouped.groupBy("leader").agg(F.min_by("ord", rank).alias("ord"), (F.count("*") - 1).alias("times_seen_elsewhere"))


def _units(column) -> np.ndarray:
    """Rows of an array column as unit vectors in double; a zero vector stays zero."""
    out = np.array([np.asarray(v, np.float64) for v in column])
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def similar_pairs(vectors: DataFrame, block: str, key: str, vector: str, least: float, tile: int = 2048) -> DataFrame:
    """(a, b, similarity) within blocks, a before b. A block of n vectors is cut into about n / `tile` tiles; a task multiplies the matrices
    of one pair of tiles, so a large block spreads over many tasks and a task holds two tiles. Only pairs of `least` or more leave it."""
    own = vectors.select(F.col(block).alias("k"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    tiles = own.groupBy("k").agg(F.ceil(F.count("*") / tile).cast("int").alias("n"))
    placed = own.join(tiles, "k").withColumn("t", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("k", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "v")
    kind = vectors.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["t"] == i], pdf[pdf["t"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pdf["id"].iloc[:0], "b": pdf["id"].iloc[:0], "similarity": np.zeros(0)})
        own, other, dots = left["id"].to_numpy(), right["id"].to_numpy(), _units(left["v"]) @ _units(right["v"]).T
        x, y = np.nonzero(dots >= least)
        keep = own[x] < other[y] if i == j else own[x] != other[y]
        x, y = x[keep], y[keep]
        return pd.DataFrame({"a": np.where(own[x] < other[y], own[x], other[y]), "b": np.where(own[x] < other[y], other[y], own[x]), "similarity": dots[x, y]})

    return dealt.groupBy("k", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def semantic_groups(vectors: DataFrame, block: str, key: str, vector: str, least: float = 0.9) -> DataFrame:
    """(node, label): connected components over similar pairs, singles left out; label is the least key."""
    return graph.components(similar_pairs(vectors, block, key, vector, least).select("a", "b"))


def collapse_semantic(jobs: DataFrame, vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Canonical postings by semantic groups: the best of each (tier, date of posting, first sight), with the number of others added to its
    times_seen_elsewhere. jobs: ord, ats, posted, first_seen, times_seen_elsewhere; vectors: ord, company_slug, vector."""
    groups = semantic_groups(vectors, "company_slug", "ord", "vector", least).select(F.col("node").alias("ord"), F.col("label").alias("leader"))
    both = jobs.join(groups, "ord", "left").withColumn("leader", F.coalesce("leader", "ord"))
    rank = F.struct(F.when(F.col("ats").isin(TIER_A), 0).otherwise(1), F.coalesce("posted", F.lit(1 << 62)), "first_seen", "ord")
    out = both.groupBy("leader").agg(F.min_by(F.struct("ord", "times_seen_elsewhere"), rank).alias("b"), F.count("*").alias("n"))
    return out.select("b.ord", (F.coalesce("b.times_seen_elsewhere", F.lit(0)) + F.col("n") - 1).alias("times_seen_elsewhere"))


def embedding_plan(texts: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """texts with key (SHA-256 of the text), vector (of the cache, null: none) and action: cached, or encode for those without one and for
    those whose vector's size isn't the commonest. cache: key, vector."""
    keyed = texts.withColumn("key", F.sha2(F.col(column), 256)).join(cache.groupBy("key").agg(F.first("vector").alias("vector")), "key", "left")
    size = F.size("vector")
    commonest = keyed.where("vector IS NOT NULL").groupBy(size.alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("usual"))
    return keyed.join(F.broadcast(commonest), how="cross").withColumn("action", F.when(F.col("vector").isNotNull() & (size == F.col("usual")), "cached").otherwise("encode")).drop("usual")  # one row


def ranked_jobs(jobs: DataFrame, profile: list[float], vector: str, key: str) -> DataFrame:
    """jobs with fit, their cosine to the profile held to 0 and 1, best first."""
    raw = scoring.cosine(F.col(vector), F.array(*map(F.lit, profile)))
    return jobs.withColumn("_c", raw).withColumn("fit", scoring.clamp(F.col("_c"), 0.0, 1.0)).orderBy(F.desc("_c"), key).drop("_c")


#: Bytes of one block of seeds or queries sent to all workers.
BLOCK_BYTES = 64 << 20


def _blocks(seeds: DataFrame, key: str, vector: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, unit vectors) of the seeds, block after block of about `block` rows and BLOCK_BYTES."""
    count, size = seeds.agg(F.count("*"), F.max(F.size(vector))).first()
    parts = max(-(-count // block), -(-(count * max(size or 0, 1) * 8) // BLOCK_BYTES), 1)
    dealt = seeds.select(key, F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    for i in range(parts):
        rows = dealt.where(F.col("part") == i).orderBy(key).collect()
        if rows:
            yield [r[0] for r in rows], _units([r["v"] for r in rows])


def nearest_seed(candidates: DataFrame, seeds: DataFrame, key: str, vector: str, n: int, block: int = 10_000) -> DataFrame:
    """The n candidates closest to any seed: (key, similarity). Any number of seeds: a block of them at a time goes to all workers as one
    matrix, and each candidate's best is found in its batch, without a shuffle."""
    kind = candidates.schema[key].dataType.simpleString()
    best = None
    for _, matrix in _blocks(seeds, key, vector, block):
        held = candidates.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"k": b["k"], "similarity": (_units(b["v"]) @ held.value.T).max(1)})

        own = candidates.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"k {kind}, similarity double").orderBy(F.desc("similarity"), "k").limit(n)
        best = own if best is None else best.unionAll(own)
    if best is None:
        return candidates.select(key, F.lit(0.0).alias("similarity")).limit(0)
    return best.groupBy("k").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "k").limit(n).select(F.col("k").alias(key), "similarity")


def similar_companies(vectors: DataFrame, tracked: DataFrame, hiring: DataFrame, n: int, key: str = "company_slug", vector: str = "vector") -> DataFrame:
    """The n companies that hire and aren't tracked, closest to any tracked one: (key, similarity). tracked and hiring have the key."""
    own = vectors.join(hiring.select(key).distinct(), key, "left_semi").join(tracked.select(key).distinct(), key, "left_anti")
    return nearest_seed(own, vectors.join(tracked.select(key).distinct(), key, "left_semi"), key, vector, n)


def cosine_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 10_000) -> DataFrame:
    """(query, key, similarity, place): for each query the k most similar of all rows but itself, ties by key. Any number of queries: a block
    of them at a time goes to all workers as one matrix; each batch of rows keeps its own k best of each query."""
    kind = rows.schema[key].dataType.simpleString()
    pairs = None
    for names, matrix in _blocks(queries, key, vector, block):
        held = rows.sparkSession.sparkContext.broadcast((np.array(names), matrix))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, matrix = held.value
            for b in batches:
                if not len(b):
                    continue
                ids, dots = b["k"].to_numpy(), _units(b["v"]) @ matrix.T
                dots[ids[:, None] == names[None, :]] = -np.inf
                bound = -np.partition(-dots, min(k, len(ids)) - 1, axis=0)[min(k, len(ids)) - 1]
                x, y = np.nonzero((dots >= bound) & np.isfinite(dots))  # ties at the bound stay; the window cuts them
                yield pd.DataFrame({"query": names[y], "k": ids[x], "similarity": dots[x, y]})

        own = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"query {kind}, k {kind}, similarity double")
        pairs = own if pairs is None else pairs.unionAll(own)
    if pairs is None:
        return rows.select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(0).alias("place")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "k")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", F.col("k").alias(key), "similarity", "place")


def merge_people(people: DataFrame) -> DataFrame:
    """(ord, leader) of records of one person in a company. Two records join if they share a github, linkedin or email id, a verified
    channel, or the name where one side has an id or a verified channel; never if an id of both sides differs.

    No pair is made: whether two records that share something may join depends on the ids that both have, so those of one pattern of
    known ids and those of another that agree in the ids common to both patterns all join, if there are any of both. Each such meeting
    place is a key of its own, and its records are linked to its least one.

    people: company_slug, ord, gh, li, em, name (null or lower case), verified (array of strings)."""
    ids = ["gh", "li", "em"]
    filled = people.select(F.struct("company_slug", "ord").alias("node"), "company_slug", *(F.nullif(c, F.lit("")).alias(c) for c in ids), F.nullif("name", F.lit("")).alias("name"), F.array_distinct(F.filter(F.coalesce("verified", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("verified"))
    bit = lambda c, n: F.when(c, n).otherwise(0)
    own = filled.withColumn("p", sum((bit(F.col(c).isNotNull(), 1 << i) for i, c in enumerate(ids)), bit(F.size("verified") > 0, 8)))
    patterns = [r.p for r in own.select("p").distinct().collect()]  # 16 at most
    if not patterns:
        return filled.select("node.ord", F.col("node.ord").alias("leader"))
    shared = F.concat(F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("t"), F.col(c).alias("v"))) for c in ids), F.when(F.col("name").isNotNull(), F.struct(F.lit("name").alias("t"), F.col("name").alias("v")))), lambda x: x.isNotNull()), F.transform("verified", lambda v: F.struct(F.lit("ver").alias("t"), v.alias("v"))))
    rows = own.withColumn("k", F.explode(shared)).withColumn("q", F.explode(F.array(*map(F.lit, patterns)))).where("NOT (k.t = 'name' AND p = 0 AND q = 0)")
    both = F.col("p").bitwiseAND(F.col("q"))
    place = F.struct("company_slug", "k", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), *(F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).alias(c) for i, c in enumerate(ids)))
    # a digest stands for the place: its parts may be null
    met = rows.select(F.sha2(F.to_json(place), 256).alias("place"), "node", "p", (F.col("p") == F.col("q")).alias("alike"))
    open_ = met.groupBy("place").agg(F.min("node").alias("first"), F.count("*").alias("n"), ((F.min("p") != F.max("p")) | F.max("alike")).alias("fits")).where("n > 1 AND fits").select("place", "first")
    links = met.join(open_, "place").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    groups = graph.components(links)
    return filled.join(groups, "node", "left").select("node.ord", F.coalesce("label.ord", "node.ord").alias("leader"))
