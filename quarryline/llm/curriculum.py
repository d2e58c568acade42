"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources by code point, null last, take the base weights in turn. The budget is a share of all words, dealt by weight; a
source stops at a multiple of its own words and the excess is dealt anew to the others until none is above. Only sums travel to the
driver, one row a round.

Curriculum: each source has a piecewise linear weight schedule over training time 0 to 1. Its integral, scaled to the target, is the
source's cumulative demand. The source's documents, in the order of a hash of id and text, repeated for as many epochs as needed, form
its supply; a copy is taken if its middle lies below the target, and its training position is the time at which the demand reaches
that middle. The mix is sorted by ranges of position.

Cumulative supply is a distributed prefix sum over different rows, those alike in all columns being counted before the
shuffle: hash ranges of each source are summed, the range sums are added up over their number, and a window within a range gives the
rest. So a source with a third of all rows is spread over many tasks, and so is an id, null or not, that a third of all rows have. The
mix joins each different row once with the positions of all its copies.

Defined results: a null or empty text has size 0, takes 0 words and has no copy in the mix; a null source is a source of its own;
repeated rows are documents of their own, one after the other; rows with one id and text come in the order of a digest of all their
columns; an empty table gives an empty result. `most` is a whole number, as whole documents are taken.
Extra columns pass through the mix by name; clashing names don't matter, as working columns are kept in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarryline.llm import _shared

WEIGHTS = (3.0, 1.0, 2.0)
#: Weight of a source at times 0, 0.5 and 1 relative to its base weight, by the source's number modulo three: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
RANGE_ROWS = 5_000
_STEP = 10_000
_SPLIT = "[ \\t-\\r]+"


def word_count(text: Column) -> Column:
    """Number of words, runs of other than 0x20 and 0x09-0x0D; null: 0."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, _SPLIT))).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (source, size, alike): a row for each source with source_size, n (rows), number (from 0), weight and target."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.count("*").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = _shared.written(
        sources.withColumn("number", number.cast("long"))
        .withColumn("weight", F.array(*map(F.lit, weights))[(F.col("number") % len(weights)).cast("int")])
        .withColumn("cap", most * F.col("source_size")), "sources",
    )
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        # a source is full if the level reached so far would give it its cap or more
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        held, free = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        now = (budget - (held or 0.0)) / free
        if now <= level:
            break
        level = now
    target = F.when(F.col("weight") * F.lit(level) >= F.col("cap"), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "n", "number", "weight", target.alias("target"))


def inverse_demand(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches `share` of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    whole = sum(areas)
    out, before = F.lit(schedule[-1][0]), sum(areas[:-1])
    for i in range(len(areas) - 1, -1, -1):
        (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
        rest = F.greatest(share * whole - before, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        at = rest / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        here = F.least(t0 + at, F.lit(t1))
        out = here if i == len(areas) - 1 else F.when(share * whole <= before + areas[i], here).otherwise(out)
        before -= areas[i - 1] if i else 0
    return out


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, text, d (all columns), tie (digest of the text), key (of id and text, by which documents are ordered), row (of all columns)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t, s = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col, source_col))
    marked = docs.toDF(*names).select(F.struct(*names).alias("d"), i.alias("doc_id"), s.alias("source"), t.alias("text"), F.md5(F.coalesce(t, F.lit(""))).alias("tie"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), "tie"))
    further = F.struct(*(F.col(f"d.{n}") for n in names if n != names[docs.columns.index(text_col)]))
    return marked.withColumn("key", key).withColumn("row", F.md5(F.concat_ws(":", "key", F.to_json(further))))


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each different row of docs: doc_id, source, key, row, size, alike (how many), source_size, target, number, and before,
    where the first's words start in the source; the others follow, each its size further."""
    sized = _marked(docs, id_col, text_col, source_col).select("doc_id", "source", word_count(F.col("text")).alias("size"), "key", "row")
    sized = _shared.written(sized.groupBy("doc_id", "source", "size", "key", "row").agg(F.count("*").alias("alike")).withColumn("at", F.conv(F.substring("key", 1, 8), 16, 10).cast("long")), "sizes")
    goal = _shared.written(targets(sized, weights, share, most), "targets")
    ranges = max(1, -(-(goal.agg(F.max("n")).first()[0] or 0) // RANGE_ROWS))
    step = -(-(1 << 32) // ranges)
    sized = sized.withColumn("range", F.floor(F.col("at") / step).cast("long"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("alike")
    starts = sized.groupBy("source", "range").agg(F.sum(words).alias("words")).select("source", "range", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inner", F.coalesce(F.sum(words).over(inner), F.lit(0)))
    s, g = starts.alias("s"), goal.alias("g")
    # one row a source and range: bounded by rows / RANGE_ROWS and the number of sources; joined without a hint
    heads = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "range", "start", "source_size", "target", "number")
    d, h = sized.alias("d"), heads.alias("h")
    return d.join(h, F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.range") == F.col("h.range"))).select(
        "d.doc_id", "d.source", "key", "row", "size", "alike", "source_size", "target", "number", (F.col("start") + F.col("inner")).alias("before"))


def copies(most: float = 2.0) -> Column:
    """Number of whole copies taken: epochs in which the document's middle lies below the target."""
    if most != int(most) or most < 1:
        raise ValueError(f"most must be a whole number, as whole documents are taken: {most}")
    middle = F.col("before") + F.col("size") / 2
    taken = [F.when((F.col("size") > 0) & (middle + k * F.col("source_size") < F.col("target")), 1).otherwise(0) for k in range(int(most))]
    return sum(taken[1:], taken[0]).cast("long")


def position(epoch: Column, schedules=SCHEDULES) -> Column:
    """Training position, 0 to 1, of a copy: the time at which the source's cumulative demand reaches the copy's middle."""
    share = (F.col("before") + F.col("size") / 2 + epoch * F.col("source_size")) / F.col("target")
    out = inverse_demand(share, schedules[-1])
    for k, schedule in enumerate(schedules[:-1]):
        out = F.when(F.col("number") % len(schedules) == k, inverse_demand(share, schedule)).otherwise(out)
    return out


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken, positions (an array, one for each copy taken),
    number, before, row (a digest of all columns), turn (from 0, among rows alike)."""
    plan = planned(docs, **options)
    # rows alike are dealt out again, in steps, so that no array grows with their number
    last = F.col("alike") - 1
    each = plan.withColumn("turn", F.explode(F.sequence(F.lit(0), last, F.lit(_STEP)))).withColumn("turn", F.explode(F.sequence("turn", F.least(F.col("turn") + _STEP - 1, last))))
    each = each.withColumn("before", F.col("before") + F.col("turn") * F.col("size")).withColumn("copies", copies(options.get("most", 2.0)))
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda epoch: position(epoch))).otherwise(F.array().cast("array<double>"))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), places.alias("positions"), "number", "before", "row", "turn")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, sorted by ranges of training position."""
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    plan = plan.select("row", F.explode("positions").alias("at"), F.col("doc_id").alias("id"))
    # rows alike in all columns are one here; the plan has a row for each of their copies
    rows = _marked(docs, id_col, text_col, source_col).select("row", "d").dropDuplicates(["row"])
    both = rows.join(plan, "row").select("at", "id", "row", "d")
    return both.repartitionByRange("at", "id", "row").sortWithinPartitions("at", "id", "row").select(*(F.col(f"d.c{i}").alias(n) for i, n in enumerate(docs.columns)))


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rounded = [F.round(F.try_element_at("positions", F.lit(i + 1)), 9) for i in range(2)]
    out = plan.select("doc_id", "size", "source_size", "target", "taken", rounded[0].alias("position"), rounded[1].alias("second_position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def _sql_position(x: str) -> str:
    """The same arithmetic as inverse_demand, for the three schedules."""
    return f"""CASE number % 3
    WHEN 0 THEN CASE WHEN {x} <= 0.625 THEN least((sqrt(greatest(2.25 - 2 * greatest({x}, 0), 0)) - 1.5) / -1.0, 0.5) ELSE least(0.5 + (sqrt(greatest(1.0 - 2 * greatest({x} - 0.625, 0), 0)) - 1.0) / -1.0, 1) END
    WHEN 1 THEN least(greatest({x}, 0), 1)
    ELSE CASE WHEN {x} <= 0.375 THEN least((sqrt(greatest(0.25 + 2 * greatest({x}, 0), 0)) - 0.5) / 1.0, 0.5) ELSE least(0.5 + (sqrt(greatest(1.0 + 2 * greatest({x} - 0.375, 0), 0)) - 1.0) / 1.0, 1) END
    END"""


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce('=' || doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS key, md5(coalesce(text, '')) AS tie,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, [3.0::double, 1.0::double, 2.0::double][1 + (number % 3)::int] AS weight, 2.0::double * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER q AS k, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WINDOW q AS (ORDER BY cap / weight, number)),
l AS (SELECT *, (1.5::double * (SELECT sum(source_size) FROM s) - held) / free AS level FROM o),
f AS (SELECT level FROM l WHERE weight * level < cap ORDER BY k LIMIT 1),
g AS (SELECT *, CASE WHEN (SELECT count(*) FROM f) = 0 OR weight * (SELECT level FROM f) >= cap THEN cap ELSE weight * (SELECT level FROM f) END AS target FROM w),
p AS (SELECT d.*, source_size, number, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (before + size / 2 < target)::bigint + (before + size / 2 + source_size < target)::bigint END AS copies, (before + size / 2) / target AS x FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::bigint AS taken, CASE WHEN copies > 0 THEN round(""" + _sql_position("x") + """, 9) END AS position,
    CASE WHEN copies > 1 THEN round(""" + _sql_position("(x + source_size / target)") + """, 9) END AS second_position FROM c
"""
