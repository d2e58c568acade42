"""MinHash near-dedup of weighted shingles (BagMinHash) with exact verification and connected classes.

Signature: the multiset of five-word shingles has integer weights, discretised into the intervals [0,1), [1,2), [2,4), [4,8) ... A
Poisson process of the signature's size a unit of weight runs over each interval of a shingle, seeded by the shingle and interval
alone. Only its first point is drawn; then it splits at its interval's middle: a coin gives that point to one half, and the other half
draws its own from there on. Halves beyond the weight and halves whose first point is later than the limit go no further, down to
units of weight, whose points have a slot each. A slot keeps its least time. Two signatures agree in a slot with the weighted Jaccard
similarity as probability. The limit is a time that fills the slots of most texts; it is doubled for the others.

Candidates: texts are collapsed by SHA-256 first. Bands of the signature are hashed into buckets. In each bucket, leaders are compared
with all members; leaders are then done in that bucket, and a bucket is done once those left are of one class. The number of leaders
grows from round to round, so all pairs of different classes are compared in the end, yet a large group of near copies costs a few
comparisons a member. Nothing is capped.

Before the second round, shingles that no other open text has are set aside: what is left of a text bounds its overlap with any
other, which proves most texts of a loose group without link and leaves few to compare. Before the third, the shingles that no text
of the largest class in its bucket has bound each other text's overlap with that class in the same way. Nothing is lost by either.

Verification: sum of least counts over sum of greatest counts of the shingles, `least` or more; shingles are told apart by 64 bits.
Classes: links are contracted to the least neighbour, in rounds over written tables. After the first round texts only go with their
neighbours' least neighbours; the links of the third round and after, few by then, join classes in the end.

Defined results: a text of one to four words has one shingle, all its words; texts without words are alike only if they are equal;
a null text counts as empty; repeated rows and equal texts are of one class; class_id is the class's least document id (null only if
all are). An empty table gives an empty result. Only the named columns are read; filtered rows keep all columns, in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarryline.llm import _shared, _text

WORDS, BANDS, ROWS, LEAST = 5, 24, 5, 0.8
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of every text, ordered by row and hash."""
    start, end, row = _text.words(data, offs)
    h = _text.hashes(data, start, end)
    at, window = _text.windows(h, row, words)
    rows = row[at]
    counts = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            on = counts[short] > k
            whole[on] = _text.mix(whole[on] * _GOLD + h[first[short[on]] + k] + _U(1))
        rows, window = np.concatenate([rows, short]), np.concatenate([window, whole])
    order = np.lexsort((window, rows))
    rows, window = rows[order], window[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (window[1:] != window[:-1])])) if len(rows) else np.zeros(0, np.int64)
    return rows[new], window[new], np.diff(np.concatenate([new, [len(rows)]]))


def _uniform(seed: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((seed >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53


def bag_min_hash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures, n by size, of weighted sets given by (row, hash, integer weight); rows without any stay infinite."""
    out = np.full(n * size, np.inf)
    total = np.bincount(row, weight, minlength=n)
    todo, until = np.flatnonzero(total > 0), np.zeros(n)
    until[todo] = (np.log(size) + 3) / total[todo]
    # one process for each interval that the weight reaches: [0,1), then [2^k, 2^(k+1))
    parts_row, parts_h, parts_w, parts_low = [row], [h], [weight], [np.zeros(len(row), np.int64)]
    low, on = 1, np.flatnonzero(weight > 1)
    while len(on):
        parts_row.append(row[on])
        parts_h.append(h[on])
        parts_w.append(weight[on])
        parts_low.append(np.full(len(on), low, np.int64))
        low *= 2
        on = on[weight[on] > low]
    row, h, weight, low = map(np.concatenate, (parts_row, parts_h, parts_w, parts_low))
    while len(todo):
        active = np.zeros(n, bool)
        active[todo] = True
        own = np.flatnonzero(active[row])
        own, time, seed = _first_points(own, h, weight, low, until[row], size)
        step, limit = 0, until[row[own]]
        while len(own):
            s = seed + _U(step * 0x9E3779B97F4A7C15 % (1 << 64))
            if step:
                time = time - np.log(_uniform(_text.mix(s))) / size
                alive = time <= limit
                own, time, seed, limit, s = own[alive], time[alive], seed[alive], limit[alive], s[alive]
            slot = (_text.mix(s ^ _U(0xD1B54A32D192ED03)) >> _U(32)) * _U(size) >> _U(32)
            np.minimum.at(out, row[own] * size + slot.astype(np.int64), time)
            step += 1
        todo = todo[np.isinf(out.reshape(n, size)[todo]).any(1)]
        until[todo] *= 2
    return out.reshape(n, size)


def _first_points(own: np.ndarray, h: np.ndarray, weight: np.ndarray, low: np.ndarray, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(process, first time, seed) of every unit of weight whose first point comes by its limit, found by halving the intervals [low, 2 low)."""
    at, length = low[own], np.maximum(low[own], 1)
    seed = _interval(h[own], at, length)
    time = -np.log(_uniform(_text.mix(seed))) / (size * length)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(own):
        go = (time <= until[own]) & (at < weight[own])
        own, at, length, time, seed = own[go], at[go], length[go], time[go], seed[go]
        unit = length == 1
        done.append((own[unit], time[unit], seed[unit]))
        own, at, half, time, seed = own[~unit], at[~unit], length[~unit] // 2, time[~unit], seed[~unit]
        coin = _text.mix(seed ^ _U(0xA0761D6478BD642F))
        first = (coin & _U(1)).astype(np.int64)  # the half that has the point
        later = time - np.log(_uniform(_text.mix(coin))) / (size * half)
        own, half = np.concatenate([own, own]), np.concatenate([half, half])
        at = np.concatenate([at, at]) + np.concatenate([first, 1 - first]) * half
        time, length = np.concatenate([time, later]), half
        seed = _interval(h[own], at, length)
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (own, time, seed)


def _interval(h: np.ndarray, low: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _text.mix(h ^ _text.mix(low.astype(np.uint64) * _GOLD + length.astype(np.uint64)))


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    bits = np.ascontiguousarray(signature[:, : count * rows]).view(np.uint64).reshape(len(signature), count, rows)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for k in range(rows):
        out = _text.mix(out * _U(0xBF58476D1CE4E5B9) ^ bits[:, :, k])
    return out


def signatures(docs: DataFrame, words: int = WORDS, count: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, node (128 bits of the text's SHA-256), total (number of shingles) and bands (none for a text without words)."""
    size = count * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text", 2 << 20):
            data, offs = _text.utf8(b.column(1))
            n = len(offs) - 1
            row, h, weight = shingles(data, offs, words)
            signature = bag_min_hash(row, h, weight, n, size)
            total = np.bincount(row, weight, minlength=n).astype(np.int64)
            none = np.isinf(signature[:, 0])
            keys = bands(signature, count, rows).view(np.int64)
            raw = data.tobytes()
            node = pa.array([hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest()[:16] for i in range(n)], pa.binary())
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, count))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~none].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), node, pa.array(total), lists], ["id", "node", "total", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node binary, total long, bands array<long>")


def similarities(pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """From (a, b, text_a, text_b): (a, b, similarity), the weighted Jaccard similarity of the shingles' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _text.slices(iter([whole]), "text_a", 1 << 20):
                out = []
                known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                names = [b.column(0).to_pylist(), b.column(1).to_pylist()]
                for side in (0, 1):
                    fresh = {}
                    for i, name in enumerate(names[side]):
                        if name not in known and name not in fresh:
                            fresh[name] = i
                    if fresh:
                        row, h, n = shingles(*_text.utf8(b.column(2 + side).take(pa.array(list(fresh.values())))), words)
                        edges = np.searchsorted(row, np.arange(len(fresh) + 1))
                        known |= {name: (h[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]]) for i, name in enumerate(fresh)}
                for x, y in zip(*names, strict=True):
                    (ha, na), (hb, nb) = known[x], known[y]
                    at = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
                    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
                    least = int(np.minimum(na[same], nb[at[same]]).sum())
                    out.append(least / max(1, int(na.sum()) + int(nb.sum()) - least))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def shingle_rows(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """From (node, text): a row (node, shingle, count) for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text", 1 << 20):
            row, h, n = shingles(*_text.utf8(b.column(1)), words)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(n)], ["node", "shingle", "count"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingle long, count long")


def linkable(members: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """members with common, those that can't link in their bucket left out. common is the weight of a text's shingles that some other member
    has too; the overlap of a pair is at most the lesser common, so a pair needs common >= share * (total + other total), and a member
    alone needs it with the least total of its bucket. Exact: no link is lost."""
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("count").alias("count")).where("n = 1").groupBy("node").agg(F.sum("count").alias("single"))
    both = _shared.written(members.join(single, "node", "left").withColumn("common", F.col("total") - F.coalesce("single", F.lit(0))).drop("single"), "weighed")
    smallest = both.groupBy("bucket").agg(F.min("total").alias("smallest"))
    return both.join(smallest, "bucket").where(F.col("common") >= least / (1 + least) * (F.col("total") + F.col("smallest")) - 1e-6).drop("smallest")


def shared_with(members: DataFrame, text: DataFrame, words: int = WORDS) -> DataFrame:
    """members (bucket, node, label, total ...) of buckets with more than one class, with inside, whether they are of the class in their
    bucket that is the largest of all buckets, and in_main: total less the weight of a text's shingles that no text of that class has. A
    pair of which one is inside needs in_main >= share * (total + other total) of the other. Exact, as linkable is; inside doesn't change
    when classes grow later, so the bound holds on.

    Texts take their classes along before they are cut into shingles, and a join gives only the shingles that a class lacks."""
    members = _shared.written(members, "members")
    sizes = members.select("node", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    great = members.select("bucket", "label").distinct().join(sizes, "label").groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("bucket", "main")
    members = _shared.written(members.join(great, "bucket"), "members")
    inside = F.col("label") == F.col("main")
    who = members.select("node", "main", inside.alias("inside")).distinct()
    rows = _shared.written(class_shingles(text.join(who, "node"), words), "class-shingles")
    held = rows.where("inside").select("main", "shingle").distinct()
    lacks = rows.where("NOT inside").join(held, ["main", "shingle"], "left_anti").groupBy("node", "main").agg(F.sum("count").alias("lacks"))
    return members.withColumn("inside", inside).join(lacks, ["node", "main"], "left").withColumn("in_main", F.col("total") - F.when(F.col("inside"), 0).otherwise(F.coalesce("lacks", F.lit(0)))).drop("lacks", "main")


def class_shingles(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """From (node, main, inside, text): a row (node, main, inside, shingle, count) for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text", 1 << 20):
            row, h, n = shingles(*_text.utf8(b.column(3)), words)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(h.view(np.int64)), pa.array(n)], ["node", "main", "inside", "shingle", "count"])

    return texts.select("node", "main", "inside", "text").mapInArrow(run, "node binary, main binary, inside boolean, shingle long, count long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the label is one node of its component. Each round sends every node to its
    least neighbour's least neighbour, itself counted as one, and contracts the graph; the rounds' maps, all written, are composed
    in the end."""
    edges = _shared.written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        one = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("p"))
        to = _shared.written(one.join(one.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")), "parents")
        labels = labels.join(to, F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label"))
        edges = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = _shared.written(edges.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return _shared.written(labels, "labels")


def nearby(links: DataFrame) -> DataFrame:
    """(node, label): each node's least neighbour's least neighbour, itself counted as one: nodes of one label are of one component."""
    both = links.union(links.select("b", "a"))
    one = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("p"))
    return one.join(one.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select(F.col("v").alias("node"), F.col("q").alias("label"))


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: only the classes that the links touch are contracted anew."""
    by = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    more = components(by.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return _shared.written(moved.union(more.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def linked(docs: DataFrame, known: DataFrame, least: float = LEAST, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label) for the texts that are near copies of others. known: signatures(docs), written."""
    texts = known.groupBy("node").agg(F.min("id").alias("id"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    keys = _shared.written(texts.where(F.size("bands") > 0).select("node", "id", "total", F.explode("bands").alias("bucket")), "band-keys")
    crowded = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    open_ = _shared.written(keys.join(crowded, "bucket").groupBy("node").agg(F.min("id").alias("id"), F.first("total").alias("total"), F.collect_set("bucket").alias("own")), "open")
    digests = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text"), F.expr(f"substring(unhex(sha2(coalesce(`{text_col}`, ''), 256)), 1, 16)").alias("n"))
    text = digests.join(open_.select("node", "id"), (F.col("n") == F.col("node")) & F.col("d").eqNullSafe(F.col("id"))).select("node", "text").dropDuplicates(["node"])
    text = _shared.written(text, "candidate-texts")
    # inside: of the bucket's large class; common and in_main: what a text can share at most, see linkable and shared_with
    members = open_.select(F.explode("own").alias("bucket"), "node", "own", "total", F.col("node").alias("label"), F.col("total").alias("common"), F.lit(False).alias("inside"), F.col("total").alias("in_main"))
    share = least / (1 + least)
    links, later, labels, leaders, turn = None, None, None, 1, 0
    while True:
        if turn == 1:
            members = _shared.written(_of_many_classes(members), "members")
            if members.isEmpty():
                break
            rows = _shared.written(shingle_rows(text.join(members.select("node").distinct(), "node"), words), "shingles")
            members = linkable(members.drop("common"), rows, least)
        elif turn == 2:
            members = shared_with(members.drop("inside", "in_main"), text, words)
        members = _shared.written(members, "members")
        # leaders: the texts of a bucket that share most of themselves, the least ones where that isn't known yet; from the third round on
        # of those outside its large class, so a bucket is done when all of them have led
        order = [F.asc("node")] if turn == 0 else [F.desc(F.col("common") / F.col("total")), F.asc("node")]
        heads = first_of_each(members.where("NOT inside"), order, leaders)
        heads = _shared.written(heads.select("bucket", F.col("node").alias("head"), *(F.col(x).alias(f"head_{x}") for x in ("own", "label", "total", "common", "inside", "in_main"))), "heads")
        if heads.isEmpty():
            break
        flagged = _shared.written(members.join(heads.select("bucket", F.col("head").alias("node"), F.lit(True).alias("leads")), ["bucket", "node"], "left").withColumn("leads", F.coalesce("leads", F.lit(False))), "flagged")
        # what both can share at most
        most = F.least("common", "head_common", F.when(F.col("inside") != F.col("head_inside"), F.least("in_main", "head_in_main")))
        can = most >= share * (F.col("total") + F.col("head_total")) - 1e-6
        # a pair is made in the least of its buckets, once: when the first of both leads there. A text that has left that bucket has met the
        # others there, or can't link with any, or is of their class
        once = (F.col("bucket") == F.array_min(F.array_intersect("own", "head_own"))) & (~F.col("leads") | (F.col("node") < F.col("head")))
        met = flagged.join(heads.withColumnRenamed("bucket", "at"), (F.col("bucket") == F.col("at")) & (F.col("label") != F.col("head_label")) & can & once)
        pairs = met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
        with_texts = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        now = _shared.written(similarities(with_texts, words).where(F.col("similarity") >= least).select("a", "b"), "links")
        links = now if links is None else links.union(now)
        members = flagged.where("NOT leads").drop("leads")
        if turn < 2:
            labels = _shared.written(nearby(links), "nearby") if turn == 0 else components(links)
            members = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        else:  # these are few; they join classes in the end
            later = now if later is None else later.union(now)
        turn, leaders = turn + 1, leaders * (4 if turn < 2 else 16)
    if turn < 2:
        return components(links if links is not None else open_.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    return labels if later is None else joined_components(labels, later)


def first_of_each(members: DataFrame, order: list, n: int) -> DataFrame:
    """The first n members of each bucket; each task cuts its own before the shuffle."""
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    return ranked.where(F.col("rank") <= n).drop("rank")


def _of_many_classes(members: DataFrame) -> DataFrame:
    """Members of buckets with more than one class."""
    many = members.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("bucket")
    return members.join(many, "bucket")


def classes(docs: DataFrame, least: float = LEAST, words: int = WORDS, count: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, node (its text), label (its class) and class_id, the least id of the class."""
    known = _shared.written(signatures(docs, words, count, rows, id_col, text_col), "signatures")
    labels = linked(docs, known, least, words, id_col, text_col)
    each = known.select("id", "node").join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("label"))
    ids = each.groupBy("label").agg(F.min("id").alias("class_id"))
    return each.join(ids, "label").select("id", "node", "label", "class_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which each class keeps one: the one with its least id, of equal such rows any."""
    found = classes(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min_by("node", F.struct("id", "node")).alias("node"), F.min("id").alias("id")).select("node", "id")
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    own = docs.toDF(*names).withColumn("n", F.expr(f"substring(unhex(sha2(coalesce({t}, ''), 256)), 1, 16)"))
    both = own.join(kept, (F.col("n") == F.col("node")) & F.col(i).eqNullSafe(F.col("id"))).select(*names, "n")
    # repeated rows alike in id and text: one stays
    return both.dropDuplicates(["n", i]).select(*names).toDF(*docs.columns)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
