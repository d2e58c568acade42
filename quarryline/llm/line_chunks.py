"""Line dedup by repeated runs of lines, or by content-defined chunks of lines.

Runs: a part is the least run of lines from a line with words on, or back from one, with two lines with words and `least_words` words,
or one line of `line_words` words. Where it begins and ends depends on its own lines alone, and the parts within any run of lines that
holds so much cover it whole, so a line goes exactly if it lies in a repeated run that came before: passages go from end to end,
whatever stands around them. The first place of each part stays, except lines of it that repeat a part come earlier, and so does a
place that overlaps the first. Of lines that go, one with the same bytes always stays earlier. Shorter repeated lines stay.

Chunks: a rolling hash over the hashes of `window` lines ends a chunk where it is divisible by `divisor`, once the chunk has `least_lines`
lines, so boundaries follow the content and lines inserted before a passage don't shift them. A chunk of several lines with words
(`least_words` words at least) that occurs more than once in the corpus, byte for byte, stays where it comes first, by document id
(null last), then place, and is removed elsewhere, in the same document too.

Stages: a scan gives one row of hash and place a part; hashes that occur once are dropped after map-side counting; the bytes of the
rest are compared by their SHA-256; the list of removals of each document joins the documents. Hot chunks are counted before the
shuffle, and the joins have their hot keys on one side alone, which adaptive execution splits.

Defined results: null texts stay null and empty texts empty; rows alike in id and text share their fate, so repeated rows of the
first occurrence all keep it; a text of which all parts are removed becomes empty, its row stays; an empty table gives an empty
result. Further columns pass through by place, so clashing names don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _shared, _text


@dataclass(frozen=True)
class Chunking:
    window: int = 2
    divisor: int = 2
    least_lines: int = 2
    most_lines: int = 64
    least_words: int = 10


@dataclass(frozen=True)
class Runs:
    least_words: int = 10
    line_words: int = 50


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, number in its text, whether it is the first, words) of every line, in order; bytes count from data's start."""
    breaks = data == 10
    at = np.flatnonzero(breaks)
    n = len(offs) - 1
    # a line starts at each text's start and after each line break; it ends at the next break or the text's end
    row_of_break = np.searchsorted(offs, at, "right") - 1
    starts = np.concatenate([offs[:-1], at + 1])
    rows = np.concatenate([np.arange(n), row_of_break])
    ends = np.concatenate([at, offs[1:]])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = ends[np.lexsort((ends, np.concatenate([row_of_break, np.arange(n)])))]
    first_line = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    number = np.arange(len(rows)) - np.maximum.accumulate(np.where(first_line, np.arange(len(rows)), 0)) if len(rows) else rows
    word_row_start, _, _ = _text.words(data, offs)
    words = np.searchsorted(word_row_start, ends) - np.searchsorted(word_row_start, starts)
    return rows, starts, ends, number, first_line, words


def runs(column: pa.Array, how: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first line, start byte, end byte, hash) of every part, by row and start; bytes count as in chunks."""
    data, offs = _text.utf8(column)
    rows, starts, ends, number, first_line, words = _lines(data, offs)
    full = np.flatnonzero(words > 0)
    total, count = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(words > 0)])
    last_line = np.searchsorted(rows, rows, "right") - 1
    ahead = np.maximum(np.searchsorted(total, total[full] + how.least_words), np.searchsorted(count, count[full] + 2)) - 1
    back = np.minimum(np.searchsorted(total, total[full + 1] - how.least_words, "right"), np.searchsorted(count, count[full + 1] - 2, "right")) - 1
    on, off = ahead <= last_line[full], back >= full - number[full]
    alone = full[words[full] >= how.line_words]
    parts = np.unique(np.concatenate([np.stack([full[on], ahead[on]], 1), np.stack([back[off], full[off]], 1), np.stack([alone, alone], 1)]), axis=0)
    a, b = parts[:, 0], parts[:, 1]
    base = offs[rows[a]]
    return rows[a], number[a], starts[a] - base, ends[b] - base, _text.hashes(data, starts[a], ends[b])


def chunks(column: pa.Array, how: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first line, start byte, end byte, hash) of every chunk that counts; bytes count from the text's start, the line break
    that ends the chunk not included."""
    data, offs = _text.utf8(column)
    rows, starts, ends, number, first_line, words = _lines(data, offs)
    h = _text.hashes(data, starts, ends)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(how.window):
        older = np.concatenate([np.zeros(k, np.uint64), h[: len(h) - k]])
        rolled += np.where(number >= k, _text.mix(older + np.uint64(k * 0x9E3779B9)), np.uint64(0))
    cut = _text.mix(rolled) % np.uint64(how.divisor) == 0
    out: list[tuple[int, int]] = []
    begin = 0
    cut_list, last = cut.tolist(), np.concatenate([first_line[1:], [True]]).tolist() if len(rows) else []
    for i in range(len(cut_list)):
        size = i - begin + 1
        if last[i] or (cut_list[i] and size >= how.least_lines) or size >= how.most_lines:
            if size > 1:
                out.append((begin, i))
            begin = i + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    a, b = np.array(out, np.int64).T
    total, full = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(words > 0)])
    good = (total[b + 1] - total[a] >= how.least_words) & (full[b + 1] - full[a] >= 2)
    a, b = a[good], b[good]
    # all lines' hashes in order, so equal chunks have equal hashes
    key = np.zeros(len(a), np.uint64)
    for k in range(how.most_lines):
        on = np.flatnonzero(b - a >= k)
        if not len(on):
            break
        key[on] = _text.mix(key[on] * np.uint64(0x9E3779B97F4A7C15) + h[a[on] + k])
    base = offs[rows[a]]
    return rows[a], number[a], starts[a] - base, ends[b] - base, key


def _parts(column: pa.Array, how: Chunking | Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return runs(column, how) if isinstance(how, Runs) else chunks(column, how)


def _scan(docs: DataFrame, how: Chunking | Runs, with_bytes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            row, line, start, end, key = _parts(b.column(2), how)
            columns = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(line), pa.array(key.view(np.int64))]
            if with_bytes:
                data, offs = _text.utf8(b.column(2))
                raw = [data[offs[r] + s : offs[r] + e].tobytes() for r, s, e in zip(row, start, end, strict=True)]
                columns += [pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([x.count(b"\n") + 1 for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "id", "line", "key", "sha", "size"][: len(columns)])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"rid long, id {kind}, line long, key long" + ", sha binary, size long" * with_bytes)


def removals(docs: DataFrame, how: Chunking | Runs = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (hash of id and text) and gone: the parts to remove, an array of (line, key)."""
    own = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    often = _scan(own, how, False).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    seen = _shared.written(_scan(own, how, True).join(often, "key"), "parts")  # read twice below
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rid", "line")
    groups = seen.groupBy("key", "sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "sha", "first")
    gone = seen.join(groups, ["key", "sha"]).where((F.col("rid") != F.col("first.rid")) | (F.col("line") >= F.col("first.line") + F.col("size")))
    # a document has as many rows here as parts at most; rows alike in id and text add nothing
    return gone.groupBy("rid").agg(F.collect_set(F.struct("line", "key")).alias("gone"))


def _without(column: pa.Array, gone: pa.Array, how: Chunking | Runs) -> tuple[list[str | None], list[int], list[int]]:
    """(texts, lines, removed lines) after removal. An entry counts only if its part has its hash."""
    row, line, start, end, key = _parts(column, how)
    texts, wanted = column.to_pylist(), gone.to_pylist()
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    keys = key.view(np.int64)
    out, removed = [], []
    for i, (text, want) in enumerate(zip(texts, wanted, strict=True)):
        count = 0
        if text is not None and want:
            want = {(x["line"], x["key"]) for x in want}
            raw, parts, at = text.encode(), [], 0
            for c in range(edges[i], edges[i + 1]):
                if (int(line[c]), int(keys[c])) in want:
                    parts.append(raw[at : start[c]])
                    if end[c] >= at:  # parts may overlap
                        count += raw[max(at, start[c]) : end[c]].count(b"\n") + 1
                        at = end[c] + 1
            text = b"".join([*parts, raw[at:]]).decode()
            if at > len(raw) and text.endswith("\n"):
                text = text[:-1]  # the break before a removed end
        out.append(text)
        removed.append(count)
    return out, [0 if t is None else t.count("\n") + 1 for t in texts], removed


def _joined(docs: DataFrame, how: Chunking | Runs, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = docs.toDF(*names).withColumn("rid", F.xxhash64(names[docs.columns.index(id_col)], names[place]))
    return plain.join(removals(docs, how, id_col, text_col), "rid", "left").select(*names, "gone"), place


def dedup_lines(docs: DataFrame, how: Chunking | Runs = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated parts removed from their texts; rows and further columns stay."""
    joined, place = _joined(docs, how, id_col, text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, f"c{place}"):
            gone = b.column(b.num_columns - 1)
            columns = b.columns[:-1]
            if gone.null_count < len(gone):
                columns[place] = pa.array(_without(b.column(place), gone, how)[0], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, how: Chunking | Runs = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_lines, n_removed_lines, n_kept_bytes and the SHA-256 of the text left (null text: null)."""
    joined, place = _joined(docs, how, id_col, text_col)
    own = docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            texts, lines, removed = _without(b.column(1), b.column(2), how)
            raw = [None if t is None else t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r or b"") for r in raw], pa.int64()), pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in raw], pa.string())], [id_col, "n_lines", "n_removed_lines", "n_kept_bytes", "text_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select(f"c{own}", F.col(f"c{place}").alias("text"), "gone").mapInArrow(run, f"`{id_col}` {kind}, n_lines long, n_removed_lines long, n_kept_bytes long, text_sha256 string")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), Runs())
