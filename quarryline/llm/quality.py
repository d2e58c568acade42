"""Quality rules: gradient-boosted trees over document statistics.

The trees are trained on the driver over a bounded sample of labelled rows (``max_rows``), with monotonic constraints on chosen
statistics, and flattened into numpy node arrays, which score whole Arrow batches at once.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged alike, each by itself; an
empty documents table gives an empty result; without labels of both kinds the verdict of the trees is to keep. Only the named id
and text columns are read, so further columns can't clash; ``quality_filter`` passes them through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _text

#: Statistic and its constraint: -1 if quality must not rise with it, 1 if it must not fall, 0 if free.
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "punctuation_share": 0, "words_per_line": 0, "non_ascii_share": 0, "end_mark_share": 0,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK, _END = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER[[*range(65, 91)]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[[*range(48, 58)]] = True
_MARK[[*b".,;:!?()\"'-"]] = True
_END[[*b".!?"]] = True


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(BASE counts as int64, STATISTICS as float64), a row for each text. Repeats are found by 64-bit hashes of five words."""
    data, offs = _text.utf8(column)
    n = len(offs) - 1
    start, end, row = _text.words(data, offs)
    n_words = np.bincount(row, minlength=n)
    lead = (data & 0xC0) != 0x80
    word_chars = _text.per_row(lead & ~_text.SEPARATOR[data], offs)
    n_symbols = _text.per_row(_SYMBOL[data], offs)
    n_repeat = np.zeros(n, np.int64)
    at, h = _text.windows(_text.hashes(data, start, end), row, 5)
    if len(at):
        key = _text.mix(h ^ (row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(row) + 1, np.int32)
        cover[at[twice]] += 1
        cover[at[twice] + 5] -= 1
        n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)
    raw = data.tobytes()
    n_dup, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x and not x.isspace()]
        n_lines[i] = len(lines)
        if len(lines) > 1:
            n_dup[i] = len(lines) - len(set(lines))
    size = np.maximum(offs[1:] - offs[:-1], 1)
    letters = np.maximum(_text.per_row(_LETTER[data], offs), 1)
    ends = np.bincount(row[_END[data[end - 1]]], minlength=n) if len(end) else np.zeros(n)
    w = np.maximum(n_words, 1)
    base = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    stats = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w,
        _text.per_row(_UPPER[data], offs) / letters, _text.per_row(_DIGIT[data], offs) / size, _text.per_row(_MARK[data], offs) / size,
        n_words / np.maximum(n_lines, 1), _text.per_row(data >= 128, offs) / size, ends / w,
    ], 1)
    return base, stats


@dataclass
class Trees:
    """Boosted trees as flat arrays: node i of all trees has a statistic (-1: leaf), a cut, its left child (right is the next) and a value."""

    start: float = 0.0
    statistic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                s = self.statistic[node]
                step = self.left[node] + (x[rows, np.maximum(s, 0)] > self.cut[node])
                node = np.where(s < 0, node, step)
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 3.0, signs: list[int] | None = None) -> Trees:
    """Histogram boosting on the logistic loss. A split on a constrained statistic must order its children's values by the sign, and
    all leaves below stay on their side of the mid value, so the score is monotonic in that statistic."""
    signs = signs or list(STATISTICS.values())
    if not len(y) or y.min() == y.max():
        return Trees(start=0.0 if not len(y) or y[0] else -1.0)
    share = y.mean()
    out = Trees(start=float(np.log(share / (1 - share))), depth=depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(y), out.start)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0.0, -1, 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            nodes[at][3] = rate * float(np.clip(sg / (sh + ridge), low, high))
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth:
                for s, sign in enumerate(signs):
                    if not len(cuts[s]):
                        continue
                    cg = np.cumsum(np.bincount(binned[rows, s], g[rows], len(cuts[s]) + 1))[:-1]
                    ch = np.cumsum(np.bincount(binned[rows, s], h[rows], len(cuts[s]) + 1))[:-1]
                    lv, rv = np.clip(cg / (ch + ridge), low, high), np.clip((sg - cg) / (sh - ch + ridge), low, high)
                    gain = lv * cg - lv**2 * (ch + ridge) / 2 + rv * (sg - cg) - rv**2 * (sh - ch + ridge) / 2 - sg**2 / (sh + ridge) / 2
                    ok = (ch >= least * 0.05) & (sh - ch >= least * 0.05) & (sign * (rv - lv) >= 0)
                    gain = np.where(ok, gain, -1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], s, k, lv[k], rv[k])
            if best[1] < 0:
                margin[rows] += nodes[at][3]
                continue
            _, s, k, lv, rv = best
            nodes[at][:3] = [s, float(cuts[s][k]), len(nodes)]
            nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
            goes = binned[rows, s] <= k
            mid, sign = (lv + rv) / 2, signs[s]
            todo.append((len(nodes) - 2, rows[goes], level + 1, mid if sign < 0 else low, mid if sign > 0 else high))
            todo.append((len(nodes) - 1, rows[~goes], level + 1, mid if sign > 0 else low, mid if sign < 0 else high))
    flat = np.array(nodes)
    out.statistic, out.cut, out.left, out.value = flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32), flat[:, 3]
    out.roots = np.array(roots, np.int32)
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees fitted on at most `max_rows` labelled documents, chosen by a hash of their ids; a label repeated for an id counts as its least."""
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            _, x = statistics(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("y")), *(pa.array(c) for c in x.T)], ["id", "y", *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, y double, " + ", ".join(f"{s} double" for s in STATISTICS))
    out = out.groupBy("id").agg(F.min(F.struct("y", *STATISTICS)).alias("v")).select("v.*").toArrow()
    if not out.num_rows:
        return Trees()
    flat = np.stack([c.to_numpy() for c in out.columns], 1)
    flat = flat[np.lexsort(flat.T)]
    return fit(flat[:, 1:], (flat[:, 0] > 0).astype(float))


def judged(base: np.ndarray, x: np.ndarray, trees: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) of each row."""
    failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
    score = 1 / (1 + np.exp(-trees.margin(x)))
    return failed, score, ~failed & (score >= threshold)


def quality_scores(docs: DataFrame, trees: Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, the base counts, the statistics, base_failed, score and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            base, x = statistics(b.column(1))
            failed, score, kept = judged(base, x, trees, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in base.T), *(pa.array(c) for c in x.T), pa.array(failed), pa.array(score), pa.array(kept)], [id_col, *BASE, *STATISTICS, "base_failed", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{s} double" for s in STATISTICS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, trees: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, text_col):
            base, x = statistics(b.column(place))
            yield b.filter(pa.array(judged(base, x, trees, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, trees).select("doc_id", *BASE, "base_failed", "kept", "score")
