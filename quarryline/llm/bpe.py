"""Byte-level BPE encoding and decoding by a two-tier lookup.

A minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole, a batch of pre-tokens at once; the
stored bytes are compared, so a foreign pre-token can't pass. The others are merged by a heap of ranked pairs over a doubly linked
list of their bytes, which takes n log n steps for a pre-token of n bytes. The ids of pre-tokens already met are kept by each task
within a bound of bytes, after which the memory is emptied.

Defined results: a null or empty text has no tokens; repeated rows are encoded each by itself; an empty table gives an empty
result. Only the named id and text columns are read, so further columns can't clash. No text is special: names of special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _text

MEMO_CHARS = 5_000_000
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ȿ", "0-9²³¹¼-¾"
#: The general pattern over code points up to U+023F, where these classes are its own; the standard library matches it in half the time.
_LATIN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: In the general pattern \s is Unicode's White_Space, which lacks U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_U = np.uint64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank. Ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if not all(out):
        raise ValueError(f"the ranks in {path} have gaps")
    return out


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of n byte strings onto 0..n-1 by hash and displace: keys fall into n/3 buckets, and each bucket, largest
    first, takes the first displacement that sends its keys to free slots; a bucket of one key names its slot itself."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        data, offs = _flat(keys)
        h = _text.hashes(data, offs[:-1], offs[1:])
        bucket = self._bucket(h)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(edges)
        for i in np.argsort(-size, kind="stable"):
            own = order[edges[i] : edges[i + 1]]
            if size[i] <= 1:
                break
            base = 0
            while True:
                d = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slot(h[own][:, None], d)
                free = (self.key[slots] < 0).all(0)
                ordered = np.sort(slots, 0)
                free &= (ordered[1:] != ordered[:-1]).all(0)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[i] = base + k
                    self.key[slots[:, k]] = own
                    break
                base += 256
                if base > 1 << 24:
                    raise ValueError("two keys are equal")
        left = iter(np.flatnonzero(self.key < 0))
        for i in np.flatnonzero(size == 1):
            slot = next(left)
            self.shift[i] = -1 - slot
            self.key[slot] = order[edges[i]]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(32)) % _U(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (_text.mix(h ^ (d * _U(0xA0761D6478BD642F))) % _U(self.n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The only key each hash can stand for; its bytes must still be compared."""
        d = self.shift[self._bucket(h)]
        return self.key[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0).astype(np.uint64)))]


class Vocabulary:
    """Tokens with the perfect hash, the ranks of pairs and flat bytes for decoding."""

    def __init__(self, tokens: list[bytes], table: PerfectHash):
        self.tokens, self.table = tokens, table
        self.data, self.offs = _flat(tokens)
        self.lens = np.diff(self.offs)
        self.hash = _text.hashes(self.data, self.offs[:-1], self.offs[1:])
        rank = {t: i for i, t in enumerate(tokens)}
        self.decimal, self.decimal_offs = _flat([b"%d," % i for i in range(len(tokens))])
        self.decimal_lens = np.diff(self.decimal_offs)
        self.byte = [rank[bytes([i])] for i in range(256)]
        #: Rank of the token made of two tokens, by both their ids.
        self.pair = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None:
                    self.pair[a << 20 | b] = i

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """The id of each piece that is a token, -1 for others: first tier."""
        data, offs = _flat(pieces)
        h = _text.hashes(data, offs[:-1], offs[1:])
        key = self.table.slots(h)
        found = np.flatnonzero((self.hash[key] == h) & (self.lens[key] == np.diff(offs)))
        out = np.full(len(pieces), -1, np.int64)
        for i in found:
            if self.tokens[key[i]] == pieces[i]:
                out[i] = key[i]
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: merge the pair of least rank, the leftmost of equals, until none is left. An entry of the heap holds a pair's
        rank above its place in one integer; one whose place no longer has that pair is skipped when it comes up."""
        pair, known, after = self.pair, self.pair.get, list(range(1, len(piece) + 1))
        ids = [*map(self.byte.__getitem__, piece), -1]
        heap = [pair[k] << 32 | i for i, k in enumerate(map(self.joined, piece, piece[1:])) if k in pair]
        heapify(heap)
        before = list(range(-1, len(piece)))
        while heap:
            i = heappop(heap)
            r, i = i >> 32, i & 0xFFFFFFFF
            a = ids[i]
            if a < 0 or known(a << 20 | ids[j := after[i]]) != r or ids[j] < 0:
                continue
            ids[i], ids[j] = r, -2
            k = after[i] = after[j]
            before[k] = i
            if (c := ids[k]) >= 0 and (x := known(r << 20 | c)) is not None:
                heappush(heap, x << 32 | i)
            if (p := before[i]) >= 0 and (x := known(ids[p] << 20 | r)) is not None:
                heappush(heap, x << 32 | p)
        return [x for x in ids if x >= 0]

    def joined(self, a: int, b: int) -> int:
        return self.byte[a] << 20 | self.byte[b]

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimal[_text.ragged(self.decimal_offs[ids], self.decimal_lens[ids])].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[_text.ragged(self.offs[ids], self.lens[ids])].tobytes()


class Memo(dict):
    """Pre-token to number; a new one gets the next number and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = i = len(self)
        return i


class Encoder:
    """Encodes texts with a bounded memory of pre-tokens. pattern splits a text; each match is encoded by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import re

        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")).findall
        self.find_latin = re.compile(_LATIN).findall if pattern == GENERAL else None
        self.beyond = re.compile("[^\x00-\u023f]").search
        self.clear()

    def clear(self) -> None:
        self.memo, self.chars, self.uses = Memo(), 0, np.zeros(0, np.int64)
        self.flat, self.starts, self.lens, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def forget(self) -> None:
        """Keep the pre-tokens used most since they came, up to a third of the bound: the rest are encoded anew when they come again."""
        old, starts, lens, flat = self.memo, self.starts, self.lens, self.flat
        keep = np.argsort(-self.uses, kind="stable")[: len(old) // 3]
        keep = keep[self.uses[keep] > 1]
        wanted = np.zeros(len(old), bool)
        wanted[keep] = True
        pieces = [x for x, w in zip(old, wanted.tolist(), strict=True) if w]
        keep = np.flatnonzero(wanted)
        self.clear()
        self.memo.update(zip(pieces, range(len(pieces)), strict=True))
        self.chars, self.uses = sum(map(len, pieces)), np.zeros(len(keep), np.int64)
        self.flat = flat[_text.ragged(starts[keep], lens[keep])]
        self.lens, self.used = lens[keep], len(self.flat)
        self.starts = np.cumsum(self.lens) - self.lens

    def learn(self) -> None:
        new, self.memo.new = self.memo.new, []
        if not new:
            return
        pieces = [x.encode() for x in new]
        merged, flat, lens = self.vocabulary.merged, [], []
        for w, p in zip(self.vocabulary.whole(pieces).tolist(), pieces, strict=True):
            if w >= 0:
                flat.append(w)
                lens.append(1)
            else:
                flat += (ids := merged(p))
                lens.append(len(ids))
        lens = np.array(lens, np.int64)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(flat) + self.used, np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += len(flat)
        self.chars += sum(map(len, pieces))

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its pre-tokens."""
        if self.chars > MEMO_CHARS:
            self.forget()
        get = self.memo.__getitem__
        out = []
        for t in texts:
            find = self.find_latin if t and self.find_latin and (t.isascii() or not self.beyond(t)) else self.find
            out.append(np.fromiter(map(get, pieces := find(t)), np.int64, len(pieces)) if t else np.zeros(0, np.int64))
        self.learn()
        uses = np.bincount(np.concatenate(out or [np.zeros(0, np.int64)]), minlength=len(self.memo))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return out

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[_text.ragged(self.starts[at], self.lens[at])]


@lru_cache(maxsize=2)
def _at_driver(path: str) -> tuple[list[bytes], PerfectHash]:
    tokens = read_ranks(path)
    return tokens, PerfectHash(tokens)


_held: dict[tuple[str, str], Encoder] = {}


def _encoder(shared, name: str, pattern: str) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, by the digest of its tokens and the pattern; it serves all tasks of that worker."""
    if (name, pattern) not in _held:
        _held.clear()
        _held[name, pattern] = Encoder(Vocabulary(*shared.value), pattern)
    return _held[name, pattern]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and `ids`, the token ids."""
    return _mapped(docs, vocabulary_path, pattern, id_col, text_col, "ids array<int>", _as_ids)


def decode(tokens: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each row: its id and `bytes`, the tokens' bytes end to end; null ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(_at_driver(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list_ = shared.value[0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join([list_[i] for i in x or []]) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_tokens, the SHA-256 of its decimal ids and of the bytes decoded from them, n_bytes."""
    return _mapped(docs, vocabulary_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", _as_digests)


def _as_ids(encoder: Encoder, texts: list[str | None]) -> list[pa.Array]:
    return [pa.array([encoder.ids(x) for x in encoder.numbers(texts)], pa.list_(pa.int32()))]


def _as_digests(encoder: Encoder, texts: list[str | None]) -> list[pa.Array]:
    counts, ids_hash, bytes_hash, sizes = [], [], [], []
    vocabulary = encoder.vocabulary
    for numbers in encoder.numbers(texts):
        ids = encoder.ids(numbers)
        decoded = vocabulary.decode(ids)
        counts.append(len(ids))
        sizes.append(len(decoded))
        ids_hash.append(hashlib.sha256(vocabulary.decimals(ids)).hexdigest())
        bytes_hash.append(hashlib.sha256(decoded).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string()), pa.array(sizes, pa.int64())]


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    tokens, table = _at_driver(path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, table))
    name = hashlib.sha256(b"\n".join(base64.b64encode(t) for t in tokens)).hexdigest()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name, pattern)
        for b in _text.slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), *make(encoder, b.column(1).to_pylist())], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_vocabulary())
