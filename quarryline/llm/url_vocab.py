"""URL filters by host rules and a weighted vocabulary.

A rule names a host, which stands for its subdomains too, and a start of the path; the longest that fits decides. Where none fits, an
Aho-Corasick automaton finds the terms of a vocabulary in the url, lower-cased and with the escapes of ASCII letters and digits
decoded once; a hit counts if no ASCII letter or digit touches it, but for an s or es after it. Terms have weights: a strict one
weighs `limit` or more, so it rejects alone; distinct soft ones add up, and reject if their sum comes to `limit`.

The vocabulary is data: rows (term, weight), as a list, or a text file with a term and its weight on each line (`read_vocabulary`).
It goes to the tasks with the function, so it must fit in memory: `most_terms` bounds it, and more terms raise.

Defined results: a null url, or one without ://, has an empty host and path, so no rule fits; a null url has no hits and is allowed.
Repeated rows are judged alike; an empty table gives an empty result. Only the named columns are read, so further columns can't
clash. Urls of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _text

LIMIT = 2.0
MOST_TERMS = 1_000_000
#: Term and weight. From LIMIT on a term is strict.
VOCABULARY = [
    *((t, 2.0) for t in "porn porno xxx hentai camgirl escort nsfw milf webcamsex livesex sexcam hardcore bdsm viagra cialis levitra tramadol cheap-pills spam-farm phishing keygen cvvshop carding".split()),
    *((t, 1.0) for t in "adult sex sexy nude naked erotic fetish casino poker betting roulette blackjack jackpot slots lottery pills pharmacy steroid cheap discount spam loan payday forex replica counterfeit torrent warez crack cracked serial nulled leaked hacked dating hookup".split()),
    *((t, 0.5) for t in "free win winner bonus prize miracle weightloss seo backlink earn cash".split()),
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_ESCAPE = re.compile(r"%(4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a]|3[0-9])")


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER), m[2]


def bare(url: str) -> str:
    """A-Z lower-cased, escapes of ASCII letters and digits decoded once."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)).lower(), url.translate(_UPPER))


def read_vocabulary(path: str, default: float = 1.0) -> list[tuple[str, float]]:
    """(term, weight) of the lines of a text file; a tab parts the two, a line without weight has `default`, # begins a comment."""
    with open(path, encoding="utf-8") as f:
        rows = [line.split("#")[0].rstrip().partition("\t") for line in f]
    return [(term.strip(), float(weight) if weight.strip() else default) for term, _, weight in rows if term.strip()]


@dataclass
class Judge:
    """Rules by host and the automaton over the vocabulary."""

    rules: list[tuple[str, str, str]]
    vocabulary: list[tuple[str, float]]
    limit: float = LIMIT

    def __post_init__(self):
        import ahocorasick

        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in self.rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda x: -len(x[0]))
        self.depth = max((h.count(".") + 1 for h in self.by_host), default=0)
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.vocabulary:
            self.automaton.add_word(term.translate(_UPPER), (term, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def ruled(self, host: str, path: str) -> tuple[str, str] | tuple[None, None]:
        """(rule, verdict) of the longest rule that fits, counted in characters of host and path."""
        best: tuple = (0, None, None)
        labels = host.rsplit(".", self.depth)[-self.depth :] if self.depth else []
        for k in range(len(labels)):
            name = ".".join(labels[k:])
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and len(name) + len(start) > best[0]:
                    best = (len(name) + len(start), name + start, verdict)
        return best[1:]

    def hits(self, url: str | None) -> tuple[int, int, float]:
        """Number of distinct strict and of distinct soft terms that stand alone, and the sum of their weights."""
        if not url or not len(self.automaton):
            return 0, 0, 0.0
        low = bare(url)
        found = set()
        for end, hit in self.automaton.iter(low):
            start, after = end - len(hit[0]) + 1, end + 1
            if start and low[start - 1] in _WORD:
                continue
            if any(low.startswith(more, after) and low[after + len(more) : after + len(more) + 1] not in _WORD for more in ("", "s", "es")):
                found.add(hit)
        strict = sum(weight >= self.limit for _, weight in found)
        return strict, len(found) - strict, sum(weight for _, weight in found)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = parts(url)
        rule, verdict = self.ruled(host, path)
        strict, soft, weight = self.hits(url)
        return host, path, rule, verdict or ("block" if weight >= self.limit else "allow"), strict, soft, weight


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, vocabulary: list[tuple[str, float]] = VOCABULARY, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url", most_terms: int = MOST_TERMS) -> DataFrame:
    """A row for each row of pages: its id, host, path, rule (null where none fits), verdict, n_strict and n_soft (distinct terms), weight."""
    if len(vocabulary) > most_terms:
        raise ValueError(f"{len(vocabulary)} terms; most_terms is {most_terms}")
    terms = list(dict(vocabulary).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, terms, limit)
        for b in _text.slices(batches, "url"):
            rows = [judge.judge(u) for u in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), *(pa.array(c, pa.int64()) for c in columns[4:6]), pa.array(columns[6], pa.float64())], [id_col, "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).alias("url")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long, weight double")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _decoded(low: str) -> str:
    """SQL of bare() over a lower-cased url: escapes of letters are replaced before those of digits, a to f after the other letters, so none is decoded twice."""
    for c in "ghijklmnopqrstuvwxyzabcdef0123456789":
        for x in dict.fromkeys((c, c.upper())):
            low = f"replace({low}, '%{ord(x):x}', '{c}')"
    return low


def _term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(term)}(e?s)?([^a-z0-9]|$)')::bigint"


_FITS = " UNION ALL ".join(f"SELECT '{h}' h, '{p}' p, '{v}' v" for h, p, v in RULES)
_ALL = [f"{_term(t)} AS t{i}" for i, (t, _) in enumerate(VOCABULARY)]
OP4_SQL = rf"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS n, {_decoded("translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS ({_FITS}),
best AS (SELECT n, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS v FROM p, rules r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY n),
terms AS (SELECT *, {", ".join(_ALL)} FROM p),
hits AS (SELECT page_id, n, host, path, {" + ".join(f"t{i}" for i, (_, w) in enumerate(VOCABULARY) if w >= LIMIT)} AS n_strict, {" + ".join(f"t{i}" for i, (_, w) in enumerate(VOCABULARY) if w < LIMIT)} AS n_soft,
        {" + ".join(f"{w}::double * t{i}" for i, (_, w) in enumerate(VOCABULARY))} AS weight FROM terms)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft, weight
FROM hits LEFT JOIN best USING (n)
"""
