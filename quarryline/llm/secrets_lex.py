"""Secret scans by assignment-aware lexing.

Three base patterns give spans as they stand. Beside them a lexer reads name-literal pairs out of source and configuration syntax. Its
heads are names with an operator (=, :=, =>, :, quoted names too), setters and puts (setToken("x"), put("token", "x")), tags
(<token>x</token>) and PEM blocks; from a head on, a scanner with a state for each kind of value reads operands: quoted strings with
escapes, prefixes and triple quotes, back-quoted strings, here-documents, indented blocks after | or >, calls with operands of their
own, bare words, joined by + or side by side. Constants go through copies, joins and {names} in format strings; each literal is scored
by the sensitivity of every name it reaches, its length and its variety of characters. A literal over the threshold becomes a span of
kind literal, unless a base span covers it already.

Literals with white space count where they hold a PEM private key or a key wrapped over lines, or as pass phrases: three to twelve words
for a name of weight 3.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty result; texts of
any length are scanned whole. Only the named columns are read, so further columns can't clash. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _text

KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run can't hold a longer one, so this equals filtering AKIA[A-Z0-9]+ by length
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of names and their weight; a name scores the greatest weight of its parts.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "private": 2, "bearer": 2, "signature": 1, "auth": 1, "key": 1, "salt": 1, "cert": 1}
#: Heads: where a value may begin. Names, literals and tag bodies may have any length; nothing after a possessive part could take back
#: what it holds, so the scan stays linear.
_HEAD = re.compile(
    r"""(?P<quote>["'`]?)(?P<name>(?<![\w$.-])[A-Za-z_$][\w$.-]*+)(?P=quote)(?:\[\])?[\x20\t]*+(?P<op>:=|=>|=(?![=~])|:(?![:/]))[\x20\t]*+"""
    r"""|\b(?:set|with|put|add)_?(?P<set>[A-Za-z_]\w*+)\((?=[\x20\t]*+[\w"'`])"""
    r"""|(?<![\w$])(?:\w++\.)*+(?:put|set\w*+|add|header|append|define|setenv|export)\([\x20\t]*+["'](?P<put>[A-Za-z_$][\w$.-]*+)["'][\x20\t]*+,[\x20\t]*+"""
    r"""|<(?P<tag>[A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>(?P<body>[^<>]++)</(?P=tag)>"""
    r"""|-----BEGIN (?P<pem>[A-Z0-9 ]*+)-----(?P<key>[^-]*+)-----END (?P=pem)-----"""
)
_OPEN = re.compile(r"""(?P<prefix>[rRbBfFuU]{0,2})(?P<quote>\"""|\'\'\'|["'`])|<<[-~]?[\x20\t]*+["']?(?P<here>\w++)["']?[^\n]*+\n|(?P<block>[|>])[-+0-9]*+[\x20\t]*+\n""")
_CALL = re.compile(r"(?:new\s+)?[A-Za-z_$][\w$.:]*+\(")
_BARE = re.compile(r"""[^\s"'`<>{}()\[\],;]+""")
_GAP = re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)?")
_JOIN = re.compile(r"[\x20\t]*+(?:\+|\.\.|\|\||&(?!&))[\x20\t]*+(?:\r?\n[\x20\t]*+)?")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*\Z")
_HELD = re.compile(r"\{([A-Za-z_$][\w$.]*)\}")
_ENDS = {"'": re.compile(r"[^'\\\n]*+(?:\\(?:\r\n|[\s\S])[^'\\\n]*+)*+"), '"': re.compile(r'[^"\\\n]*+(?:\\(?:\r\n|[\s\S])[^"\\\n]*+)*+')}
_DEEPEST = 8
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WANTED = [*SENSITIVE]
_SPACE = re.compile(r"\s")
_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY")


def weight(name: str) -> int:
    """Sensitivity of a name: parts are split at case changes and non-letters; api and key side by side count as apikey."""
    found = [x.lower() for x in _PART.findall(name)]
    both = [a + b for a, b in zip(found, found[1:], strict=False)]
    return max((SENSITIVE.get(x, 0) for x in [*found, *both]), default=0)


def variety(literal: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


class _Values:
    """Scanner over the values of a text. Each method reads from a place on and returns where it stopped; what it finds goes to `literals`
    and, for names that have been assigned to, `copied`."""

    def __init__(self, text: str, known: set[str]):
        self.text, self.known = text, known
        self.literals: list[tuple[int, int, str]] = []
        self.copied: list[str] = []

    def literal(self, start: int, end: int) -> None:
        if end > start:
            self.literals.append((start, end, self.text[start:end]))

    def value(self, at: int, indent: int, depth: int = 0) -> int:
        """Operands joined by operators, or strings side by side."""
        while True:
            to = self.operand(at, indent, depth)
            if to == at:
                return at
            joined = _JOIN.match(self.text, to)
            after = joined or _GAP.match(self.text, to)
            if not joined and not (to and self.text[to - 1] in "\"'`" and self.text[after.end() : after.end() + 1] in ("'", '"', "`")):
                return to
            at = after.end()

    def operand(self, at: int, indent: int, depth: int) -> int:
        text = self.text
        if m := _OPEN.match(text, at):
            if m["here"]:
                return self.here(m.end(), m["here"])
            if m["block"]:
                return self.block(m.end(), indent)
            if to := self.string(m.end(), m["quote"], "f" in m["prefix"].lower()):
                return to
            return at  # a quote that isn't closed
        if depth < _DEEPEST and (m := _CALL.match(text, at)):
            return self.arguments(m.end(), indent, depth + 1)
        if text[at : at + 1] in ("(", "[") and depth < _DEEPEST:
            return self.arguments(at + 1, indent, depth + 1)
        if m := _BARE.match(text, at):
            self.bare(at, m.end())
            return m.end()
        return at

    def bare(self, start: int, end: int) -> None:
        """A bare word; + within it joins names that have been assigned to."""
        parts = self.text[start:end].split("+")
        if all(_NAME.match(x) for x in parts) and any(x in self.known for x in parts):
            self.copied += [x for x in parts if x in self.known]
        else:
            self.literal(start, end)

    def string(self, at: int, quote: str, held: bool) -> int:
        """The end of a string, past its closing quote; 0 if it isn't closed."""
        if len(quote) == 3 or quote == "`":
            end = self.text.find(quote, at)
        else:
            end = _ENDS[quote].match(self.text, at).end()
            end = end if self.text.startswith(quote, end) else -1
        if end < 0:
            return 0
        self.literal(at, end)
        if held or quote == "`":
            self.copied += [n for n in _HELD.findall(self.text[at:end]) if n in self.known]
        return end + len(quote)

    def here(self, at: int, word: str) -> int:
        """A here-document up to the line of its word, or to the text's end."""
        m = re.compile(rf"^[\x20\t]*{re.escape(word)}[\x20\t;,)]*$", re.M).search(self.text, at)
        end = m.start() if m else len(self.text)
        self.trimmed(at, end)
        return m.end() if m else end

    def block(self, at: int, indent: int) -> int:
        """The lines after | or > that are indented more than the name, or blank."""
        end = at
        while end < len(self.text):
            to = self.text.find("\n", end)
            to = len(self.text) if to < 0 else to
            line = self.text[end:to]
            if line.strip() and len(line) - len(line.lstrip(" \t")) <= indent:
                break
            end = to + 1
        end = min(end, len(self.text))
        self.trimmed(at, end)
        return end

    def trimmed(self, start: int, end: int) -> None:
        inner = self.text[start:end]
        self.literal(start + len(inner) - len(inner.lstrip()), end - (len(inner) - len(inner.rstrip())))

    def arguments(self, at: int, indent: int, depth: int) -> int:
        """The operands of a call or list up to its closing bracket, over lines; at most one name of a keyword before each."""
        text = self.text
        while at < len(text):
            m = re.compile(r"[\s,;]*+(?:[A-Za-z_]\w*+\s*+=(?!=)\s*+)?").match(text, at)
            at = m.end()
            if text[at : at + 1] in (")", "]", ""):
                return min(at + 1, len(text))
            to = self.value(at, indent, depth)
            if to == at:
                return at
            at = to
        return at


def lexed(text: str) -> list[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """Assignments in order: name, literals (start, end, value), names copied from. A bare word that has been assigned to is a name, any other a literal."""
    out, known, at, line = [], set(), 0, 0
    while m := _HEAD.search(text, at):
        if m["pem"] is not None:
            values = _Values(text, known)
            if "PRIVATE" in m["pem"]:
                values.literal(*m.span())
            name, at = m["pem"].lower().replace(" ", "_"), m.end()
        elif m["tag"]:
            values, name, at = _Values(text, known), m["tag"], m.end()
            values.trimmed(*m.span("body"))
        else:
            line = text.rfind("\n", line, m.start()) + 1 or line  # the scan goes forward, so each line is looked for once
            head = text[line : m.start()]
            name, values = m["name"] or m["put"] or m["set"], _Values(text, known)
            to = values.arguments(m.end(), 0, 1) if m["set"] else values.value(m.end(), len(head) - len(head.lstrip(" \t-")))
            at = max(to if values.literals or values.copied else m.end(), m.end())
        out.append((name, values.literals, values.copied))
        known.add(name)
    return out


def _phrase(value: str, weight: int) -> bool:
    """Whether a literal with white space is a secret: a PEM private key, a key wrapped over lines, or a pass phrase of three to twelve
    words without marks."""
    words = value.split()
    if _PRIVATE.search(value) or len(words) <= value.count("\n") + 1:
        return True
    return weight >= 3 and 3 <= len(words) <= 12 and all(x.isalnum() for x in words)


def sensitive_literals(text: str, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name. Names carry the literals last assigned to them."""
    held: dict[str, set[tuple[int, int, str]]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, literals, copied in lexed(text):
        fresh = set(literals).union(*(held.get(c, ()) for c in copied if c != name))
        if name in copied and name in held:
            fresh -= held[name]
            held[name] |= fresh  # x = x + "...": what x held before has been scored
        else:
            held[name] = fresh
        if w := weight(name):
            for start, end, value in fresh:
                bits = variety(value)
                if len(value) >= 8 and bits >= 2.5 and (not _SPACE.search(value) or _phrase(value, w)):
                    score = w + min(len(value), 40) / 20 + bits / 2 + (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) + 3 * bool(_PRIVATE.search(value))
                    best[start, end] = max(best.get((start, end), 0), score)
    return [(s, e, x) for (s, e), x in sorted(best.items()) if x >= threshold]


def scan(text: str | None, threshold: float = 6.0) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), both by start, then kind."""
    if not text:
        return [], []
    low = text.lower()
    named = any(x in low for x in ("passw", "secret", "token", "apikey", "api_key"))
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if named else []
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    place = {k: i for i, k in enumerate(KINDS)}
    base.sort(key=lambda s: (s[1], place[s[0]]))
    spans = base
    if any(x in low for x in _WANTED) and ("=" in text or ":" in text or "</" in text or "(" in text or "-----BEGIN" in text):
        extra = [("literal", s, e) for s, e, _ in sensitive_literals(text, threshold) if not any(b[1] <= s and e <= b[2] for b in base)]
        if extra:
            spans = sorted([*base, *extra], key=lambda s: (s[1], place[s[0]]))
    return base, spans


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, threshold: float = 6.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, base and spans as arrays of (kind, start, end), in order."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], span)

        for b in _text.slices(batches, "text", 1 << 20):
            both = [scan(t, threshold) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), rows(x for x, _ in both), rows(x for _, x in both)], [id_col, "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, base {each}, spans {each}")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
