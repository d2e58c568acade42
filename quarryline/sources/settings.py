"""Settings files, registries, spreadsheets and the plan of a fetch: small files read on the driver, large ones as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarryline.operators.targets import Targets


def _yaml(path: str | Path) -> dict | None:
    """A YAML file's mapping; null if the file is missing, malformed or no mapping."""
    try:
        import yaml
    except ImportError:
        return None
    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError, yaml.YAMLError):
        return None
    return {} if data is None else data if isinstance(data, dict) else None


def _strings(value) -> list[str]:
    if not value:
        return []
    return [value] if isinstance(value, str) else [str(x) for x in value if str(x).strip()] if isinstance(value, list | tuple) else []


def _slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")


def _domains(value) -> list[str]:
    return [d.lower().removeprefix("www.") for d in _strings(value)]


def load_targets(path: str | Path) -> Targets:
    """Target firms and keywords. A missing or malformed file gives settings that are switched off."""
    data = _yaml(path)
    if data is None:
        return Targets(enabled=False)
    firms = [x for x in data.get("firms") or [] if isinstance(x, dict) and str(x.get("name") or "").strip()]
    words = data.get("keywords") if isinstance(data.get("keywords"), dict) else {}
    return Targets(
        firms=[(str(x["name"]).strip(), _slug(str(x["name"])), _domains(x.get("domains")), str(x.get("priority") or "normal")) for x in firms],
        include=[w.lower() for w in _strings(words.get("include"))], exclude=[w.lower() for w in _strings(words.get("exclude"))], locations=[w.lower() for w in _strings(data.get("locations"))],
        remote_ok=bool(data.get("remote_ok", True)), enabled=bool(data.get("enabled", True)),
    )


@dataclass(frozen=True)
class Connection:
    name: str
    relationship: str = ""
    contact: str = ""
    firms: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    notes: str = ""


def load_connections(path: str | Path) -> list[Connection]:
    """People who can introduce; a missing or malformed file gives none. As (name, firms, domains) they go to targets.connection."""
    rows = [x for x in (_yaml(path) or {}).get("connections") or [] if isinstance(x, dict) and str(x.get("name") or "").strip()]
    one = lambda x, k: str(x.get(k) or "").strip()
    return [Connection(one(x, "name"), one(x, "relationship"), one(x, "contact"), _strings(x.get("firms")), _domains(x.get("domains")), _strings(x.get("tags")), one(x, "notes")) for x in rows]


def load_profile(path: str | Path, keys: list[str]) -> str:
    """The filled values of a profile under the given keys, nested lists and mappings flattened, joined by ". "."""

    def flat(x) -> Iterator[str]:
        if isinstance(x, dict):
            for v in x.values():
                yield from flat(v)
        elif isinstance(x, list | tuple):
            for v in x:
                yield from flat(v)
        elif x is not None and str(x).strip():
            yield str(x).strip()

    data = _yaml(path) or {}
    return ". ".join(v for k in keys for v in flat(data.get(k)))


def load_resume(path: str | Path) -> str | None:
    """The first filled text among the file itself, path.md, path/resume.md and the same with .txt; null if there is none."""
    path = Path(path)
    tried = [path] if path.suffix else [p for ext in (".md", ".txt") for p in (Path(f"{path}{ext}"), path / f"resume{ext}")]
    for p in tried:
        if p.is_file() and p.suffix in (".md", ".txt") and (own := p.read_text(encoding="utf-8", errors="ignore").strip()):
            return own
    return None


def load_boards(spark: SparkSession, path: str, ats: str | None = None) -> DataFrame:
    """(ats, token, company) of a registry of JSON lines; malformed lines and those without ats or token are left out."""
    rows = spark.read.schema("ats STRING, token STRING, company STRING").option("mode", "DROPMALFORMED").json(path).where("ats <> '' AND token <> ''")
    return rows.where(F.col("ats") == ats) if ats else rows


def append_boards(boards: DataFrame, path: str) -> None:
    """Adds boards to a registry of JSON lines: what isn't known there yet, as merge.new_boards tells."""
    boards.select("ats", "token", *(["company"] if "company" in boards.columns else [])).write.mode("append").option("ignoreNullFields", "true").json(path)


def load_urls(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url): the urls of JSON lines, in file order; malformed lines are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.get_json_object(F.trim("value"), "$.url").alias("url"))
    return lines.where(F.startswith("url", F.lit("http")))


_CELL = re.compile(r"([A-Z]+)")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    n = 0
    for c in _CELL.match(reference)[1]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _workbook(raw: bytes) -> zipfile.ZipFile:
    """The workbook itself, or the largest one within an archive of workbooks."""
    own = zipfile.ZipFile(io.BytesIO(raw))
    inner = [x for x in own.infolist() if x.filename.lower().endswith(".xlsx")]
    return _workbook(own.read(max(inner, key=lambda x: x.file_size))) if inner else own


def sheet_rows(raw: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, cell texts by column, read as a stream."""
    book = _workbook(raw)
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if node.tag == f"{_NS}si":
                shared.append("".join(t.text or "" for t in node.iter(f"{_NS}t")))
                node.clear()
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not sheets:
        return
    for _, node in ElementTree.iterparse(book.open(sheets[0])):
        if node.tag != f"{_NS}row":
            continue
        row: list[str | None] = []
        for cell in node.iter(f"{_NS}c"):
            at = _column_number(cell.get("r")) if cell.get("r") else len(row)
            row += [None] * (at - len(row) + 1)
            kind, value = cell.get("t"), cell.find(f"{_NS}v")
            if kind == "inlineStr":
                row[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            elif value is not None and value.text is not None:
                row[at] = shared[int(value.text)] if kind == "s" else value.text
        yield row
        node.clear()


def _headers(row: list[str | None]) -> list[str]:
    """Names of columns: a blank one is _col and its number, a repeated one gets __ and its turn."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(row):
        base = (cell or "").strip() or f"_col{i}"
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(base if not n else f"{base}__{n}")
    return out


def read_workbooks(spark: SparkSession, path: str, columns: list[str], most_rows: int | None = None) -> DataFrame:
    """(file, ord, and the given columns as text): the rows of every workbook, plain or in an archive, below a path; a column that a sheet
    lacks is null. Rows leave in batches; a file is held whole by one task. most_rows bounds the rows of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(bytes(raw))
                at = {h: i for i, h in enumerate(_headers(next(rows, [])))}
                held = []
                for n, row in enumerate(rows):
                    if most_rows is not None and n >= most_rows:
                        break
                    held.append([name, n, *(row[at[c]] if c in at and at[c] < len(row) else None for c in columns)])
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=["file", "ord", *columns])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["file", "ord", *columns])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, ord long, " + ", ".join(f"`{c}` string" for c in columns))


def fetch_plan(urls: DataFrame, cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Each url with what to do: fresh (its answer is younger than ttl seconds), revalidate (send the etag) or fetch. cache: url, etag, body, fetched_at."""
    both = urls.select("url").distinct().join(cache.select("url", "etag", "fetched_at"), "url", "left")
    return both.select("url", F.when(F.col("fetched_at") >= now - ttl, "fresh").when(F.col("etag").isNotNull(), "revalidate").otherwise("fetch").alias("action"), "etag")


def fetched(cache: DataFrame, answers: DataFrame, now: Column, most_bytes: int = 25 << 20) -> DataFrame:
    """The cache after answers (url, status, etag, body): 304 keeps the body and counts as new, 200 replaces it unless it is larger than
    `most_bytes`, anything else changes nothing."""
    a = answers.select("url", F.struct("status", "etag", "body").alias("a"))
    both = cache.withColumn("old", F.lit(True)).join(a, "url", "full")
    ok = F.coalesce((F.col("a.status") == 200) & (F.octet_length("a.body") <= most_bytes), F.lit(False))
    kept = F.coalesce(F.col("a.status") == 304, F.lit(False)) & F.col("old").isNotNull()
    out = both.where(F.col("old").isNotNull() | ok)
    return out.select("url", F.when(ok, F.col("a.etag")).otherwise(F.col("etag")).alias("etag"), F.when(ok, F.col("a.body")).otherwise(F.col("body")).alias("body"), F.when(ok | kept, now).otherwise(F.col("fetched_at")).alias("fetched_at"))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls that their host's rules for an agent let fetch: the longest Allow or Disallow that the path begins with decides, Allow on a
    tie. urls: url, host, path; robots: host, body (no row: everything is allowed)."""
    lines = F.transform(F.split(F.lower("body"), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", "")))
    text_ = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    group = F.regexp_extract(text_, rf"(?s)\nuser-agent:[ \t]*{re.escape(agent.lower())}[ \t]*\n(.*?)(?=\nuser-agent:|\Z)", 1)
    rule = F.explode_outer(F.regexp_extract_all(group, F.lit(r"(?m)^(?:allow|disallow):[ \t]*\S+"), F.lit(0))).alias("rule")
    rules = robots.select("host", rule).where("rule IS NOT NULL").select("host", F.startswith("rule", F.lit("allow")).alias("allow"), F.trim(F.regexp_replace("rule", "^[a-z]+:", "")).alias("start"))
    both = urls.join(rules, "host", "left").withColumn("fits", F.coalesce(F.startswith(F.lower("path"), F.col("start")), F.lit(False)))
    best = both.groupBy("url").agg(F.max_by("allow", F.when(F.col("fits"), F.struct(F.length("start").alias("n"), "allow"))).alias("allow"))
    return urls.join(best.where(F.coalesce("allow", F.lit(True))).select("url"), "url", "left_semi")


def polite_schedule(urls: DataFrame, at_once: int, delay: float) -> DataFrame:
    """(url, host, starts): when to fetch each url so that a host gets `at_once` requests every `delay` seconds. urls: url, host."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url")) - 1
    return urls.select("url", "host", (F.floor(turn / at_once) * delay).alias("starts"))
