"""Secret scan: fixed patterns plus sliding-window Shannon entropy per character class.

Candidate strings are runs of key-like characters.  A window slides over a candidate and its entropy is kept up to
date from the counts of the letter that enters and the one that leaves; windows above the threshold of the candidate's
class are merged into spans.  An allow list suppresses identifiers that only look random.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, parts

# Fixed values of the base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates of the letters ``pattern``, flagged where ``window`` letters hold ``bits`` of entropy or more."""

    name: str
    pattern: str
    window: int
    bits: float


#: The first class that fits decides.  Letters alone are words and digits alone are numbers: neither is a candidate.
CLASSES = (
    CharClass("hex", r"[0-9A-Fa-f]+", 20, 2.9),
    CharClass("alnum", r"[0-9A-Za-z]+", 20, 3.6),
    CharClass("base64", r"[0-9A-Za-z+/_=-]+", 20, 3.9),
)
CANDIDATE = r"[0-9A-Za-z+/_=-]{20,}"
#: Identifiers that are random by design but open: UUIDs, digests named as such, dates, versions, placeholders.
ALLOW = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?:sha(?:1|256|384|512)|md5)-[0-9A-Za-z+/=]+",
    r"\d{4}-\d{2}-\d{2}[T_-].*",
    r"(?i:.*(?:example|placeholder|changeme|x{6,}|0123456789|abcdefghij).*)",
    r"(?:[a-z]+[-_/])+[a-z]+|(?:[A-Z]+[-_/])+[A-Z]+",
)


def entropy_spans(text: str, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int]]:
    """Merged spans of high-entropy windows, start and end in code points."""
    found: list[tuple[int, int]] = []
    for match in _compiled(CANDIDATE).finditer(text):
        value = match[0]
        if not (any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value)):
            continue
        if any(_compiled(a).fullmatch(value) for a in allow):
            continue
        kind = next((c for c in classes if _compiled(c.pattern).fullmatch(value)), None)
        if kind is None or len(value) < kind.window:
            continue
        for start in _hot_windows(value, kind.window, kind.bits):
            low, high = match.start() + start, match.start() + start + kind.window
            if found and low <= found[-1][1]:
                found[-1] = (found[-1][0], high)
            else:
                found.append((low, high))
    return found


def _hot_windows(value: str, window: int, bits: float) -> Iterator[int]:
    """Starts of the windows with enough entropy: log2(n) - sum(c log2 c) / n, the sum kept by differences."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, letter in enumerate(value):
        if i >= window:
            gone = counts[value[i - window]]
            total += weight[gone - 1] - weight[gone]
            counts[value[i - window]] = gone - 1
        now = counts.get(letter, 0)
        total += weight[now + 1] - weight[now]
        counts[letter] = now + 1
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            yield i - window + 1


_PATTERNS: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = re.compile(pattern, re.ASCII)
    return _PATTERNS[pattern]


_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
#: A run shorter than 24 never counts, so asking for 24 finds the same spans and skips the others at once.
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: str, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """Base spans, and high-entropy spans that touch none of them, by start, then kind."""
    spans = base_spans(text)
    extra = [("entropy", a, b) for a, b in entropy_spans(text, classes, allow) if not any(a < e and s < b for _, s, e in spans)]
    return sorted(spans + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """``id, spans`` per row; a span is ``kind, start, end, value`` in code points, end exclusive, by start, then kind.

    Null counts as empty and has no spans; a text is scanned whole; repeated rows are repeated; extra columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    span = "array<struct<kind:string,start:int,end:int,value:string>>"
    schema = rows.select("id", F.array().cast(span).alias("spans")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            spans = [
                [{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in secret_spans(text, classes, allow)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return rows.mapInArrow(run, schema)
