"""Secret scans: one minimal automaton for all rules, walked once over the bytes of all texts.

The rules' regular expressions are compiled on the driver by subset construction and minimisation into transition arrays
(their size depends on the rules only). The scan gives the places where matches end. Every rule ends in a repeated class or
at a fixed mark, so of a run of such places the last ends all matches in it; the rule's automaton of reversed strings, walked
back from there but not into the match before, gives the leftmost start. A third one, of what stands before a rule's last
group, gives that group's length. The span of a private key goes on to its END line, or without one to the last base64 line
that follows.

Letters of keywords are ASCII in either case; letters that only Unicode folds to them do not count.

Edge cases: a null or empty text has no spans; text of any length is scanned whole; equal rows give equal results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.automata import Automaton, Walk
from lodestar.llm.common import batch_of, mapped, prepare, slices, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Kind, what stands before the measured part, that part, and its least length; shorter matches are passed over, but what
#: they cover can't be matched again. Where the part is one class and nothing else ends a match sooner, its least number may
#: stand in it instead, which saves the walks.
BASE = (
    ("assign", ASSIGN, r"[A-Za-z0-9+/_.=\-]+", 6),
    ("access", "", r"AKIA[A-Z0-9]{16,}", 20),
    ("hex", "", r"[0-9a-f]{24,}", 24),
)
MORE = (
    ("private_key", "", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----", 0),
    ("host_token", "", r"gh[oprsu]_[A-Za-z0-9]+", 24),
    ("chat_token", "", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
)
RULES = BASE + MORE


#: Lines of a key without an END line: headers and blank lines, base64, a last padded line that may be shorter.
LINE = rb"[\x20\t\r]*\n[\x20\t]*"
BODY = re.compile(rb"(?:(?:" + LINE + rb"(?:[A-Za-z\-]+:\x20[^\n]*|(?=[\r\n])))*(?:" + LINE + rb"[A-Za-z0-9+/=]{40,})+(?:" + LINE + rb"[A-Za-z0-9+/]{2,}={1,2}(?=[\x20\t\r]*(?:\n|\Z)))?)?")


def key_end(joined: bytes, start: int, end: int, high: int) -> int:
    """Where the key ends whose BEGIN mark was found, in a text that ends at ``high``."""
    following = joined.find(b"-----BEGIN ", end, high)
    mark = joined[start:end].replace(b"BEGIN", b"END", 1)
    at = joined.find(mark, end, high if following < 0 else following)
    return at + len(mark) if at >= 0 else BODY.match(joined, end, high).end()


@cache
def automaton() -> Automaton:
    return Automaton([r[1] + r[2] for r in RULES])


@cache
def walks() -> list[tuple[Walk, Walk | None]]:
    """Of each rule the way back from a match's end, and that from its start over what stands before the measured part."""
    return [(Walk(before + part, backwards=True), Walk(before) if before else None) for _, before, part, _ in RULES]


def find(texts: list[bytes], scanner: Automaton) -> list[list[tuple[int, int, int]]]:
    """Rule, start and end (bytes) of the spans of each text."""
    joined = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends, rules = scanner.scan(np.frombuffer(joined, dtype=np.uint8))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (back, before) in enumerate(walks()):
        own = ends[rules >> k & 1 == 1]
        last = own[np.append(np.diff(own) != 1, True)] if len(own) else own
        done, docs = 0, np.searchsorted(starts, last - 1, side="right") - 1
        for end, doc in zip(last.tolist(), docs.tolist(), strict=True):
            low = int(starts[doc])
            start = back.furthest(joined, end, max(done, low))
            if start < 0:
                continue
            done = end
            if end - (before.furthest(joined, start, end) if before else start) >= RULES[k][3]:
                until = key_end(joined, start, end, int(starts[doc + 1]) - 1) if RULES[k][0] == "private_key" else end
                found[doc].append((k, start - low, until - low))
    return found


def in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points, by start, then kind."""
    if not spans or text.isascii():
        return sorted(spans, key=lambda s: (s[1], s[0]))
    edges = sorted({p for s in spans for p in s[1:]})
    points, at, count = {}, 0, 0
    for e in edges:
        count += len(text[at:e].decode("utf-8", "replace"))
        points[e], at = count, e
    return sorted(((k, points[a], points[b]) for k, a, b in spans), key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every rule in each document, in code points with exclusive ends."""

    compiled = automaton()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out = [[{"kind": RULES[k][0], "start": a, "end": b} for k, a, b in in_points(t, s)] for t, s in zip(texts, find(texts, compiled), strict=True)]
            yield batch_of(schema, batch.column("doc_id"), out)

    return mapped(docs.select("doc_id", "text"), search, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    compiled = automaton()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            spans = [in_points(t, s) for t, s in zip(texts, find(texts, compiled), strict=True)]
            said = [[f"{RULES[k][0]}:{a}:{b}" for k, a, b in s] for s in spans]
            base = [",".join(x for x, (k, _, _) in zip(words, s, strict=True) if k < len(BASE)) for words, s in zip(said, spans, strict=True)]
            yield batch_of(schema, batch.column("doc_id"), *([sum(x[0] == k for x in s) for s in spans] for k in range(3)), [hashlib.sha256(b.encode()).hexdigest() for b in base], [",".join(w) for w in said])

    return mapped(docs.select("doc_id", "text"), search, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what any rule finds in it is replaced by a mark of its kind."""
    compiled = automaton()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            raw = column.to_pylist()
            texts = [(t or "").encode() for t in raw]
            for i, spans in enumerate(find(texts, compiled)):
                if spans:
                    raw[i] = redacted(texts[i], spans)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(raw, type=column.type))

    prepare(spark)
    return mapped(docs, clean, docs.schema).withColumn("n_chars", F.length("text").cast("long"))


def redacted(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, joined where they overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{RULES[k][0]}]".encode()]
        at = max(at, b)
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")
