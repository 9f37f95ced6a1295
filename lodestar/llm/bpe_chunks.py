"""BPE encoding and decoding with content-defined chunks that are encoded once and joined by repair.

A rolling hash over the last bytes cuts texts where its low bits are zero, so equal passages of different documents are cut
alike. A chunk met before in a task is not encoded again. What is held of a chunk are the ids of the words between its first
and its last white space, those of the first and of the last of these words alone, and the bytes outside them.

A join is repaired by encoding anew the bytes from the last such word of the chunk before it to the first of the chunk after
it. It holds if the new ids begin and end with those that the chunks have for these two words. Where they differ, both chunks
are given up in that text and the join is encoded again with all their bytes, until the ids agree or the join is the whole
text. Chunks without such a word belong to a join from the start. Decoded texts are joined in the same way.

Edge cases: a null or empty text has no ids; chunks have no greatest length, a text without white space is one join; equal
rows give equal results; an empty table gives an empty result; further columns are ignored. A vocabulary that does not split
at white space in the way ``wordbpe`` relies on raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import batch_of, mapped, slices, table

#: Bytes the hash sees, bits of it that must be zero at a cut, chunks of each generation of the cache.
WINDOW, BITS, CHUNKS = 8, 8, 30_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BLANKS = (b"\t", b"\n", b"\r", b"\x0b", b"\x0c")
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.random.default_rng(20_011).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, table: np.ndarray, window: int = WINDOW, bits: int = BITS) -> np.ndarray:
    """Positions after which the rolling hash of the last bytes cuts."""
    h = np.zeros(len(data), dtype=np.uint32)
    v = table[data]
    for k in range(min(window, len(data))):
        h[k:] += v[: len(v) - k] * np.uint32(1 << (3 * k))
    return np.nonzero(h >> np.uint32(32 - bits) == 0)[0] + 1


def chunked(texts: list[bytes], hashes: np.ndarray) -> list[list[bytes]]:
    """Chunks of each text; cuts see bytes of the same text only, but for its first few, where they fall on the text's start anyhow."""
    out = []
    joined = b"".join(texts)
    at = cuts(np.frombuffer(joined, dtype=np.uint8), hashes)
    start = 0
    for t in texts:
        end = start + len(t)
        low, high = np.searchsorted(at, (start + WINDOW, end))
        edges = [start, *at[low:high].tolist(), end]
        out.append([joined[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b])
        start = end
    return out


class ChunkCodec:
    """Encodes and decodes texts by chunks; chunks are shared by all texts that it is given."""

    def __init__(self, path: str | None = None):
        from lodestar.llm.wordbpe import Generations, WordBPE

        self.bpe, self.hashes = WordBPE(path), gear()
        self.chunks, self.joins = Generations(CHUNKS), Generations(CHUNKS)

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that begin and end at white space or at a text's ends."""
        return self.bpe.encode([p.decode("utf-8", "replace") for p in parts])

    @staticmethod
    def _split(chunk: bytes) -> tuple[int, int, int, int] | None:
        """Where the first word between two white spaces begins and ends, and the last one; none without such a word."""
        first = SPACE.search(chunk)
        last = chunk.rfind(b" ")
        last = max(last, *(chunk.rfind(c, last + 1) for c in BLANKS)) if first else -1
        if last < 0 or not (words := chunk[first.start() : last].split()):
            return None
        begin = chunk.index(words[0], first.start())
        end = chunk.rindex(words[-1], 0, last) + len(words[-1])
        return begin, begin + len(words[0]), end - len(words[-1]), end

    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks that are not known yet."""
        known, split = self.chunks.new, [(c, self._split(c)) for c in chunks]
        known.update((c, None) for c, at in split if at is None)
        split = [(c, at) for c, at in split if at]
        middle = self._ids([c[at[0] : at[3]] for c, at in split])
        first, last = self._ids([c[at[0] : at[1]] for c, at in split]), self._ids([c[at[2] : at[3]] for c, at in split])
        for (c, at), ids, one, other in zip(split, middle, first, last, strict=True):
            known[c] = (c[: at[1]], one, ids, self.bpe.decode(ids), other, c[at[2] :])

    def _heal(self, joins: list[tuple[bytes, bytes | None, bytes | None]]) -> None:
        """Encodes joins (bytes, ids that they must begin and end with, none at a text's ends) that are not known yet."""
        known = self.joins.new
        for (data, left, right), ids in zip(joins, self._ids([j[0] for j in joins]), strict=True):
            begin, end = len(left or b""), len(ids) - len(right or b"")
            if begin <= end and ids.startswith(left or b"") and ids.endswith(right or b""):
                known[data, left, right] = (ids[begin:end], self.bpe.decode(ids[begin:end]))
            else:
                known[data, left, right] = None

    @staticmethod
    def _plan(chunks: list[bytes], held: list[tuple | None]) -> list:
        """Joins and the chunks between them, in turn."""
        plan, open_, left = [], [], None
        for c, h in zip(chunks, held, strict=True):
            if h is None:
                open_.append(c)
            else:
                plan += [(b"".join([*open_, h[0]]), left, h[1]), h]
                open_, left = [h[5]], h[4]
        plan.append((b"".join(open_), left, None))
        return plan

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each text."""
        docs = chunked(texts, self.hashes)
        fresh = self.chunks.unknown({c for d in docs for c in d})
        self._learn(fresh)
        held = [[self.chunks.new[c] for c in d] for d in docs]
        plans = [self._plan(d, h) for d, h in zip(docs, held, strict=True)]
        wanted = joins = self.joins.unknown({j for p in plans for j in p[::2]})
        known = self.joins.new
        while True:
            self._heal(wanted)
            differ = [i for i, p in enumerate(plans) if any(known[j] is None for j in p[::2])]
            if not differ:
                break
            for i in differ:  # a text in one join has nothing to differ from
                bad = {id(plans[i][m]) for k, j in enumerate(plans[i][::2]) if known[j] is None for m in (2 * k - 1, 2 * k + 1) if 0 < m < len(plans[i])}
                held[i] = [None if id(h) in bad else h for h in held[i]]
                plans[i] = self._plan(docs[i], held[i])
            wanted = list({j for i in differ for j in plans[i][::2] if j not in known})
            joins = joins + wanted
        out = []
        for plan in plans:
            parts = [known[x] if k % 2 == 0 else x[2:4] for k, x in enumerate(plan)]
            out.append((b"".join([x[0] for x in parts]), b" ".join([x[1] for x in parts if x[1]])))
        for c in fresh:  # long ones are not kept for later texts
            if len(c) > 1024:
                del self.chunks.new[c]
        for j in joins:
            if len(j[0]) > 1024:
                del known[j]
        return out


def encode(docs: DataFrame, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """The number of ids of each document and digests of its ids and of the text they decode to; ``ids`` adds both themselves."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        if ids:
            schema = schema.append(pa.field("ids", pa.list_(pa.int64()))).append(pa.field("decoded", pa.string()))
        codec = ChunkCodec(tokenizer)
        for batch in slices(batches):
            got = codec.encode([(t or "").encode() for t in batch.column("text").to_pylist()])
            more = ([np.frombuffer(i, "<u4").tolist() for i, _ in got], [t.decode("utf-8", "replace") for _, t in got]) if ids else ()
            yield batch_of(schema, batch.column("doc_id"), [len(i) // 4 for i, _ in got], [hashlib.sha256(i).hexdigest() for i, _ in got], [hashlib.sha256(t).hexdigest() for _, t in got], *more)

    return mapped(docs.select("doc_id", "text"), code, ENCODED + (", ids array<long>, decoded string" if ids else ""))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
