"""Packing of tokenized documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document is its token ids and an end id. Whole sequences are cut off its front; the rest, shorter than a sequence, goes
to one of the randomised groups. A group is packed on its own by first-fit decreasing: a tournament tree over the bins holds
the largest free room below each node, so the first bin with room is found in logarithmic time. Tokenizing takes one pass
and no shuffle; only short rows about pieces are shuffled.

Edge cases: a null or empty text is its end id alone; equal rows are packed each on its own; ties in length go by the rows'
order; ids stay whole beside null ones; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, mapped, slices, table

#: Tokens of a sequence, the id that ends a document, mean number of pieces in a group.
LENGTH, END_ID, GROUP = 2048, 1, 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in the order they were opened; each inner node holds the most room of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * (2 * self.leaves)
        self.capacity, self.opened = capacity, 0

    def _set(self, leaf: int, room: int) -> None:
        i, tree = leaf + self.leaves, self.room
        tree[i] = room
        while i > 1:
            i >>= 1
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for so much, and where in it the item begins."""
        tree = self.room
        if tree[1] < size:
            leaf, room = self.opened, self.capacity
            self.opened += 1
        else:
            i = 1
            while i < self.leaves:
                i *= 2
                if tree[i] < size:
                    i += 1
            leaf, room = i - self.leaves, tree[i]
        self._set(leaf, room - size)
        return leaf, self.capacity - room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item; no item may exceed the capacity."""
    tree, out = Tournament(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = tree.put(sizes[i])
    return out


def mixed(x: int) -> int:
    """A 63-bit hash of a number."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) >> 1


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, seed: int = 0) -> DataFrame:
    """The pieces of each document, each with a random draw that depends on its place in the input only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestar.llm.wordbpe import WordBPE

        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw")])
        bpe, end, row = WordBPE(tokenizer), end_id.to_bytes(4, "little"), 0
        base = (seed << 56) ^ (TaskContext.get().partitionId() << 36)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), n, mixed(base ^ row)))
                    row += 1
            yield batch_of(schema, *zip(*out, strict=True))

    return mapped(docs.select("doc_id", "text"), cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, end_id: int = END_ID, seed: int = 0) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    rows = docs.count()
    groups = max(1, -(-rows // group))

    def fill(piece: pa.Table) -> pa.Table:
        piece = piece.take(pa.compute.sort_indices(piece, sort_keys=[("draw", "ascending")]))
        placed = np.array(first_fit_decreasing(piece.column("length").to_pylist(), length), dtype=np.int64)
        sequence = placed[:, 0] + piece.column("g").to_numpy() * (1 << 32)
        return piece.drop_columns(["draw", "g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(placed[:, 1]))

    dealt = pieces(docs, tokenizer, length, end_id, seed).withColumn("g", F.col("draw") % groups)
    return dealt.groupBy("g").applyInArrow(fill, PACKED)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: every document it is given, packed."""
    from lodestar.llm.common import prepare

    return pack((prepare(spark) and docs).select("doc_id", "text"))
