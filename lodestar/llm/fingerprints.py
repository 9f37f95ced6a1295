"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest hashes of the distinct five-word shingles of a text. Sketches of parts merge into that of the
whole; two of them estimate resemblance, containment and the number of distinct shingles. The sketch is exact where a text
has no more than k distinct shingles.

Edge cases: a null or empty text has an empty sketch; two empty sketches are alike (1), an empty and another are not (0);
fewer than five words count as one shingle; equal texts have equal sketches; rows with the same doc_id are ordered by text,
a null doc_id comes first; of one document the next is itself; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, mapped, partitions_of, slices, table
from lodestar.llm.shingles import shingles
from lodestar.operators.joins import estimated_bytes

#: Hashes of a sketch, bits of a hash, words of a shingle.
K, BITS, WORDS = 128, 48, 5
#: Bytes of documents in a range, ranges at most (beyond that they are larger).
RANGE, RANGES = 64 << 20, 20_000


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    return [np.unique(s >> np.uint64(64 - BITS))[:k] for s in shingles([t.encode("utf-8", "surrogatepass") for t in texts], WORDS)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates the share of shingles of either that are of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.count_nonzero(np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)) / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimates the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / (1 << BITS))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates the share of the first text's shingles that the second has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def packed(a: np.ndarray) -> str:
    """A sketch as text: six bytes a hash, the most significant first, in base 64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """The sketch of each document and its estimated number of distinct shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_distinct", pa.float64())])
        for batch in slices(batches):
            got = sketches([t or "" for t in batch.column("text").to_pylist()], k)
            yield batch_of(schema, batch.column("doc_id"), [packed(s) for s in got], [distinct(s, k) for s in got])

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, fingerprint string, n_distinct double")


def merged(prints: DataFrame, key: str, k: int = K, held: int = 20_000) -> DataFrame:
    """One sketch per key. Each task first merges what it reads, so a key sends no more rows on than there are tasks times flushes."""
    kind = prints.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            out = batch_of(schema, list(found), [packed(s) for s in found.values()])
            found.clear()
            return out

        schema = None
        for batch in batches:
            schema = pa.schema([(key, batch.column(key).type), ("fingerprint", pa.string())])
            for g, s in zip(batch.column(key).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                sketch = unpacked(s or "")
                found[g] = merge(found[g], sketch, k) if g in found else sketch
            if len(found) > held:
                yield flush(schema)
        if found:
            yield flush(schema)

    some = mapped(prints.select(key, "fingerprint"), partial, f"{key} {kind}, fingerprint string")
    return some.repartition(partitions_of(prints.sparkSession), key).sortWithinPartitions(key).mapInArrow(partial, some.schema)


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents in column ``part`` by ranges of doc_id, sorted in each; a range also gets, with ``extra``, the document after its last one.

    The ranges' bounds come from the ids alone; there are as many as shuffle partitions, or more where the table's estimated
    size asks for it. Only the first document of each range is sent twice. Ranges are read as streams, so a range with a hot
    id may be of any size.
    """
    spark = docs.sparkSession
    parts = max(partitions_of(spark), min(estimated_bytes(docs) // RANGE, RANGES))
    bounds = np.array(sorted(set(docs.select("doc_id").where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) or [])))

    @F.pandas_udf("int")
    def range_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(dtype="float64"), side="right")).astype("int32"))

    ids = docs.select("doc_id", range_of("doc_id").alias("part"))
    first = {r.part: r.first for r in ids.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect()}
    held = sorted(first)
    dealt = docs.select("doc_id", "text", range_of("doc_id").alias("part"), F.lit(0).alias("extra"))
    if held:
        # The first document of a range goes to the range before it too, that of the first range to the last.
        more = F.broadcast(spark.createDataFrame([(first[p].doc_id, held[i - 1]) for i, p in enumerate(held)], "id long, before int"))
        again = docs.join(more, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", F.col("before").alias("part"), F.lit(1).alias("extra"))
        dealt = dealt.unionAll(again)
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", "doc_id", F.coalesce("text", F.lit("")))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        ids, texts, total = [], [], 0

        def close(after: list[str]) -> pa.RecordBatch:
            return batch_of(schema, ids[: len(texts) - 1 + len(after)], *zip(*compared(texts + after, len(texts) - 1 + len(after)), strict=True))

        for batch in slices(batches):
            for extra, doc, text in zip(*(batch.column(c).to_pylist() for c in ("extra", "doc_id", "text")), strict=True):
                if extra:  # what follows the range; of equal ids the first
                    if texts:
                        yield close([text or ""])
                        ids, texts, total = [], [], 0
                    continue
                ids.append(doc)
                texts.append(text or "")
                total += len(texts[-1])
                if total > 4 << 20 and len(texts) > 1:
                    yield close([])
                    ids, texts, total = ids[-1:], texts[-1:], len(texts[-1])

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return mapped(neighbours(docs), compare, RESULT)


def compared(texts: list[str], n: int) -> list[tuple]:
    """The results of the first n texts, each of which another follows."""
    edited = []
    for text, after in zip(texts[:n], texts[1:] or texts, strict=False):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    own, new = sketches(texts), sketches(edited)
    after = own[1:] or own
    return [(len(t), hashlib.sha256(e.encode()).hexdigest(), packed(a), packed(b), resemblance(a, b), resemblance(a, c)) for t, e, a, b, c in zip(texts[:n], edited, own, new, after, strict=False)]
