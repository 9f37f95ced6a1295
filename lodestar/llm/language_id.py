"""Language identification with string kernels.

A text is the set of its byte n-grams of one to four bytes (a blended spectrum, presence only, hashed). The kernel of two
texts is the size of the common part over the root of both sizes. Nystroem landmarks, a fixed number of snippets of each
language, span the feature space; one ridge regression per language, one against the rest, is solved in it. The kernel is
linear in presence, so landmarks, whitening and regression fold into one matrix of n-grams by languages, and a batch of
texts is scored by one product of its presence matrix with that.

Learning takes the documents of each language with the smallest hash of their id, ``most`` documents over all languages
(a document of each at least) and whole texts of them; their n-grams go to the driver as bits, so long texts weigh no more
than short ones. More than ``CLASSES`` languages raise an error, as the weights grow with them. These bounds are parameters.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with no language to learn every text is ``und``;
ties go to the language first by name; repeated rows get equal results (and are learned once each); an empty table gives an
empty result; further columns are ignored (the pipeline's stage keeps those of ``documents``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import batch_of, crc_bucket, mapped, prepare, slices, table

#: Documents learned from at most, languages at most, landmarks, ridge, n-gram lengths, bits of a hash.
MOST, CLASSES, LANDMARKS, RIDGE, GRAMS, BITS = 4000, 500, 384, 1e-3, (1, 2, 3, 4), 16
#: Score below which the stage rejects a document: every regression puts it clearly with the rest. Prose of a learned language
#: has 0.45 or more but for a few lines of names and numbers; other languages and random characters have 0.2 to 0.3.
REJECT = 0.3
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def presence(text: bytes) -> np.ndarray:
    """The hashed n-grams that a text has, ascending."""
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    run = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        run = run[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] if n > 1 else raw + np.uint32(1)
        if n in GRAMS:
            seen[(run * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)] = True
    return np.nonzero(seen)[0].astype(np.uint16)


def normal(text: str) -> bytes:
    """Lower case, with runs of anything but letters as one blank."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Languages by name, and a weight for each n-gram and language."""

    languages: list[str]
    weights: np.ndarray
    constant: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per text, one column per language: the product of the texts' presence matrix with the weights, by runs of rows."""
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate([np.zeros(0, np.uint16), *sets])
        out = np.zeros((len(sets), len(self.languages)))
        full = np.nonzero(sizes)[0]
        if len(full):
            begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            out[full] = np.add.reduceat(self.weights[flat], begins[full], axis=0) / np.sqrt(sizes[full])[:, None]
        return out + self.constant


def fit(sets: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Solves the regressions; texts, as the n-grams they have, come in a fixed order, landmarks are spread over languages."""
    names = sorted(set(languages))
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    turn: dict[str, int] = {}
    rank = [turn.__setitem__(x, turn.get(x, 0) + 1) or turn[x] for x in languages]
    chosen = sorted(range(len(sets)), key=lambda i: (rank[i], i))[:landmarks]
    # A row for each n-gram, so that a text gathers whole rows.
    marks = np.zeros((1 << BITS, len(chosen)), dtype=np.float32)
    for column, i in enumerate(chosen):
        marks[sets[i], column] = 1 / max(1, len(sets[i])) ** 0.5
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    kernel = np.array([marks[s].sum(axis=0) / max(1, len(s)) ** 0.5 for s in sets])  # texts by landmarks
    x = kernel @ whiten
    # Each language counts alike; the constant is not penalised.
    counts = y.copy()
    counts[counts < 0] = 0
    weight = (counts / counts.sum(axis=0)).sum(axis=1)
    weight /= weight.mean()
    mean_x, mean_y = np.average(x, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    xc, yc = x - mean_x, y - mean_y
    w = np.linalg.solve(xc.T @ (xc * weight[:, None]) + ridge * len(x) * np.eye(x.shape[1]), xc.T @ (yc * weight[:, None]))
    return Model(names, (marks @ (whiten @ w).astype(np.float32)).astype(np.float64), mean_y - mean_x @ w)


def learn(docs: DataFrame, where: object | None = None, most: int = MOST) -> Model | None:
    """Learns from documents with a language (and a condition on them); their hash order makes the choice repeatable."""
    known = docs.where("lang IS NOT NULL")
    known = known.where(where) if where is not None else known
    ids = known.select("doc_id", "lang", F.xxhash64(F.lit("language"), "doc_id").alias("rank"))
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().limit(CLASSES + 1).collect()}
    if not counts:
        return None
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} languages; the model holds no more")
    # A share of each language, so that rare ones are learned too. Hashes are spread evenly, so of a language with many rows
    # only those below a bound, a few times the share, are ranked; texts are fetched for the chosen ids alone.
    share = max(1, most // len(counts))
    bounds = [(lang, min((1 << 64) - 1, (1 << 64) * 4 * (share + 16) // n) - (1 << 63)) for lang, n in counts.items()]
    below = ids.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("rank <= bound").select("doc_id", "lang", "rank").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))
    chosen = below.withColumn("turn", turn).where(F.col("turn") <= share).select("doc_id", "lang")
    rank = F.xxhash64(F.lit("language"), "doc_id").alias("rank")
    texts = known.select("doc_id", "lang", "text", rank).join(F.broadcast(chosen.withColumnRenamed("lang", "of")), "doc_id").where("lang = of")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rank", pa.int64()), ("lang", pa.string()), ("grams", pa.binary())])
        for batch in slices(batches):
            out = []
            for rank, lang, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "lang", "text")), strict=True):
                if LETTER.search(text or ""):
                    row = np.zeros(1 << BITS, dtype=bool)
                    row[presence(normal(text))] = True
                    out.append((rank, lang, zlib.compress(np.packbits(row).tobytes(), 1)))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    rows = sorted({(r.rank, r.lang, bytes(r.grams)) for r in mapped(texts.select("rank", "lang", "text"), bits, "rank long, lang string, grams binary").toLocalIterator()})
    sets = [np.nonzero(np.unpackbits(np.frombuffer(zlib.decompress(g), dtype=np.uint8)))[0].astype(np.uint16) for _, _, g in rows]
    return fit(sets, [lang for _, lang, _ in rows]) if rows else None


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text; scores are in 0 to 1, 0.5 where the regression is undecided."""
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    real = [t is not None and LETTER.search(t) is not None for t in texts]
    got = model.scores([presence(normal(t)) if ok else np.zeros(0, np.uint16) for t, ok in zip(texts, real, strict=True)])
    best, value = got.argmax(axis=1), got.max(axis=1)
    sure = np.round(1 / (1 + np.exp(-3 * value)), 9)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, real, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(sure, real, strict=True)]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id with the predicted language and its score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for batch in slices(batches):
            yield batch_of(schema, batch.column("doc_id"), *predict(batch.column("text").to_pylist(), model))

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, lang_pred string, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = crc_bucket(3) == 1
    model = learn(docs, F.coalesce(~held, F.lit(True)))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, reject: float = REJECT) -> DataFrame:
    """Drops documents in no language: null texts, texts without a letter, and texts that no language's regression claims.

    With no language to learn only the first two go.
    """
    prepare(spark)
    model = learn(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if model is None:
                yield batch.filter(pa.array([t is not None and LETTER.search(t) is not None for t in texts], type=pa.bool_()))
                continue
            names, scores = predict(texts, model)
            yield batch.filter(pa.array([n != UNKNOWN and s >= reject for n, s in zip(names, scores, strict=True)], type=pa.bool_()))

    return mapped(docs, each, docs.schema)
