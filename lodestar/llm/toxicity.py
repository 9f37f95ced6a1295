"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are scored by log-odds with informative Dirichlet priors between toxic and other labelled documents, for whole words
and for their beginnings, so that unseen words are scored too. Within a document a linear-time scan finds every maximal
scoring segment. Under the background of clean documents the highest segment score of n tokens follows an extreme-value
law, P(score > x) = 1 - exp(-K n exp(-lambda x)); lambda solves the background's moment equation, K comes from held-back
clean documents. Each segment's evidence is its score on that scale; a logistic model on the evidence gives the score.

Learning takes at most ``most`` labelled documents, those with the smallest hash of their id, and tables of 2^18 hashed
features; both bounds are independent of the input. Scoring covers every whole text.

Edge cases: a null or empty text has no segments and gets the score that such documents have; without any labelled rows or
with only one label all scores are that label's share (0 without any); repeated rows count as often as they occur, equal
texts get equal scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import batch_of, crc_bucket, mapped, slices, stored, table

#: Labelled documents learned from at most, hashed features, weight of the prior, cost of a token. A passage is significant if
#: clean text of the document's length has fewer than exp(-SIGNIFICANT) such passages by chance.
MOST, FEATURES, PRIOR, COST, SIGNIFICANT = 20_000, 1 << 18, 500.0, 0.03, 3.0
#: A word counts at most so often in a document, as further repeats there say little; standard errors below which log-odds
#: may be chance; smaller log-odds tell languages and subjects apart rather than toxic words. These, the prior and the cost
#: have the least log loss over four folds of the learning rows, with no held-out row in view.
OFTEN, CHANCE, MARGIN = 1, 3.0, 1.0
WORDS = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7, 8)


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginnings."""
    return [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % FEATURES, *(zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "surrogatepass")) % FEATURES for n in BEGINNINGS if len(word) >= n)]


def occurrences(text: str) -> Counter:
    """How often each word occurs, in lower case."""
    out: Counter = Counter()
    for w, n in Counter(WORDS.findall(text)).items():
        out[w.lower()] += n
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each feature between the words of two sets of documents, and the root of its likelihood ratio; the prior has each feature's overall share.

    The ratio grows with the counts, also for features that one set lacks, where the log-odds' own variance is the prior's.
    """
    both = n_toxic + n_clean
    share = np.minimum((toxic + clean + 0.01) / (both + 1), 0.999)
    a = prior * share
    p, q = toxic + a, clean + a
    delta = np.log(p / np.maximum(n_toxic + prior - p, 0.5)) - np.log(q / np.maximum(n_clean + prior - q, 0.5))
    all_, part = toxic + clean, n_toxic / max(both, 1)
    ratio = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(all_ * part, 1e-9)) + clean * np.log(np.maximum(clean, 1e-9) / np.maximum(all_ * (1 - part), 1e-9)))
    return delta, np.sign(delta) * np.sqrt(np.maximum(ratio, 0))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; ends are exclusive.

    A stack holds candidates with the sums before and after them; a new positive token either starts its own candidate or
    is joined with the nearest one that begins lower and ends lower, as Ruzzo and Tompa showed.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # start, end, sum before, sum after, index of the nearest candidate that begins lower
    for i in np.nonzero(scores > 0)[0].tolist():
        new = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            new[4] = j
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
    return [(a, b, y - x) for a, b, x, y, _ in held]


@dataclass
class Model:
    """Token scores and the calibration of segment scores; its size is bounded."""

    weights: np.ndarray
    rate: float
    k: float
    logistic: np.ndarray

    def score_word(self, word: str) -> float:
        """The strongest of its features, less the cost of a token."""
        w = self.weights[features(word)]
        return float(w[np.argmax(np.abs(w))]) - COST

    def evidence(self, scores: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """Of a document: most evidence of a segment, evidence of all significant ones, their number; and the segments themselves."""
        n = len(scores)
        if not n or scores.max() <= 0:
            return np.array([1.0, 0.0, 0.0, 0.0]), []
        found = [(a, b, self.rate * s - math.log(max(self.k * n, 1e-9))) for a, b, s in segments(scores)]
        real = [s for s in found if s[2] > SIGNIFICANT]
        most = max(s[2] for s in found)
        return np.array([1.0, np.log1p(max(most, 0.0)), np.log1p(sum(s[2] for s in real)), len(real) / (1 + len(real))]), real

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.logistic))))))


class Scorer:
    """Scores words through a bounded cache."""

    def __init__(self, model: Model):
        from lodestar.llm.wordbpe import Generations

        self.model, self.cache = model, Generations(200_000)

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        """Scores of the words of each text, one for each match of WORDS in the text itself."""
        lists = [WORDS.findall(t) for t in texts]
        fresh, known = self.cache.unknown({w for words in lists for w in words}), self.cache.new
        for w in fresh:
            known[w] = self.model.score_word(w.lower())
        out = [np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words)) for words in lists]
        for w in fresh:
            if len(w) > 64:
                del known[w]
        return out


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """Labelled documents to learn from: those with the smallest hashes, at most so many; ``half`` is 0 for a quarter of them."""
    rank = F.xxhash64(F.lit("toxicity"), "doc_id")
    labelled = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_bucket(5) != 0).select("doc_id", "toxic", rank.alias("rank"))
    chosen = labelled.orderBy("rank", "doc_id", "toxic").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.col("rank"), F.lit(4)) != 0).cast("int").alias("half"))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    rows = stored(sampled(docs, labels, most), "labelled")  # read four times below

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
        counts, cache = np.zeros((FEATURES + 1, 2), dtype=np.int64), {}
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                times: Counter = Counter()
                for w, n in occurrences(text or "").items():
                    if (f := cache.get(w)) is None:
                        f = features(w)
                        if len(cache) < 200_000:
                            cache[w] = f
                    times[FEATURES] += min(n, OFTEN)
                    for x in f:
                        times[x] += min(n, OFTEN)
                counts[list(times), 0 if label else 1] += np.fromiter(times.values(), np.int64, len(times))
        some = np.nonzero(counts.any(axis=1))[0]
        yield batch_of(schema, some, counts[some, 0], counts[some, 1])

    counted = mapped(rows.where("half <> 0").select("text", "toxic"), count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    counts = np.zeros((FEATURES + 1, 2))
    counts[counted["feature"].to_numpy(dtype=np.int64)] = counted[["toxic", "clean"]].to_numpy(dtype=np.float64)
    n_toxic, n_clean = counts[FEATURES]
    counts = counts[:FEATURES]
    model = Model(np.zeros(FEATURES), 1.0, 1.0, np.zeros(4))
    if n_toxic and n_clean:
        delta, z = log_odds(counts[:, 0], counts[:, 1], n_toxic, n_clean)
        model.weights = np.sign(delta) * np.maximum(np.abs(delta) - MARGIN, 0) * np.maximum(0, 1 - (CHANCE / np.maximum(np.abs(z), 1e-9)) ** 2)  # zero where it may be chance

    held = rows.where("half = 0").select("text", "toxic")

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, schema = Scorer(model), pa.schema([("score", pa.float64()), ("n", pa.int64())])
        values, times = np.zeros(0), np.zeros(0, np.int64)
        for batch in slices(batches):
            got = np.round(np.concatenate([np.zeros(0), *scorer.tokens([t or "" for t in batch.column("text").to_pylist()])]), 2)
            u, c = np.unique(np.concatenate([values, got]), return_inverse=True)
            values, times = u, np.bincount(c, weights=np.concatenate([times, np.ones(len(got), np.int64)]), minlength=len(u)).astype(np.int64)
        yield batch_of(schema, values, times)

    spread = mapped(held.where("toxic = 0").select("text"), background, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    model.rate = moment(spread["score"].to_numpy(dtype=np.float64), spread["n"].to_numpy(dtype=np.float64))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, schema = Scorer(model), pa.schema([("n", pa.int64()), ("best", pa.float64())])
        for batch in slices(batches):
            got = scorer.tokens([t or "" for t in batch.column("text").to_pylist()])
            yield batch_of(schema, [len(s) for s in got], [max((y for _, _, y in segments(s)), default=0.0) for s in got])

    clean = mapped(held.where("toxic = 0").select("text"), highest, "n long, best double").where("n > 0").toPandas()
    if len(clean):
        # Expectations K n exp(-rate x) of the highest scores are exponential with mean 1.
        model.k = 1 / max(float((clean["n"] * np.exp(-model.rate * np.minimum(clean["best"], 50.0))).mean()), 1e-9)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, schema = Scorer(model), pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in slices(batches):
            yield batch_of(schema, batch.column("toxic"), [model.evidence(s)[0].tolist() for s in scorer.tokens([t or "" for t in batch.column("text").to_pylist()])])

    known = mapped(held, evidence, "toxic int, x array<double>").toPandas()
    model.logistic = fitted(np.array(known["x"].tolist(), dtype=np.float64).reshape(-1, 4), known["toxic"].to_numpy(dtype=np.float64))
    return model


def moment(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1; bounded where the background has no positive scores."""
    if not len(scores) or scores.max() <= 0 or (scores * counts).sum() >= 0:
        return 1.0
    p, low, high = counts / counts.sum(), 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return low


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge on all but the constant."""
    w = np.zeros(4)
    if not len(y):
        w[0] = -30.0
        return w
    penalty = np.diag([1e-6, ridge, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """The score of each document; ``passages`` adds its significant segments with their text and evidence."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64())])
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64()), ("text", pa.string())])
        schema = schema.append(pa.field("passages", pa.list_(kind))) if passages else schema
        for batch in slices(batches):
            texts, out = [t or "" for t in batch.column("text").to_pylist()], []
            for text, s in zip(texts, scorer.tokens(texts), strict=True):
                x, real = model.evidence(s)
                row = [round(model.probability(x), 9), len(real)]
                if passages:
                    at = [m.span() for m in WORDS.finditer(text)] if real else []
                    row.append([{"start": at[a][0], "end": at[b - 1][1], "evidence": e, "text": text[at[a][0] : at[b - 1][1]]} for a, b, e in real])
                out.append(row)
            yield batch_of(schema, batch.column("doc_id"), *zip(*out, strict=True))

    return mapped(docs.select("doc_id", "text"), each, "doc_id long, score double, n_passages long" + (", passages array<struct<start:long,end:long,evidence:double,text:string>>" if passages else ""))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = crc_bucket(5) == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
