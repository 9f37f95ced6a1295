"""Plain versions of the operators' results, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def removed(texts: list[str | None], length: int) -> list[list[tuple[int, int]]]:
    """Of each text the maximal byte ranges covered by strings of that length that start anywhere else too."""
    data = [raw(t) for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    windows = [[hashlib.blake2b(d[i : i + length], digest_size=12).digest() for i in range(len(d) - length + 1)] for d in data]
    for w in windows:
        for x in w:
            seen[x] += 1
    out = []
    for w in windows:
        spans: list[tuple[int, int]] = []
        for i, x in enumerate(w):
            if seen[x] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out


def suffix_dedup(docs: pd.DataFrame, length: int = 400) -> pd.DataFrame:
    out = []
    for (doc, text), spans in zip(docs[["doc_id", "text"]].itertuples(index=False), removed(docs["text"].tolist(), length), strict=True):
        d, kept, at = raw(text), [], 0
        for a, b in spans:
            kept.append(d[at:a])
            at = b
        kept.append(d[at:])
        out.append((doc, len(d), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(zip(*(words[i:] for i in range(size)), strict=False))


def near_duplicates(docs: pd.DataFrame, size: int = 3, percent: int = 85) -> pd.DataFrame:
    ids = docs["doc_id"].tolist()
    sets = [shingle_set(t, size) for t in docs["text"]]
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted((i for i in range(len(ids)) if sets[i]), key=lambda i: len(sets[i]))
    for a, b in combinations(order, 2):
        if len(sets[a]) * 100 < percent * len(sets[b]):
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y, key=lambda i: ids[i])] = min(x, y, key=lambda i: ids[i])
    least = [ids[find(i)] for i in range(len(ids))]
    return pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "component_id": least, "kept": [a == b for a, b in zip(ids, least, strict=True)]})


#: Letters in either case are spelled out: re's own flag takes more letters than ASCII for alike.
KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs: pd.DataFrame) -> pd.DataFrame:
    out = []
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        text = text or ""
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        out.append((doc, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    return t


def ids_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encoded(docs: pd.DataFrame) -> pd.DataFrame:
    t, out = tokenizer(), []
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def check_packing(docs: pd.DataFrame, got: pd.DataFrame, length: int = 2048) -> float:
    """Asserts that pieces are whole, sequences are gapless and none is too long; returns the share of padding."""
    t, wanted = tokenizer(), defaultdict(list)
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        wanted[doc].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in got.itertuples(index=False):
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(wanted)
    for doc, rows in wanted.items():
        assert sum(p[1] for p in pieces[doc]) == sum(map(len, rows))
        if len(rows) == 1:
            at = 0
            for start, n, crc, total in sorted(pieces[doc]):
                assert start == at and n > 0 and total == len(rows[0])
                assert crc == zlib.crc32(ids_bytes(rows[0][start : start + n]))
                at += n
    used = 0
    for _, s in got.groupby("sequence_id"):
        at = 0
        for offset, n in sorted(zip(s["offset"], s["length"], strict=True)):
            assert offset == at
            at += n
        assert at <= length
        used += at
    return 1 - used / (length * got["sequence_id"].nunique())


def payloads(docs: pd.DataFrame) -> pd.DataFrame:
    out = []
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        d = raw(text)
        p = d + b"\xff" * (-len(d) % 576 if d else 576)
        out.append((doc, len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])


def warc(pages: pd.DataFrame) -> pd.DataFrame:
    largest: dict = {}
    for page, html in pages[["page_id", "html"]].itertuples(index=False):
        largest[raw(html)] = max(page, largest.get(raw(html), page))
    out = []
    for page, html in pages[["page_id", "html"]].itertuples(index=False):
        d = raw(html)
        last = largest[d]
        out.append((page, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if page == last else "revisit", None if page == last else last))
    return pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def edits(docs: pd.DataFrame) -> pd.DataFrame:
    """Edited texts, and the exact resemblance of five-word shingles to the edited and the next text."""
    rows = docs.sort_values("doc_id")[["doc_id", "text"]].values.tolist()
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        a, b, c = (shingle_set(t, 5) for t in (text, new, after))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), like(a, b), like(a, c)))
    return pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"])


def grams(text: str) -> frozenset[int]:
    """Numbers of the one to four byte strings of a text's letters, as the 16-bit hash of each."""
    raw_ = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    out = set()
    for n in (1, 2, 3, 4):
        for i in range(len(raw_) - n + 1):
            h = raw_[i] + 1
            for b in raw_[i + 1 : i + n]:
                h = (h * 257 + b) % (1 << 32)
            out.add((h * 2654435761 + n * 40503) % (1 << 32) >> 16)
    return frozenset(out)


def language_scores(texts: list[str], languages: list[str], asked: list[str], landmarks: int, ridge: float) -> np.ndarray:
    """One-versus-rest ridge regression in the span of landmarks, on kernels of pairs; languages weigh alike."""
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    sets, names, seen = [grams(t) for t in texts], sorted(set(languages)), defaultdict(int)
    turns = []
    for i, lang in enumerate(languages):
        seen[lang] += 1
        turns.append((seen[lang], i))
    marks = [sets[i] for _, i in sorted(turns)[:landmarks]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    feature = lambda some: np.array([[kernel(a, b) for b in marks] for a in some]) @ root
    x, out = feature(sets), []
    weight = np.array([1 / languages.count(lang) for lang in languages])
    weight = weight / weight.mean()
    for name in names:
        y = np.array([1.0 if lang == name else -1.0 for lang in languages])
        # The constant is a column that is not penalised.
        z = np.column_stack([x, np.ones(len(x))])
        penalty = np.diag([ridge * len(x)] * x.shape[1] + [0.0])
        w = np.linalg.solve(z.T @ np.diag(weight) @ z + penalty, z.T @ (weight * y))
        out.append(np.column_stack([feature([grams(t) for t in asked]), np.ones(len(asked))]) @ w)
    return np.array(out).T


def toxicity(docs: pd.DataFrame, labels: pd.DataFrame, asked: list[str]) -> list[float]:
    """Scores of some texts by the model learned from the rows that are not held out."""
    from lodestar.llm import toxicity as t

    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(texts[i], int(y), rank % 4 == 0) for i, y, rank in labels.itertuples(index=False) if i in texts and y == y and y is not None and zlib.crc32(str(i).encode()) % 5]
    split = lambda text: [w.lower() for w in re.findall(r"\w+", text or "")]
    feature = lambda w: [zlib.crc32(b"w" + w.encode()) % (1 << 18)] + [zlib.crc32(b"p%d" % n + w[:n].encode()) % (1 << 18) for n in (4, 5, 6, 7, 8) if len(w) >= n]
    counts, total = defaultdict(lambda: [0, 0]), [0, 0]
    for text, y, half in rows:
        if not half:
            seen = defaultdict(int)
            for w in split(text):
                seen[w] += 1
            for w, n in seen.items():
                total[1 - y] += min(n, t.OFTEN)
                for f in feature(w):
                    counts[f][1 - y] += min(n, t.OFTEN)
    n, m = total

    def weight(f: int) -> float:
        a, b = counts.get(f, (0, 0))
        prior = t.PRIOR * min((a + b + 0.01) / (n + m + 1), 0.999)
        p, q = a + prior, b + prior
        delta = math.log(p / max(n + t.PRIOR - p, 0.5)) - math.log(q / max(m + t.PRIOR - q, 0.5))
        part = n / (n + m)
        ratio = 2 * sum(c * math.log(c / ((a + b) * s)) for c, s in ((a, part), (b, 1 - part)) if c)
        z = math.sqrt(max(ratio, 0))
        return math.copysign(max(abs(delta) - t.MARGIN, 0) * max(0, 1 - (t.CHANCE / max(z, 1e-9)) ** 2), delta)

    known: dict[str, float] = {}

    def scores(text: str) -> list[float]:
        out = []
        for w in split(text):
            if w not in known:
                known[w] = max((weight(f) for f in feature(w)), key=abs) - t.COST
            out.append(known[w])
        return out

    def best(s: list[float]) -> list[float]:
        """Scores of all maximal segments: the best one, then those on both sides of it."""
        top, total_, start, span = 0.0, 0.0, 0, None
        for i, x in enumerate(s):
            if total_ <= 0:
                total_, start = 0.0, i
            total_ += x
            if total_ > top:
                top, span = total_, (start, i + 1)
        return [] if span is None else [top, *best(s[: span[0]]), *best(s[span[1] :])]

    held = [(scores(text), y) for text, y, half in rows if half]
    clean = [s for s, y in held if not y]
    spread = defaultdict(int)
    for s in clean:
        for x in s:
            spread[float(np.round(x, 2))] += 1
    mean = lambda rate: sum(c * math.exp(rate * x) for x, c in spread.items()) / max(1, sum(spread.values()))
    rate = 1.0
    if spread and max(spread) > 0 and sum(x * c for x, c in spread.items()) < 0:
        low, high = 1e-3, 5.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if mean(middle) < 1 else (low, middle)
        rate = low
    tops = [(len(s), max(best(s), default=0.0)) for s in clean if s]
    k = 1 / max(sum(n_ * math.exp(-rate * min(x, 50)) for n_, x in tops) / max(1, len(tops)), 1e-9) if tops else 1.0

    def evidence(s: list[float]) -> list[float]:
        if not s or max(s) <= 0:
            return [1.0, 0.0, 0.0, 0.0]
        e = [rate * x - math.log(max(k * len(s), 1e-9)) for x in best(s)]
        real = [x for x in e if x > t.SIGNIFICANT]
        return [1.0, math.log1p(max(max(e), 0.0)), math.log1p(sum(real)), len(real) / (1 + len(real))]

    x, y = np.array([evidence(s) for s, _ in held]).reshape(-1, 4), np.array([y for _, y in held], dtype=float)
    w, penalty = np.zeros(4), np.array([1e-6, 0.05, 0.05, 0.05])
    for _ in range(60):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(evidence(scores(text)), w)))))) for text in asked]


def same(got: pd.DataFrame, want: pd.DataFrame, key: str = "doc_id") -> None:
    """Both have the same rows in the wanted frame's columns."""
    a = got[want.columns].sort_values(list(want.columns), na_position="first").reset_index(drop=True)
    b = want.sort_values(list(want.columns), na_position="first").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
