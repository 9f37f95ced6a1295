"""The public word-level BPE vocabulary, exactly as the tokenizers library encodes with it, at a fraction of the cost.

ASCII white space always separates pre-tokens of that vocabulary and is dropped, so words between it are encoded apart.
Words of ASCII and Latin-1 letters are split and merged here, many at once with numpy; all others go to the library.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

FAST = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
BLANKS = re.compile(r"[\t-\r ]+")
#: Entries of each generation of the cache, characters of the longest entry kept, bytes of the longest pre-token merged here.
CACHE, LONGEST, WIDEST = 250_000, 64, 48
NONE = 1 << 30


#: What a vocabulary must say of itself: how it changes, splits and joins texts, as the code here does.
SAYS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def checked(spec: dict) -> dict:
    """The vocabulary, if texts are split, changed and joined by it as the code here does; raises for others rather than encode them wrongly."""
    model = spec["model"]
    differ = [k for k, v in SAYS.items() if spec.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if model.get(k, v) != v]
    if not model.get("end_of_word_suffix"):
        differ.append("model.end_of_word_suffix")
    if len(model["vocab"]) > 1 << 16 or len(model["merges"]) > 1 << 16:
        differ.append("model.vocab")
    if any(not t["content"].startswith("<|") or re.search(r"\s", t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        differ.append("added_tokens")
    if differ:
        raise ValueError(f"not a vocabulary of the kind that this code encodes: {', '.join(differ)}")
    return spec


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A cache of two generations; what the older holds and is not asked for goes."""

    def __init__(self, most: int = CACHE):
        self.new, self.old, self.most = {}, {}, most

    def unknown(self, keys: set) -> list:
        """Keys that are in neither; before that, makes room."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out, old, new = [], self.old, self.new
        for k in keys.difference(new):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                new[k] = v
        return out


class WordBPE:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or default_path()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # An open hash table, sparse so that nearly all lookups take one probe; a slot holds the pair and its rank.
        self.bits = 21
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.probes, left, at = 1, np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.slots[at[one]] = keys[left[one]] << 16 | left[one]
            stay = np.ones(len(left), bool)
            stay[one] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        self.cache = Generations()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 16 | b
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got >> 16 == keys, got & 0xFFFF, NONE)
        missed = np.nonzero((out == NONE) & (got >= 0) & (a >= 0) & (b >= 0))
        for _ in range(1, self.probes):
            if not len(missed[0]):
                break
            at[missed] = (at[missed] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[missed]]
            hit = got >> 16 == keys[missed]
            out[missed] = np.where(hit, got & 0xFFFF, NONE)
            missed = tuple(m[~hit & (got >= 0)] for m in missed)
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers: the lowest-ranked pair is joined again and again, in all words at once."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 12), (12, 18), (18, 28), (28, WIDEST)):
            which = np.nonzero((sizes > low) & (sizes <= high))[0]
            for i in range(0, len(which), 1 << 14):
                self._merge(words, which[i : i + (1 << 14)], high, sizes, out)
        for i in np.nonzero(sizes > WIDEST)[0]:
            out[i] = self.by_library(words[i].decode())
        return out

    def _merge(self, words, which, width, sizes, out) -> None:
        flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in which), dtype=np.uint8).reshape(len(which), width)
        n, rows = sizes[which], np.arange(len(which))
        s = np.where(np.arange(width) < n[:, None], self.first[flat], -1).astype(np.int32)
        s[rows, n - 1] = self.last[flat[rows, n - 1]]
        s = np.concatenate([s, np.full((len(s), 2), -1, np.int32)], axis=1)
        r = np.full(s.shape, NONE, dtype=np.int32)
        r[:, :-1] = self.ranks(s[:, :-1], s[:, 1:])
        live, done_s, cols = rows, s, np.arange(s.shape[1])
        while len(live):
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            going = best < NONE
            if not going.all():
                done_s[live[~going]] = s[~going]
                s, r, live, at, best = s[going], r[going], live[going], at[going], best[going]
                if not len(live):
                    break
            i = np.arange(len(live))
            take = np.minimum(cols + (cols > at[:, None]), s.shape[1] - 1)
            s, r = np.take_along_axis(s, take, 1), np.take_along_axis(r, take, 1)
            s[i, at] = self.merged[best]
            r[i, at] = self.ranks(s[i, at], s[i, at + 1])
            before = np.maximum(at - 1, 0)
            r[i, before] = np.where(at > 0, self.ranks(s[i, before], s[i, at]), r[i, before])
        counts = (done_s >= 0).sum(axis=1)
        data = done_s.astype("<u4")
        for k, i in enumerate(which):
            out[i] = data[k, : counts[k]].tobytes()

    def by_library(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list:
        """Pre-tokens of a text as strings; words that only the library may split as bytes."""
        if FAST.fullmatch(text) and "<|" not in text:
            return PIECES.findall(text.lower())
        out: list = []
        for w in BLANKS.split(text):
            if FAST.fullmatch(w) and "<|" not in w:
                out += PIECES.findall(w.lower())
            else:
                out.append(w.encode())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) for t in texts]
        fresh, known = self.cache.unknown(set(chain.from_iterable(pieces))), self.cache.new
        cores = [p for p in fresh if type(p) is str]
        known.update(zip(cores, self.merge([p.encode() for p in cores]), strict=True))
        known.update((w, self.by_library(w.decode())) for w in fresh if type(w) is bytes)
        out = [b"".join(map(known.__getitem__, p)) for p in pieces]
        for k in fresh:  # long ones are not kept
            if len(k) > LONGEST:
                del known[k]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of these ids: their tokens with a blank between them, as the vocabulary names no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
