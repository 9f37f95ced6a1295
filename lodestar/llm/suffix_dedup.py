"""Suffix-array dedup: bytes of every passage of a given length that also starts anywhere else are removed.

Texts are first cut so that equal passages meet. Each window of LENGTH bytes has an anchor, the place of the least hash of
its short grams; successive windows with one anchor form a segment, keyed by the anchor's gram. Equal windows have equal
grams at equal places, so they lie in segments of one key, and a key met once holds nothing that repeats. Segments that are
equal as a whole are settled by their count: a copy needs no order. The different segments of a key are compared by suffix
order: cut into blocks of BLOCK bytes aligned at the anchor, they are strings over numbered blocks. Equal windows have equal
blocks at equal places from the anchor, so a block that is met once there ends a string, and strings with fewer blocks than any
window holds are left out: segments that share little but the gram cost no order. Shards of the others have Burrows-Wheeler
transforms, which are merged by interleave refinement (see ``bwt``). Neighbours in the merged order whose
common prefix reaches the blocks that any window holds form the repeated intervals. A window of an interval's suffix adds
some bytes before and after those blocks; windows of one interval repeat each other where these bytes are equal. A key with
more segments than one task should hold is split: each segment is halved by its windows and keyed anew by the bytes that all
windows of a half share, until keys are small; halves equal as a whole are again settled by count, and single windows have
nothing left to compare.

Equal texts are named by one 64-bit hash: among 10^10 different texts about three pairs share a name, and each of such a pair
also loses what the other repeats. Equal segments are named by two (the key and the content), whose clashes are not expected
below 10^18 segments. The windows of different segments are compared by their bytes.

Edge cases: a null or empty text, or one shorter than LENGTH, keeps all its bytes and can match nothing; matches never cross
documents but may lie in one document; equal rows and equal texts repeat each other; an empty table gives an empty result;
further columns are ignored (the pipeline's stage keeps those of ``documents``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bwt import merge, shard
from lodestar.llm.common import batch_of, fresh, mapped, partitions_of, prepare, slices, stored, table
from lodestar.llm.shingles import BASE, mix

#: Bytes of a passage, of a gram, of a block; segments of a key that one task compares; shards of a merge; bytes merged at once.
#: A gram of 16 bytes, three words, is met by chance ever more often as the table grows; one of 32 seldom is.
LENGTH, GRAM, BLOCK, MANY, SHARDS, AT_ONCE = 400, 32, 16, 2048, 4, 3 << 20
#: Bytes of text of a batch, and of a part of a long text; bytes whose windows are cut into segments at once, few enough for the cache.
STRETCH, CLOSE = 1 << 20, 1 << 17
#: Bits of a place in a stretch.
PLACE = 22
SEGMENT = "key long, seg long, uid long, doc_id long, start int, windows int, anchor int"


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    v = raw.astype(np.uint64)
    v = v[:-1] | v[1:] << np.uint64(8)
    v = v[:-2] | v[2:] << np.uint64(16)
    v = v[:-4] | v[4:] << np.uint64(32)
    v = mix(v[:-8]) + v[8:] * np.uint64(BASE)
    return mix(mix(v[:-16]) + v[16:] * np.uint64(BASE))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def contents(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of at least GRAM bytes: of every GRAM-th gram in each, mixed with its number, and of the last one."""
    grams_ = (size - GRAM) // GRAM + 1
    first = np.cumsum(grams_) - grams_
    k = np.arange(int(grams_.sum())) - np.repeat(first, grams_)
    parts = mix(hashes[np.repeat(start, grams_) + GRAM * k] + k.astype(np.uint64) * np.uint64(BASE), 21)
    return mix(np.add.reduceat(parts, first) + mix(hashes[start + size - GRAM], 22), 23)


def cut(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Segments of all texts: text, start there, number of windows, place of the anchor in the segment, anchor's hash, content's hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < length:
        return none
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes = grams(raw)
    if len(raw) >> PLACE:
        raise ValueError(f"more than {1 << PLACE} bytes at once")
    # Of equal hashes the first is least. The bits of the place are as many in every call, so that equal windows agree.
    bits = np.uint64(PLACE)
    least = sliding_least(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
    number = np.maximum(np.diff(begins) - length + 1, 0)
    ends = np.cumsum(number)
    if not ends[-1]:
        return none
    skipped = begins[:-1] - (ends - number)  # places without a window before each text's
    at = (least[np.arange(ends[-1]) + np.repeat(skipped, number)] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[(ends - number)[number > 0]] = True
    first = np.nonzero(fresh)[0]
    windows = np.diff(np.append(first, len(at)))
    doc = np.searchsorted(ends, first, side="right")
    start = first + skipped[doc]
    anchor = at[first] - start
    whole = mix(contents(hashes, start, windows + length - 1) + (anchor * 4096 + windows).astype(np.uint64))
    return doc, start - begins[doc], windows, anchor, hashes[at[first]].view(np.int64), whole.view(np.int64)


def stretches(texts: list[bytes], length: int, most: int = 0, close: int = 0) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of parts of texts (text, offset, bytes) of about ``close`` bytes, parts of ``most``, so that memory does not follow the longest text.

    Each window is in one part. A segment that is cut at a part's end is two of one key, which are compared as others are.
    """
    most = most or STRETCH
    close = close or min(most, CLOSE)
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), most):
            part = t[a : a + most + length - 1]
            if held and total + len(part) > close + length:
                yield held
                held, total = [], 0
            held.append((i, a, part))
            total += len(part)
    if held:
        yield held


def segments(docs: DataFrame, length: int) -> DataFrame:
    """All segments of all texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.int64(), pa.int32()
        schema = pa.schema([("key", longs), ("seg", longs), ("uid", longs), ("doc_id", longs), ("start", ints), ("windows", ints), ("anchor", ints)])
        for batch in slices(batches, most=STRETCH):
            for group in stretches([(t or "").encode() for t in batch.column("text").to_pylist()], length):
                rows, offsets, parts = zip(*group, strict=True)
                text, start, windows, anchor, key, seg = cut(list(parts), length)
                which, start = pa.array(np.array(rows)[text]), start + np.array(offsets)[text]
                yield batch_of(schema, key, seg, batch.column("uid").take(which), batch.column("doc_id").take(which), start.astype(np.int32), windows.astype(np.int32), anchor.astype(np.int32))

    return mapped(docs, each, SEGMENT)


def repeated(keys: np.ndarray, anchors: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Of each of some different segments, the runs (first, number) of its windows that another one of its key has too."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join([*texts, bytes(8)]), dtype=np.uint8)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    # Blocks aligned at the anchor, named by their key, place from the anchor and bytes.
    lead = anchors % BLOCK
    number = (sizes - lead) // BLOCK
    which = np.repeat(np.arange(len(texts)), number)
    place = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
    halves = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    at = begins[which] + lead[which] + place * BLOCK
    symbols = named(np.stack([keys[which].view(np.uint64), (place - (anchors // BLOCK)[which]).astype(np.uint64), halves[at], halves[at + 8]], axis=1))
    depth = (length - BLOCK + 1) // BLOCK  # whole blocks that a window holds wherever it starts
    owner, begin, strings = live_strings(symbols, which, place, depth)
    if not strings:
        return out
    symbols = np.unique(np.concatenate(strings), return_inverse=True)[1].ravel().astype(np.int64)
    strings = np.split(symbols + 1, np.cumsum([len(x) for x in strings])[:-1])
    edges = np.linspace(0, len(strings), min(SHARDS, len(strings)) + 1).astype(int)
    string, at, common = merge([shard(strings[a:b], a, int(symbols.max(initial=0)) + 1) for a, b in zip(edges, edges[1:], strict=False)], depth)
    # Repeated intervals: neighbours whose common prefix has all those blocks.
    interval = np.cumsum(common < depth)
    near = common >= depth
    near = near | np.append(near[1:], False)
    at, string, interval = at[near] + begin[string[near]], owner[string[near]], interval[near]
    found_s, found_first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = length - depth * BLOCK  # bytes of a window beside those blocks
    words = -(-rest // 8)
    beside = np.concatenate([np.arange(-BLOCK, 0), np.arange(depth * BLOCK, depth * BLOCK + rest)])
    for before in range(BLOCK):  # bytes of the window before the blocks
        first = lead[string] + at * BLOCK - before
        good = np.nonzero((first >= 0) & (first < windows[string]))[0]
        if not len(good):
            continue
        places = beside[BLOCK - before : BLOCK - before + rest]
        edge = np.zeros((len(good), 8 * words), dtype=np.uint8)
        edge[:, :rest] = raw[(begins[string[good]] + first[good] + before)[:, None] + places]
        kind = named(np.concatenate([interval[good].astype(np.uint64)[:, None], edge.view("<u8")], axis=1))
        some = good[np.bincount(kind)[kind] > 1]
        found_s.append(string[some])
        found_first.append(lead[string[some]] + at[some] * BLOCK - before)
    s, first = np.concatenate(found_s), np.concatenate(found_first)
    order = np.lexsort((first, s))
    s, first = s[order], first[order]
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (first[1:] != first[:-1] + 1)
        runs = np.nonzero(new)[0]
        for a, n in zip(runs.tolist(), np.diff(np.append(runs, len(s))).tolist(), strict=True):
            out[s[a]].append((int(first[a]), n))
    return out


def live_strings(symbols: np.ndarray, which: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs of at least ``depth`` blocks that others equal: the segment of each, its first block there, its symbols."""
    for _ in range(3):  # a run left out can leave blocks of others alone
        some = np.nonzero(np.bincount(symbols)[symbols] > 1)[0] if len(symbols) else np.zeros(0, np.int64)
        symbols, which, place = symbols[some], which[some], place[some]
        new = np.ones(len(some), dtype=bool)
        new[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.nonzero(new)[0]
        sizes = np.diff(np.append(first, len(some)))
        whole = np.repeat(sizes >= depth, sizes)
        symbols, which, place, new = symbols[whole], which[whole], place[whole], new[whole]
        if whole.all():
            break
    first = np.nonzero(new)[0]
    return which[first], place[first], np.split(symbols, first[1:]) if len(first) else []


def named(rows: np.ndarray) -> np.ndarray:
    """A number for each different row of 64-bit columns. Rows are told apart by a hash, and by sorting them where two of one hash differ."""
    hashed = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        hashed = mix(hashed ^ rows[:, k], 31 + k)
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    if not (rows == rows[first[number]]).all():
        number = np.unique(rows, axis=0, return_inverse=True)[1]
    return number.ravel().astype(np.int64)


PIECES = "key long, seg long, uid long, start int, windows int, anchor int, bytes binary"
RUNS = "uid long, start int, windows int"


def compared(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of windows that different segments of a key share."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
        held: list[tuple] = []
        total, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            key, uid, start, windows, anchor, texts = zip(*held, strict=True)
            found = repeated(np.array(key, dtype=np.int64), np.array(anchor), np.array(windows), list(texts), length)
            out = [(u, s + a, n) for u, s, runs in zip(uid, start, found, strict=True) for a, n in runs]
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "start", "windows", "anchor", "bytes", "seg")), strict=True):
                if held and row[0] != held[-1][0] and total > AT_ONCE:
                    yield from close()
                    held, total = [], 0
                if row[0] == (last or row)[0] and last is not None and row[6] == last[6]:
                    continue  # the same segment, from equal rows
                last = row
                held.append(row[:6])
                total += len(row[5])
        if held:
            yield from close()

    dealt = pieces.repartition(partitions_of(pieces.sparkSession), "key").sortWithinPartitions("key", "seg")
    return mapped(dealt, each, RUNS)


def halved(pieces: DataFrame, level: int, length: int) -> DataFrame:
    """Each segment as two, by its windows' distances to the anchor: ranges of 2^level of them, aligned, so that equal windows stay together.

    The key of a half is made of its range and the bytes that all windows of that range share.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.int64(), pa.int32()
        schema = pa.schema([("key", longs), ("seg", longs), ("uid", longs), ("start", ints), ("windows", ints), ("anchor", ints), ("bytes", pa.binary())])

        def hashed(data: bytes, *numbers: int) -> int:
            return int.from_bytes(hashlib.blake2b(repr(numbers).encode() + data, digest_size=8).digest(), "little", signed=True)

        for batch in slices(batches, "bytes"):
            out = []
            for key, uid, start, windows, anchor, data in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "start", "windows", "anchor", "bytes")), strict=True):
                first = 0
                while first < windows:
                    least = anchor - first >> level << level
                    most = min(least + (1 << level) - 1, length - GRAM)
                    end = min(windows, anchor - least + 1)
                    own = data[first : end + length - 1]
                    new = hashed(data[anchor - least : anchor - most + length], key, level, least)
                    out.append((new, hashed(own, new, anchor - first, end - first), uid, start + first, end - first, anchor - first, own))
                    first = end
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return mapped(pieces, each, PIECES)


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    """uid, start, windows: all runs of windows that start elsewhere too, of every different text."""
    found = stored(segments(docs, length), "segments")
    # Written first: a merge join can deal a hot key's rows to several tasks only if no aggregate stands below it.
    often = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    # Grouped by another name of the key: else the join's dealing by key serves the aggregate too, and rows of a hot key meet before they are pre-aggregated.
    again = found.join(often, "key", "left_semi").withColumn("other", F.bitwise_not("key"))
    kinds = again.groupBy("other", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "doc_id", "start", "windows", "anchor")).alias("one"))
    kinds = stored(kinds.select(F.bitwise_not("other").alias("key"), "seg", "n", "one.*"), "kinds")
    out = found.join(kinds.where("n > 1").select("key", "seg"), ["key", "seg"]).select("uid", "start", "windows").distinct()
    several = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    wanted = kinds.join(several, "key").groupBy("uid", "doc_id").agg(F.collect_list(F.struct("key", "seg", "start", "windows", "anchor", "kinds")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.int64(), pa.int32()
        schema = pa.schema([("key", longs), ("seg", longs), ("uid", longs), ("start", ints), ("windows", ints), ("anchor", ints), ("bytes", pa.binary()), ("kinds", longs)])
        for batch in slices(batches):
            out, total = [], 0
            for text, uid, parts in zip(*(batch.column(c).to_pylist() for c in ("text", "uid", "parts")), strict=True):
                raw = text.encode()
                for p in parts:
                    own = raw[p["start"] : p["start"] + p["windows"] + length - 1]
                    out.append((p["key"], p["seg"], uid, p["start"], p["windows"], p["anchor"], own, p["kinds"]))
                    total += len(own)
                if total > 8 << 20:
                    yield batch_of(schema, *zip(*out, strict=True))
                    out, total = [], 0
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    texts = docs.alias("d").join(wanted.alias("w"), (F.col("d.uid") == F.col("w.uid")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.text", "d.uid", "w.parts")
    pieces = mapped(texts, fetch, PIECES + ", kinds long")
    large = several.where(F.col("kinds") > MANY)
    if large.isEmpty():
        return out.unionAll(compared(pieces.drop("kinds"), length))
    pieces = stored(pieces, "pieces")
    out = out.unionAll(compared(pieces.where(F.col("kinds") <= MANY).drop("kinds"), length))
    level = pieces.where(F.col("kinds") > MANY).drop("kinds")
    for size in range((length - GRAM).bit_length() - 1, -1, -1):
        if level.isEmpty():
            break
        level = stored(halved(level, size, length), "halves")
        counts = level.groupBy("key", "seg").agg(F.count_distinct("uid", "start").alias("n"), F.min(F.struct("uid", "start")).alias("one"))
        counts = stored(counts, "halves-kinds")
        out = out.unionAll(level.join(counts.where("n > 1").select("key", "seg"), ["key", "seg"]).select("uid", "start", "windows"))
        several = stored(counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "halves-several")
        chosen = counts.join(several, "key").select("key", "seg", "one.*", "kinds")
        level = stored(level.join(chosen, ["key", "seg", "uid", "start"]), "halves-left")
        out = out.unionAll(compared(level.where(F.col("kinds") <= MANY).drop("kinds"), length))
        level = level.where(F.col("kinds") > MANY).drop("kinds")
    return out


def spans_of(raw: bytes, runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the runs cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["start"] + r["windows"] + length - 1) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def left_of(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """What lies between the spans."""
    edges = [0, *(p for s in spans for p in s), len(raw)]
    return [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def whole(pieces: list[bytes]) -> str:
    """The text of remaining pieces; of a character that was cut in part nothing stays, and halves of two make none."""
    return "".join([p.decode("utf-8", "ignore") for p in pieces])


def with_runs(docs: DataFrame, length: int, name: str = "runs") -> DataFrame:
    """Adds the runs of repeated windows to each row with a column ``text``."""
    uid, at = fresh(docs, "uid"), fresh(docs, "at")
    keyed = docs.withColumn(uid, F.xxhash64("text"))
    runs = runs_of(keyed.where("text IS NOT NULL").select("doc_id", F.col(uid).alias("uid"), "text"), length)
    runs = runs.groupBy(F.col("uid").alias(at)).agg(F.collect_set(F.struct("start", "windows")).alias(name))
    return keyed.join(runs, F.col(uid) == F.col(at), "left").drop(at, uid)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each text, and the text that is left."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, strings = pa.int64(), pa.string()
        schema = pa.schema([("doc_id", longs), ("n_bytes", longs), ("n_removed", longs), ("n_spans", longs), ("kept_sha256", strings), ("text", strings)])
        for batch in slices(batches):
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = spans_of(raw, runs, LENGTH)
                left = left_of(raw, spans)
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), whole(left) if spans else text))
            yield batch_of(schema, batch.column("doc_id"), *zip(*out, strict=True))

    docs = with_runs(table(spark, sf_dir, "documents", "doc_id", "text"), LENGTH)
    return mapped(docs, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


#: Bytes of a passage in the pipeline: fifty words have more.
STAGE_LENGTH = 200


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = STAGE_LENGTH) -> DataFrame:
    """Every document stays, without the passages that it or another has too; a character cut in part goes as a whole."""
    prepare(spark)
    name = fresh(docs, "runs")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column, runs = batch.column("text"), batch.column(name).to_pylist()
            texts = column.to_pylist()
            for i, r in enumerate(runs):
                if r:
                    raw = texts[i].encode()
                    texts[i] = whole(left_of(raw, spans_of(raw, r, length)))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, type=column.type))
            yield batch.drop_columns([name])

    return mapped(with_runs(docs, length, name), each, docs.schema).withColumn("n_chars", F.length("text").cast("long"))
