"""Matroska media columns: EBML elements, clusters, lacing and cues read into packet tables; and a lossless writer.

A packet is one frame of a track: its time stamp in nanoseconds and its byte range in the file. ``packets`` makes a table of
them from a binary column; ``op4`` stores texts as 8-bit samples of one track, reads them back and computes features.

Edge cases: a null or empty text is stored as one frame of padding; texts have no greatest length (clusters follow each
other); equal texts give equal bytes, as nothing else goes into a file; a null or malformed file has no packets and an
``error``; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import batch_of, mapped, slices, table

EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK, AUDIO, GROUP, CUE_POINT, CUE_PLACE = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SCALE, DURATION, NUMBER, UID, KIND, CODEC, LACED, DEFAULT = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
RATE, CHANNELS, DEPTH, TIME, SIMPLE, BLOCK, LASTS = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA1, 0x9B
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
ENCODINGS, ENCODING, ENCODING_KIND, ENCODING_SCOPE, COMPRESSION, ALGORITHM, SETTINGS = 0x6D80, 0x6240, 0x5033, 0x5032, 0x5034, 0x4254, 0x4255
#: What may follow a cluster of unknown size.
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}
#: Samples of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, LACE, BLOCKS, HERTZ = 576, 8, 32, 8000
PACKET = "track long, cluster long, timestamp_ns long, duration_ns long, start long, size long, keyframe boolean, cued boolean, prefix binary, stored boolean"


def size_of(n: int, width: int = 0) -> bytes:
    """A length as a variable-length integer; all ones are reserved for an unknown one."""
    if not width:
        width = 1
        while n >= (1 << 7 * width) - 1:
            width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_of(len(data)) + data


def number(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(name: int, x: float) -> bytes:
    return element(name, struct.pack(">d", x))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The body of a block: kind 0 none, 1 Xiph, 2 fixed sizes, 3 EBML differences."""
    sizes = [len(f) for f in frames]
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += size_of(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
                width += 1
            head += size_of(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A file with the payload as 8-bit samples of one track; its length is a positive multiple of FRAME."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    lasts = FRAME * 1000 // HERTZ
    info = element(INFO, number(SCALE, 1_000_000) + real(DURATION, float(len(frames) * lasts)))
    audio = element(AUDIO, real(RATE, float(HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACED, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT, lasts * 1_000_000) + audio
    head = info + element(TRACKS, element(TRACK, track))
    clusters, cues, at = [], [], len(head)
    for first in range(0, len(frames), LACE * BLOCKS):
        parts = [number(TIME, first * lasts)]
        for k, i in enumerate(range(first, min(first + LACE * BLOCKS, len(frames)), LACE)):
            some = frames[i : i + LACE]
            kind = 0 if len(some) == 1 else 1 + k % 3
            parts.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (i - first) * lasts, 0x80 | kind << 1) + laced(some, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * lasts) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        clusters.append(element(CLUSTER, b"".join(parts)))
        at += len(clusters[-1])
    ebml = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return ebml + element(SEGMENT, head + b"".join(clusters) + element(CUES, b"".join(cues)))


class Malformed(ValueError):
    """The bytes are not a Matroska file, end too soon, or hold numbers beyond 64 bits."""


def stripped(data: bytes, elements_of: list[tuple[int, int, int, int]]) -> bytes | None:
    """What a track's content encodings strip from the front of each frame: no bytes without any, None if frames are changed otherwise."""
    out = b""
    for name, _, a, b in elements_of:
        if name != ENCODING:
            continue
        kind, algorithm, settings, scope = 0, None, b"", 1
        for k, _, x, y in elements(data, a, b):
            if k == ENCODING_KIND:
                kind = int.from_bytes(data[x:y], "big")
            elif k == ENCODING_SCOPE:
                scope = int.from_bytes(data[x:y], "big")
            elif k == COMPRESSION:
                algorithm = 0
                for f, _, u, v in elements(data, x, y):
                    algorithm = int.from_bytes(data[u:v], "big") if f == ALGORITHM else algorithm
                    settings = data[u:v] if f == SETTINGS else settings
        if kind or algorithm != 3:
            return None
        out = settings + out if scope & 1 else out
    return out


def vint(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 for an unknown length. ``marked`` keeps the length bit, as in names."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Malformed(f"ends within a number at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if marked:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Name, start, and byte range of the content of each element of a range."""
    while at < end:
        name, body = vint(data, at, marked=True)
        if within == CLUSTER and name in TOP:
            return
        size, body = vint(data, body)
        if size >= 0:
            stop = body + size
            if stop > end:
                raise Malformed(f"the element at {at} is longer than what holds it")
        elif name == CLUSTER:  # of unknown size: it ends where another top element begins
            stop = body
            for _, _, _, stop in elements(data, body, end, CLUSTER):
                pass
        elif name == SEGMENT:
            stop = end
        else:
            raise Malformed(f"unknown size of the element at {at}")
        yield name, at, body, stop
        at = stop


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the frames' byte ranges of a block."""
    track, at = vint(data, at)
    if at + 3 > end:
        raise Malformed(f"ends within a block at {at}")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, time, flags, [(at, end - at)]
    if at >= end:
        raise Malformed(f"ends within a lace at {at}")
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            raise Malformed(f"unequal frames at {at}")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed(f"ends within a lace at {at}")
                    size, at, more = size + data[at], at + 1, data[at] == 255
                    if not more:
                        break
            else:
                was = at
                size, at = vint(data, at)
                if i:
                    size = sizes[-1] + size - ((1 << 7 * (at - was) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"frames exceed their block at {at}")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, time, flags, out


def read(data: bytes) -> dict:
    """Tracks, packets (in the order of PACKET), cues and scale of a file."""

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def floating(a: int, b: int) -> float:
        return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0

    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    segment = next((x for x in top if x[0] == SEGMENT), None)
    if not segment:
        raise Malformed("no segment")
    scale, duration, tracks, cues, clusters = 1_000_000, 0.0, {}, [], []
    base = segment[2]
    for name, start, a, b in elements(data, segment[2], segment[3]):
        if name == INFO:
            for k, _, x, y in elements(data, a, b):
                scale, duration = (uint(x, y), duration) if k == SCALE else (scale, floating(x, y)) if k == DURATION else (scale, duration)
        elif name == TRACKS:
            for k, _, x, y in elements(data, a, b):
                if k == TRACK:
                    t = {"number": 0, "codec": "", "type": 0, "frame_ns": 0, "rate": 0.0, "channels": 1, "depth": 0, "prefix": b""}
                    for f, _, u, v in elements(data, x, y):
                        if f == AUDIO:
                            for g, _, p, q in elements(data, u, v):
                                t |= {RATE: {"rate": floating(p, q)}, CHANNELS: {"channels": uint(p, q)}, DEPTH: {"depth": uint(p, q)}}.get(g, {})
                        elif f == ENCODINGS:
                            t["prefix"] = stripped(data, list(elements(data, u, v)))
                        else:
                            t |= {NUMBER: {"number": uint(u, v)}, KIND: {"type": uint(u, v)}, DEFAULT: {"frame_ns": uint(u, v)}}.get(f, {}) | ({"codec": data[u:v].decode("ascii", "replace")} if f == CODEC else {})
                    tracks[t["number"]] = t
        elif name == CLUSTER:
            clusters.append((start, a, b))
        elif name == CUES:
            for k, _, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    when, places = 0, []
                    for f, _, u, v in elements(data, x, y):
                        if f == CUE_TIME:
                            when = uint(u, v)
                        elif f == CUE_PLACE:
                            got = {g: uint(p, q) for g, _, p, q in elements(data, u, v)}
                            places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
                    cues += [(when * scale, t, base + p) for t, p in places]
    packets, cued = [], {(t, p) for _, t, p in cues}
    for k, (start, a, b) in enumerate(clusters):
        time = 0
        for name, _, x, y in elements(data, a, b, CLUSTER):
            lasts = None
            if name == TIME:
                time = uint(x, y)
            elif name == GROUP:
                inner = list(elements(data, x, y))
                lasts = next((uint(u, v) * scale for f, _, u, v in inner if f == LASTS), None)
                referred = any(f == 0xFB for f, *_ in inner)
                x, y = next(((u, v) for f, _, u, v in inner if f == BLOCK), (0, 0))
            if name == SIMPLE or name == GROUP and y:
                track, relative, flags, frames = frames_of(data, x, y)
                each = tracks.get(track, {}).get("frame_ns", 0) or (lasts or 0) // len(frames)
                when = (time + relative) * scale
                key = not referred if name == GROUP else bool(flags & 0x80)
                for i, (at, size) in enumerate(frames):
                    packets.append((track, k, when + i * each, each, at, size, key, (track, start) in cued))
    duration *= scale
    if not 0 <= duration < 1 << 63 or any(not -(1 << 63) <= n < 1 << 63 for p in packets for n in p[:6]):  # NaN fails too
        raise Malformed("a time or number is beyond 64 bits")
    return {"scale": scale, "duration_ns": int(duration), "tracks": tracks, "packets": packets, "cues": cues, "clusters": len(clusters)}


def packets(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of each file in a binary column, with the key of its row; a malformed or null file gives one row with an error.

    A frame is ``prefix`` (what its track strips from all frames) and the bytes of the range; ``stored`` is false where the
    track's frames are compressed or encrypted, so that the range is not the frame itself.
    """
    kind = df.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track", "cluster", "timestamp_ns", "duration_ns", "start", "size"]
        for batch in slices(batches, media):
            keys, out = batch.column(key), []
            for i, data in enumerate(batch.column(media).to_pylist()):
                try:
                    found = read(data or b"")
                    front = {n: t["prefix"] for n, t in found["tracks"].items()}
                    out += [(i, *p, front.get(p[0], b"") or b"", front.get(p[0], b"") is not None, None) for p in found["packets"]]
                except Malformed as e:
                    out.append((i, *[None] * 10, str(e)))
            which, *columns = zip(*out, strict=True) if out else ((),) * 12
            schema = pa.schema([(key, keys.type), *((n, pa.int64()) for n in names), ("keyframe", pa.bool_()), ("cued", pa.bool_()), ("prefix", pa.binary()), ("stored", pa.bool_()), ("error", pa.string())])
            yield batch_of(schema, keys.take(pa.array(which, type=pa.int64())), *columns)

    return mapped(df.select(key, media), rows, f"{key} {kind}, {PACKET}, error string")


def features(found: dict, samples: np.ndarray) -> str:
    """A short description of what was read."""
    packets = found["packets"]
    crossings = int(np.count_nonzero(np.diff(samples >= 128))) if len(samples) > 1 else 0
    return f"packets={len(packets)};clusters={found['clusters']};cues={len(found['cues'])};ms={found['duration_ns'] // 1_000_000};mean={samples.mean():.4f};std={samples.std():.4f};crossings={crossings}"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as a file and read back."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, strings = pa.int64(), pa.string()
        schema = pa.schema([("doc_id", longs), ("n_bytes", longs), ("payload_bytes", longs), ("payload_sha256", strings), ("tail_crc32", longs), ("media_bytes", longs), ("media_sha256", strings), ("feature", strings)])
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                media = write(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME))
                found = read(media)
                payload = b"".join([media[p[4] : p[4] + p[5]] for p in found["packets"]])
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(found, np.frombuffer(payload, dtype=np.uint8))))
            yield batch_of(schema, batch.column("doc_id"), *zip(*out, strict=True))

    return mapped(table(spark, sf_dir, "documents", "doc_id", "text"), store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
