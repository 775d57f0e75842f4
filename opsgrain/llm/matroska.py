"""Op 10, media columns in Matroska: payloads as 8-bit samples, and packet tables read back from the bytes.

The writer makes one audio track of unsigned 8-bit samples, in frames of a fixed size, several frames to a
block (with no, Xiph, fixed-size or EBML lacing), blocks in clusters, and cues that point to the clusters.
The reader parses any Matroska file of known or unknown element sizes: EBML elements with variable-length
ids and sizes, clusters, simple blocks and block groups, all lacings, and cues. The frames of a laced block follow
each other by their duration: an equal part of the group's duration if that is given, else the track's default one;
with neither they all have the block's timestamp, and no duration. A block of a group is a keyframe unless the group
refers to another block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, TRACK, NUMBER, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE, DEFAULT = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB, 0x23E383
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that are read into.
PARENTS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS, INFO, EBML}
#: Samples in a frame and a second, frames in a block, blocks in a cluster.
FRAME, SECOND, LACED, BLOCKS = 192, 8000, 8, 32

PACKETS = "track long, timestamp long, keyframe boolean, start long, size long, cluster long, duration long"


def vint(n: int) -> bytes:
    """An element size as a variable-length integer of the least width (all ones is kept for unknown)."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def block(track: int, relative: int, frames: list[bytes], lacing: int, keyframe: bool = True) -> bytes:
    """A simple block; lacing 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([keyframe << 7 | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return element(SIMPLE, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds the payload; its length is a multiple of :data:`FRAME`."""
    head = element(EBML, element(0x4286, b"\1") + element(0x42F7, b"\1") + element(0x42F2, b"\4") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\4") + element(0x4285, b"\2"))
    audio = element(RATE, np.array(SECOND, ">f8").tobytes()) + element(CHANNELS, b"\1") + element(DEPTH, b"\x08")
    track = element(TRACK, element(NUMBER, b"\1") + element(0x73C5, b"\1") + element(KIND, b"\2") + element(DEFAULT, _uint(FRAME * 1_000_000_000 // SECOND)) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio))
    body = [element(INFO, element(SCALE, _uint(1_000_000))), element(TRACKS, track)]
    at, cues, step = sum(map(len, body)), [], FRAME * LACED
    for k, begin in enumerate(range(0, len(payload), step * BLOCKS)):
        time = begin * 1000 // SECOND
        inner = [element(TIME, _uint(time))]
        for j, lo in enumerate(range(begin, min(begin + step * BLOCKS, len(payload)), step)):
            frames = [payload[i : i + FRAME] for i in range(lo, min(lo + step, len(payload)), FRAME)]
            inner.append(block(1, lo * 1000 // SECOND - time, frames, (2, 3, 1)[(j + k) % 3] if len(frames) > 1 else 0))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(POINT, element(CUE_TIME, _uint(time)) + element(POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, _uint(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _number(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """A variable-length integer and where it ends; without its marker bit it is -1 if all ones (unknown)."""
    first = data[at] if at < len(data) else 0
    if not first:
        raise ValueError(f"no number at byte {at}")
    width = 9 - first.bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at:end], "big")
    if not marker:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, end


def elements(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """All elements in order, read into their parents: id, first byte, first byte of the body, end."""
    at = 0
    while at < len(data):
        kind, body = _number(data, at, True)
        size, body = _number(data, body, False)
        end = len(data) if size < 0 else body + size
        if end > len(data):
            raise ValueError(f"the element at byte {at} ends after the file")
        yield kind, at, body, end
        at = body if kind in PARENTS else end


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, the keyframe flag, and byte ranges of the frames in a block."""
    track, at = _number(data, at, False)
    if at + 3 > end:
        raise ValueError(f"no whole head in the block that ends at byte {end}")
    relative, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, bool(flags & 128), [(at, end - at)]
    if at == end:
        raise ValueError(f"no number of frames in the block that ends at byte {end}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"fixed-size lacing does not divide the block that ends at byte {end}")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == 1:
                n = 0
                while at < end and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= end:
                    raise ValueError(f"lacing sizes exceed the block that ends at byte {end}")
                n, at = n + data[at], at + 1
            elif k == 0:
                n, at = _number(data, at, False)
            else:
                begin = at
                change, at = _number(data, at, True)
                width = at - begin
                n = sizes[-1] + (change ^ 1 << 7 * width) - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    ranges = []
    for n in sizes:
        if n < 0:
            raise ValueError(f"lacing sizes exceed the block that ends at byte {end}")
        ranges.append((at, n))
        at += n
    return track, relative, bool(flags & 128), ranges


def demux(data: bytes) -> tuple[list[tuple[int, int, bool, int, int, int, int | None]], dict]:
    """The packet table (see :data:`PACKETS`; start and size are bytes of the file) and what the heads say.

    Timestamps and durations are nanoseconds; a duration is None where neither the block's group nor its track gives
    one. Bytes that are no such file raise ValueError.
    """
    packets, info = [], {"scale": 1_000_000, "clusters": 0, "blocks": 0, "cues": [], "laces": 0, "durations": {}}
    segment, time, cluster, cue, number, default = 0, 0, 0, 0, None, None
    group: dict | None = None
    value = lambda: int.from_bytes(data[body:end], "big")

    def block(track, relative, key, ranges, whole=None):
        info["blocks"] += 1
        info["laces"] += len(ranges) > 1
        first, each = (time + relative) * info["scale"], info["durations"].get(track)
        if whole is not None:  # cut so that the parts add up to the whole
            cuts = [whole * info["scale"] * i // len(ranges) for i in range(len(ranges) + 1)]
        else:
            cuts = [(each or 0) * i for i in range(len(ranges) + 1)]
        known = whole is not None or each is not None
        packets.extend((track, first + cuts[i], key, lo, n, cluster, cuts[i + 1] - cuts[i] if known else None) for i, (lo, n) in enumerate(ranges))

    def close():  # what tells of a block in a group may come after it
        if group and "block" in group:
            track, relative, _, ranges = group["block"]
            block(track, relative, not group["refers"], ranges, group["duration"])

    for kind, at, body, end in elements(data):
        if group and at >= group["end"]:
            close()
            group = None
        if kind == SIMPLE:
            block(*_frames(data, body, end))
        elif kind == GROUP:
            group = {"end": end, "refers": False, "duration": None}
        elif kind == BLOCK:
            if group is None:
                raise ValueError(f"a block outside of a group at byte {at}")
            group["block"] = _frames(data, body, end)
        elif kind == DURATION and group:
            group["duration"] = value()
        elif kind == REFERENCE and group:
            group["refers"] = True
        elif kind == TRACK:
            number = default = None
        elif kind in (NUMBER, DEFAULT):
            number, default = (value(), default) if kind == NUMBER else (number, value())
            if number is not None and default:
                info["durations"][number] = default
        elif kind == CLUSTER:
            cluster, info["clusters"] = at - segment, info["clusters"] + 1
        elif kind == TIME:
            time = value()
        elif kind == SEGMENT:
            segment = body
        elif kind == SCALE:
            info["scale"] = value()
        elif kind == CODEC:
            info["codec"] = data[body:end].decode("ascii")
        elif kind == RATE:
            if end - body not in (4, 8):
                raise ValueError(f"a rate of {end - body} bytes at byte {at}")
            info["rate"] = float(np.frombuffer(data[body:end], f">f{end - body}")[0])
        elif kind == DEPTH:
            info["depth"] = value()
        elif kind == CUE_TIME:
            cue = value()
        elif kind == CUE_CLUSTER:
            info["cues"].append((cue, value()))
    close()
    # numbers that their columns can't hold are no media's
    times = [x for p in packets for x in (p[1], p[6] or 0)] + [t * info["scale"] for t, _ in info["cues"]] + [c for _, c in info["cues"]]
    if max(map(abs, times), default=0) >= 1 << 63 or info.get("depth", 0) >= 1 << 31:
        raise ValueError("a number is too large")
    return packets, info


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as UTF-8 (null: empty), with spaces up to a positive multiple of
    :data:`FRAME` bytes, in a Matroska file. Repeated rows stay; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                raw = [(x or "").encode() for x in some.column("text").to_pylist()]
                media = [mux(x + b" " * (-len(x) % FRAME if x else FRAME)) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parsed(media: DataFrame) -> DataFrame:
    """Reads the files in ``doc_id, n_bytes, media`` back: one row for each, with its packet table as an array.

    The payload is put together from the packets' byte ranges alone; of it and of the file come sizes, checksums and
    the samples' mean, deviation and share of steps that cross the mean. A null file has no packets and nulls. A broken
    one has ``error``, what is wrong with it (else null), its size and checksum, and nulls; the others go on.
    """
    packet = pa.struct([(n, pa.bool_() if n == "keyframe" else pa.int64()) for n in (x.split()[0] for x in PACKETS.split(", "))])
    cue = pa.struct([("timestamp", pa.int64()), ("cluster", pa.int64())])
    names = [x.split()[0] for x in FACTS.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                tables, cues, facts = [], [], []
                for data in some.column("media"):
                    if not data.is_valid:
                        tables.append(None), cues.append(None), facts.append((None,) * len(names))
                        continue
                    data = data.as_py()
                    try:
                        packets, info = demux(data)
                    except ValueError as broken:
                        own = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "error": str(broken)}
                        tables.append(None), cues.append(None), facts.append(tuple(own.get(x) for x in names))
                        continue
                    payload = b"".join([data[lo : lo + size] for _, _, _, lo, size, _, _ in packets])
                    x = np.frombuffer(payload, np.uint8)
                    mean = float(x.mean()) if len(x) else 0.0
                    over = x > mean
                    crossed = float(np.mean(over[1:] != over[:-1])) if len(x) > 1 else 0.0
                    tables.append(packets)
                    cues.append([(time * info["scale"], to) for time, to in info["cues"]])
                    facts.append((
                        info["blocks"], info["laces"], info.get("codec"), info.get("rate"), info.get("depth"), len(data), hashlib.sha256(data).hexdigest(),
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), mean, float(x.std()) if len(x) else 0.0, crossed, None,
                    ))
                columns = list(zip(*facts, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("n_bytes"), _structs(tables, packet), _structs(cues, cue), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", "n_bytes", "packets", "cues", *names],
                )

    fields = ", ".join(x.replace(" ", ": ") for x in PACKETS.split(", "))
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id long, n_bytes long, packets array<struct<{fields}>>, cues array<struct<timestamp: long, cluster: long>>, {FACTS}"
    )


#: Facts about a file and its payload.
FACTS = (
    "blocks int, laced int, codec string, rate double, depth int, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, mean double, deviation double, crossings double, error string"
)


def _structs(lists: list[list[tuple] | None], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, column by column."""
    sizes = [len(x) if x else 0 for x in lists]
    flat = list(zip(*(t for x in lists if x for t in x), strict=True)) or [[]] * kind.num_fields
    inner = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(flat)], fields=list(kind))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([x is None for x in lists] + [False])), inner) if None in lists else pa.ListArray.from_arrays(pa.array(offsets), inner)


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of each file in ``doc_id, media``: doc_id, nth and :data:`PACKETS`.

    Timestamps and durations are nanoseconds. A null file has no packets, nor has a broken one; :func:`parsed` says why.
    """
    if "n_bytes" not in media.columns:
        media = media.withColumn("n_bytes", F.lit(None).cast("long"))
    return parsed(media).select("doc_id", F.posexplode("packets").alias("nth", "_p")).select("doc_id", F.col("nth").cast("long").alias("nth"), "_p.*")


def features(media: DataFrame) -> DataFrame:
    """Describes stored files from what :func:`parsed` reads: sizes, checksums and features of packets and samples.

    ``feature`` lists packets, blocks, laced blocks, clusters, cues that point to a cluster of that time, duration in
    ms, and of the samples the mean, the deviation and the share of steps that cross the mean. A file that can't be
    parsed has ``error``, with a null ``feature``.
    """
    read = parsed(media)
    begins = F.transform("packets", lambda p: F.struct(p["cluster"].alias("cluster"), p["timestamp"].alias("timestamp")))
    times = F.array_distinct(F.transform(F.filter(begins, lambda p, i: (i == 0) | (F.get(begins, i - 1)["cluster"] != p["cluster"])), lambda p: p))
    read = read.withColumn("clusters", times)
    true = F.size(F.filter("cues", lambda c: F.exists("clusters", lambda p: (p["cluster"] == c["cluster"]) & (p["timestamp"] == c["timestamp"]))))
    text = F.format_string(
        "codec=%s;rate=%.0f;depth=%d;packets=%d;blocks=%d;laced=%d;clusters=%d;cues=%d;ms=%d;mean=%.4f;deviation=%.4f;crossings=%.4f",
        "codec", "rate", "depth", F.size("packets"), "blocks", "laced", F.size("clusters"), true, F.floor(F.col("payload_bytes") * 1000 / F.col("rate")), "mean", "deviation", "crossings",
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.when(F.col("packets").isNotNull(), text).alias("feature"), "error")
