"""Media columns: Matroska files in a binary column, parsed to packet tables.

The parser reads variable-length EBML elements, clusters with simple blocks and
block groups, all four kinds of lacing, and cues. Each frame becomes a packet with
its track, timestamp and byte range in the file, so payloads are slices of the
column and nothing is decoded twice. The writer makes audio files of unsigned 8-bit samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches

# Fixed values of the format: element ids, with their marker bits.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE = 0x4282, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PCM = b"A_PCM/INT/LIT"

RATE = 8000  # samples a second, of one byte each
UNIT = 64
FRAME = 512  # bytes of a packet
LACED = 8  # packets of a block
PER_CLUSTER = 32  # blocks of a cluster

PACKET_SCHEMA = "packet long, cluster long, track long, timestamp_ns long, keyframe boolean, lacing string, offset long, size long"


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least width, or of `width`."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag bits and body of a block with these frames: none, fixed or EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0b100, bytes([len(frames) - 1]) + b"".join(frames)
    head = [bytes([len(frames) - 1]), vint(sizes[0])]
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head.append(vint(b - a + (1 << 7 * width - 1) - 1, width))
    return 0b110, b"".join(head + frames)


def mux(payload: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """A file with one track of 8-bit samples; equal payloads give equal files."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(rate, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, PCM) + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_block, per_cluster = frame * LACED, frame * LACED * PER_CLUSTER
    for start in range(0, len(payload), per_cluster):
        base = start * 1000 // rate
        body = [uint(TIMESTAMP, base)]
        for i in range(start, min(start + per_cluster, len(payload)), per_block):
            end = min(i + per_block, len(payload))
            flag, frames = laced([payload[j : min(j + frame, end)] for j in range(i, end, frame)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + (i * 1000 // rate - base).to_bytes(2, "big", signed=True) + bytes([0x80 | flag]) + frames))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 for the size that means unknown."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


#: Elements of the levels above that end an element of unknown size.
_ENDS = {CLUSTER: {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}, SEGMENT: {EBML, SEGMENT}}


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """id, start and end of the body, of the elements in a range; cut ones end with it."""
    while at < end:
        id_, body = read_vint(data, at, keep_marker=True)
        size, body = read_vint(data, body)
        stop = min(end, body + size)
        if size < 0:
            stop = end
            if id_ in _ENDS:
                pos = body
                while pos < end:
                    inner, after = read_vint(data, pos, keep_marker=True)
                    if inner in _ENDS[id_]:
                        stop = pos
                        break
                    n, after = read_vint(data, after)
                    pos = end if n < 0 else after + n
        yield id_, body, stop
        at = stop


def frames_of(data: bytes, at: int, end: int, flags: int) -> tuple[str, list[tuple[int, int]]]:
    """Offset and size of the frames in a block's body."""
    kind = flags >> 1 & 3
    if not kind:
        return "none", [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size = (end - at) // n
        return "fixed", [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
            sizes.append(sizes[-1] + raw - (1 << 7 * width - 1) + 1)
            at += width
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing at {at} doesn't fit its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return "xiph" if kind == 1 else "ebml", list(zip(starts, sizes, strict=True))


def number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def demux(data: bytes) -> dict:
    """packets (tuples in PACKET_SCHEMA's order), tracks by number, and cues."""
    packets: list[tuple] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    scale, cluster = 1_000_000, -1

    def block(at: int, end: int, base: int, key: bool | None) -> None:
        track, at = read_vint(data, at)
        offset = int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        kind, frames = frames_of(data, at + 3, end, flags)
        for a, size in frames:
            packets.append((len(packets), cluster, track, (base + offset) * scale, bool(flags & 0x80) if key is None else key, kind, a, size))

    for id_, top, stop in elements(data, 0, len(data)):
        if id_ != SEGMENT:
            continue
        for kind, a, b in elements(data, top, stop):
            if kind == INFO:
                scale = next((number(data, x, y) for i, x, y in elements(data, a, b) if i == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for i, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        fields = {j: data[u:v] for j, u, v in elements(data, x, y)}
                        tracks[number(fields.get(TRACK_NUMBER, b"\x00"), 0, 8)] = {"codec": fields.get(CODEC_ID, b"").decode("ascii", "replace"), "type": number(fields.get(TRACK_TYPE, b"\x00"), 0, 8)}
            elif kind == CLUSTER:
                cluster, base = cluster + 1, 0
                for i, x, y in elements(data, a, b):
                    if i == TIMESTAMP:
                        base = number(data, x, y)
                    elif i == SIMPLE_BLOCK:
                        block(x, y, base, None)
                    elif i == BLOCK_GROUP:
                        inner = list(elements(data, x, y))
                        key = all(j != REFERENCE_BLOCK for j, _, _ in inner)
                        for j, u, v in inner:
                            if j == BLOCK:
                                block(u, v, base, key)
            elif kind == CUES:
                for _, x, y in elements(data, a, b):
                    at = {i: (u, v) for i, u, v in elements(data, x, y)}
                    if CUE_TIME in at and CUE_TRACK_POSITIONS in at:
                        spot = {i: number(data, u, v) for i, u, v in elements(data, *at[CUE_TRACK_POSITIONS])}
                        cues.append((number(data, *at[CUE_TIME]) * scale, spot.get(CUE_TRACK, 0), top + spot.get(CUE_CLUSTER_POSITION, 0)))
    return {"packets": packets, "tracks": tracks, "cues": cues}


def samples(data: bytes, packets: list[tuple], track: int = 1) -> bytes:
    """The bytes of a track, its packets in timestamp order."""
    own = [p for p in packets if p[2] == track]
    if any(p[3] > q[3] for p, q in zip(own, own[1:], strict=False)):
        own.sort(key=lambda p: (p[3], p[0]))
    return b"".join([data[p[6] : p[6] + p[7]] for p in own])


def feature(payload: bytes, parsed: dict) -> str:
    """Level, energy, zero crossings and a 16-band histogram of the samples, and packet counts."""
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.int16) - 128
    bands = np.bincount(x >> 4, minlength=16)
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    return (
        f"packets={len(parsed['packets'])};cues={len(parsed['cues'])};mean={level.mean(dtype=np.float64):.6f};"
        f"rms={np.sqrt(np.square(level, dtype=np.int32).mean(dtype=np.float64)):.6f};crossings={crossings};bands={','.join(map(str, bands.tolist()))}"
    )


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // unit)) * unit
    return raw.ljust(size, b"\x00"), len(raw)


def _slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, so that outputs of wide rows stay small."""
    rows = max(1, int(batch.num_rows * most // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(docs: DataFrame, rate: int = RATE, frame: int = FRAME) -> DataFrame:
    """doc_id, n_bytes and media: a Matroska file a row, with the text's bytes padded as samples.

    A null or empty text is one unit of zero bytes. Rows stay where they are: no shuffle.
    """

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                media, sizes = [], []
                for text in part.column(1).to_pylist():
                    payload, n = padded(text)
                    media.append(mux(payload, rate, frame))
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """A row for each packet of the files in column media, with doc_id and the packet's place.

    A null, empty or broken file gives no packets past the place where it breaks off.
    """
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in PACKET_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = demux(data or b"")["packets"]
                except (ValueError, IndexError):
                    rows = []
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(part), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True))],
                        ["doc_id", *names])

    bounded_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id long, {PACKET_SCHEMA}")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests and features of the samples read back from the stored files.

    Null, empty and broken files give nulls for all that is read from them, each row
    by itself; repeated rows give equal rows, long files are parsed whole, no rows give none.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                try:
                    parsed = demux(data or b"")
                    payload = samples(data or b"", parsed["packets"])
                except (ValueError, IndexError):
                    payload = b""
                if not payload:
                    rows.append((None,) * 6)
                    continue
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, parsed)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                [c.split()[0] for c in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
