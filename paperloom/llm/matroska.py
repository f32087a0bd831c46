"""Text payloads as Matroska media, and Matroska files as packet tables.

Writing: the UTF-8 bytes of a text, filled with spaces to a positive multiple of
FRAME_UNIT, are the samples of an 8-bit PCM track. Frames of up to FRAME_BYTES
go into SimpleBlocks of several frames (fixed-size lacing where all frames of a
block are equal, EBML lacing otherwise), blocks into clusters with a timestamp,
and cues name each cluster's time and place. Nothing in the file depends on
anything but the payload.

Reading: elements are parsed by their variable-length ids and sizes (unknown
sizes too), tracks, clusters, simple blocks and block groups, all four kinds of
lacing (none, Xiph, EBML, fixed) and cues. The result is a packet table: track,
timestamp, byte range in the file, cluster, key flag, duration. A block of a
group is a key frame unless the group names a block that it refers to.

Results in special cases: null and empty texts have a payload of FRAME_UNIT
spaces; a file that isn't Matroska or ends early raises MatroskaError in
`parse` and gives a row without packets, with the error, in `packets`; void and
unknown elements are skipped; repeated rows and null ids are treated like
others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_UNIT, FRAME_BYTES, LACED, CLUSTER_BLOCKS, RATE = 192, 1536, 8, 16, 8000

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION, NUMBER, UID, TYPE, CODEC, AUDIO, HERTZ, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
REFERENCE, TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_AT, DEFAULT_DURATION = 0xFB, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x23E383
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
#: Where an element of unknown size may end: at one that its parent holds.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469, SEGMENT, EBML}


class MatroskaError(ValueError):
    pass


# Writing --------------------------------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer: as short as can be, or of a given width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(track: int, relative: int, frames: list[bytes], lacing: str = "auto", key: bool = True) -> bytes:
    """The body of a SimpleBlock."""
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len({len(f) for f in frames}) == 1 else "ebml"
    flags = (0x80 if key else 0) | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing]
    sizes = [len(f) for f in frames]
    head = b""
    if lacing == "none":
        if len(frames) != 1:
            raise MatroskaError("a block without lacing has one frame")
    else:
        head = bytes([len(frames) - 1])
        if lacing == "xiph":
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == "ebml" and len(frames) > 1:
            head += vint(sizes[0])
            for a, b in zip(sizes, sizes[1:-1], strict=False):
                width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
                head += vint(b - a + (1 << 7 * width - 1) - 1, width)
        elif lacing == "fixed" and len(set(sizes)) > 1:
            raise MatroskaError("fixed-size lacing needs equal frames")
    return vint(track) + struct.pack(">hB", relative, flags) + head + b"".join(frames)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(FRAME_UNIT, -(-len(raw) // FRAME_UNIT) * FRAME_UNIT) - len(raw)), len(raw)


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload as its only track."""
    scale = 1_000_000_000 // RATE  # a tick is one sample
    audio = element(AUDIO, element(HERTZ, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    info = element(INFO, number(SCALE, scale) + element(DURATION, struct.pack(">d", len(payload))))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    clusters, cues, at = [], [], len(info) + len(tracks)
    span = FRAME_BYTES * LACED
    # relative timestamps have 16 bits, so a cluster ends before sample 32768
    step = span * min(CLUSTER_BLOCKS, 32767 // span + 1)
    for start in range(0, len(payload), step):
        body = [number(TIMESTAMP, start)]
        for b in range(start, min(start + step, len(payload)), span):
            frames = [payload[k : k + FRAME_BYTES] for k in range(b, min(b + span, len(payload)), FRAME_BYTES)]
            body.append(element(SIMPLE, laced(1, b - start, frames)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, number(CUE_TIME, start) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_AT, at))))
        clusters.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


# Reading --------------------------------------------------------------------------------------------------------------


@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    end: int
    cluster: int
    key: bool
    #: In ticks, where the file tells it.
    duration: int | None = None


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    duration: float = 0.0


def _id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise MatroskaError(f"no element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, or None if it is the unknown size, and where it ends."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"no size at {at}")
    n = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _lacing(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first begins."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a lace without frames")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("fixed-size lacing that doesn't divide")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise MatroskaError("a lace ends early")
            size, at = size + data[at], at + 1
        else:
            first = at
            size, at = _size(data, at)
            if size is None:
                raise MatroskaError("a lace of unknown size")
            if k:
                size += sizes[-1] - ((1 << 7 * (at - first) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("a lace is longer than its block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file."""
    media = Media()
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    head, at = _id(data, 0)
    if head != EBML:
        raise MatroskaError("no EBML header")
    size, at = _size(data, at)
    stop = at + (size or 0)
    while at < stop:
        id_, at = _id(data, at)
        n, at = _size(data, at)
        if id_ == DOC_TYPE:
            media.doc_type = data[at : at + n].rstrip(b"\0").decode("ascii", "replace")
        at += n
    if media.doc_type not in ("matroska", "webm"):
        raise MatroskaError(f"document type {media.doc_type!r}")

    def block(a: int, b: int, base: int, cluster: int, key: bool | None) -> None:
        track, a = _size(data, a)
        if a + 3 > b:
            raise MatroskaError("a block ends early")
        relative, flags = struct.unpack(">hB", data[a : a + 3])
        sizes, a = _lacing(data, a + 3, b, flags >> 1 & 3)
        # a laced frame's time follows from the frame before: the track's default duration, or a sample a byte for 8-bit PCM
        known = media.tracks.get(track, {})
        time = base + relative
        for n in sizes:
            lasts = known["ticks"] if "ticks" in known else n // known["bytes"] if "bytes" in known else None
            media.packets.append(Packet(track, time, a, a + n, cluster, bool(flags & 0x80) if key is None else key, lasts))
            time += lasts or 0
            a += n

    def close_group() -> None:
        """A group's references and duration hold for its block, whichever comes first."""
        made = media.packets[group["from"] :]
        for k, p in enumerate(made):
            p.key = not group["refers"]
            if group["lasts"] is not None:
                if p.duration is None:
                    p.timestamp += group["lasts"] * k // len(made)
                p.duration = group["lasts"] * (k + 1) // len(made) - group["lasts"] * k // len(made)
        group["from"] = None

    group: dict = {"from": None}
    segment = 0
    cluster, base = -1, 0
    track: dict = {}
    cue: list[int] = [0, 0, 0]
    ends: list[tuple[int | None, int]] = []  # (end, id) of the open parents
    while at < len(data):
        while ends and ends[-1][0] is not None and at >= ends[-1][0]:
            if ends.pop()[1] == GROUP:
                close_group()
        begin = at
        id_, at = _id(data, at)
        while ends and ends[-1][0] is None and ends[-1][1] != SEGMENT and id_ in (TOP | {GROUP, SIMPLE, TIMESTAMP} if ends[-1][1] == GROUP else TOP):
            if ends.pop()[1] == GROUP:
                close_group()
        n, at = _size(data, at)
        if n is not None and at + n > len(data):
            raise MatroskaError(f"element {id_:X} at {begin} ends after the file")
        if id_ == SEGMENT:
            segment = at
        elif id_ == CLUSTER:
            cluster, base = begin, 0
            media.clusters.append(begin)
        elif id_ == TRACK:
            track = {}
        elif id_ == GROUP:
            group = {"from": len(media.packets), "refers": False, "lasts": None}
        elif id_ == POINT:
            cue = [0, 0, 0]
        if id_ in PARENTS:
            ends.append((None if n is None else at + n, id_))
            continue
        if n is None:
            raise MatroskaError(f"element {id_:X} of unknown size")
        end = at + n
        if id_ == SCALE:
            media.scale = uint(at, end)
        elif id_ == DURATION:
            media.duration = real(at, end)
        elif id_ == NUMBER:
            track["number"] = uint(at, end)
            media.tracks[track["number"]] = track
        elif id_ == TYPE:
            track["type"] = uint(at, end)
        elif id_ == CODEC:
            track["codec"] = data[at:end].decode("ascii", "replace")
        elif id_ == DEFAULT_DURATION:
            track["ticks"] = uint(at, end) // media.scale
        elif id_ == HERTZ:
            track["hertz"] = real(at, end)
        elif id_ == DEPTH:
            if track.get("codec", "").startswith("A_PCM/INT"):
                track["bytes"] = max(1, uint(at, end) // 8 * track.get("channels", 1))
        elif id_ == CHANNELS:
            track["channels"] = uint(at, end)
        elif id_ == TIMESTAMP:
            base = uint(at, end)
        elif id_ == SIMPLE:
            block(at, end, base, cluster, None)
        elif id_ == BLOCK:
            block(at, end, base, cluster, True)
        elif id_ == REFERENCE:
            group["refers"] = True
        elif id_ == BLOCK_DURATION:
            group["lasts"] = uint(at, end)
        elif id_ == CUE_TIME:
            cue[0] = uint(at, end)
        elif id_ == CUE_TRACK:
            cue[1] = uint(at, end)
        elif id_ == CUE_AT:
            cue[2] = segment + uint(at, end)
            media.cues.append((cue[0], cue[1], cue[2]))
        at = end
    if group["from"] is not None:
        close_group()
    return media


def track_bytes(data: bytes, media: Media, track: int) -> bytes:
    return b"".join([data[p.start : p.end] for p in media.packets if p.track == track])


# Tables ---------------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One Matroska file a document: id, n_bytes, media (binary)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                made = [payload_of(t.as_py()) for t in b.column(1)[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 256], pa.array([n for _, n in made], pa.int64()), pa.array([write(p) for p, _ in made], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_PACKET = "track int, timestamp long, start long, end long, cluster long, key boolean, duration long"


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, timestamp, start, end, cluster, key, duration, cued, error. A file that can't be read has one row, with the error."""
    id_type = media.schema[id_col].dataType.simpleString()
    schema = pa.schema([("packet", pa.int32()), ("track", pa.int32()), ("timestamp", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("cluster", pa.int64()), ("key", pa.bool_()), ("duration", pa.int64()), ("cued", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    m = parse(data.as_py() or b"")
                    cued = {c[2] for c in m.cues}
                    rows = [(k, p.track, p.timestamp, p.start, p.end, p.cluster, p.key, p.duration, p.cluster in cued, None) for k, p in enumerate(m.packets)]
                except MatroskaError as e:
                    rows = [(None,) * 9 + (str(e),)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), b.schema.field(0).type), *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], ["id", *schema.names])

    rows = media.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    return rows.mapInArrow(run, f"id {id_type}, packet int, {_PACKET}, cued boolean, error string").withColumnRenamed("id", id_col)


def digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What `encode` gave, read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The feature is a short description of the packet table: packets, clusters,
    cues, last timestamp and the mean sample of each packet, as a checksum.
    """
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for data in b.column(2):
                raw = data.as_py()
                m = parse(raw)
                payload = track_bytes(raw, m, 1)
                means = struct.pack(f">{len(m.packets)}H", *[sum(raw[p.start : p.end]) // max(1, p.end - p.start) for p in m.packets])
                feature = f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};last={m.packets[-1].timestamp if m.packets else 0};levels={zlib.crc32(means):08x}"
                for col, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
