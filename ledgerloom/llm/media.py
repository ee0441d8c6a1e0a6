"""Media columns: MPEG audio streams written, resynchronised, verified and indexed.

``write_stream`` stores a payload losslessly: each unit of 576 bytes is the ancillary data of one
MPEG-2 layer III frame (mono, 16 kHz, 144 kbit/s, CRC-protected) whose granule is silent and whose
576 samples stand for the 576 bytes. An ID3v2 tag holds the unpadded length; a first frame holds a
variable-bitrate table (frame count, byte count, 100 seek points).

``read_stream`` takes any bytes: it skips and parses ID3v2 tags, and ID3v1 tags that aren't within a frame, finds frame headers again
after damage (a header counts only if the next frame's header, or the end, follows where it says),
reads Xing/Info and VBRI tables, checks the CRC-16 of protected layer III frames, and gives exact
durations as samples and rate, and the byte offset of each audio frame. Tables and tags that are cut off give what
they still hold. An ID3v1 tag counts where no frame goes through it. As a frame has 576 samples and holds 576
bytes, a stream's duration follows from the length of its text; the query's feature names that store.

Null and empty texts are one unit of padding. Every row gives one row; equal texts give equal bytes.
Bytes without any frame give zero frames and duration 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, rows, texts

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), and Hz by version.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header:
    """What the four bytes of a frame header say."""

    __slots__ = ("channels", "layer", "protected", "rate", "samples", "side", "size", "version")

    def __init__(self, version: int, layer: int, protected: bool, kbits: int, rate: int, padding: int, mono: bool):
        first = version == 3
        self.version, self.layer, self.protected, self.rate, self.channels = version, layer, protected, rate, 2 - mono
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        self.size = (12 * kbits * 1000 // rate + padding) * 4 if layer == 1 else self.samples // 8 * kbits * 1000 // rate + padding
        self.side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)


_HEADERS: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """The header in four bytes, or None where they are none. Free-format streams count as none."""
    if four in _HEADERS:
        return _HEADERS[four]
    out = None
    if len(four) == 4 and four[0] == 255 and four[1] >= 224:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        kbits, rate = four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < kbits < 15 and rate != 3 and four[3] & 3 != 2:
            out = Header(version, layer, not four[1] & 1, KBITS[version == 3, layer][kbits - 1], RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)
    if len(_HEADERS) < 4096:
        _HEADERS[four] = out
    return out


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The CRC-16 of the audio standard (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ CRC[c >> 8 ^ b]
    return c


def _frame_head() -> bytes:
    head = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])
    side = bytes(9)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


HEAD = _frame_head()
FRAME = parse_header(HEAD[:4])
TAIL = bytes(FRAME.size - len(HEAD) - UNIT)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_stream(data: bytes) -> bytes:
    """``data``, padded with 255 to a positive multiple of 576 bytes, as an MPEG audio stream."""
    frames = max(1, -(-len(data) // UNIT))
    padded = data.ljust(frames * UNIT, b"\xff")
    body = b"ledgerloom\0" + struct.pack(">QI", len(data), UNIT)
    tag = b"PRIV" + _synchsafe(len(body)) + b"\0\0" + body
    tag = b"ID3\4\0\0" + _synchsafe(len(tag)) + tag
    size = (frames + 1) * FRAME.size
    toc = bytes(min(255, (FRAME.size * (1 + frames * i // 100)) * 256 // size) for i in range(100))
    table = b"Info" + struct.pack(">III", 7, frames, size) + toc
    out = [tag, (HEAD + table).ljust(FRAME.size, b"\0")]
    for at in range(0, len(padded), UNIT):
        out += (HEAD, padded[at : at + UNIT], TAIL)
    return b"".join(out)


def _skip_tag(data: bytes, at: int) -> tuple[int, int | None]:
    """Past an ID3v2 tag at ``at``, and the unpadded length if the tag has one."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at, None
    n = 0
    for b in data[at + 6 : at + 10]:
        n = n << 7 | b & 127
    end, length, pos = at + 10 + n, None, at + 10
    while pos + 10 <= end and data[pos : pos + 4].isalnum():
        size = 0
        for b in data[pos + 4 : pos + 8]:
            size = size << 7 | b & 127 if data[at + 3] >= 4 else size << 8 | b
        body = data[pos + 10 : pos + 10 + size]
        if data[pos : pos + 4] == b"PRIV" and body.startswith(b"ledgerloom\0") and len(body) >= 19:
            length = struct.unpack(">Q", body[11:19])[0]
        pos += 10 + size
    return min(end + (10 if data[at + 5] & 16 else 0), len(data)), length


def _table(frame: bytes, head: Header) -> tuple[str, int, int, bytes] | None:
    """Kind, frames, bytes and seek points of a variable-bitrate table in a frame; -1 for figures that it lacks or that are cut off."""
    pos = 4 + 2 * head.protected + head.side
    number = lambda at: int.from_bytes(frame[at : at + 4], "big") if at + 4 <= len(frame) else -1
    kind = frame[pos : pos + 4]
    if kind in (b"Xing", b"Info"):
        flags, pos = max(0, number(pos + 4)), pos + 8
        frames = size = -1
        if flags & 1:
            frames, pos = number(pos), pos + 4
        if flags & 2:
            size, pos = number(pos), pos + 4
        return kind.decode(), frames, size, frame[pos : pos + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI":
        return "VBRI", number(50), number(46), b""
    return None


def read_stream(data: bytes) -> dict:
    """Length, payload, frames and figures of a stream; see the module's text."""
    at, length = _skip_tag(data, 0)
    tag = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    end = tag
    offsets, units, table, resyncs, bad, checked, samples, rate, first, lost = [], [], None, 0, 0, 0, 0, 0, True, False
    sums: dict[bytes, int] = {}
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        after = at + head.size if head else 0
        if at < tag < after and (after == len(data) or parse_header(data[after : after + 4])):
            end = len(data)  # the frames go on past these bytes, so they are no tag
        if not head or after > end or (lost or first) and after + 4 <= end and not parse_header(data[after : after + 4]):
            lost = True
            if data[at : at + 3] == b"ID3":
                at = max(at + 1, _skip_tag(data, at)[0])
                continue
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        resyncs, lost = resyncs + lost, False
        found = _table(data[at:after], head) if first and head.layer == 3 else None
        first, rate = False, head.rate
        if head.protected and head.layer == 3:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
            checked += 1
            if covered not in sums and len(sums) < 4096:
                sums[covered] = crc16(covered)
            bad += int.from_bytes(data[at + 4 : at + 6], "big") != (sums[covered] if covered in sums else crc16(covered))
        if found:
            table = found
        else:
            offsets.append(at)
            samples += head.samples
            body = at + 4 + 2 * head.protected + head.side
            units.append(data[body : min(body + UNIT, after)])
        at = after
    return {"n_bytes": length, "payload": b"".join(units), "offsets": offsets, "samples": samples, "rate": rate, "table": table, "resyncs": resyncs, "checked": checked, "bad": bad}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        media = [write_stream(t.encode("utf-8", "surrogatepass")) for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, frame_offsets array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        out = []
        for media in batch.column("media").to_pylist():
            x = read_stream(media)
            payload, table = x["payload"], x["table"] or ("none", -1, -1, b"")
            mean = sum(payload) * 1000 // max(1, len(payload))
            feature = f"store=ancillary:{UNIT};frames={len(x['offsets'])};ms={x['samples'] * 1000 // max(1, x['rate'])};rate={x['rate']};table={table[0]}:{table[1]};crc={x['checked'] - x['bad']}/{x['checked']};resyncs={x['resyncs']};mean={mean}"
            out.append((x["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["samples"], x["rate"], x["offsets"]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)


def audio_columns(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text as an MPEG audio stream to a table, reads that back and gives its figures."""
    ws = Workspace(spark, "media")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = ws.table("streams", source.mapInArrow(_encode, "doc_id long, media binary"))
    return stored.mapInArrow(_features, COLUMNS)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as an MPEG audio stream, read back."""
    return audio_columns(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
