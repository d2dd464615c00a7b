"""MPEG audio columns: write text payloads as MP3 streams, and read any MP3 stream back.

`encode_audio` stores bytes as an MPEG-1 Layer III stream: an ID3v2.4 tag, a frame with a Xing variable-bitrate table, then
protected 48 kHz mono frames whose main data are empty (a player hears silence) and whose ancillary bytes are the payload.
`parse_audio` reads such or foreign streams: it resynchronises on frame headers, parses ID3v2/ID3v1 tags and Xing/Info/VBRI
tables, verifies frame checksums and stores exact durations (samples and rate) and the seek offset of each frame.

Nulls: a null text is empty; a null media value gives n_frames 0 and null payload. Empty tables give empty results. Other columns
may have any names: only the named ones are read, and `keep` columns are carried along unchanged.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, mapped

# Fixed values of ISO 11172-3 / 13818-3: bitrates in kbit/s by (MPEG-1?, layer), index 1 to 14; sampling rates by version.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
PAD_UNIT = 192
SIDE = 17  # bytes of side information of an MPEG-1 mono frame
HEAD = 4 + 2 + SIDE


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(8192)
def header(word: bytes) -> tuple[int, int, int, bool, int, int] | None:
    """(frame bytes, samples, rate, protected, bytes of side information, layer) of 4 header bytes; None if they aren't a header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, protected = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), not word[1] & 1
    index, rate_index, padding, mono = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1, word[3] >> 6 == 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first = version == 3
    bitrate, rate = BITRATES[first, layer][index - 1] * 1000, RATES[version][rate_index]
    if layer == 1:
        return (12 * bitrate // rate + padding) * 4, 384, rate, protected, 0, 1
    samples = 1152 if first or layer == 2 else 576
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * bitrate // rate + padding, samples, rate, protected, side if layer == 3 else 0, layer


def _head(index: int) -> bytes:
    """Header, checksum and empty side information of a protected MPEG-1 Layer III frame, 48 kHz, mono."""
    start = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return start + struct.pack(">H", crc16(start[2:] + bytes(SIDE))) + bytes(SIDE)


HEADS = {3 * kbps: _head(i + 1) for i, kbps in enumerate(BITRATES[True, 3])}  # by frame bytes: 144 * kbps * 1000 / 48000
LARGEST = max(HEADS)
FULL = LARGEST - HEAD


def _text_frame(name: bytes, value: bytes) -> bytes:
    body = b"\3" + name + b"\0" + value
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """An MP3 stream that holds payload; its length is in the tag."""
    tag = _text_frame(b"payload_bytes", str(len(payload)).encode())
    full, rest = divmod(len(payload), FULL)
    parts = [HEADS[LARGEST] + payload[i * FULL : (i + 1) * FULL] for i in range(full)]
    if rest:
        last = next(n for n in sorted(HEADS) if n - HEAD >= rest)
        parts.append((HEADS[last] + payload[full * FULL :]).ljust(last, b"\0"))
    audio, at, offsets = sum(map(len, parts)), 0, []
    first = 576  # the table's own frame, 192 kbit/s
    for p in parts:
        offsets.append(first + at)
        at += len(p)
    total = first + audio
    toc = bytes(min(255, offsets[len(offsets) * i // 100] * 256 // total) for i in range(100)) if offsets else bytes(100)
    table = (HEADS[first] + b"Xing" + struct.pack(">III", 7, len(parts), total) + toc).ljust(first, b"\0")
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + table + b"".join(parts)


def decode(media: bytes) -> dict:
    """Frames, tags, tables, checksums and ancillary payload of an MPEG audio stream.

    A header counts only if another one of its layer and rate (or the stream's end, or a closing tag) stands where its length says, or if
    it continues a chain of such; other bytes are skipped up to the next such place and counted in skipped_bytes. Bytes "TAG" 128 before
    the end are a closing tag only where no frame covers them: a frame that reaches to the very end holds them as data. The table's own
    frame makes no sound and is not counted.
    """
    end, at, tags = len(media), 0, {}
    while media[at : at + 3] == b"ID3" and end - at >= 10:
        size = media[at + 6] << 21 | media[at + 7] << 14 | media[at + 8] << 7 | media[at + 9]
        tags |= _tag(media[at + 10 : at + 10 + size], media[at + 3])
        at += 10 + size + (10 if media[at + 5] & 0x10 else 0)
    closing = end - 128 if end - at >= 128 and media[end - 128 : end - 125] == b"TAG" else -1
    out = {"n_frames": 0, "n_samples": 0, "sample_rate": 0, "crc_checked": 0, "crc_errors": 0, "skipped_bytes": 0, "vbr_frames": -1, "vbr_bytes": -1}
    offsets: list[int] = []
    body: list[bytes] = []
    first, locked, stream = True, False, None
    while at < end:
        if at == closing:
            tags.setdefault("title", media[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1"))
            break
        h = header(media[at : at + 4])
        follows = h and (at + h[0] in (end, closing) or (n := header(media[at + h[0] : at + h[0] + 4])) is not None and (n[1], n[2], n[5]) == (h[1], h[2], h[5]))
        if h is None or at + h[0] > end or not (follows or locked and (h[1], h[2], h[5]) == stream):
            to = media.find(b"\xff", at + 1, end)
            to, locked = end if to < 0 else to, False
            to = closing if at < closing < to else to
            out["skipped_bytes"] += to - at
            at = to
            continue
        size, samples, rate, protected, side, layer = h
        locked, stream = follows, (samples, rate, layer)  # the lock falls when the chain breaks
        skip = 4 + 2 * protected + side
        found = _table(media[at + 4 + 2 * protected + side : at + size], media[at + 36 : at + 62]) if first and layer == 3 else None
        if protected and layer == 3:
            out["crc_checked"] += 1
            out["crc_errors"] += crc16(media[at + 2 : at + 4] + media[at + 6 : at + skip]) != media[at + 4] << 8 | media[at + 5]
        first = False
        if found:
            out["vbr_frames"], out["vbr_bytes"] = found
        else:
            out["n_frames"] += 1
            out["n_samples"] += samples
            out["sample_rate"] = out["sample_rate"] or rate
            offsets.append(at)
            body.append(media[at + skip : at + size])
        at += size
    data = b"".join(body)
    n = tags.get("payload_bytes", "")
    return out | {"offsets": offsets, "tags": tags, "payload": data[: int(n)] if n.isdecimal() and n.isascii() else data}


def _table(xing: bytes, vbri: bytes) -> tuple[int, int] | None:
    """(frames, bytes) of a Xing, Info or VBRI table; -1 where the table has no such entry."""
    if xing[:4] in (b"Xing", b"Info") and len(xing) >= 16:
        flags = xing[7]
        frames = struct.unpack(">I", xing[8:12])[0] if flags & 1 else -1
        at = 12 if flags & 1 else 8
        return frames, struct.unpack(">I", xing[at : at + 4])[0] if flags & 2 else -1
    if vbri[:4] == b"VBRI" and len(vbri) >= 18:
        return struct.unpack(">I", vbri[14:18])[0], struct.unpack(">I", vbri[10:14])[0]
    return None


def _tag(body: bytes, version: int) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag; TXXX frames under their own description."""
    at, out = 0, {}
    while version >= 3 and at + 10 <= len(body) and body[at] != 0:
        size = body[at + 4 : at + 8]
        n = size[0] << 21 | size[1] << 14 | size[2] << 7 | size[3] if version == 4 else int.from_bytes(size)
        name, value = body[at : at + 4], body[at + 10 : at + 10 + n]
        if name[:1] == b"T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
            key, _, rest = text.partition("\0")
            out |= {key: rest} if name == b"TXXX" else {name.decode("latin-1"): text}
        at += 10 + n
    return out


def encode_audio(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes (of the text's UTF-8), payload_bytes (padded by spaces to a positive multiple of 192) and media.

    One row for each row, repeated rows included; equal texts give equal media.
    """
    schema = df.select(*keep).schema.add("n_bytes", "long").add("payload_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = as_bytes(part.column(part.num_columns - 1))
                sizes = [max(1, -(-len(x) // PAD_UNIT)) * PAD_UNIT for x in texts]
                media = [encode(x.ljust(n, b" ")) for x, n in zip(texts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema.names)

    return mapped(df.select(*keep, F.col(text).alias("__text")), run, schema)


def parse_audio(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, then what the stream holds.

    payload, tags (map), n_frames, n_samples, sample_rate (seconds are exactly n_samples / sample_rate), crc_checked, crc_errors,
    skipped_bytes, vbr_frames, vbr_bytes (-1: no table) and seek_offsets (of each frame's first byte).
    """
    counts = ("n_frames", "n_samples", "sample_rate", "crc_checked", "crc_errors", "skipped_bytes", "vbr_frames", "vbr_bytes")
    schema = df.select(*keep).schema.add("payload", "binary").add("tags", T.MapType(T.StringType(), T.StringType()))
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("seek_offsets", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                raw = part.column(part.num_columns - 1).to_pylist()
                read = [decode(x or b"") for x in raw]
                columns = [pa.array([None if x is None else r["payload"] for x, r in zip(raw, read, strict=True)], pa.binary()), pa.array([[*r["tags"].items()] for r in read], pa.map_(pa.string(), pa.string()))]
                columns += [pa.array([r[c] for r in read], pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns, pa.array([r["offsets"] for r in read], pa.list_(pa.int64()))], schema.names)

    return mapped(df.select(*keep, F.col(media).alias("__media")), run, schema)


def feature(read: dict) -> str:
    """Frames, exact duration, table and a checksum of the seek offsets in one line (for tests; the query derives it by columns)."""
    at = zlib.crc32(",".join(map(str, read["offsets"])).encode())
    return f"mp3 frames={read['n_frames']} samples={read['n_samples']}/{read['sample_rate']} vbr={read['vbr_frames']}/{read['vbr_bytes']} crc={read['crc_checked']}-{read['crc_errors']} skipped={read['skipped_bytes']} seek={at:08x}"


def media_digests(documents: DataFrame) -> DataFrame:
    """The digest columns of the contract, from what `parse_audio` reads back."""
    stored = encode_audio(documents).select("*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = parse_audio(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    feature_ = F.format_string(
        "mp3 frames=%d samples=%d/%d vbr=%d/%d crc=%d-%d skipped=%d seek=%s", "n_frames", "n_samples", "sample_rate", "vbr_frames", "vbr_bytes", "crc_checked", "crc_errors", "skipped_bytes",
        F.lpad(F.lower(F.hex(F.crc32(F.array_join("seek_offsets", ",").cast("binary")))), 8, "0"),
    )
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes", "media_sha256", feature_.alias("feature"), "sample_rate", "n_samples", "n_frames",
    )
