"""MPEG audio columns: resynchronised frame headers, tags, variable-bitrate tables, checksums, seek offsets.

``store`` writes a payload as the main data of silent MPEG-1 Layer III frames (mono, 32 kHz, 36 ms a frame, each with
its checksum), after an ID3v2 tag and a frame with a variable-bitrate table. ``read_back`` parses any MPEG audio
stream: tags, junk before and between frames, all versions and layers, Xing, Info and VBRI tables, and takes out such a
payload again. Checksums are verified of Layer III only; those of Layers I and II count as not checked.

Defined results: a null text is an empty payload of 64 zero bytes; a value that holds no frame has no frames, zero
samples and a null payload; a frame cut off at the end is not counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: kbit/s by (version 1 or not, layer) and index, samples a second by version, samples a frame.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
PAD, TAIL = 64, 64
#: Header, checksum and side information of our frames; kbit/s and bytes of main data that each size holds.
OVERHEAD = 4 + 2 + 17
SIZES = [(i, 9 * kbps // 2) for i, kbps in enumerate(BITRATES[True, 3]) if kbps]
ROOM = [size - OVERHEAD for _, size in SIZES]


def _crc_table() -> list[int]:
    table = []
    for high in range(256):
        value = high << 8
        for _ in range(8):
            value = (value << 1) ^ 0x8005 if value & 0x8000 else value << 1
        table.append(value & 0xFFFF)
    return table


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005 from 0xFFFF, most significant bit first."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[value >> 8 ^ byte]
    return value


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of one of our frames."""
    header = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 3 << 6])
    side = bytes(17)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


HEADS = [np.frombuffer(_frame_head(i), np.uint8) for i, _ in SIZES]


def _tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.3 tag with user text fields."""
    body = b"".join(b"TXXX" + struct.pack(">IH", len(x), 0) + x for x in (b"\0" + k.encode() + b"\0" + v.encode() for k, v in fields.items()))
    size = len(body)
    return b"ID3\x03\x00\x00" + bytes(size >> shift & 0x7F for shift in (21, 14, 7, 0)) + body


def wrap(payload: bytes) -> bytes:
    """The stored form of ``payload``."""
    whole, rest = divmod(len(payload), ROOM[-1])
    frames = np.zeros((whole, SIZES[-1][1]), np.uint8)
    frames[:, :OVERHEAD] = HEADS[-1]
    frames[:, OVERHEAD:] = np.frombuffer(payload, np.uint8, whole * ROOM[-1]).reshape(whole, ROOM[-1])
    sizes, last = [SIZES[-1][1]] * whole, b""
    if rest:
        k = next(i for i, room in enumerate(ROOM) if room >= rest)
        last = HEADS[k].tobytes() + payload[whole * ROOM[-1] :].ljust(ROOM[k], b"\0")
        sizes.append(SIZES[k][1])
    first = SIZES[0][1]
    ends = np.cumsum([first, *sizes])
    at = np.arange(100) * len(sizes) // 100
    toc = np.minimum(255, 256 * ends[at] // ends[-1]).astype(np.uint8).tobytes()
    table = HEADS[0].tobytes() + b"Xing" + struct.pack(">III", 0xF, len(sizes), int(ends[-1])) + toc + struct.pack(">I", 0)
    tag = _tag({"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))})
    return b"".join([tag, table.ljust(first, b"\0"), frames.tobytes(), last])


def parse_header(data: bytes, at: int) -> tuple[int, int, int, int, bool] | None:
    """(frame bytes, samples, samples a second, bytes of side information, is there a checksum) of a frame header."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(data[at + 1] >> 3 & 3)
    layer = 4 - (data[at + 1] >> 1 & 3)
    index, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    one, padding, mono = version == 1, data[at + 2] >> 1 & 1, data[at + 3] >> 6 == 3
    hertz, kbps, samples = RATES[version][rate], BITRATES[one, layer][index], SAMPLES[one, layer]
    size = (12 * kbps * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return size, samples, hertz, side, not data[at + 1] & 1


def parse_tag(data: bytes) -> tuple[int, dict[str, str]]:
    """(length of an ID3v2 tag at the start, its user text fields)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = sum((x & 0x7F) << shift for x, shift in zip(data[6:10], (21, 14, 7, 0), strict=True))
    fields, at, end = {}, 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at]:
        if data[3] >= 4:
            length = sum((x & 0x7F) << shift for x, shift in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        else:
            length = struct.unpack_from(">I", data, at + 4)[0]
        if data[at : at + 4] == b"TXXX":
            name, _, value = data[at + 11 : min(end, at + 10 + length)].partition(b"\0")
            fields[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + length
    return 10 + size, fields


def _xing(data: bytes) -> dict:
    """A table's fields, from its flags on; those that do not lie in the frame are left out."""
    flags, place, table = int.from_bytes(data[:4], "big"), 4, {"toc": b""}
    for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
        if flags & bit and place + size <= len(data):
            part = data[place : place + size]
            table[name] = part if name == "toc" else int.from_bytes(part, "big")
            place += size
    return table


def parse(data: bytes) -> dict:
    """What a stream holds; frames are found again after junk at the next header that another frame or the end follows."""
    at, fields = parse_tag(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    seek, parts, checked, failed, skipped, samples, hertz = [], [], 0, 0, 0, 0, 0
    table, first, synced, seen = None, True, True, {}
    while at < end:
        found = parse_header(data, at)
        size = found[0] if found else 0
        follows = found and at + size <= end and (synced or at + size == end or parse_header(data, at + size))
        if not follows:
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            skipped += nearest - at
            at, synced = nearest, False
            continue
        synced = True
        _, count, hertz, side, has_crc = found
        body = at + 4 + 2 * has_crc + side
        if has_crc and side:
            covered = data[at + 2 : at + 4] + data[at + 6 : body]
            if covered not in seen:
                seen[covered] = crc16(covered)
            checked += 1
            failed += seen[covered] != data[at + 4] << 8 | data[at + 5]
        if first and body + 8 <= at + size and data[body : body + 4] in (b"Xing", b"Info"):
            table = _xing(data[body + 4 : at + size])
        elif first and size >= 62 and data[at + 36 : at + 40] == b"VBRI":
            total, frames, entries, scale, width, each = struct.unpack_from(">IIHHHH", data, at + 46)
            steps = [data[p : p + width] for p in range(at + 62, min(at + 62 + entries * width, at + size), max(1, width))]
            table = {"frames": frames, "bytes": total, "toc": b"", "steps": [int.from_bytes(x, "big") * scale for x in steps], "frames_a_step": each}
        else:
            seek.append(at)
            samples += count
            parts.append(data[body : at + size])
        first = False
        at += size
    payload = None
    size = fields.get("payload_bytes", "")
    if size.isascii() and size.isdecimal() and len(size) < 19:
        payload = b"".join(parts)[: int(size)]
    sound = payload is not None and str(zlib.crc32(payload)) == fields.get("payload_crc32")
    return {"seek": seek, "samples": samples, "hertz": hertz, "checked": checked, "failed": failed, "skipped": skipped, "table": table, "payload": payload, "sound": sound}


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media``: each text's bytes, with zero bytes up to a positive multiple of 64, as an MPEG audio stream."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            data = b"" if (t := value.as_py()) is None else t.encode("utf-8", "surrogatepass")
            out.append(wrap(data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")))
        return pa.array(out, pa.binary())

    return df.withColumn(media, stored.asNondeterministic()(F.col(text)))


PARSED = "frames long, samples long, hertz long, crc_checked long, crc_failed long, skipped long, listed_frames long, listed_bytes long, seek array<long>, payload_bytes long, payload_sha256 string, tail_crc32 long, sound boolean"


def read_back(media: Column) -> Column:
    """What the streams in ``media`` hold: a struct of PARSED; ``seek`` are the byte offsets of the frames."""

    @F.arrow_udf(PARSED)
    def parsed(values: pa.Array) -> pa.Array:
        rows = []
        for value in values:
            x = parse(value.as_py() or b"")
            payload, table = x["payload"], x["table"] or {}
            rows.append((
                len(x["seek"]), x["samples"], x["hertz"], x["checked"], x["failed"], x["skipped"], table.get("frames"), table.get("bytes"), x["seek"],
                None if payload is None else len(payload),
                None if payload is None else hashlib.sha256(payload).hexdigest(),
                None if payload is None else zlib.crc32(payload[-TAIL:]), x["sound"],
            ))
        names = [part.split()[0] for part in PARSED.split(", ")]
        kinds = [pa.list_(pa.int64()) if n == "seek" else pa.string() if n == "payload_sha256" else pa.bool_() if n == "sound" else pa.int64() for n in names]
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return parsed.asNondeterministic()(media)


def digests(docs: DataFrame) -> DataFrame:
    """The stored form of every text, read back: digests, exact duration and a digest of the seek offsets."""
    held = store(docs.select("doc_id", "text")).withColumn("x", read_back(F.col("media")))
    return held.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("x.payload_bytes").alias("payload_bytes"),
        F.col("x.payload_sha256").alias("payload_sha256"),
        F.col("x.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.format_string("frames=%d/%d", "x.frames", "x.listed_frames"), F.format_string("duration=%d/%d", "x.samples", "x.hertz"),
            F.format_string("crc=%d/%d", F.col("x.crc_checked") - F.col("x.crc_failed"), F.col("x.crc_checked")),
            F.concat(F.lit("sound="), F.col("x.sound").cast("string")), F.format_string("seek=%d", F.crc32(F.array_join("x.seek", ",").cast("binary"))),
        ).alias("feature"),
        (F.col("x.samples") * 1000000 / F.col("x.hertz")).cast("long").alias("duration_us"),
    )
