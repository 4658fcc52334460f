"""MPEG audio as a media column: write payloads into frames, parse any stream of frames.

``parse`` reads bytes that may begin with ID3v2 tags and junk, end with an ID3v1 tag, and be broken in between. It finds
frame headers anew after damage (a header counts if the next one follows it, or the audio ends there), reads the
Xing/Info or VBRI table of variable-bitrate files, verifies the CRC-16 of protected frames, and gives the exact duration
as samples over rate with the byte offset of every frame, so a seek needs no scan.

``frames_of`` stores bytes losslessly: protected mono layer III frames of silence whose ancillary bytes, which decoders
skip, hold the payload; the bitrate of each frame follows what is left to store. An empty ID3v1 tag ends the stream, so
that no payload is taken for one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import tidy

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index.
RATES_1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
HERTZ = (44100, 48000, 32000)

#: The writer's frames: MPEG 1, layer III, 48 kHz, mono, where a frame of b kbit/s has 3 b bytes.
WRITER_RATE, SIDE, HEAD = 48000, 17, 4 + 2 + 17
LAST = b"TAG".ljust(128, b"\x00")
STEPS = [(3 * kbps - HEAD, index) for index, kbps in enumerate(RATES_1[3]) if kbps]


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes of layer III side information


@lru_cache(4096)
def header(word: int) -> Header | None:
    """The frame header in these 32 bits, or None. Free-format and reserved values give None."""
    if word >> 21 != 0x7FF:
        return None
    version = {3: 1, 2: 2, 0: 25}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    index, hertz = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or index in (0, 15) or hertz == 3 or word & 3 == 2:
        return None
    kbps = (RATES_1 if version == 1 else RATES_2)[layer][index]
    rate = HERTZ[hertz] // {1: 1, 2: 2, 25: 4}[version]
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    if layer == 1:
        size, samples = (12_000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * 1000 * kbps // rate + pad
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 1 else (9 if mono else 17))
    return Header(version, layer, not word >> 16 & 1, kbps, rate, 1 if mono else 2, size, samples, side)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The standard's CRC-16: polynomial 0x8005, highest bit first."""
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC_TABLE[value >> 8 ^ byte]
    return value


@lru_cache(1)
def _crc_places(block: int = 256) -> np.ndarray:
    """(block, 256): the CRC-16 of a byte at each place of a block of zeros, from 0."""
    table = np.array(CRC_TABLE, np.uint16)
    rows = [table]
    while len(rows) < block:
        rows.append((rows[-1] << np.uint16(8)) ^ table[rows[-1] >> np.uint16(8)])
    return np.stack(rows[::-1])


def audio_crc(data: bytes) -> int:
    """``crc16(data, 0)`` of long data: the bytes of a block add up by exclusive or, a block's register is added to the next one's first bytes."""
    places = _crc_places()
    block = len(places)
    data = bytes(-len(data) % block) + data  # zeros in front change nothing
    first, second, value = places[0].tolist(), places[1].tolist(), 0
    for at in range(0, len(data), block << 10):
        part = np.frombuffer(data[at : at + (block << 10)], np.uint8).reshape(-1, block)
        for own in np.bitwise_xor.reduce(places[np.arange(block), part], axis=1).tolist():
            value = own ^ first[value >> 8] ^ second[value & 255]
    return value


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _to_synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def tag_bytes(fields: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of user-defined text fields."""
    body = b""
    for name, value in fields.items():
        text = b"\x03" + name.encode() + b"\x00" + value.encode()
        body += b"TXXX" + _to_synchsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _to_synchsafe(len(body)) + body


def _read_tag(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Text fields of the ID3v2 tag at a place, and where it ends."""
    major, end = data[at + 3], min(len(data), at + 10 + _synchsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0))
    fields, at = {}, at + 10
    width = 3 if major == 2 else 4
    while at + width * 2 + (0 if major == 2 else 2) <= end and data[at : at + width].isalnum():
        name = data[at : at + width].decode("latin-1")
        raw = data[at + width : at + 2 * width]
        size = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        start = at + 2 * width + (0 if major == 2 else 2)
        if size <= 0 or start + size > end:
            break
        if name[0] == "T":
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[start], "latin-1")
            parts = data[start + 1 : start + size].decode(code, "replace").split("\x00")
            if name in ("TXXX", "TXX") and len(parts) > 1:
                fields[parts[0]] = parts[1]
            else:
                fields[name] = parts[0]
        at = start + size
    return fields, end


@dataclass
class Stream:
    """What a stream holds; ``offsets`` and ``sizes`` are of its audio frames, without the table's frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str = "none"  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    table_ok: bool | None = None  # its counts are right and so is its own checksum, if it has one
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unread: int = 0  # layer II, whose protected span depends on its allocation
    skipped: int = 0  # bytes that belong to no frame or tag
    samples: int = 0
    audio_bytes: int = 0

    @property
    def rate(self) -> int:
        return self.heads[0].rate if self.heads else 0

    def seek(self, sample: int) -> int | None:
        """Byte offset of the frame that holds a sample."""
        ends = np.cumsum([h.samples for h in self.heads])
        at = int(np.searchsorted(ends, sample, "right"))
        return self.offsets[at] if at < len(self.offsets) else None


def _alike(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Whether the frame holds a variable-bitrate table; its counts go to ``out``."""
    for spot in (at + 4 + head.side, at + 6 + head.side):
        mark = data[spot : spot + 4]
        if mark in (b"Xing", b"Info"):
            out.table, flags, spot = mark.decode(), _word(data, spot + 4), spot + 8
            if flags & 1:
                out.table_frames, spot = _word(data, spot), spot + 4
            if flags & 2:
                out.table_bytes, spot = _word(data, spot), spot + 4
            spot += 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
            if flags == 15 and spot + 36 <= at + head.size and data[spot : spot + 4].isalnum():
                out.table_ok = crc16(data[at : spot + 34], 0) == int.from_bytes(data[spot + 34 : spot + 36], "big")
            return True
    spot = at + 36
    if data[spot : spot + 4] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", _word(data, spot + 10), _word(data, spot + 14)
        return True
    return False


def parse(data: bytes | None) -> Stream:
    """Parse a stream. Null, empty and foreign bytes give a stream without frames."""
    data = data or b""
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        fields, at = _read_tag(data, at)
        out.tags |= fields
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + a : end + b].rstrip(b"\x00 ").decode("latin-1"):
                out.tags.setdefault(name, text)
    first, last, begun = True, None, at
    while at < end:
        head = header(_word(data, at))
        stop = at + head.size if head else 0
        if head and stop <= end and (last is None or _alike(head, last)):
            after = header(_word(data, stop)) if stop < end else head
            known = stop >= end or (after is not None and _alike(after, head))
            if known or last is not None:
                if first and _table(data, at, head, out):
                    begun = stop
                else:
                    out.offsets.append(at)
                    out.sizes.append(head.size)
                    out.heads.append(head)
                    out.samples += head.samples
                    if head.protected:
                        if head.layer == 2:
                            out.crc_unread += 1
                        else:
                            span = head.side if head.layer == 3 else 16 * head.channels
                            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + span]) == int.from_bytes(data[at + 4 : at + 6], "big")
                            out.crc_ok += good
                            out.crc_bad += not good
                first, last = False, head
                if known:
                    at = stop
                    continue
                at = stop  # the next header is damaged: look for it from here
                last = None if header(_word(data, at)) is None else last
                continue
        found = data.find(b"\xff", at + 1, end)
        new = found if found >= 0 else end
        out.skipped += new - at
        at, last = new, None
    out.audio_bytes = sum(out.sizes)
    if out.table_frames is not None:
        right = out.table_frames in (len(out.offsets), len(out.offsets) + 1)
        out.table_ok = right and out.table_ok is not False
    return out


def frames_of(payload: bytes, fields: dict[str, str]) -> bytes:
    """The payload as an MP3 stream: tag, Xing frame with seek table, frames, empty tag."""
    largest, top = STEPS[-1]
    cuts = list(range(0, len(payload), largest)) or [0]
    frames = []
    for cut in cuts:
        part = payload[cut : cut + largest]
        room, index = next(s for s in STEPS if s[0] >= len(part)) if len(part) < largest else (largest, top)
        word = struct.pack(">I", 0xFFFA0000 | index << 12 | 1 << 10 | 3 << 6)
        frames.append(word + struct.pack(">H", crc16(word[2:] + bytes(SIDE))) + bytes(SIDE) + part.ljust(room, b"\x00"))
    audio = b"".join(frames)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    toc = bytes(int(256 * starts[len(frames) * i // 100] // len(audio)) for i in range(100))
    lead = struct.pack(">I", 0xFFFB0000 | 5 << 12 | 1 << 10 | 3 << 6)  # 64 kbit/s, 192 bytes, no CRC
    lead += bytes(SIDE) + b"Xing" + struct.pack(">III", 15, len(frames), len(audio) + 192) + toc + struct.pack(">I", 100)
    lead += b"TPHR0.1  ".ljust(28, b"\x00") + struct.pack(">IH", len(audio) + 192, audio_crc(audio))
    lead += struct.pack(">H", crc16(lead, 0))
    return tag_bytes(fields) + lead.ljust(192, b"\x00") + audio + LAST


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes of the writer's frames, as long as its tag says."""
    body = b"".join(data[o + HEAD : o + s] for o, s in zip(stream.offsets, stream.sizes, strict=True))
    return body[: int(stream.tags["payload_bytes"])]


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """(id, media): each text as UTF-8, filled with bytes 0 to a positive multiple of ``unit``, as an MP3 stream.

    Null is stored as empty. Equal texts give equal bytes. Rows may repeat; an empty table gives no rows.
    """

    @tidy
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media = []
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                padded = raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\x00")
                media.append(frames_of(padded, {"n_bytes": str(len(raw)), "payload_bytes": str(len(padded))}))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "media": media})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(write, f"doc_id {kind}, media binary")


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, samples long, sample_rate int, seek_offsets array<int>"


def read_media(stored: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Parse a media column of stored texts: payload digests, checksums, exact duration and frame offsets.

    Media of another writer, damaged past the writer's tag or without frames, have null payload columns; null media have
    only nulls, no frames and the feature 'none'. Rows may repeat; an empty table gives no rows.
    """
    kinds = dict(stored.dtypes)

    @tidy
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for media in batch["media"]:
                if media is None:
                    out.append((None, None, None, None, None, None, "none", 0, 0, 0, []))
                    continue
                media = bytes(media)
                s = parse(media)
                whole = hashlib.sha256(media).hexdigest()
                if not s.heads:
                    out.append((None, None, None, None, len(media), whole, f"no frames skipped={s.skipped}", 0, 0, 0, []))
                    continue
                known = all(str(s.tags.get(k, "")).isdigit() for k in ("n_bytes", "payload_bytes"))
                payload = payload_of(media, s) if known else b""
                kbps = [h.kbps for h in s.heads]
                feature = f"mpeg1-layer3 {s.rate}Hz {s.heads[0].channels}ch frames={len(kbps)} samples={s.samples} kbps={min(kbps)}-{max(kbps)} table={s.table}:{'ok' if s.table_ok else 'bad'} crc={s.crc_ok}/{s.crc_ok + s.crc_bad} skipped={s.skipped}"
                stored_as = (int(s.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if known else (None,) * 4
                out.append((*stored_as, len(media), whole, feature, len(kbps), s.samples, s.rate, s.offsets))
            names = [x.split()[0] for x in READ.split(", ")]
            found = pd.DataFrame(out, columns=names)
            for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes"):
                found[c] = found[c].astype("Int64")
            yield pd.concat([batch[list(keep)].reset_index(drop=True), found], axis=1)

    return stored.mapInPandas(read, ", ".join([*(f"{k} {kinds[k]}" for k in keep), READ]))


def streams(media: DataFrame, *, id_col: str, media_col: str = "media") -> DataFrame:
    """Parse any column of MPEG audio: a row per stream with tags, table, checksums, duration and offsets. Null media: no frames."""

    @tidy
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data in zip(batch["id"], batch["media"], strict=True):
                s = parse(None if data is None else bytes(data))
                out.append((key, s.tags, s.table, s.table_ok, len(s.offsets), s.samples, s.rate, s.samples / s.rate if s.rate else 0.0, s.crc_ok, s.crc_bad, s.crc_unread, s.skipped, s.offsets))
            yield pd.DataFrame(out, columns=["id", "tags", "vbr_table", "table_ok", "n_frames", "samples", "sample_rate", "seconds", "crc_ok", "crc_bad", "crc_unread", "skipped", "offsets"])

    kind = dict(media.dtypes)[id_col]
    schema = f"id {kind}, tags map<string,string>, vbr_table string, table_ok boolean, n_frames int, samples long, sample_rate int, seconds double, crc_ok int, crc_bad int, crc_unread int, skipped long, offsets array<int>"
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInPandas(read, schema)
