"""Media columns in the Ogg container: pages with checksums, lacing values, several logical streams, granules."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from gridlake.llm.shared import chunks

PACKET = 4096  # samples in a packet
RATE = 8000  # samples a second
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_FIRST = struct.Struct("<4sBBIQ")  # name, version, channels, rate, samples


def page_checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion.

    It is the bit-reversed image of zlib's CRC over bit-reversed bytes."""
    c = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Writer:
    """One logical stream: packets go in, pages come out."""

    serial: int
    seq: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list = field(default_factory=list)
    granule: int = -1
    carried: bool = False

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Adds a packet; yields the pages that it fills. ``granule``: position at the packet's end."""
        at, n = 0, len(data)
        while True:
            room = 255 - len(self.lacing)
            full = min(room, (n - at) // 255)
            self.lacing += b"\xff" * full
            self.body.append(data[at : at + full * 255])
            at += full * 255
            if len(self.lacing) == 255:
                yield self.page(False)
                self.carried = True
                continue
            self.lacing.append(n - at)
            self.body.append(data[at:])
            self.granule = granule
            if len(self.lacing) == 255:
                yield self.page(False)
            return

    def page(self, last: bool) -> bytes:
        kind = (1 if self.carried else 0) | (2 if self.seq == 0 else 0) | (4 if last else 0)
        raw = bytearray(_HEAD.pack(b"OggS", 0, kind, self.granule, self.serial, self.seq, 0, len(self.lacing)))
        raw += self.lacing + b"".join(self.body)
        raw[22:26] = page_checksum(bytes(raw)).to_bytes(4, "little")
        self.seq, self.lacing, self.body, self.granule, self.carried = self.seq + 1, bytearray(), [], -1, False
        return bytes(raw)


def write(payload: bytes, notes: bytes = b"", packet: int = PACKET, rate: int = RATE) -> bytes:
    """An Ogg file with two logical streams: ``payload`` as 8-bit samples, and ``notes`` in one packet.

    Equal arguments give equal bytes. An empty payload gives a stream with its header only."""
    serial = zlib.crc32(payload)
    sound, text = Writer(serial), Writer(serial ^ 0x5A5A5A5A)
    out = list(sound.packet(_FIRST.pack(b"PCM8", 1, 1, rate, len(payload)), 0)) + [sound.page(False)]
    out += list(text.packet(_FIRST.pack(b"NOTE", 1, 0, rate, len(notes)), 0)) + [text.page(False)]
    middle = len(payload) // 2
    noted = False
    for at in range(0, len(payload), packet):
        if not noted and at >= middle:
            noted = True
            out += list(text.packet(notes, at)) + [text.page(True)]
        out += sound.packet(payload[at : at + packet], min(at + packet, len(payload)))
    if not noted:
        out += list(text.packet(notes, len(payload))) + [text.page(True)]
    return b"".join([*out, sound.page(True)])


@dataclass
class Stream:
    """A logical stream as read."""

    serial: int
    packets: list = field(default_factory=list)
    ends: list = field(default_factory=list)  # granule at the end of each page's last whole packet, and that packet's number
    seq: int = -1
    open: list = field(default_factory=list)
    closed: bool = False
    pages: int = 0

    @property
    def granule(self) -> int:
        return self.ends[-1][1] if self.ends else 0


def read(data: bytes) -> dict[int, Stream]:
    """Demultiplexes a file. ValueError for a broken checksum, a lost page or a cut packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("cut page header")
        magic, version, kind, granule, serial, seq, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("cut page")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of page {seq} of stream {serial}")
        if kind & 2:
            if serial in streams:
                raise ValueError("stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.closed or seq != s.seq + 1 or bool(kind & 1) != bool(s.open):
            raise ValueError(f"lost page before {seq} of stream {serial}")
        s.seq, s.pages, size, whole = seq, s.pages + 1, 0, False
        for v in lacing:
            size += v
            if v < 255:
                s.open.append(data[body : body + size])
                s.packets.append(s.open[0] if len(s.open) == 1 else b"".join(s.open))
                s.open = []
                body, size, whole = body + size, 0, True
        if size or (lacing and lacing[-1] == 255):
            s.open.append(data[body : body + size])
        if whole:
            s.ends.append((len(s.packets) - 1, granule))
        s.closed = bool(kind & 4)
        at = end
    for s in streams.values():
        if s.open or not s.closed:
            raise ValueError(f"stream {s.serial} doesn't end")
    return streams


def timestamps(s: Stream, rate: int = RATE) -> list[tuple[int, float]]:
    """(packet, seconds at its end) for the last packet that ends on each page."""
    return [(k, g / rate) for k, g in s.ends]


def samples(data: bytes) -> tuple[bytes, str]:
    """The sample stream's payload, read back, and a line of features."""
    streams = read(data)
    sound = next(s for s in streams.values() if s.packets[0][:4] == b"PCM8")
    _, _, channels, rate, n = _FIRST.unpack(sound.packets[0])
    payload = b"".join(sound.packets[1:])
    if len(payload) != n or sound.granule != n:
        raise ValueError("granule position and samples differ")
    x = np.frombuffer(payload, np.uint8)
    level = f"{x.sum(dtype=np.int64) / max(1, len(x)):.3f}" if len(x) else "0.000"
    peak = int(x.max()) if len(x) else 0
    last = timestamps(sound, rate)[-1][1]
    return payload, f"pcm8/{rate}x{channels} streams={len(streams)} pages={sum(s.pages for s in streams.values())} packets={len(sound.packets) - 1} seconds={last:.4f} mean={level} peak={peak}"


def ogg_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with ``out``: each text's UTF-8 bytes, padded as ``padded`` says, in an Ogg file. Null texts are empty."""
    schema = pa.schema([(out, pa.binary())])

    def run(batches):
        for rows, buf, offs in chunks(batches, text):
            raw = buf.tobytes()
            media = [write(padded(raw[a:b])) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(media, schema.field(0).type)], [*rows.schema.names, out])

    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the text stored in Ogg and read back from the stored bytes, as lengths, hashes and features.

    Null and empty texts store 64 bytes 0. A null key stays null; equal rows give equal results; other columns
    are not read. One row is in memory at a time beside its batch, whatever its length. A stored file that
    doesn't read back raises and fails the task."""
    src = df.select(df[key].alias("k"), df[text].alias("t"))
    schema = f"{key} {dict(df.dtypes)[key]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches):
        for rows, buf, offs in chunks(batches, "t"):
            raw, out = buf.tobytes(), []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                media = write(padded(raw[a:b]))
                back, feature = samples(media)
                out.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return src.mapInArrow(run, schema)
