"""Media columns: an Ogg container in a binary column.

Writer: a text's bytes become 8-bit mono samples, 576 to a packet, in one logical stream; a second logical
stream carries the unpadded length. Their pages are multiplexed. Reader: every page's checksum is verified,
packets are reassembled from lacing values (also over page borders), the logical streams are demultiplexed by
serial number, and each packet's time comes from the granule positions. Nothing in the container depends on
the row, so equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0 and without a final inversion.

    zlib's is the mirrored form of the same polynomial, so bytes are mirrored on the way in and the sum on the
    way out; both run in C.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + page_checksum(whole).to_bytes(4, "little") + whole[26:]


def _lace(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream. packets: (bytes, granule position at the packet's end). A page holds 255
    lacing values; a longer packet goes on in the next page."""
    lacing, body, ends = bytearray(), bytearray(), []
    for packet, granule in packets:
        lacing += _lace(packet)
        body += packet
        ends.append((len(lacing), granule))
    at = number = done = 0
    begun = False  # whether the page starts inside a packet
    k = 0
    while done < len(lacing) or not number:
        part = bytes(lacing[done : done + 255])
        size = sum(part)
        granule = -1
        while k < len(ends) and ends[k][0] <= done + len(part):
            granule = ends[k][1]
            k += 1
        last = done + len(part) >= len(lacing)
        yield _page(serial, number, granule, begun | 2 * (number == 0) | 4 * last, part, bytes(body[at : at + size]))
        at, done, number = at + size, done + len(part), number + 1
        begun = part[-1:] == b"\xff"


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """Two multiplexed logical streams: samples (a header packet, then 576 samples a packet) and notes."""
    serial = zlib.crc32(payload)
    head = b"\x01PCM8" + struct.pack("<IHH", RATE, 1, FRAME)
    sound = list(stream_pages(serial, [(head, 0)])), [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    first, note = sound[0][0], (serial ^ 0x5A5A5A5A)
    # The header has a page to itself, as mappings ask for; it isn't the stream's last.
    first = _page(serial, 0, 0, 2, _lace(head), head)
    pages = [first, *stream_pages(note, [(b"\x01NOTE" + struct.pack("<Q", n_bytes), len(payload))])]
    for page in stream_pages(serial, sound[1]):
        flags, granule, number, n = page[5] & ~2, int.from_bytes(page[6:14], "little", signed=True), int.from_bytes(page[18:22], "little"), page[26]
        pages.append(_page(serial, number + 1, granule, flags, page[27 : 27 + n], page[27 + n :]))
    return b"".join(pages)


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at each packet's end; -1 where no page says it.
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    _open: bytearray | None = None
    _number: int = 0


class OggError(ValueError):
    """The bytes aren't a whole, sound Ogg file."""


def read_ogg(data: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number. Raises OggError on a bad checksum, a gap in page numbers or a torn packet."""
    streams: dict[int, LogicalStream] = {}
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError(f"torn page at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or end > len(data):
            raise OggError(f"no whole page at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"bad checksum at byte {at}")
        if bool(flags & 2) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, LogicalStream())
        if number != s._number or bool(flags & 1) != (s._open is not None) or s.ended:
            raise OggError(f"page {number} of stream {serial} is out of order")
        s._number += 1
        s.ended = bool(flags & 4)
        at += 27 + n
        size, closed = 0, 0
        for x in lacing:
            size += x
            if x < 255:
                piece = bytes(view[at : at + size])
                s.packets.append(bytes(s._open) + piece if s._open is not None else piece)
                s.granules.append(-1)
                s._open, size, at, closed = None, 0, at + size, closed + 1
        if lacing and lacing[-1] == 255:
            s._open = (s._open if s._open is not None else bytearray()) + view[at : at + size]
            at += size
        if closed:
            s.granules[-1] = granule
    if any(s._open is not None or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def packet_times(stream: LogicalStream, rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Start of each sample packet in ms. A page tells the end of its last packet; the ones before count back."""
    ends = np.array(stream.granules[1:], dtype=np.int64)
    known = np.flatnonzero(ends >= 0)
    nearest = known[np.searchsorted(known, np.arange(len(ends)))]
    return (ends[nearest] - (nearest - np.arange(len(ends)) + 1) * frame) * 1000 // rate


def features(samples: np.ndarray, last_ms: int) -> str:
    """Digits from exact integer sums: duration, mean, root mean square, sign changes around 128, peak."""
    n, counts = len(samples), np.bincount(samples, minlength=256)
    v = np.arange(256, dtype=np.int64) - 128
    square = int(counts @ (v * v)) // n
    changes = int(np.count_nonzero((samples[1:] ^ samples[:-1]) & 128))
    peak = int(np.abs(v[counts > 0]).max())
    return f"samples={n};last_packet_ms={last_ms};mean_milli={int(counts @ v) * 1000 // n};mean_square={square};sign_changes={changes};peak={peak}"


def text_media(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)
    media = write_ogg(payload, len(raw))
    streams = read_ogg(media)
    sound = next(s for s in streams.values() if s.packets[0].startswith(b"\x01PCM8"))
    notes = next(s for s in streams.values() if s.packets[0].startswith(b"\x01NOTE"))
    back = b"".join(sound.packets[1:])
    times = packet_times(sound)
    return (
        struct.unpack("<Q", notes.packets[0][5:])[0],
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-32:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        features(np.frombuffer(back, dtype=np.uint8), int(times[-1])),
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = [text_media(t.as_py()) for t in b.column(1)]
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names)


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as Ogg, read it back, and describe both. One row per row, also for null (empty) texts,
    repeated rows and null ids; an empty table gives none; other columns are not read. Map only, no shuffle."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_digest, SCHEMA)


def media_column(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with the Ogg bytes of a text column in a binary column."""

    @F.pandas_udf("binary")
    def stored(s):  # noqa: ANN001, ANN202
        raws = [(x or "").encode("utf-8", "surrogatepass") for x in s]
        import pandas as pd

        return pd.Series([write_ogg(r + b"\xff" * (-len(r) % FRAME if r else FRAME), len(r)) for r in raws])

    return docs.withColumn(into, stored(F.col(f"`{text}`")))
