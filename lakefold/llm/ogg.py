"""Media columns in Ogg containers.

`mux` writes two logical streams into one physical stream: the samples, and a log with one entry a packet of samples.
`demux` reads any physical stream of such pages: it verifies each page's checksum, puts packets together from the lacing
values over page ends, separates logical streams by serial number and checks page order. `packet_times` derives the start
and end of every packet from the granule positions of pages: the last packet that ends on a page ends at its granule, and
those before it by their lengths backwards. Both work on bytes, and `store` and `features` apply them to a column.

Defined results: a null text is empty; an empty text is stored as one unit of padding. Equal texts give equal bytes, as
serial numbers come from the payload alone. A damaged, reordered or cut stream raises OggError in `demux`; in `features` its
row, like that of null media, has nulls and the reason in `error`, which is null otherwise. Texts of any length are stored
whole, in as many pages as they need. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

UNIT = 192
RATE = 8000
PACKET = 4096
# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
SEGMENTS = 255

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0 and without a final inversion.

    zlib has the mirrored form: bits are mirrored on the way in and out, and its two inversions are undone."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(length: int) -> bytes:
    """255 for each full segment and then the rest, which may be 0."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def paged(serial: int, packets: list[tuple[bytes, int]], first: bool = True) -> list[bytes]:
    """Pages of one logical stream. Each packet comes with the granule position that holds at its end."""
    segments: list[tuple[bytes, int, bool]] = []  # bytes, granule if a packet ends here else -1, starts a packet
    for data, granule in packets:
        sizes = lacing(len(data))
        at = 0
        for k, n in enumerate(sizes):
            segments.append((data[at : at + n], granule if k == len(sizes) - 1 else -1, k == 0))
            at += n
    runs, begin = [], 0
    while begin < len(segments):
        # The head packet has a page to itself, as decoders expect.
        end = begin + 1 if first and begin == 0 else min(begin + SEGMENTS, len(segments))
        while first and begin == 0 and segments[end - 1][1] < 0:
            end += 1
        runs.append(segments[begin:end])
        begin = end
    pages = []
    for number, run in enumerate(runs):
        ends = [g for _, g, _ in run if g >= 0]
        flags = (0 if run[0][2] else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if number == len(runs) - 1 else 0)
        head = HEADER.pack(CAPTURE, 0, flags, ends[-1] if ends else -1, serial, number, 0, len(run)) + bytes(len(s) for s, _, _ in run)
        body = head + b"".join(s for s, _, _ in run)
        pages.append(body[:22] + struct.pack("<I", checksum(body)) + body[26:])
    return pages


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """Samples of one byte each in packets of PACKET, and beside them a log of (first sample, samples, crc32)."""
    serial = zlib.crc32(payload)
    samples: list[tuple[bytes, int]] = [(b"SAMPLES8" + struct.pack("<IBQ", rate, 1, len(payload)), 0)]
    log: list[tuple[bytes, int]] = [(b"SAMPLELG" + struct.pack("<I", PACKET), 0)]
    for at in range(0, len(payload), PACKET):
        packet = payload[at : at + PACKET]
        samples.append((packet, at + len(packet)))
        log.append((struct.pack("<QII", at, len(packet), zlib.crc32(packet)), at + len(packet)))
    a, b = paged(serial, samples), paged(serial ^ 0xFFFFFFFF, log)
    # Head pages come first, then the rest by time.
    rest = sorted([(struct.unpack_from("<q", p, 6)[0] % (1 << 63), k, n, p) for k, s in enumerate((a, b)) for n, p in enumerate(s) if n], key=lambda x: (x[1], x[2]))
    merged, times = [], {0: 0, 1: 0}
    for granule, k, n, page in rest:  # a page without a packet's end keeps the time of the page before it
        times[k] = max(times[k], granule) if granule != (1 << 63) - 1 else times[k]
        merged.append((times[k], k, n, page))
    return a[0] + b[0] + b"".join(p for _, _, _, p in sorted(merged, key=lambda x: x[:3]))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1 for a packet that isn't the last to end on its page
    pages: int = 0
    ended: bool = False
    partial: bytearray | None = None


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of appearance."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"cut page head at byte {at}")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        sizes = data[at + HEADER.size : at + HEADER.size + count]
        end = at + HEADER.size + count + sum(sizes)
        if len(sizes) < count or end > len(data):
            raise OggError(f"cut page at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial:08x} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended:
            raise OggError(f"stream {serial:08x} lacks page {s.pages}")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise OggError(f"stream {serial:08x}: page {number} continues no packet")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        place, done = at + HEADER.size + count, len(s.packets)
        for n in sizes:
            s.partial = s.partial if s.partial is not None else bytearray()
            s.partial += data[place : place + n]
            place += n
            if n < 255:
                s.packets.append(bytes(s.partial))
                s.granules.append(-1)
                s.partial = None
        if len(s.packets) > done:
            s.granules[-1] = granule
        at = end
    for serial, s in streams.items():
        if not s.ended or s.partial is not None:
            raise OggError(f"stream {serial:08x} has no end")
    return streams


def packet_times(s: Stream, samples: Callable[[bytes], int]) -> list[tuple[int, int]]:
    """Start and end of each packet in samples; the head packet takes no time. `samples` gives a packet's length.

    Pages must not overlap: a page's first packet starts no earlier than the last packet before it ends."""
    out, end = [(0, 0)], None
    held: list[int] = []
    for packet, granule in zip(s.packets[1:], s.granules[1:], strict=True):
        held.append(samples(packet))
        if granule < 0:
            continue
        begin = granule - sum(held)
        if begin < (end if end is not None else 0):
            raise OggError("granule positions go back")
        for n in held:
            out.append((begin, begin + n))
            begin += n
        held, end = [], granule
    if held:
        raise OggError("a packet has no granule position")
    return out


def read_samples(data: bytes) -> tuple[bytes, dict]:
    """The payload that mux stored and what the container says of it."""
    streams = demux(data)
    by_kind = {s.packets[0][:8]: s for s in streams.values() if s.packets}
    if set(by_kind) != {b"SAMPLES8", b"SAMPLELG"} or len(streams) != 2:
        raise OggError("not a sample stream and its log")
    samples, log = by_kind[b"SAMPLES8"], by_kind[b"SAMPLELG"]
    rate, channels, total = struct.unpack_from("<IBQ", samples.packets[0], 8)
    payload = b"".join(samples.packets[1:])
    times = packet_times(samples, lambda p: len(p) // channels)
    logged = packet_times(log, lambda p: struct.unpack("<QII", p)[1])
    if len(samples.packets) != len(log.packets):
        raise OggError("the log doesn't match the samples")
    for packet, entry, time, beside in zip(samples.packets[1:], log.packets[1:], times[1:], logged[1:]):
        first, length, crc = struct.unpack("<QII", entry)
        if (len(packet), zlib.crc32(packet), time) != (length, crc, beside) or first != time[0]:
            raise OggError("the log doesn't match the samples")
    if len(payload) != total or times[-1][1] - times[min(1, len(times) - 1)][0] != total // channels:
        raise OggError("granule position and samples differ")
    ms = (times[-1][1] - times[min(1, len(times) - 1)][0]) * 1000 // rate
    return payload, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(samples.packets), "ms": ms, "granule": times[-1][1], "last": times[-1][0] * 1000 // rate}


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def feature_of(payload: bytes, facts: dict) -> str:
    """Loudness and zero crossings of the samples around their middle value, with the container's facts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    energy = int(np.dot(x.astype(np.int64), x)) // len(x)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};ms={facts['ms']};last={facts['last']};granule={facts['granule']};energy={energy};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the Ogg bytes of every whole text."""

    def over(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for at in range(0, len(texts), 64):
            part = [padded(t) for t in texts[at : at + 64]]
            yield {"doc_id": ids[at : at + 64], "n_bytes": pa.array([n for _, n in part], pa.int64()), "media": pa.array([mux(p) for p, _ in part], pa.binary())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back: payload and digests of payload and container, a feature string, and what was wrong."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("no media",)
        size, digest = len(data), hashlib.sha256(data).hexdigest()
        try:
            payload, facts = read_samples(data)
        except (OggError, struct.error) as e:
            return (None, None, None, size, digest, None, str(e))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, feature_of(payload, facts), None

    def over(batch):
        columns = list(zip(*map(row, batch.column("media").to_pylist()))) or [()] * len(names)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}

    return arrow_map(media.select("doc_id", "n_bytes", "media"), over, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
