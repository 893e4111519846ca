"""Ogg media columns: payloads written to and read from Ogg pages.

A payload of 8-bit samples is cut into packets of PACKET samples, dealt in turn to STREAMS logical streams whose pages
alternate in the file. Pages follow RFC 3533: a 27-byte header with serial number, page number, granule
position and checksum, the lacing values, and the packet bytes; a packet may run over several pages. Each stream begins with a
page of its own that holds its header packet: its place among the streams, the number of streams, the rate, the samples of a packet
and of the whole payload. These pages come first in the file. A stream's granule position is the number of samples of the
whole payload up to the end of the last packet that the page completes, so that it dates a packet among all streams; over the
rate it gives the timestamp.

Reading verifies each page's checksum and number, joins packets from lacing values by stream, dates the packets that a page completes
from its granule position and the header, and merges the streams in that order. It knows nothing of the writer's constants. Every
stream must begin and end with the pages marked so, all streams that the headers tell of must be there, and the packets must
follow one another without gaps up to the payload's length.

Defined results: null and empty texts become one block of 64 zero bytes; rows that repeat a doc_id, or have none, are stored one
by one; equal texts give equal media; an empty table gives an empty table; columns besides doc_id and text are ignored; a page
that is cut short, missing, out of order or fails its checksum raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PACKET, STREAMS, RATE, BLOCK = 4080, 2, 8000, 64
PAGE_SEGMENTS = 48  # lacing values a page; a page may hold up to 255
FIRST, LAST, CONTINUED = 2, 4, 1

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
#: A stream's header packet: magic, place among the streams, streams, rate, samples of a packet, samples in all.
MAGIC, _IDENTITY = b"PCM8", struct.Struct("<4sBBIIQ")


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04C11DB7 from the highest bit on, from 0. zlib's CRC is the same with all bits reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    stream: int
    granule: int
    seconds: float
    data: bytes


def _page(kind: int, granule: int, serial: int, number: int, parts: list[bytes]) -> bytes:
    bare = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(parts)) + bytes(map(len, parts)) + b"".join(parts)
    return bare[:22] + struct.pack("<I", checksum(bare)) + bare[26:]


def _stream_pages(serial: int, header: bytes, packets: list[tuple[int, bytes]]) -> list[bytes]:
    """The pages of one stream, from its header and its packets with their granule positions."""
    lacing: list[tuple[bytes, int]] = []  # bytes, granule of a packet that ends here or -1
    for granule, data in packets:
        for at in range(0, len(data) + 1, 255):
            part = data[at : at + 255]
            lacing.append((part, granule if len(part) < 255 else -1))
    pages = [_page(FIRST, 0, serial, 0, [header])]
    for at in range(0, len(lacing), PAGE_SEGMENTS):
        own = lacing[at : at + PAGE_SEGMENTS]
        kind = CONTINUED * (at > 0 and lacing[at - 1][1] < 0) | LAST * (at + PAGE_SEGMENTS >= len(lacing))
        pages.append(_page(kind, max(g for _, g in own), serial, len(pages), [part for part, _ in own]))
    return pages


def write_ogg(payload: bytes) -> bytes:
    cut = [payload[at : at + PACKET] for at in range(0, len(payload), PACKET)]
    n = min(STREAMS, len(cut))
    ends = np.cumsum([len(c) for c in cut]).tolist()
    pages = [
        _stream_pages(1 + k, _IDENTITY.pack(MAGIC, k, n, RATE, PACKET, len(payload)), list(zip(ends[k::n], cut[k::n])))
        for k in range(n)
    ]
    return b"".join(own[i] for i in range(max(map(len, pages))) for own in pages if i < len(own))


def _pages(media: bytes) -> Iterator[tuple[int, int, int, int, list[bytes]]]:
    """kind, granule, serial, number and parts of each page, verified by itself."""
    at = 0
    while at < len(media):
        if len(media) < at + _HEADER.size:
            raise ValueError("a page is cut short")
        magic, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError("no whole page here")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("a page fails its checksum")
        edges = np.cumsum([at + 27 + n, *lacing]).tolist()
        yield kind, granule, serial, number, [media[x:y] for x, y in zip(edges, edges[1:])]
        at = end


def read_ogg(media: bytes) -> tuple[list[Packet], int]:
    """All packets in the order of their granule positions, and the number of pages."""
    headers: dict[int, tuple[int, ...]] = {}
    numbers: dict[int, int] = {}
    partial: dict[int, list[bytes]] = {}
    ended: set[int] = set()
    packets: list[Packet] = []
    pages = 0
    for kind, granule, serial, number, parts in _pages(media):
        pages += 1
        if number != numbers.get(serial, -1) + 1 or bool(kind & FIRST) != (serial not in numbers) or bool(kind & CONTINUED) != bool(partial.get(serial)) or serial in ended:
            raise ValueError("a page is missing or out of order")
        numbers[serial] = number
        if kind & FIRST:
            if len(parts) != 1 or len(parts[0]) != _IDENTITY.size or parts[0][:4] != MAGIC or packets or any(partial.values()):
                raise ValueError("a stream begins without its header")
            headers[serial] = _IDENTITY.unpack(parts[0])[1:]
            continue
        done = []
        for part in parts:
            partial.setdefault(serial, []).append(part)
            if len(part) < 255:
                done.append(b"".join(partial.pop(serial)))
        _, n, rate, samples, _ = headers[serial]
        dated = granule  # of the last packet that the page completes; the one before it ended one packet of each other stream and this one earlier
        for data in reversed(done):
            packets.append(Packet(serial, dated, dated / rate, data))
            dated -= len(data) + (n - 1) * samples
        if kind & LAST:
            ended.add(serial)
    places, rest = sorted(h[0] for h in headers.values()), {h[1:] for h in headers.values()}
    if len(rest) != 1 or places != list(range(next(iter(rest))[0])) or ended != set(headers) or any(partial.values()):
        raise ValueError("a stream is missing or cut short")
    packets.sort(key=lambda p: p.granule)
    ends = np.cumsum([0, *(len(p.data) for p in packets)]).tolist()
    if [p.granule for p in packets] != ends[1:] or ends[-1] != next(iter(rest))[-1]:
        raise ValueError("the packets leave gaps")
    return packets, pages


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + bytes((-len(data)) % BLOCK or (BLOCK if not data else 0))


def feature(packets: list[Packet], pages: int) -> str:
    samples = np.frombuffer(b"".join(p.data for p in packets), np.uint8)
    centred = samples - samples.mean()
    crossings = int((np.diff(np.signbit(centred)) != 0).sum())
    loud = float(np.sqrt((centred * centred).mean()))
    streams = len({p.stream for p in packets})
    return f"streams={streams};pages={pages};packets={len(packets)};seconds={packets[-1].seconds:.3f};mean={samples.mean():.3f};rms={loud:.3f};crossings={crossings}"


def ogg_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each text as Ogg, reads it back and describes what was read; keep_media adds the stored bytes as `media`."""

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media

    def stored(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            rows = []
            for text in texts:
                payload = payload_of(text)
                media = write_ogg(payload)
                packets, pages = read_ogg(media)
                read = b"".join(p.data for p in packets)
                row = (
                    len((text or "").encode("utf-8")),
                    len(read),
                    hashlib.sha256(read).hexdigest(),
                    zlib.crc32(read[-BLOCK:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature(packets, pages),
                )
                rows.append(row + (media,) * keep_media)
            yield pd.DataFrame(rows, columns=names)

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    store = F.pandas_udf(stored, schema + ", media binary" * keep_media)
    return docs.select("doc_id", store("text").alias("_stored")).select("doc_id", "_stored.*")
