"""MPEG transport streams as columns: writing payloads into them, and reading them back packet by packet."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_texts, saved, table, text_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0, 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
#: Bytes of an access unit, ticks of the 90 kHz clock between two, and every how many one is a random-access point.
UNIT, TICKS, RANDOM_ACCESS = 3072, 3600, 8
ALIGN = 192


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


#: One program, whose map names one stream of private data.
TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
)


def _time(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | t >> 29 & 0xE | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream: program tables, then an elementary packet with a timestamp for each access unit."""
    out, cc = [TABLES], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit, t = payload[at : at + UNIT], i * TICKS & 0x1FFFFFFFF
        pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(2, t) + unit
        field_ = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big") if i % RANDOM_ACCESS == 0 else b""
        start, first = 0, 0x40
        while start < len(pes):
            room = 184 - (len(field_) + 1 if field_ else 0)
            left = len(pes) - start
            adapt = bytes([len(field_)]) + field_ if field_ else b""
            if left < room:
                stuff = room - left
                if not adapt:
                    adapt, stuff = (b"\0", 0) if stuff == 1 else (b"\0\0", stuff - 2)
                adapt = bytes([len(adapt) - 1 + stuff]) + adapt[1:] + b"\xff" * stuff
            take = 184 - len(adapt)
            out.append(bytes([SYNC, first | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adapt else 0x10) | cc]) + adapt + pes[start : start + take])
            start, first, field_, cc = start + take, 0, b"", cc + 1 & 15
    return b"".join(out)


@dataclass
class ElementaryPacket:
    """A reassembled packet; ``complete`` is false where packets are missing or its length isn't as declared."""

    pid: int
    stream_type: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    complete: bool


@dataclass
class Stream:
    """What was found in a transport stream."""

    packets: int = 0
    lost_sync: int = 0
    cc_errors: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    units: list[ElementaryPacket] = field(default_factory=list)


def _clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _finish(found: Stream, pid: int, parts: list[bytes], random: bool, whole: bool) -> None:
    pes = b"".join(parts)
    if len(pes) < 9 or pes[:3] != b"\0\0\1":
        found.units.append(ElementaryPacket(pid, found.types[pid], None, None, random, pes, False))
        return
    size, flags, start = int.from_bytes(pes[4:6], "big"), pes[7] >> 6, 9 + pes[8]
    pts = _clock(pes[9:14]) if flags & 2 and len(pes) >= 14 else None
    dts = _clock(pes[14:19]) if flags == 3 and len(pes) >= 19 else None
    stop = 6 + size if size else len(pes)
    found.units.append(ElementaryPacket(pid, found.types[pid], pts, dts, random, pes[start:stop], whole and len(pes) >= stop))


def _tables(found: Stream, pid: int, section: bytes) -> None:
    size = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    if len(section) < size or size < 12 or crc32_mpeg(section[:size]) != 0:
        found.bad_tables += 1
        return
    section = section[:size]
    if not section[5] & 1:  # holds from a later time on
        return
    if pid == PAT_PID and section[0] == 0:
        for at in range(8, size - 4, 4):
            number, to = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if number:
                found.programs[to] = number
    elif pid in found.programs and section[0] == 2:
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while at + 5 <= size - 4:
            found.types[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)


def _in_sync(data: bytes, at: int, further: int) -> bool:
    """Whether a packet can begin at ``at``: it is there whole, and packets' first bytes, or the end, follow at ``further`` packets' distance.

    A first byte is the sync byte, and the byte three after it says that there is a payload or an adaptation field.
    """
    end = len(data)
    if at + PACKET > end:
        return False
    return all(data[p] == SYNC and (p + 3 >= end or data[p + 3] & 0x30) for p in range(at, min(end, at + further * PACKET + 1), PACKET))


def _resync(data: bytes, at: int) -> int:
    """The next place from which packets follow each other; the end if there is none. A sync byte in a payload alone is none."""
    while (at := data.find(SYNC, at)) >= 0:
        if _in_sync(data, at, 2):
            return at
        at += 1
    return len(data)


def _sections(found: Stream, pid: int, section: bytes) -> bytes:
    """Use the whole sections at the start; what is left of the buffer."""
    while len(section) >= 3 and section[0] != 0xFF and len(section) >= (size := 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)):
        _tables(found, pid, section[:size])
        section = section[size:]
    return b"" if section[:1] == b"\xff" else section


def demux(data: bytes) -> Stream:
    """Parse a transport stream.

    A packet counts where a sync byte, or the end, follows it; else sync is
    lost, and searched for again where three packets follow each other.
    Packets with the error flag set are passed over. Continuity counters are
    checked per stream: a repeated packet is dropped, a gap counts as an
    error and leaves the elementary packet incomplete, a flagged
    discontinuity is none. Scrambled packets count but give no data. Sections
    may span packets and end where a packet begins another. Tables with a
    wrong checksum are counted and not used, those not yet in force are not
    used; streams that no table names give no elementary packets.
    """
    found, last, open_ = Stream(), {}, {}
    sections: dict[int, bytes] = {}
    at, end = 0, len(data)
    while at + PACKET <= end:
        if not _in_sync(data, at, 1):
            found.lost_sync += 1
            at = _resync(data, at + 1)
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid, begins = (b1 & 0x1F) << 8 | data[at + 2], b1 & 0x40
        start, stop = at + 4, at + PACKET
        at = stop
        found.packets += 1
        if b1 & 0x80 or pid == 0x1FFF:
            continue
        flags = 0
        if b3 & 0x20:
            size = data[start]
            flags = data[start + 1] if size else 0
            start += 1 + size
        if not b3 & 0x10 or start > stop:
            continue
        cc, body = b3 & 15, data[start:stop]
        before = last.get(pid)
        last[pid] = (cc, body)
        if before is not None and not flags & 0x80 and cc != before[0] + 1 & 15:
            if before == (cc, body):
                continue
            found.cc_errors += 1
            sections.pop(pid, None)
            if pid in open_:
                open_[pid][2] = False
        if b3 & 0xC0:
            continue
        if pid == PAT_PID or pid in found.programs:
            if begins and body:
                new = 1 + body[0]
                if pid in sections:
                    _sections(found, pid, sections[pid] + body[1:new])
                sections[pid] = _sections(found, pid, body[new:])
            elif pid in sections:
                sections[pid] = _sections(found, pid, sections[pid] + body)
        elif pid in found.types:
            if begins:
                if pid in open_:
                    _finish(found, pid, *open_[pid])
                open_[pid] = [[body], bool(flags & 0x40), True]
            elif pid in open_:
                open_[pid][0].append(body)
    for pid, parts in open_.items():
        _finish(found, pid, *parts)
    return found


def padded(text: str | bytes | None) -> bytes:
    """The text as UTF-8, or its bytes if they are none, filled with spaces to a positive multiple of 192 bytes."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data + b" " * (-len(data) % ALIGN if data else ALIGN)


def with_streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of each row: the padded text as a transport stream, and its own length. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = raw_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def elementary_packets(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """(key, nth, pid, stream_type, pts, dts, random_access, complete, data): a row for each elementary packet of each stream.

    A null or empty stream, and one without tables, gives no rows.
    """
    kind = media.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            for i, data in enumerate(batch.column(1).to_pylist()):
                units = demux(data or b"").units
                n = len(units)
                cols = [pa.array([getattr(u, k) for u in units], t) for k, t in (("pid", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("complete", pa.bool_()), ("data", pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(i, 1)] * n) if n else batch.column(0).slice(0, 0), pa.array(range(n), pa.int32()), *cols], [key, "nth", "pid", "stream_type", "pts", "dts", "random_access", "complete", "data"])

    schema = f"`{key}` {kind.simpleString()}, nth int, pid int, stream_type int, pts long, dts long, random_access boolean, complete boolean, data binary"
    return media.select(key, column).mapInArrow(run, schema)


def features(found: Stream, payload: bytes) -> str:
    """Counts of the stream, its timestamps and random-access points, and the samples' mean, deviation and loudest unit."""
    pts = [u.pts for u in found.units if u.pts is not None]
    samples = np.frombuffer(payload, np.uint8).astype(np.float64)
    means = [float(np.frombuffer(u.data, np.uint8).mean()) if u.data else 0.0 for u in found.units]
    loud = int(np.argmax(means)) if means else -1
    return (
        f"packets={found.packets};units={len(found.units)};complete={sum(u.complete for u in found.units)};cc_errors={found.cc_errors};"
        f"pts={min(pts, default=-1)}..{max(pts, default=-1)};random_access={sum(u.random_access for u in found.units)};"
        f"mean={samples.mean() if len(samples) else 0:.4f};dev={samples.std() if len(samples) else 0:.4f};loudest={loud}"
    )


PACKETS = "array<struct<pid:int,stream_type:int,pts:long,dts:long,random_access:boolean,complete:boolean,start:long,length:int>>"


def described(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, packets) of stored streams.

    ``packets`` has each elementary packet's timestamps, whether it is a
    random-access point, and its place in the payload. A null stream counts
    as empty; streams without tables have no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                found = demux(data)
                payload = b"".join(u.data for u in found.units)
                starts = np.cumsum([0, *[len(u.data) for u in found.units]]).tolist()
                packets = [{"pid": u.pid, "stream_type": u.stream_type, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "complete": u.complete, "start": a, "length": len(u.data)} for a, u in zip(starts, found.units, strict=False)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(found, payload), packets))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            packet = pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("complete", pa.bool_()), ("start", pa.int64()), ("length", pa.int32())])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(packet))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets {PACKETS}")


def access_points(described_: DataFrame, *keep: str) -> DataFrame:
    """``keep``, nth, pts, start of each random-access point of described streams: where a reader can begin, and when that is."""
    each = described_.select(*keep, F.posexplode("packets").alias("nth", "p"))
    return each.filter("p.random_access").select(*keep, "nth", "p.pts", "p.start")


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`described` of each document's stream, with the timestamps of its random-access points as ``access``."""
    found = described(saved(with_streams(table(spark, sf_dir, "documents"))))
    access = F.transform(F.filter("packets", lambda p: p["random_access"]), lambda p: F.struct(p["pts"].alias("pts"), p["start"].alias("start")))
    return found.withColumn("access", access).drop("packets")
