"""Texts in MPEG transport streams: a multiplexer and a demultiplexer for media columns.

A payload of 192-byte units is carried in a private elementary stream.  Packets
of the elementary stream (PES) hold up to 85 units and a 90 kHz presentation
time, as if a byte were a sample at 8 kHz.  Every eighth of them is a random-access
point: its first transport packet says so, carries the clock reference, and the
program tables stand before it.

The demultiplexer reads any such stream: it finds the program map through the
association table, in sections of one packet or several, checks both tables' CRC, counts gaps of the continuity
counter that no discontinuity indicator announces, drops repeated packets, reassembles the elementary packets and keeps
their times and random-access points with their byte offsets.

Defined results: a null text is the empty one, whose payload is one unit of
spaces; bytes that are no whole packets, packets without the sync byte, and streams with gaps give
a null payload with the fault named; equal rows have equal streams, an empty table gives an empty result; other columns are not read.
A very long text is one stream, of about 1.03 times its bytes, made packet row by packet row and sent in a batch of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .tables import narrow_batches, table

UNIT = 192
PES_UNITS = 85
RAP_EVERY = 8
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
CLOCK, RATE = 90_000, 8_000
PES_HEADER = 14
#: Bytes of media in a batch that goes to Spark.
BATCH_BYTES = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_PAT = np.frombuffer(_table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))), dtype=np.uint8)
_PMT = np.frombuffer(_table_packet(PMT_PID, _section(0x02, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, 0x06, 0xE000 | ES_PID, 0xF000))), dtype=np.uint8)


def pad(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _pes_header(size: int, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])
    return struct.pack(">IHBBB", 0x000001BD, size + 8, 0x84, 0x80, 5) + stamp


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of whole units."""
    data = np.frombuffer(payload, dtype=np.uint8)
    step = UNIT * PES_UNITS
    rows, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(data), step)):
        part = data[at : at + step]
        rap = k % RAP_EVERY == 0
        pts = at * CLOCK // RATE % (1 << 33)
        if rap:
            for t in (_PAT, _PMT):
                row = t.copy()
                row[3] |= tables & 15
                rows.append(row[None])
            tables += 1
        es = np.concatenate([np.frombuffer(_pes_header(len(part), pts), dtype=np.uint8), part])
        lead = 8 if rap else 0  # bytes of the first packet's adaptation field
        n = max(1, -(-(len(es) + lead) // 184))
        out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        start = np.full(n, 4)
        if rap:
            out[0, 3] |= 0x20
            out[0, 4:6] = (7, 0x50)
            out[0, 6:12] = np.frombuffer(struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00), dtype=np.uint8)
            start[0] += lead
        stuff = n * 184 - lead - len(es)
        if stuff:  # the last packet's adaptation field grows
            own = 8 if rap and n == 1 else 0
            out[-1, 3] |= 0x20
            out[-1, 4] = own + stuff - 1
            if not own and stuff > 1:
                out[-1, 5] = 0
            start[-1] = 4 + own + stuff
        out[np.arange(PACKET)[None] >= start[:, None]] = es
        rows.append(out)
    return np.concatenate(rows).tobytes()


@dataclass
class Stream:
    """What demux finds: the payload (None with a fault but gaps), times, random-access points and faults of continuity."""

    payload: bytes | None = None
    fault: str = ""
    packets: int = 0
    gaps: int = 0
    repeats: int = 0
    times: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)


def _payload(p: bytes) -> bytes:
    return p[5 + p[4] :] if p[3] & 0x20 else p[4:]


def _table_body(packets: np.ndarray, pid: int, pids: np.ndarray, table_id: int) -> bytes | None:
    """The body of the first whole section of a table, which may take several packets, with a right CRC."""
    held, counter = b"", None
    for i in np.flatnonzero(pids == pid):
        p = packets[i].tobytes()
        if not p[3] & 0x10 or (counter is not None and p[3] & 15 == counter):  # no payload, or a repeated packet
            continue
        whole = counter is None or p[3] & 15 == (counter + 1) & 15
        counter, data = p[3] & 15, _payload(p)
        if p[1] & 0x40:  # a section begins after so many bytes of the one before
            pointer = data[0] if data else 0
            ends = [held + data[1 : 1 + pointer] if held and whole else b"", data[1 + pointer :]]
        else:
            ends = [held + data if held and whole else b""]
        for section in ends:
            held = section
            if len(section) < 3:
                continue
            size = 3 + (struct.unpack_from(">H", section, 1)[0] & 0x0FFF)
            if len(section) >= size:
                held = b""
                if section[0] == table_id and crc32_mpeg(section[:size]) == 0:
                    return section[8 : size - 4]
    return None


def demux(media: bytes) -> Stream:
    """The first elementary stream of the first program."""
    s = Stream()
    if len(media) % PACKET or not media:
        s.fault = "not whole packets"
        return s
    packets = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    s.packets = len(packets)
    if (packets[:, 0] != SYNC).any():
        s.fault = "no sync byte"
        return s
    pids = ((packets[:, 1].astype(np.int64) & 0x1F) << 8) | packets[:, 2]
    pat = _table_body(packets, PAT_PID, pids, 0x00)
    programs = [struct.unpack_from(">HH", pat, i) for i in range(0, len(pat), 4)] if pat else []
    pmt = next((_table_body(packets, pid & 0x1FFF, pids, 0x02) for number, pid in programs if number), None)
    if not pmt:
        s.fault = "no program"
        return s
    es_pid = struct.unpack_from(">H", pmt, 5 + (struct.unpack_from(">H", pmt, 2)[0] & 0x0FFF))[0] & 0x1FFF
    es = packets[(pids == es_pid) & (packets[:, 3] & 0x10 > 0)]
    if not len(es):
        s.fault = "no elementary packets"
        return s
    counter = es[:, 3] & 15
    again = np.zeros(len(es), dtype=bool)
    again[1:] = (counter[1:] == counter[:-1]) & (es[1:] == es[:-1]).all(1)
    s.repeats = int(again.sum())
    es, counter = es[~again], counter[~again]
    fielded = es[:, 3] & 0x20 > 0
    announced = fielded & (es[:, 4] > 0) & (es[:, 5] & 0x80 > 0)  # the counter may begin anew
    s.gaps = int(((((counter[1:].astype(int) - counter[:-1]) & 15) != 1) & ~announced[1:]).sum())
    start = np.where(fielded, 5 + es[:, 4].astype(np.int64), 4)
    begins = es[:, 1] & 0x40 > 0
    access = fielded & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    sizes = np.maximum(PACKET - start, 0)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    data = es[np.arange(PACKET)[None] >= start[:, None]].tobytes()
    heads = np.flatnonzero(begins)
    parts, done = [], 0
    for i, k in enumerate(heads):
        at, end = int(edges[k]), int(edges[heads[i + 1]]) if i + 1 < len(heads) else int(edges[-1])
        if data[at : at + 3] != b"\x00\x00\x01":
            s.gaps += 1
            continue
        length = struct.unpack_from(">H", data, at + 4)[0]
        end = min(end, at + 6 + length) if length else end
        body = at + 9 + data[at + 8]
        if data[at + 7] & 0x80:
            t = data[at + 9 : at + 14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
            if s.times:  # 33 bits wrap
                pts += round((s.times[-1] - pts) / (1 << 33)) * (1 << 33)
            s.times.append(pts)
            s.offsets.append(done)
        if access[k]:
            s.random_access.append(done)
        parts.append(data[body:end])
        done += end - body
    s.payload = b"".join(parts)
    if s.gaps:
        s.fault = f"{s.gaps} gaps"
    return s


def summary(s: Stream) -> str:
    """Features of what was read back: counts, times, random-access points, and the samples' mean and mean change in thousandths."""
    x = np.frombuffer(s.payload, dtype=np.uint8).astype(np.int64)
    change = int(np.abs(np.diff(x)).sum() * 1000 // max(1, len(x) - 1))
    return (
        f"packets={s.packets};pes={len(s.times)};units={len(x) // UNIT};gaps={s.gaps};repeats={s.repeats};pts={s.times[0]}-{s.times[-1]};"
        f"rap={len(s.random_access)};last_rap={s.random_access[-1] if s.random_access else -1};mean={int(x.sum()) * 1000 // len(x)};change={change}"
    )


def encode(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media) of docs' texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.large_binary())
            first, held, sizes, media = 0, 0, [], []
            for i in range(len(b)):
                raw = texts[i].as_py()
                sizes.append(len(raw))
                media.append(mux(pad(raw)))
                held += len(media[-1])
                if held > BATCH_BYTES or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0)[first : i + 1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])
                    first, held, sizes, media = i + 1, 0, [], []

    return docs.select(key, "text").mapInArrow(rows, docs.select(key).schema.add("n_bytes", "long").add("media", "binary"))


def decode(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, fault) of (key, n_bytes, media)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fault")}
            for m in b.column(2):
                raw = m.as_py() or b""
                s = demux(raw)
                ok = not s.fault and bool(s.payload) and bool(s.times)
                out["payload_bytes"].append(len(s.payload) if ok else None)
                out["payload_sha256"].append(hashlib.sha256(s.payload).hexdigest() if ok else None)
                out["tail_crc32"].append(zlib.crc32(s.payload[-16:]) if ok else None)
                out["media_bytes"].append(len(raw))
                out["media_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["feature"].append(summary(s) if ok else None)
                out["fault"].append(None if ok else s.fault or "no payload")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=[key, "n_bytes", *out])

    schema = media.select(key, "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("fault", "string")):
        schema = schema.add(name, kind)
    return media.select(key, "n_bytes", "media").mapInArrow(rows, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow_batches(spark)
    return decode(encode(table(spark, sf_dir, "documents")))


QUERIES = {"op3_media": op3_media}
ORACLES: dict[str, str] = {}
