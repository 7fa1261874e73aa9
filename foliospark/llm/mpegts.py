"""Media columns: MPEG transport streams, written and read in tasks with numpy.

`write_streams` stores a binary payload as one programme: tables (PAT, PMT) before every random-access point, then one
private elementary stream of timestamped packets (PES), cut into 188-byte transport packets with continuity
counters, clock references and stuffing. `read_streams` is a reader for any such stream: it finds the sync bytes, parses
the programme tables, checks the continuity counters, drops repeated packets, reassembles the elementary packets and
returns their timestamps and random-access points beside the payload.

Scale: narrow maps without a shuffle; a task holds one Arrow batch, a stream is read in whole.

Defined cases: a null payload counts as empty; an empty stream has the tables only and gives an empty payload; null or
foreign bytes read as a stream without packets (payload empty, sync_errors = packets without a sync byte); equal payloads
give equal streams; all columns are kept, a column named like an output is replaced; empty tables stay empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x06, 0xBD
#: Chosen for our streams: identifiers, bytes of payload in a PES packet, PES packets from one random-access point to the next,
#: and the 90 kHz ticks between PES packets (25 a second).
PMT_PID, DATA_PID, UNIT, GROUP, TICKS = 0x1000, 0x0100, 9216, 8, 3600
BLOCK = 576

UNITS = "array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,damaged:boolean,offset:bigint,length:bigint>>"
READ = f"struct<payload:binary,units:{UNITS},n_packets:bigint,sync_errors:bigint,continuity_errors:bigint,duplicates:bigint,table_errors:bigint,pids:array<int>>"


def pad_payload(text: str | None, block: int = BLOCK) -> bytes:
    """UTF-8 of the text with bytes 255 up to a positive multiple of `block`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(block, -(-len(raw) // block) * block) - len(raw))


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ x]
    return c


def _section_packet(pid: int, table_id: int, extension: int, body: bytes) -> np.ndarray:
    head = extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    size = len(head) + len(body) + 4
    section = bytes([table_id, 0xB0 | size >> 8, size & 255]) + head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section_packet(PAT_PID, 0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section_packet(PMT_PID, 2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + streams)
    return np.stack([pat, pmt])


@lru_cache(maxsize=64)
def _unit_form(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packets of one PES packet with `size` bytes of payload, and where those bytes go in them."""
    pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + size).to_bytes(2, "big") + b"\x84\x80\x05" + b"\x00" * 5
    length, at, packets, places = len(pes) + size, 0, [], []
    while at < length:
        first = at == 0
        room = 176 if first else min(184, length - at)
        take = min(room, length - at)
        stuff = 184 - take
        head = bytearray([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 255, 0x30 if stuff else 0x10])
        if stuff:
            field = bytearray([stuff - 1]) + (b"\x10" + b"\x00" * 6 if first else b"\x00")[: stuff - 1]
            head += field.ljust(stuff, b"\xff")
        start = len(packets) * PACKET + len(head)
        places.append(np.arange(start, start + take))
        packets.append(bytes(head) + b"\x00" * take)
        at += take
    where = np.concatenate(places)
    form = np.frombuffer(b"".join(packets), np.uint8).copy()
    form[where[: len(pes)]] = np.frombuffer(pes, np.uint8)
    return form, where[len(pes) :]


def _stamp(pts: np.ndarray) -> np.ndarray:
    return np.stack([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1], 1)


def write_stream(payload: bytes | None) -> bytes:
    """The payload as a transport stream."""
    data = np.frombuffer(payload or b"", np.uint8)
    full, rest = divmod(len(data), UNIT)
    runs = [(0, full, UNIT), (full, 1, rest)] if rest else [(0, full, UNIT)]
    pieces: list[np.ndarray] = []
    counter = 0
    for first, n, size in runs:
        if not n:
            continue
        form, where = _unit_form(size)
        out = np.repeat(form[None, :], n, 0)
        out[:, where] = data[first * UNIT : first * UNIT + n * size].reshape(n, size)
        index = np.arange(first, first + n, dtype=np.int64)
        out[index % GROUP == 0, 5] |= 0x40
        clock = index * TICKS
        out[:, 6:12] = np.stack([clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E, clock * 0], 1)
        stamp_at = where[0] - 5 + np.arange(5)
        out[:, stamp_at] = _stamp(clock + TICKS)
        packets = out.reshape(-1, PACKET)
        packets[:, 3] |= ((counter + np.arange(len(packets))) % 16).astype(np.uint8)
        counter += len(packets)
        pieces += _groups(packets.reshape(n, -1), first)
    done: list[np.ndarray] = []
    k = units = 0
    for piece in pieces or [np.empty((0, PACKET), np.uint8)]:
        if units % GROUP == 0:
            tables = _tables().copy()
            tables[:, 3] |= k % 16
            done.append(tables)
            k += 1
        done.append(piece)
        units += len(piece) and -(-len(piece) // (len(_unit_form(UNIT)[0]) // PACKET))
    return np.concatenate(done).tobytes()


def _groups(units: np.ndarray, first: int) -> list[np.ndarray]:
    """The packets of units numbered from `first`, cut before every random-access point."""
    cuts = np.arange(-first % GROUP, len(units), GROUP)
    return [x.reshape(-1, PACKET) for x in np.split(units, cuts) if len(x)]


def _sections(packets: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], int]:
    """Whole sections with a right checksum on one table PID, and how many were wrong."""
    found, wrong, held = [], 0, b""
    for packet, start in zip(packets, starts, strict=True):
        raw = packet[start:].tobytes()
        if packet[1] & 0x40 and raw:
            held = raw[1 + raw[0] :]
        elif held:
            held += raw
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            if section_crc(held[:size]) == 0:
                found.append(held[:size])
            else:
                wrong += 1
            held = held[size:]
    return found, wrong


def _time(b: np.ndarray) -> int:
    return (int(b[0]) >> 1 & 7) << 30 | int(b[1]) << 22 | (int(b[2]) >> 1) << 15 | int(b[3]) << 7 | int(b[4]) >> 1


def read_stream(media: bytes | None) -> dict:
    """What READ names, for one stream."""
    raw = np.frombuffer(media or b"", np.uint8)
    shift = next((s for s in range(min(PACKET, len(raw))) if raw[s] == SYNC and (s + PACKET >= len(raw) or raw[s + PACKET] == SYNC)), 0)
    whole = raw[shift : shift + (len(raw) - shift) // PACKET * PACKET].reshape(-1, PACKET)
    good = (whole[:, 0] == SYNC) & (whole[:, 1] < 0x80)
    packets = whole[good]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    control, counter = packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    adapted = control & 2 > 0
    start = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    carries = (control & 1 > 0) & (start < PACKET)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    wrong = 0

    def tables(p: int) -> list[bytes]:
        nonlocal wrong
        at = (pid == p) & carries
        found, bad = _sections(packets[at], start[at])
        wrong += bad
        return list(dict.fromkeys(found))

    streams: dict[int, int] = {}
    for section in tables(PAT_PID):
        for k in range(8, len(section) - 4, 4):
            if section[0] == 0 and section[k : k + 2] != b"\x00\x00":
                for inner in tables((section[k + 2] & 31) << 8 | section[k + 3]):
                    at = 12 + ((inner[10] & 15) << 8 | inner[11])
                    while inner[0] == 2 and at + 5 <= len(inner) - 4:
                        streams[(inner[at + 1] & 31) << 8 | inner[at + 2]] = inner[at]
                        at += 5 + ((inner[at + 3] & 15) << 8 | inner[at + 4])
    units, payload, offset, lost, repeated = [], [], 0, 0, 0
    for p in sorted(streams):
        rows = np.flatnonzero((pid == p) & carries)
        step = np.diff(counter[rows].astype(np.int16)) % 16
        again = np.flatnonzero(step == 0) + 1
        again = again[[bool((packets[rows[k]] == packets[rows[k - 1]]).all()) for k in again]] if len(again) else again
        repeated += len(again)
        rows = np.delete(rows, again)
        step = np.diff(counter[rows].astype(np.int16)) % 16
        gap = np.flatnonzero((step != 1) & (flags[rows[1:]] & 0x80 == 0)) + 1
        lost += len(gap)
        body = packets[rows]
        inside = np.arange(PACKET)[None, :] >= start[rows][:, None]
        data, ends = body[inside], np.cumsum(PACKET - start[rows])
        heads = np.flatnonzero(body[:, 1] & 0x40)
        for h, after in zip(heads, [*heads[1:], len(rows)], strict=True):
            low, high = int(ends[h] - (PACKET - start[rows[h]])), int(ends[after - 1])
            pes = data[low:high]
            if len(pes) < 9 or pes[0] or pes[1] or pes[2] != 1:
                lost += 1
                continue
            size, skip = int(pes[4]) << 8 | int(pes[5]), 9 + int(pes[8])
            part = pes[skip : 6 + size if size else None]
            pts = _time(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            dts = _time(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19 else pts
            damaged = bool(((gap > h) & (gap < after)).any() or (size and len(pes) < 6 + size))
            units.append({"pid": p, "pts": pts, "dts": dts, "random_access": bool(flags[rows[h]] & 0x40), "damaged": damaged, "offset": offset, "length": len(part)})
            payload.append(part.tobytes())
            offset += len(part)
    return {"payload": b"".join(payload), "units": units, "n_packets": len(packets), "sync_errors": int((~good).sum()), "continuity_errors": lost, "duplicates": repeated, "table_errors": wrong, "pids": sorted(streams)}


def write_streams(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with media_col: the padded UTF-8 of text_col as a transport stream."""
    return mapped(df, text_col, media_col, "binary", lambda texts: [write_stream(pad_payload(t)) for t in texts])


def read_streams(df: DataFrame, media_col: str = "media", read_col: str = "read") -> DataFrame:
    """df with read_col, a struct as READ: payload, units with timestamps and random-access points, errors."""
    return mapped(df, media_col, read_col, READ, lambda streams: [read_stream(m) for m in streams])
