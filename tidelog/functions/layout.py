"""A log as segments of a fixed size: where records go, and how they are read back across segments.

The sequence number of a record is the log's length when it is appended. A record that does not fit is
split if its 13-byte header still fits: header, zeros to the end, the rest in the next segment; else it
goes into the next segment whole. Segments are named by their base: see tidelog.functions.segments.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

from tidelog.functions.crc32c import crc32c_ranges
from tidelog.functions.records import HEADER, LEAST, decode_batch, encode_batch, ranges_of

LOG_BYTES = 1 << 32
_NAME = re.compile(r"[0-9a-f]{24}\.wal")


def segment_name(lsn: int, size: int, timeline: int = 0) -> str:
    return f"{timeline:08x}{lsn >> 32:08x}{lsn % LOG_BYTES // size:08x}.wal"


def base_lsn(name: str, size: int) -> int | None:
    """First LSN of a segment; None for other files of the folder."""
    return int(name[8:16], 16) * LOG_BYTES + int(name[16:24], 16) * size if _NAME.fullmatch(name) else None


class LogWriter:
    """Lays out records; `take` hands over what has been filled. Starts at `lsn` (a new log: 0), which is
    within the segment whose bytes so far are `begun`."""

    def __init__(self, size: int, lsn: int = 0, begun: bytes = b"", timeline: int = 0):
        if size <= HEADER or LOG_BYTES % size:
            raise ValueError(f"a segment size must divide {LOG_BYTES}")
        self.size, self.timeline = size, timeline
        self.now = bytearray(begun or bytes(lsn % size))
        self.base = lsn - len(self.now)
        self.full: list[tuple[str, bytes]] = []

    @property
    def next_lsn(self) -> int:
        return self.base + len(self.now)

    def _rotate(self) -> None:
        self.now += bytes(self.size - len(self.now))
        self.full.append((segment_name(self.base, self.size, self.timeline), bytes(self.now)))
        self.base, self.now = self.base + self.size, bytearray()

    def append(self, op: str, key: str, value: str | None) -> int:
        """The record's LSN. A record larger than a segment is refused and changes nothing."""
        import pyarrow as pa

        return int(self.extend(*(pa.array([x], pa.string()) for x in (op, key, value)))[0])

    def extend(self, op, k, v) -> np.ndarray:
        """Appends many records, Arrow arrays; their LSNs. If one is refused nothing changes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        length = lambda x: pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = LEAST + length(k) + np.where(np.asarray(v.is_valid()), 4 + length(v), 0)
        if (size > self.size).any():
            raise ValueError(f"a record of {size.max()} bytes does not fit a segment of {self.size}")
        lsn, at = np.zeros(len(size), np.int64), self.next_lsn
        for i, n in enumerate(size.tolist()):
            lsn[i] = at
            free = self.size - at % self.size
            if n > free:
                # the header stays in this segment if it fits, the rest begins the next one
                at += free + (n - HEADER if free >= HEADER else n)
            else:
                at += n
        records, _ = encode_batch(op, k, v, pa.array(lsn))
        buffer, begin, _ = ranges_of(records)
        data, starts = memoryview(buffer), begin.tolist()
        for begin, n in zip(starts, size.tolist()):
            record, free = data[begin : begin + n], self.size - len(self.now)
            if n > free:
                if free >= HEADER:
                    self.now += record[:HEADER]
                    record = record[HEADER:]
                self._rotate()
            self.now += record
        return lsn

    def take(self) -> list[tuple[str, bytes]]:
        """Segments that are full, and the last as it is."""
        out, self.full = self.full, []
        return out + ([(segment_name(self.base, self.size, self.timeline), bytes(self.now))] if self.now else [])


class Records(NamedTuple):
    """Records of a log: numpy arrays and, of op, k and v, Arrow ones."""

    file: list[str]
    pos: np.ndarray
    seq: np.ndarray
    op: object
    k: object
    v: object


class Entry(NamedTuple):
    file: str
    pos: int
    seq: int
    op: str
    k: str
    v: str | None


class Corruption(NamedTuple):
    """Where reading stopped: everything from this byte of this file on, and all later files, is to go."""

    file: str
    pos: int


def read_log(files: Iterable[tuple[str, bytes]], offset: int = 0) -> Iterator[Entry | Corruption]:
    """As read_segments, record by record."""
    for x in read_segments(files, offset):
        if isinstance(x, Corruption):
            yield x
        else:
            yield from map(Entry._make, zip(x.file, x.pos.tolist(), x.seq.tolist(), x.op.to_pylist(), x.k.to_pylist(), x.v.to_pylist()))


def read_segments(files: Iterable[tuple[str, bytes]], offset: int = 0) -> Iterator[Records | Corruption]:
    """Records of a log's segments in order, those of a segment at a time, from a byte offset in the first; at the first
    corrupt record a Corruption comes out and reading ends. `pos` is where a record's header lies, in its own file.

    A header at the end of a segment whose record goes on in the next one is carried over. Zeros up to the end of a
    segment are padding; a header at the very end of the log is a torn tail: corrupt, to be cut off.
    """
    carried, at_file, at_pos, last = b"", "", 0, None
    for name, content in files:
        data, at = carried + content[offset:], 0
        shift = offset - len(carried)
        offset = 0
        starts, ends, stop = [], [], None

        def where(p: int, name=name, shift=shift, carried=carried, at_file=at_file, at_pos=at_pos) -> Corruption:
            return Corruption(at_file, at_pos) if carried and p == 0 else Corruption(name, p + shift)

        while len(data) - at >= HEADER:
            (n,) = struct.unpack_from("<I", data, at)
            if n == 0 and not any(data[at:]):
                at = len(data)
                break
            if n + 4 < LEAST:
                stop = where(at)
                break
            if at + 4 + n > len(data):
                break
            starts.append(at)
            at += 4 + n
            ends.append(at)
        buffer, start = np.frombuffer(data, dtype=np.uint8), np.array(starts, dtype=np.int64)
        size = np.array(ends, dtype=np.int64) - start
        good, op, k, v, seq = decode_batch(buffer, start, size)
        if len(start):
            said = np.ascontiguousarray(buffer[start[:, None] + np.arange(4, 8)]).view("<u4").ravel()
            good &= crc32c_ranges(buffer, start + 8, size - 8) == said
        m = len(start)
        if not good.all():
            m = int(np.argmin(good))
            stop = where(starts[m])
        if m:
            places = [where(p) for p in starts[:m]]
            yield Records([p.file for p in places], np.array([p.pos for p in places]), seq[:m], op[:m], k[:m], v[:m])
        if stop is not None:
            yield stop
            return
        if len(data) - at >= HEADER:
            at_file, at_pos = where(at)
            carried, last = data[at : at + HEADER], Corruption(at_file, at_pos)
        else:
            last = Corruption(name, at + shift) if any(data[at:]) else None
            carried = b""
    if last is not None:
        yield last
