"""Log records: layout, encoding, and scanning of raw segments.

A record, little-endian: u32 length of what follows; u32 CRC-32C of all after itself; u8 operation
(1 put, 2 delete); u32 key length; key; for a put u32 value length and value; u64 sequence number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from tidelog.functions.crc32c import crc32c, crc32c_ranges

PUT, DELETE = 1, 2
#: Bytes that are moved in one step.
PIECE = 1 << 22
HEADER = 13
#: Bytes of a delete with an empty key; nothing shorter is a record.
LEAST = 21
NEVER = 1 << 63


class Scan(NamedTuple):
    """start, size, seq: of each readable record, in order; file: the number of its file. end, status:
    of each file, the bytes up to which it could be read and why not further."""

    file: np.ndarray
    start: np.ndarray
    size: np.ndarray
    seq: np.ndarray
    end: np.ndarray
    status: list[str]


CLEAN, PADDING, CUT_OFF, CORRUPTED = "clean", "padding", "cut off", "corrupted"


def encode(op: str, key: str, value: str | None, seq: int) -> bytes:
    """One record. A put needs a value and a delete has none; keys are not empty, 0 <= seq < 2^63."""
    if op not in ("P", "D") or not key or (op == "P") != (value is not None) or not 0 <= seq < NEVER:
        raise ValueError(f"not a record: {op!r}, key {key!r}, seq {seq}")
    k = key.encode()
    body = struct.pack("<BI", PUT if op == "P" else DELETE, len(k)) + k
    if value is not None:
        v = value.encode()
        body += struct.pack("<I", len(v)) + v
    body += struct.pack("<Q", seq)
    return struct.pack("<II", len(body) + 4, crc32c(body)) + body


def decode(data: bytes, start: int, size: int) -> tuple[str, str, str | None, int] | None:
    """(op, key, value, seq) of the record at `start`, None if its lengths or texts are wrong.

    As in the store that wrote the logs, every operation byte but 1 is a delete, and a value is there
    if there are bytes for it.
    """
    end = start + size
    if size < LEAST or struct.unpack_from("<I", data, start)[0] != size - 4:
        return None
    op, n = struct.unpack_from("<BI", data, start + 8)
    at = start + HEADER
    if at + n + 8 > end:
        return None
    try:
        key = data[at : at + n].decode()
        at += n
        value = None
        if at + 8 != end:
            if at + 12 > end or at + 12 + (m := struct.unpack_from("<I", data, at)[0]) != end:
                return None
            value = data[at + 4 : at + 4 + m].decode()
    except UnicodeDecodeError:
        return None
    return ("P" if op == PUT else "D", key, value, struct.unpack_from("<Q", data, end - 8)[0])


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes, one row at least."""
    cuts = np.nonzero(np.diff(offsets[:-1] // PIECE))[0] + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(offsets) - 1])


def _ends(length: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(length, dtype=np.int64)])


def gather(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of a buffer, one after the other, and their offsets."""
    offsets = _ends(length)
    out = np.empty(offsets[-1], dtype=np.uint8)
    for a, b in _pieces(offsets) if len(length) else ():
        lo, hi = offsets[a], offsets[b]
        if b - a == 1:
            out[lo:hi] = buffer[start[a] : start[a] + length[a]]
        else:
            out[lo:hi] = buffer[np.arange(lo, hi) + np.repeat(start[a:b] - offsets[a:b], length[a:b])]
    return out, offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies data[start:start+length] of each row to out[at:]."""
    offsets = _ends(length)
    for a, b in _pieces(offsets) if len(length) else ():
        lo, hi = offsets[a], offsets[b]
        if b - a == 1:
            out[at[a] : at[a] + length[a]] = data[start[a] : start[a] + length[a]]
        else:
            step = np.arange(lo, hi)
            out[step + np.repeat(at[a:b] - offsets[a:b], length[a:b])] = data[step + np.repeat(start[a:b] - offsets[a:b], length[a:b])]


def _numbers(buffer: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Little-endian numbers at byte positions."""
    kind = {4: "<u4", 8: "<u8"}[width]
    return np.ascontiguousarray(buffer[at[:, None] + np.arange(width)]).view(kind).ravel() if len(at) else np.zeros(0, kind)


def encode_batch(op, k, v, seq):
    """(records, crc) of Arrow arrays: as `encode`, for all rows at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(seq)
    put = pc.fill_null(pc.equal(op, "P"), False).to_numpy(zero_copy_only=False)
    delete = pc.fill_null(pc.equal(op, "D"), False).to_numpy(zero_copy_only=False)
    keys, k_at, k_len = ranges_of(k.cast(pa.binary()))
    values, v_at, v_len = ranges_of(v.cast(pa.binary()))
    valued, numbers = np.asarray(v.is_valid()), np.asarray(pc.fill_null(seq, -1)).astype(np.int64)
    bad = ~(put | delete) | (k_len == 0) | (put != valued) | (numbers < 0)
    if bad.any():
        i = int(np.nonzero(bad)[0][0])
        raise ValueError(f"not a record: {op[i].as_py()!r}, key {k[i].as_py()!r}, seq {seq[i].as_py()}")
    size = HEADER + k_len + np.where(put, 4 + v_len, 0) + 8
    offsets = _ends(size)
    start, out = offsets[:-1], np.zeros(offsets[-1], dtype=np.uint8)

    def fill(at: np.ndarray, value: np.ndarray, kind: str) -> None:
        raw = np.ascontiguousarray(value.astype(kind)).view(np.uint8).reshape(len(at), np.dtype(kind).itemsize)
        out[at[:, None] + np.arange(raw.shape[1])] = raw

    if n:
        fill(start, size - 4, "<u4")
        out[start + 8] = np.where(put, PUT, DELETE)
        fill(start + 9, k_len, "<u4")
        _scatter(out, start + HEADER, keys, k_at, k_len)
        fill((start + HEADER + k_len)[put], v_len[put], "<u4")
        _scatter(out, (start + HEADER + 4 + k_len)[put], values, v_at[put], v_len[put])
        fill(offsets[1:] - 8, numbers, "<u8")
    crc = crc32c_ranges(out, start + 8, size - 8)
    if n:
        fill(start + 4, crc, "<u4")
    if offsets[-1] >= 1 << 31:
        records = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    else:
        records = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return records, crc


def _texts(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, good: np.ndarray, null: np.ndarray | None = None):
    """Arrow strings of ranges of bytes; rows that are no UTF-8 are taken off `good`."""
    import pyarrow as pa

    def made():
        data, offsets = gather(buffer, start, np.where(good, length, 0))
        wide = offsets[-1] >= 1 << 31
        valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
        raw = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(start), [valid, pa.py_buffer(offsets if wide else offsets.astype(np.int32)), pa.py_buffer(data)])
        return raw.cast(pa.large_string() if wide else pa.string())

    try:
        return made()
    except pa.ArrowInvalid:
        for i in np.nonzero(good)[0].tolist():
            try:
                bytes(buffer[start[i] : start[i] + length[i]]).decode()
            except UnicodeDecodeError:
                good[i] = False
        return made()


def decode_batch(buffer: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(good, op, k, v, seq) of records at ranges of a buffer: as `decode`, for all at once. Rows that are not good hold nothing."""
    import pyarrow as pa

    end = start + size
    good = size >= LEAST
    safe = np.where(good, start, 0)
    if not good.any():
        none = pa.nulls(len(start), pa.string())
        return good, none, none, none, np.zeros(len(start), np.int64)
    at = lambda p, ok: np.where(ok, p, 0)
    good &= _numbers(buffer, safe, 4) == size - 4
    n = np.where(good, _numbers(buffer, at(start + 9, good), 4).astype(np.int64), 0)
    good &= start + HEADER + n + 8 <= end
    after = start + HEADER + n
    valued = good & (after + 8 != end)
    room = valued & (after + 12 <= end)
    m = np.where(room, _numbers(buffer, at(after, room), 4).astype(np.int64), 0)
    good &= ~valued | room & (after + 12 + m == end)
    seq = np.where(good, _numbers(buffer, at(end - 8, good), 8), 0).astype(np.int64)
    op = np.where(buffer[at(start + 8, good)] == PUT, "P", "D")
    k = _texts(buffer, start + HEADER, n, good)
    v = _texts(buffer, after + 4, m, good, ~valued)
    return good, pa.array(op, pa.string()), k, v, seq


def scan(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Scan:
    """Readable records of many files, each a range of one buffer. Keys and values are not decoded.

    Reading a file ends at its end, at a record length of 0 (padding), or at the first record that is
    cut off or fails its checksum; records before that are kept.
    """
    u32, u64 = struct.Struct("<I").unpack_from, struct.Struct("<Q").unpack_from
    view = memoryview(buffer)
    file, start, total, seq, end, status = [], [], [], [], [], []
    for f, (at, n) in enumerate(zip(begin.tolist(), size.tolist())):
        stop, why = at + n, CLEAN
        while at < stop:
            if stop - at < 4:
                why = CUT_OFF if any(view[at:stop]) else PADDING
                break
            (m,) = u32(view, at)
            if m == 0:
                why = PADDING
                break
            if at + m + 4 > stop:
                why = CUT_OFF
                break
            if m + 4 < LEAST:
                why = CORRUPTED
                break
            file.append(f)
            start.append(at)
            total.append(m + 4)
            (s,) = u64(view, at + m - 4)
            seq.append(s if s < NEVER else -1)
            at += m + 4
        end.append(at)
        status.append(why)
    file, start, total, seq, end = (np.array(x, dtype=np.int64) for x in (file, start, total, seq, end))
    if len(start):
        at = start[:, None] + np.arange(4, 8)
        said = buffer[at].astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], dtype=np.uint32)
        bad = (crc32c_ranges(buffer, start + 8, total - 8) != said) | (seq < 0)
        if bad.any():
            first = np.full(len(end), len(start), dtype=np.int64)
            np.minimum.at(first, file[bad], np.nonzero(bad)[0])
            keep = np.arange(len(start)) < first[file]
            for f in np.unique(file[bad]).tolist():
                end[f], status[f] = start[first[f]], CORRUPTED
            file, start, total, seq = file[keep], start[keep], total[keep], seq[keep]
    return Scan(file, start, total, seq, end, status)


def ranges_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buffer, begin, size of the values of an Arrow binary array, without copying; nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.diff(at)
    if column.null_count:
        size = np.where(np.asarray(column.is_null()), 0, size)
    return buffer, at[:-1], size
