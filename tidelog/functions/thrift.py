"""The compact Thrift protocol, as far as Parquet footers need it: structs as {field id: (type, value)}.

Fields that are not known are kept as they are, so that a footer that is read and written again loses nothing.
"""

from __future__ import annotations

import struct

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int):
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (BYTE, TRUE, FALSE):  # of a list's items, booleans are bytes
            self.at += 1
            return self.data[self.at - 1]
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4
            n = self.varint() if n == 15 else n
            return (head & 15, [self.value(head & 15) for _ in range(n)])
        if kind == MAP:
            n = self.varint()
            if not n:
                return (0, 0, [])
            kinds = self.data[self.at]
            self.at += 1
            return (kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)])
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"Thrift type {kind}")

    def struct(self) -> dict:
        out, field = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            kind = head & 15
            if not kind:
                return out
            field = field + (head >> 4) if head >> 4 else self.signed()
            out[field] = (kind, kind == TRUE) if kind in (TRUE, FALSE) else (kind, self.value(kind))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _signed(n: int) -> bytes:
    return _varint(n << 1 ^ n >> 63)


def _value(kind: int, v) -> bytes:
    if kind in (I16, I32, I64):
        return _signed(v)
    if kind == BINARY:
        return _varint(len(v)) + v
    if kind in (BYTE, TRUE, FALSE):
        return bytes([v])
    if kind == DOUBLE:
        return struct.pack("<d", v)
    if kind in (LIST, SET):
        item, values = v
        n = len(values)
        head = bytes([n << 4 | item]) if n < 15 else bytes([240 | item]) + _varint(n)
        return head + b"".join(_value(item, x) for x in values)
    if kind == MAP:
        a, b, values = v
        return b"\0" if not values else _varint(len(values)) + bytes([a << 4 | b]) + b"".join(_value(a, x) + _value(b, y) for x, y in values)
    return write_struct(v)


def write_struct(fields: dict) -> bytes:
    out, last = bytearray(), 0
    for field in sorted(fields):
        kind, v = fields[field]
        if kind in (TRUE, FALSE):
            kind = TRUE if v else FALSE
        step = field - last
        out += bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _signed(field)
        if kind not in (TRUE, FALSE):
            out += _value(kind, v)
        last = field
    return bytes(out) + b"\0"


def read_struct(data: bytes) -> dict:
    return Reader(data).struct()
