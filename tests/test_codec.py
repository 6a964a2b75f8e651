"""Checksum, records, layout and names, with the known values of the formats."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import layout
from tidelog.functions.crc32c import BLOCK, crc32c, crc32c_ranges
from tidelog.functions.records import CLEAN, CORRUPTED, CUT_OFF, PADDING, decode, decode_batch, encode, encode_batch, ranges_of, scan
from tidelog.functions.segments import ends_after, segment_name

# records as bytes: operation, key, value, sequence number, hex. Fixed values.
RECORDS = [
    ("P", "key1", "value1", 0, "1f000000ad64a30701040000006b6579310600000076616c7565310000000000000000"),
    ("D", "key2", None, 35, "150000004b55bda602040000006b6579322300000000000000"),
    ("P", "key3", "value2", 60, "1f000000216dc68301040000006b6579330600000076616c7565323c00000000000000"),
    ("P", "key", "value", 1024, "1d000000e43cda6601030000006b65790500000076616c75650004000000000000"),
    ("D", "key", None, 1024, "14000000860f18bf02030000006b65790004000000000000"),
]
# file names: sequence number, segment size, name. Fixed values.
NAMES = [
    (0, 2, "000000000000000000000000.wal"),
    (2**16 + 30, 2**8, "000000000000000000000100.wal"),
    (2**40 + 8443, 2**16, "000000000000010000000000.wal"),
    (56014641572749563, 2**16, "0000000000c7010500000d2a.wal"),
]
# name, file size, sequence number, whether it can hold later records. Fixed values.
BOUNDS = [
    ("0000000000c7010500000d2a.wal", 2**24, 0, True),
    ("000000000000000000000000.wal", 2**6, 65, False),
    ("0000000000c7010500000d2a.wal", 2**24, 56014641572741120, True),
    ("0000000000c7010500000d2a.wal", 2**24, 0x00C70105 * 2**32 + 0xD2B * 2**24, False),
]


def bitwise(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    start = np.array([0, 7, 100, 0, 4999, 5000, 33])
    size = np.array([5000, BLOCK, BLOCK - 1, 0, 1, 0, 3 * BLOCK + 5])
    got = crc32c_ranges(np.frombuffer(data, np.uint8), start, size)
    assert got.tolist() == [bitwise(data[a : a + n]) for a, n in zip(start, size)]


@pytest.mark.parametrize("op,k,v,seq,hexed", RECORDS)
def test_records(op, k, v, seq, hexed):
    assert encode(op, k, v, seq).hex() == hexed
    data = bytes.fromhex(hexed)
    assert decode(data, 0, len(data)) == (op, k, v, seq)


@pytest.mark.parametrize("bad", [("P", "", "v", 0), ("P", "k", None, 0), ("D", "k", "v", 0), ("G", "k", None, 0), ("P", "k", "v", -1), ("P", "k", "v", 1 << 63)])
def test_not_a_record(bad):
    with pytest.raises(ValueError):
        encode(*bad)


def many(n=1000):
    return [encode(*(("P", f"key{i}", f"value{i}") if i % 7 == 0 else ("D", f"key{i}", None)), i) for i in range(n)]


def scanned(*files):
    buffer, begin, size = ranges_of(pa.array(files, pa.binary()))
    return scan(buffer, begin, size)


def test_scan_of_clean_padded_and_damaged_files():
    records = many()
    whole = b"".join(records)
    at = len(b"".join(records[:500]))
    flipped = bytearray(whole)
    flipped[at + 7] ^= 1
    cut = b"".join(records[:500]) + records[500][:-5] + b"".join(records[501:])
    header = b"".join(records[:-1]) + records[-1][:13]
    zero = b"".join(records[:5]) + bytes(4) + records[5][4:] + b"".join(records[6:10])
    s = scanned(whole, whole + bytes(4), bytes(flipped), cut, header, zero, b"", None, b"\x01")
    assert np.bincount(s.file, minlength=9).tolist() == [1000, 1000, 500, 500, 999, 5, 0, 0, 0]
    assert s.status == [CLEAN, PADDING, CORRUPTED, CORRUPTED, CUT_OFF, PADDING, CLEAN, CLEAN, CUT_OFF]
    assert s.seq[:1000].tolist() == list(range(1000))
    assert s.end[2] - len(whole) * 2 - 4 == at


def test_scan_finds_every_flipped_byte():
    record = encode("P", "key", "värdet", 77)
    base = b"".join(many(3)) + record + b"".join(many(2))
    first = len(b"".join(many(3)))
    for i in range(len(base)):
        damaged = bytearray(base)
        damaged[i] ^= 0x41
        s = scanned(bytes(damaged))
        n = len(s.seq)
        assert n < 6
        assert b"".join(bytes(damaged[a : a + m]) for a, m in zip(s.start, s.size)) == base[: s.end[0]]
        assert n >= (3 if i >= first else 0)


def test_truncation_at_each_byte_is_no_record():
    data = encode("P", "key", "value", 5)
    for n in range(len(data)):
        assert decode(data[:n], 0, n) is None or n == len(data)


def test_long_records():
    value = "x" * 1_000_003
    s = scanned(encode("P", "k", value, 9) + encode("D", "k", None, 10))
    assert s.seq.tolist() == [9, 10]


def test_padded_layout():
    w = layout.LogWriter(64)
    ops = [("P", "key1", "value1"), ("P", "key1", "new_value1"), ("P", "key2", "value2"), ("D", "key2", None), ("P", "key3", "value3")]
    assert [w.append(*o) for o in ops] == [0, 35, 90, 125, 153]
    files = w.take()
    assert [n for n, _ in files] == [layout.segment_name(i * 64, 64) for i in range(3)]
    got = list(layout.read_log(files))
    assert [(e.op, e.k, e.v, e.seq) for e in got] == [(*o, s) for o, s in zip(ops, [0, 35, 90, 125, 153])]
    # from an LSN, inclusive
    late = list(layout.read_log(files[1:], 90 - 64))
    assert [e.seq for e in late] == [90, 125, 153]
    # resumed in the middle of a segment
    again = layout.LogWriter(64, w.next_lsn, files[-1][1])
    assert again.append("D", "key3", None) == w.next_lsn
    assert [e.seq for e in layout.read_log(files[:-1] + again.take())] == [0, 35, 90, 125, 153, w.next_lsn]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(min_size=1, max_size=8), st.none() | st.text(max_size=12)), max_size=30), st.sampled_from([128, 256, 4096]))
def test_layout_round_trip(ops, size):
    w = layout.LogWriter(size)
    want = [("D" if v is None else "P", k, v, w.append("D" if v is None else "P", k, v)) for k, v in ops]
    files = w.take()
    assert all(len(d) == size for _, d in files[:-1])
    assert [(e.op, e.k, e.v, e.seq) for e in layout.read_log(files)] == want


def test_torn_and_corrupt_logs():
    w = layout.LogWriter(64)
    for i in range(20):
        w.append("P", f"key{i}", "some value")
    files = w.take()
    whole = list(layout.read_log(files))
    assert len(whole) == 20
    for f in range(len(files)):
        for i in range(len(files[f][1])):
            data = bytearray(files[f][1])
            data[i] ^= 0xFF
            got = list(layout.read_log(files[:f] + [(files[f][0], bytes(data))] + files[f + 1 :]))
            entries = [x for x in got if isinstance(x, layout.Entry)]
            assert entries == whole[: len(entries)]
            assert len(entries) == 20 or isinstance(got[-1], layout.Corruption)
    torn = [*files[:-1], (files[-1][0], files[-1][1][:-3])]
    assert isinstance(list(layout.read_log(torn))[-1], layout.Corruption)


def test_too_large_for_a_segment():
    w = layout.LogWriter(64)
    with pytest.raises(ValueError):
        w.append("P", "key", "v" * 100)
    assert w.next_lsn == 0


OPS = st.lists(st.tuples(st.text(min_size=1, max_size=8), st.none() | st.text(max_size=300), st.integers(0, (1 << 63) - 1)), max_size=30)


@settings(max_examples=60, deadline=None)
@given(OPS)
def test_batches_are_as_single_records(ops):
    columns = [["D" if v is None else "P" for _, v, _ in ops], *([x[i] for x in ops] for i in range(3))]
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))]
    records, crc = encode_batch(*arrays)
    want = [encode(*r) for r in zip(*columns)]
    assert records.to_pylist() == want and crc.tolist() == [struct.unpack_from("<I", r, 4)[0] for r in want]
    buffer, begin, size = ranges_of(records)
    good, op, k, v, seq = decode_batch(buffer, begin, size)
    assert good.all() and [op.to_pylist(), k.to_pylist(), v.to_pylist(), seq.tolist()] == columns
    # any damage: what is no record is told, the others are as they are
    raw = bytearray(b"".join(want))
    for i in range(0, len(raw), 7):
        raw[i] ^= 0x81
    good, op, k, v, seq = decode_batch(np.frombuffer(bytes(raw), np.uint8), begin, size)
    single = [decode(bytes(raw), a, n) for a, n in zip(begin.tolist(), size.tolist())]
    assert good.tolist() == [x is not None for x in single]
    rows = list(zip(op.to_pylist(), k.to_pylist(), v.to_pylist(), [x % (1 << 64) for x in seq.tolist()]))
    assert [r for r, g in zip(rows, good) if g] == [x for x in single if x]


@pytest.mark.parametrize("bad", [("P", "", "v", 0), ("P", None, "v", 0), ("P", "k", None, 0), ("D", "k", "v", 0), (None, "k", None, 0), ("P", "k", "v", None)])
def test_not_a_batch(bad):
    with pytest.raises(ValueError):
        encode_batch(*(pa.array([x], t) for x, t in zip(bad, (pa.string(), pa.string(), pa.string(), pa.int64()))))


def test_long_values_in_batches(monkeypatch):
    monkeypatch.setattr("tidelog.functions.records.PIECE", 100)
    values = ["x" * n for n in (0, 1, 99, 100, 101, 1000, 3, 5)]
    records, _ = encode_batch(*(pa.array(c, t) for c, t in ((["P"] * 8, pa.string()), (list("abcdefgh"), pa.string()), (values, pa.string()), (range(8), pa.int64()))))
    assert records.to_pylist() == [encode("P", k, v, i) for i, (k, v) in enumerate(zip("abcdefgh", values))]
    assert decode_batch(*ranges_of(records))[3].to_pylist() == values


def test_names_and_bounds(spark):
    for lsn, size, name in NAMES:
        assert layout.segment_name(lsn, size) == name
        assert spark.range(1).select(segment_name(F.lit(lsn).cast("bigint"), size)).first()[0] == name
    for name, size, lsn, later in BOUNDS:
        assert spark.range(1).select(ends_after(F.lit(name), F.lit(size), size, F.lit(lsn).cast("bigint"))).first()[0] is later
    row = spark.range(1).select(ends_after(F.lit("notes.txt"), F.lit(5), 64, F.lit(0)), ends_after(F.lit(layout.segment_name(640, 64)), F.lit(5), 64, F.lit(644)))
    assert tuple(row.first()) == (False, True)


def test_reading_binary_slices():
    a = pa.array([b"abc", None, b"", b"defg"], pa.binary()).slice(1)
    buffer, begin, size = ranges_of(a)
    assert [bytes(buffer[x : x + n]) for x, n in zip(begin, size)] == [b"", b"", b"defg"]
    assert struct.unpack("<I", encode("D", "k", None, 1)[:4])[0] == 18
