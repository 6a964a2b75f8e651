"""Raw log files as tables of records, and records as raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.records import CLEAN, CORRUPTED, PADDING, decode_batch, encode_batch, gather, ranges_of, scan

RECORD = "path string, pos bigint, seq bigint, op string, k string, v string"
STATUS = "path string, records bigint, readable bigint, bytes bigint, status string"


def _readable(content) -> tuple:
    """(buffer, begin, size, scan, good, op, k, v) of an Arrow array of raw files: the records up to the first that is no
    record; good: those of all that were scanned."""
    buffer, begin, size = ranges_of(content)
    s = scan(buffer, begin, size)
    good, op, k, v, _ = decode_batch(buffer, s.start, s.size)
    if not good.all():
        first = np.full(len(begin), len(good))
        np.minimum.at(first, s.file[~good], np.nonzero(~good)[0])
        good = np.arange(len(good)) < first[s.file]
    return buffer, begin, size, s, good, op, k, v


def _decode(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        _, begin, _, s, good, op, k, v = _readable(b["content"])
        paths = b["path"].take(pa.array(s.file[good]))
        texts = [x.filter(pa.array(good)).cast(pa.string()) for x in (op, k, v)]
        yield pa.RecordBatch.from_arrays([paths, pa.array((s.start - begin[s.file])[good]), pa.array(s.seq[good]), *texts], names=["path", "pos", "seq", "op", "k", "v"])


def decode_files(wal_file: DataFrame) -> DataFrame:
    """(path, pos, seq, op, k, v): every readable record of each file, with its byte position. A file is read
    to its end, to padding, or to the first record that is cut off, fails its checksum or has a text that
    is no UTF-8. Null contents have no records; no shuffle."""
    return wal_file.select("path", "content").mapInArrow(_decode, RECORD)


def _ends(content) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(records, readable bytes, bytes, status) of raw files."""
    _, begin, size, s, good, *_ = _readable(content)
    n = np.bincount(s.file[good], minlength=len(begin))
    end, status = (s.end - begin).copy(), list(s.status)
    for i in np.nonzero(~good)[0][::-1].tolist():
        end[s.file[i]], status[s.file[i]] = s.start[i] - begin[s.file[i]], CORRUPTED
    return n, end, size, status


def _status(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        n, end, size, status = _ends(b["content"])
        yield pa.RecordBatch.from_arrays([b["path"], pa.array(n), pa.array(end), pa.array(size), pa.array(status, pa.string())], names=["path", "records", "readable", "bytes", "status"])


def file_status(wal_file: DataFrame) -> DataFrame:
    """(path, records, readable, bytes, status) of each file: how far it can be read and why not further."""
    return wal_file.select("path", "content").mapInArrow(_status, STATUS)


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        _, end, size, status = _ends(b["content"])
        keep = np.where([x in (CLEAN, PADDING) for x in status], size, end)
        if (keep == size).all():
            yield b
            continue
        buffer, begin, _ = ranges_of(b["content"])
        data, offsets = gather(buffer, begin, keep)
        valid = pa.py_buffer(np.packbits(np.asarray(b["content"].is_valid()), bitorder="little"))
        content = pa.Array.from_buffers(pa.binary(), len(keep), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([b["path"], content], names=["path", "content"])


def truncated(wal_file: DataFrame) -> DataFrame:
    """(path, content): each file cut to its readable part, so that appending can go on; the rest of the
    table as a repair of it. Padding stays, a null content too. No shuffle."""
    return wal_file.select("path", "content").mapInArrow(_cut, "path string, content binary")


def encode_records(writes: DataFrame) -> DataFrame:
    """(seq, record, crc) of each distinct (seq, op, k, v). Rows that are no record (a null seq, an empty key, a
    put without value) raise an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            records, crc = encode_batch(*(b[c] for c in ("op", "k", "v", "seq")))
            yield pa.RecordBatch.from_arrays([b["seq"], records, pa.array(crc.astype(np.int64))], names=["seq", "record", "crc"])

    return writes.select("seq", "op", "k", "v").distinct().mapInArrow(run, "seq bigint, record binary, crc bigint")
