"""Log folders as a data source, 'kvwal': batch reading and writing.

    spark.dataSource.register(KvWal)
    spark.read.format("kvwal").option("segmentSize", 65536).option("from", lsn).load(folder)
    writes.write.format("kvwal").option("segmentSize", 65536).mode("append").save(folder)

With option "resume" = "true" a write goes on in the logs that are there: task i appends to the log part-<i>, in its last
segment, and begins it if there is none. Else each task begins a log of its own.

A log is a folder of segments; logs below `folder` are read in parallel, the segments of a log in order, as
records may go on in the next one. Segments that end before `from` are not opened. Reading stops at the first
corrupt record of a log; what went before it is kept, and with option "corrupt" = "true" a row with op '!'
tells where it is. Files of other names are left alone.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidelog.functions.layout import Corruption, LogWriter, base_lsn, read_segments
from tidelog.sources.files import opened, read_whole, write_whole

SCHEMA = "file string, pos bigint, seq bigint, op string, k string, v string"
SEGMENT_SIZE = 1 << 24


@dataclass
class Log(InputPartition):
    files: list[tuple[str, str]]
    offset: int


class KvWalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("segmentsize", SEGMENT_SIZE))
        self.start, self.corrupt = int(options.get("from", 0)), str(options.get("corrupt", "false")).lower() == "true"

    def partitions(self) -> list[Log]:
        from pyarrow import fs

        system, path = opened(self.folder)
        logs: dict[str, list[tuple[int, str, int]]] = {}
        for f in system.get_file_info(fs.FileSelector(path, recursive=True)):
            base = base_lsn(f.base_name, self.size) if f.is_file else None
            if base is not None and f.size > self.size:
                raise ValueError(f"{f.path}: {f.size} bytes are more than a segment of {self.size}")
            # the last segment of a log may be partly filled: its end is its own size
            if base is not None and self.start < base + f.size:
                logs.setdefault(os.path.dirname(f.path), []).append((base, f.base_name, f.size))
        out = []
        for at, files in sorted(logs.items()):
            files.sort()
            prefix = self.folder[: self.folder.index(path)] if path in self.folder else ""
            out.append(Log([(n, f"{prefix}{at}/{n}") for _, n, _ in files], max(0, self.start - files[0][0])))
        return out

    def read(self, log: Log) -> Iterator:
        import pyarrow as pa

        names, kinds = dict(log.files), [("file", pa.string()), ("pos", pa.int64()), ("seq", pa.int64()), ("op", pa.string()), ("k", pa.string()), ("v", pa.string())]
        for x in read_segments(((n, read_whole(uri)) for n, uri in log.files), log.offset):
            if not isinstance(x, Corruption):
                columns = [[names[f] for f in x.file], x.pos, x.seq, x.op, x.k, x.v]
            elif self.corrupt:
                columns = [[names[x.file]], [x.pos], [None], ["!"], [None], [None]]
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) if not isinstance(c, pa.Array) else c.cast(kind) for c, (_, kind) in zip(columns, kinds)], schema=pa.schema(kinds))


def last_segment(folder: str, segment_size: int) -> tuple[str, bytes] | None:
    """Name and bytes of a log's last segment; None if it has none."""
    from pyarrow import fs

    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [f.base_name for f in found if f.is_file and base_lsn(f.base_name, segment_size) is not None]
    return (max(names), read_whole(f"{folder}/{max(names)}")) if names else None


@dataclass
class Written(WriterCommitMessage):
    log: str
    records: int
    into: str


class KvWalWriter(DataSourceArrowWriter):
    """Each task writes a log; LSNs are given anew, in the order of the rows. It is written aside and appears when the whole
    job commits. A log that goes on gets its new segments one by one, the one that was begun first: if that is cut short,
    reading it ends with a torn tail, to be cut off by `repair`, after a part of what was appended. One job at a time may go on
    with the logs of a folder."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("logs are appended to: use mode('append')")
        self.folder, self.size, self.names = options["path"].rstrip("/"), int(options.get("segmentsize", SEGMENT_SIZE)), schema.names
        self.job, self.resume = uuid.uuid4().hex, str(options.get("resume", "false")).lower() == "true"

    def write(self, batches: Iterator) -> Written:
        log, n, own = LogWriter(self.size), 0, f"{self.job}-{uuid.uuid4().hex}"
        into = f"part-{TaskContext.get().partitionId():05d}" if self.resume else own
        if begun := last_segment(f"{self.folder}/{into}", self.size) if self.resume else None:
            log = LogWriter(self.size, base_lsn(begun[0], self.size) + len(begun[1]), begun[1])
        for b in batches:
            log.extend(*(b[c] for c in ("op", "k", "v")))
            n += b.num_rows
            for name, data in log.full:
                write_whole(f"{self.folder}/.{own}/{name}", [data])
            log.full = []
        for name, data in log.take():
            write_whole(f"{self.folder}/.{own}/{name}", [data])
        return Written(own, n, into)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = opened(self.folder)
        for m in messages:
            if m and m.records:
                if m.into == m.log:
                    system.move(f"{path}/.{m.log}", f"{path}/{m.log}")
                    continue
                system.create_dir(f"{path}/{m.into}", recursive=True)
                for f in sorted(x.base_name for x in system.get_file_info(fs.FileSelector(f"{path}/.{m.log}"))):
                    system.move(f"{path}/.{m.log}/{f}", f"{path}/{m.into}/{f}")
                system.delete_dir(f"{path}/.{m.log}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        for m in messages:
            if m and m.records:
                system.delete_dir(f"{path}/.{m.log}")


class KvWal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return KvWalReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return KvWalWriter(self.options, schema, overwrite)


def repair(folder: str, segment_size: int, file: str, pos: int) -> list[str]:
    """Cuts a log at a corrupt record: its file to `pos` bytes, later files removed. Returns what was removed."""
    from pyarrow import fs

    system, path = opened(folder)
    write_whole(f"{folder}/{file}", [read_whole(f"{folder}/{file}")[:pos]])
    found = system.get_file_info(fs.FileSelector(path))
    gone = [f.base_name for f in found if base_lsn(f.base_name, segment_size) is not None and f.base_name > file]
    for name in gone:
        system.delete_file(f"{path}/{name}")
    return gone
