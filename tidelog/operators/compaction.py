"""Far too many small files (problem 4): encoded blocks are copied, not decoded.

Of each log file, the runs of readable records are blocks. Blocks of one log go, byte for byte, into
files of a target size; each new file ends with a footer that is written anew: where each block lies, from
which file it is, its records. Keys and values are never decoded: a record's length and sequence number
are read in place, its checksum is verified. Of a record found in several files one copy is taken. At the
end, blocks, records and bytes of the footers must be what was planned.

(Parquet files are dealt with the same way by their row groups: tidelog.sources.parquet_blocks.)
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.records import ranges_of, scan
from tidelog.operators.membership import may_be_among
from tidelog.operators.skew import range_of, running_sum
from tidelog.session import checkpoint, small, work_dir
from tidelog.sources.files import read_whole, write_whole

#: Bytes of a file of good size.
TARGET = 128 << 20
MAGIC = b"tdl1"
INDEX = "fid bigint, log string, path string, first bigint, length bigint, end bigint, status string, recs array<struct<pos:int,size:int,seq:bigint>>"
MANIFEST = "file string, log string, blocks bigint, n bigint, bytes bigint, lo bigint, hi bigint"


@dataclass
class Compacted:
    """folder: of the new files. files: one row per new file, as MANIFEST. index: one row per file read."""

    folder: str
    files: DataFrame
    index: DataFrame

    def sequence_numbers(self) -> DataFrame:
        """(seq): read back from the new files by their footers."""
        return self.files.select("file").repartition(F.col("file")).mapInArrow(_sequence_numbers, "seq bigint")


def log_of(path: Column) -> Column:
    """The log that a file belongs to: its folder up to a shard's (`.../s<n>`), else its folder."""
    shard = F.regexp_extract(path, r"^(.*?/?s\d+)/", 1)
    return F.when(shard != "", shard).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def first_seq(content: Column) -> Column:
    """The sequence number of the first record as it stands, whether the record is right or not; 0 if there is none."""

    def little_endian(at: Column, n: int) -> Column:
        digits = F.hex(F.concat(*[F.substring(content, at + i, F.lit(1)) for i in range(n - 1, -1, -1)]))
        return F.conv(digits, 16, 10).try_cast("bigint")

    size = F.when(F.length(content) >= 4, little_endian(F.lit(1), 4))
    at = F.when((size >= 8) & (size + 4 <= F.length(content)), size - 3).cast("int")
    return F.coalesce(F.when(at.isNotNull(), little_endian(at, 8)), F.lit(0)).cast("bigint")


def _index(batches: Iterator) -> Iterator:
    import pyarrow as pa

    record = pa.struct([("pos", pa.int32()), ("size", pa.int32()), ("seq", pa.int64())])
    for b in batches:
        buffer, begin, size = ranges_of(b["content"])
        s = scan(buffer, begin, size)
        n = np.bincount(s.file, minlength=len(begin))
        first = np.concatenate([[0], np.cumsum(n)])
        pos = np.arange(len(s.file)) - first[s.file]
        recs = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(s.size, pa.int32()), pa.array(s.seq)], fields=list(record))
        yield pa.RecordBatch.from_arrays(
            [*(b[c] for c in ("fid", "log", "path", "first", "length")), pa.array(s.end - begin), pa.array(s.status, pa.string()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), recs)],
            names=["fid", "log", "path", "first", "length", "end", "status", "recs"],
        )


def _kept(content: np.ndarray, keep: np.ndarray) -> list[tuple[int, int, int]]:
    """(offset, bytes, records) of the runs of records to keep, by their numbers in the file."""
    starts, at, u32 = [], 0, struct.Struct("<I").unpack_from
    for _ in range(int(keep[-1]) + 1):
        starts.append(at)
        at += u32(content, at)[0] + 4
    starts.append(at)
    cut = np.nonzero(np.diff(keep) != 1)[0] + 1
    return [(starts[r[0]], starts[r[-1] + 1] - starts[r[0]], len(r)) for r in np.split(keep, cut)]


def _writer(folder: str):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(bin_: str, log: str, pieces: list, blocks: list, lo: int, hi: int):
            size = sum(map(len, pieces))
            footer = json.dumps({"log": log, "blocks": blocks, "records": sum(x[2] for x in blocks), "bytes": size, "lo": lo, "hi": hi}).encode()
            name = f"{folder}/{bin_}.wal"
            write_whole(name, [*pieces, b"\0\0\0\0", footer, struct.pack("<I", len(footer)), MAGIC])
            row = (name, log, len(blocks), sum(x[2] for x in blocks), size, lo, hi)
            names = ["file", "log", "blocks", "n", "bytes", "lo", "hi"]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, row)})

        now, plan, pieces, blocks, log, size, lo, hi = None, None, [], [], "", 0, 0, 0
        for b in batches:
            bins, fids, paths, contents, keeps = (b[c] for c in ("bin", "fid", "path", "content", "keep"))
            for i in range(b.num_rows):
                bin_, fid = bins[i].as_py(), fids[i].as_py()
                if bin_ != now:
                    if pieces:
                        yield flush(now, log, pieces, blocks, lo, hi)
                    now, plan, pieces, blocks, size, lo, hi = bin_, None, [], [], 0, 1 << 62, 0
                if keeps[i].is_valid:  # what to take of the file that comes next
                    plan, log = (fid, keeps[i].values.to_numpy()), b["log"][i].as_py()
                    lo, hi = min(lo, b["lo"][i].as_py()), max(hi, b["hi"][i].as_py())
                elif plan and plan[0] == fid:
                    content = contents[i].as_buffer()
                    for offset, n, records in _kept(memoryview(content), plan[1]):
                        pieces.append(content[offset : offset + n].to_pybytes())
                        blocks.append([size, n, records, paths[i].as_py(), offset])
                        size += n
                    plan = None  # the very same file once more adds nothing, as does one of which nothing is kept
        if pieces:
            yield flush(now, log, pieces, blocks, lo, hi)

    return write


def footer_of(data: bytes) -> dict:
    if data[-4:] != MAGIC:
        raise ValueError("not a compacted file")
    (n,) = struct.unpack_from("<I", data, len(data) - 8)
    return json.loads(data[-8 - n : -8])


def _sequence_numbers(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for file in b["file"].to_pylist():
            data = read_whole(file)
            footer = footer_of(data)
            begin = np.array([x[0] for x in footer["blocks"]], dtype=np.int64)
            s = scan(np.frombuffer(data, dtype=np.uint8), begin, np.array([x[1] for x in footer["blocks"]], dtype=np.int64))
            if np.bincount(s.file, minlength=len(begin)).tolist() != [x[2] for x in footer["blocks"]]:
                raise ValueError(f"{file}: a block does not hold the records that the footer says")
            yield pa.RecordBatch.from_arrays([pa.array(s.seq)], names=["seq"])


def compact_log_files(wal_file: DataFrame, target: int = TARGET, log: Column | None = None) -> Compacted:
    """Consolidates the raw log files of `wal_file` (path, content) into files of about `target` bytes.

    Every readable record comes out once, of copies that in the file of the lowest id. Empty files, null
    contents and files without a readable record add nothing. `length` is not relied on. Repeated rows
    count once. Files of at least `target` bytes become a file of their own.

    Two passes read the contents: the first for the index (about 16 bytes a record, checkpointed), the
    second to copy. Between them only numbers are shuffled. A file's place is told from its log and the sequence number of its
    first record, which the second pass reads in place: so the contents are shuffled once, to the task that writes their new
    file, without a join. The borders of the new files are broadcast, a number for each `target` bytes. Of copies that
    add nothing most are dropped before the shuffle. No task holds more than one new file and one old one.
    """
    spark = wal_file.sparkSession
    path = F.coalesce("path", F.lit(""))
    source = wal_file.where(F.length("content") > 0).select(path.alias("path"), (log if log is not None else log_of(path)).alias("log"), "content")
    source = source.withColumn("fid", F.xxhash64("path", "content")).withColumn("first", first_seq(F.col("content"))).withColumn("length", F.length("content").cast("bigint"))
    index = checkpoint(source.select("fid", "log", "path", "first", "length", "content").mapInArrow(_index, INDEX))
    records = index.select("fid", F.inline("recs"))
    kept = records.groupBy("seq").agg(F.min(F.struct("fid", "pos", "size")).alias("at"))
    files = kept.groupBy("at.fid").agg(F.sort_array(F.collect_list("at.pos")).alias("keep"), F.sum("at.size").alias("size"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    own = index.groupBy("fid").agg(F.min("log").alias("log"), F.min("first").alias("first"), F.min("length").alias("length"))
    files = checkpoint(files.join(own, "fid"))
    # large files are files of their own and take no room in those of several
    placed = running_sum(files, "first", F.when(F.col("length") < target, F.col("size")).otherwise(0), "before", by=["log"])
    borders = placed.groupBy("log", F.floor(F.col("before") / target).alias("number")).agg(F.min("first").alias("first")).where("number > 0")
    points = borders.groupBy(F.col("log").alias("_log")).agg(F.sort_array(F.collect_list("first")).alias("_points"))
    points = points.withColumn("_step", F.greatest(F.lit(1), F.round(F.sqrt(F.size("_points"))).cast("int")))
    coarse = F.expr("transform(sequence(_step, greatest(_step, size(_points) - size(_points) % _step), _step), i -> _points[i - 1])")
    points = small(checkpoint(points.withColumn("_coarse", coarse)))

    def binned(rows: DataFrame) -> DataFrame:
        number = range_of(F.col("first") + 1, F.col("_points"), F.col("_coarse"), F.col("_step"))
        alone = F.when(F.col("length") >= target, F.concat(F.lit("-"), F.hex("fid"))).otherwise("")
        name = F.concat(F.hex(F.xxhash64("log")), F.lit("-"), F.lpad(number.cast("string"), 9, "0"), alone)
        return rows.join(points, F.col("log").eqNullSafe(F.col("_log")), "left").withColumn("bin", name)

    folder = work_dir(spark, "compacted")
    plan = binned(files).select("bin", "first", "fid", F.lit(0).alias("kind"), "log", "keep", "lo", "hi")
    contents = may_be_among(source, F.col("fid"), files, F.col("fid"))
    contents = binned(contents).select("bin", "first", "fid", F.lit(1).alias("kind"), "path", "content")
    work = plan.unionByName(contents, allowMissingColumns=True).repartition(F.col("bin")).sortWithinPartitions("bin", "first", "fid", "kind")
    work.select("fid", "path", "log", "bin", "keep", "lo", "hi", "content").mapInArrow(_writer(folder), MANIFEST).write.parquet(f"{folder}/_files")
    out = Compacted(folder, spark.read.schema(MANIFEST).parquet(f"{folder}/_files"), index)
    want = files.agg(F.coalesce(F.sum(F.size("keep")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
    got = out.files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0]
    if tuple(want) != tuple(got):
        raise RuntimeError(f"compaction lost or repeated records: planned {tuple(want)}, written {tuple(got)}")
    return out
