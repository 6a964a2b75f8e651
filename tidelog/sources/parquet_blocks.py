"""Many small Parquet files into fewer: encoded column blocks are copied, footers written anew.

The bytes of each row group, its pages still compressed and encoded, are copied into the new file; only the
footer is rewritten, with offsets moved. Files go together if their schemas and the Spark and Arrow schemas in
their footers are equal. Page indexes hold offsets of their own and are left out; statistics and
bloom filters stay. No value is decoded. A file's row groups stay apart, so many tiny row groups
remain many: that is the price of not decoding.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.thrift import I16, LIST, STRUCT, read_struct, write_struct
from tidelog.operators.skew import running_sum
from tidelog.session import checkpoint, work_dir
from tidelog.sources.files import opened, write_whole, written_whole

MAGIC = b"PAR1"
FOOTERS = "path string, schema string, row_groups int, n bigint, bytes bigint"
WRITTEN = "file string, files bigint, row_groups bigint, n bigint, bytes bigint"
#: Bytes of a consolidated file, and the most row groups in one: its footer is built in memory.
TARGET, MOST_GROUPS = 128 << 20, 8192
# fields of the footer's structs
SCHEMA, ROWS, GROUPS, KEYS = 2, 3, 4, 5
COLUMNS, GROUP_ROWS, GROUP_OFFSET, ORDINAL = 1, 3, 5, 7
CHUNK_OFFSET, CHUNK_META, PAGE_INDEX = 2, 3, (4, 5, 6, 7)
DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE, SIZE, BLOOM, BLOOM_SIZE = 9, 10, 11, 7, 14, 15


def read_footer(uri: str) -> tuple[dict, int]:
    """The footer and the file's size."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        if size < 12:
            raise ValueError(f"{uri}: not a Parquet file")
        f.seek(size - 8)
        tail = f.read(8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri}: not a Parquet file, or encrypted")
        n = struct.unpack("<I", tail[:4])[0]
        f.seek(size - 8 - n)
        return read_struct(f.read(n)), size


def compatible(footer: dict) -> str:
    """What must be equal for files to go together: the schema and the schemas kept beside it."""
    import hashlib

    keys = sorted(write_struct(x) for x in footer.get(KEYS, (LIST, (STRUCT, [])))[1][1])
    schema = b"".join(write_struct(x) for x in footer[SCHEMA][1][1])
    return hashlib.sha256(schema + b"\0".join(keys)).hexdigest()


def _chunk_start(meta: dict) -> int:
    return min(meta[f][1] for f in (DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE) if f in meta and meta[f][1] > 0)


def merge_files(sources: list[str], target: str) -> tuple[int, int, int]:
    """Copies the row groups of `sources` into `target`; (row groups, rows, bytes). Files without rows add nothing."""
    out: dict | None = None
    groups, rows, same = [], 0, ""

    def pieces() -> Iterator[bytes]:
        nonlocal out, rows, same
        at = len(MAGIC)
        yield MAGIC
        for uri in sources:
            footer, _ = read_footer(uri)
            if out is None:
                out, same = footer, compatible(footer)
            elif compatible(footer) != same:
                raise ValueError(f"{uri}: its schema differs")
            system, path = opened(uri)
            with system.open_input_file(path) as f:
                for group in footer[GROUPS][1][1]:
                    chunks = [c for c in group[COLUMNS][1][1]]
                    spans = [(_chunk_start(c[CHUNK_META][1]), c[CHUNK_META][1][SIZE][1]) for c in chunks]
                    first = at
                    for chunk, (start, size) in zip(chunks, spans):
                        f.seek(start)
                        block = f.read(size)
                        if len(block) != size:
                            raise ValueError(f"{uri}: a column block is cut off")
                        yield block
                        meta, move = chunk[CHUNK_META][1], at - start
                        for field in (DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE):
                            if field in meta and meta[field][1] > 0:
                                meta[field] = (meta[field][0], meta[field][1] + move)
                        if CHUNK_OFFSET in chunk:
                            chunk[CHUNK_OFFSET] = (chunk[CHUNK_OFFSET][0], 0)
                        for field in PAGE_INDEX:
                            chunk.pop(field, None)
                        at += size
                    for chunk in chunks:
                        meta = chunk[CHUNK_META][1]
                        if BLOOM in meta and BLOOM_SIZE in meta:
                            f.seek(meta[BLOOM][1])
                            block = f.read(meta[BLOOM_SIZE][1])
                            yield block
                            meta[BLOOM] = (meta[BLOOM][0], at)
                            at += len(block)
                        else:
                            meta.pop(BLOOM, None)
                    if GROUP_OFFSET in group:
                        group[GROUP_OFFSET] = (group[GROUP_OFFSET][0], first)
                    if len(groups) < 32768:
                        group[ORDINAL] = (I16, len(groups))
                    else:
                        group.pop(ORDINAL, None)
                    groups.append(group)
                    rows += group[GROUP_ROWS][1]
        footer = dict(out)
        footer[ROWS] = (footer[ROWS][0], rows)
        footer[GROUPS] = (LIST, (STRUCT, groups))
        data = write_struct(footer)
        yield data + struct.pack("<I", len(data)) + MAGIC

    size = write_whole(target, pieces())
    return len(groups), rows, size


def _footers(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = []
        for uri in b["path"].to_pylist():
            footer, size = read_footer(uri)
            rows.append((uri, compatible(footer), len(footer[GROUPS][1][1]), footer[ROWS][1], size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "schema", "row_groups", "n", "bytes"), r)) for r in rows], schema=pa.schema([("path", pa.string()), ("schema", pa.string()), ("row_groups", pa.int32()), ("n", pa.int64()), ("bytes", pa.int64())]))


def _merger(folder: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(name: str, paths: list[str]):
            groups, rows, size = merge_files(paths, f"{folder}/{name}.parquet")
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}.parquet"], "files": [len(paths)], "row_groups": [groups], "n": [rows], "bytes": [size]})

        now, paths = None, []
        for b in batches:
            for name, path in zip(b["bin"].to_pylist(), b["path"].to_pylist()):
                if name != now and paths:
                    yield flush(now, paths)
                    paths = []
                now = name
                paths.append(path)
        if paths:
            yield flush(now, paths)

    return run


def _group_writer(folder: str, by: list[str], names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa
        import pyarrow.parquet as pq

        def runs() -> Iterator:
            for b in batches:
                keys = list(zip(*[b[f"_{c}"].to_pylist() for c in by]))
                rows = b.select(names)
                at = 0
                for key, same in itertools.groupby(keys):
                    n = sum(1 for _ in same)
                    yield key, rows.slice(at, n)
                    at += n

        for key, pieces in itertools.groupby(runs(), lambda r: r[0]):
            name = "-".join("null" if x is None else str(x) for x in key)
            n, first = 0, next(pieces)[1]
            with written_whole(f"{folder}/{name}.parquet") as out, pq.ParquetWriter(out, first.schema) as writer:
                for piece in itertools.chain([first], (p for _, p in pieces)):
                    writer.write_batch(piece)
                    n += piece.num_rows
            done = {"path": [f"{folder}/{name}.parquet"]} | {c: [x] for c, x in zip(by, key)} | {"rows": [n]}
            kinds = [(c, first.schema.field(c).type) for c in by]
            yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("path", pa.string()), *kinds, ("rows", pa.int64())]))

    return run


def write_groups(rows: DataFrame, by: list[str], order: list[str], folder: str) -> DataFrame:
    """Writes one Parquet file per group of the number columns `by`, sorted by `order`: (path, *by, rows) of each.
    A group is written batch by batch as it comes, so that none is held whole; a null group has its file."""
    keys = {f"_{c}": F.col(c) for c in by}
    sorted_ = rows.withColumns(keys).repartition(*by).sortWithinPartitions(*by, *order)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return checkpoint(sorted_.mapInArrow(_group_writer(folder, by, rows.columns), f"path string, {kinds}, rows bigint"))


def compact_parquet(spark: SparkSession, folder: str, target: int = TARGET, into: str | None = None, placing: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Consolidates the Parquet files under `folder` into files of about `target` bytes in a new folder.

    Returns the new folder and WRITTEN rows. Files are listed and their footers read by tasks; only a row
    per file is shuffled, then each task copies the bytes of its new files. Files are placed in order of a hash
    of their path, within files of equal schemas; or by `placing`, (path, name, ord) of all files: the new
    file's name and the place in it, still within equal schemas, and nothing is listed. At the end the rows and
    row groups written must be those read. The old files are left as they are; an empty folder gives an empty table.
    """
    if placing is None:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path")
    else:
        listed = placing.select("path")
    footers = checkpoint(listed.repartition(F.col("path")).mapInArrow(_footers, FOOTERS))
    prefix, full = F.substring("schema", 1, 12), footers.where("row_groups > 0")
    if placing is None:
        placed = running_sum(full.withColumn("ord", F.xxhash64("path")), "ord", F.col("bytes"), "before", by=["schema"])
        plan = placed.withColumn("bin", F.concat_ws("-", prefix, F.lpad(F.floor(F.col("before") / target).cast("string"), 9, "0")))
    else:
        plan = full.join(placing, "path").withColumn("bin", F.concat_ws("-", prefix, "name"))
    into = into or work_dir(spark, "parquet")
    work = plan.select("bin", "path", "ord").repartition(F.col("bin")).sortWithinPartitions("bin", "ord")
    work.select("bin", "path").mapInArrow(_merger(into), WRITTEN).write.parquet(f"{into}/_files")
    written = spark.read.schema(WRITTEN).parquet(f"{into}/_files")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    want = footers.agg(zero("n"), zero("row_groups")).first()
    got = written.agg(zero("n"), zero("row_groups")).first()
    if tuple(want) != tuple(got):
        raise RuntimeError(f"compaction lost or repeated rows: {tuple(want)} read, {tuple(got)} written")
    return into, written
