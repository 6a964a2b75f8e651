"""The store as a stream: requests are answered, changes are applied, as they arrive.

Within a micro-batch rows are in no order; each key's rows are sorted by seq. The state is all requests so far, by
buckets of keys, each in blocks in order of key and seq, so that a restart from the checkpoint goes on where it stopped and
a late request is told from a repeated one. Nothing expires: the state grows with the distinct requests.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.changes import apply_changes
from tidelog.schema import GET, PUT, changes, requests
from tidelog.session import checkpoint, work_dir
from tidelog.sources.files import opened, read_whole, write_whole

#: Buckets of keys of the state that changes are applied to: a batch rewrites those that it touches.
APPLY_BUCKETS = 64
#: Bytes of files in a micro-batch.
BATCH_BYTES = 256 << 20
#: Buckets of keys; they stay for the life of a checkpoint. About one for some hundred keys to come is right.
BUCKETS = 256
#: Requests in a block of a bucket's state, doubled before it is split; blocks held in memory; answers handed on at once.
BLOCK, KEPT, ANSWERS = 512, 8, 10_000
LOWEST = ("", -(1 << 63))
COLUMNS = ["seq", "k", "op", "rc", "payload", "of"]
ANSWER = "seq bigint, k string, op string, rc int, payload string, of bigint"


class History:
    """The requests (k, seq, op, v) of a bucket in order of k and seq. The index has the first place of each block and
    whether it holds a write; of the blocks only those asked for are read from the state."""

    def __init__(self, index, blocks):
        self.index, self.blocks, self.read = index, blocks, {}
        held = (index.get() if index.exists() else None) or ((), (), ())
        self.starts, self.writes = list(zip(held[0], held[1])), list(held[2])

    def place(self, at: tuple) -> int:
        return max(bisect_right(self.starts, at) - 1, 0)

    def _keep(self, start: tuple, rows: list[tuple]) -> None:
        self.read.pop(start, None)
        if len(self.read) >= KEPT:
            self.read.pop(next(iter(self.read)))
        self.read[start] = rows

    def block(self, i: int) -> list[tuple]:
        start = self.starts[i]
        if start not in self.read:
            self._keep(start, list(zip(*self.blocks.getValue(start))))
        return self.read[start]

    def add(self, rows: list[tuple]) -> set[tuple]:
        """Takes up the rows, each (k, seq) once and in order, that are not known yet; their places."""
        new, parts = set(), {}
        for row in rows:
            parts.setdefault(self.place(row[:2]), []).append(row)
        for i in sorted(parts, reverse=True):
            held = self.block(i) if self.starts else []
            known = {r[:2] for r in held}
            fresh = [r for r in parts[i] if r[:2] not in known]
            if not fresh:
                continue
            new.update(r[:2] for r in fresh)
            all_ = sorted(held + fresh, key=lambda r: r[:2])
            pieces = [all_[j : j + BLOCK] for j in range(0, len(all_), BLOCK)] if len(all_) > 2 * BLOCK else [all_]
            # the first block is open downwards: rows that come late may be lower than all
            starts = [*(self.starts[i : i + 1] or [LOWEST]), *[p[0][:2] for p in pieces[1:]]]
            for start, piece in zip(starts, pieces):
                self.blocks.updateValue(start, tuple(list(c) for c in zip(*piece)))
                self._keep(start, piece)
            self.starts[i : i + 1] = starts
            self.writes[i : i + 1] = [any(r[2] != GET for r in p) for p in pieces]
        if new:
            self.index.update((*map(list, zip(*self.starts)), self.writes))
        return new

    def before(self, i: int, k: str) -> tuple:
        """(seq, v) of the key's last write in the blocks before one."""
        while i > 0:
            i -= 1
            alone = self.starts[i][0] == k  # the block holds nothing else, as the key goes on behind it
            if self.writes[i]:
                for key, seq, op, v in reversed(self.block(i)):
                    if key != k:
                        return None, None
                    if op != GET:
                        return seq, v
            if not alone:
                break
        return None, None

    def answers(self, new: set[tuple]) -> Iterator[tuple]:
        """(k, seq, op, rc, v, of) of the new requests, and anew of the older ones that follow a new write."""
        touched = sorted({self.place(at) for at in new})
        among, done = set(touched), -1
        for i in touched:
            if i <= done:
                continue
            last = self.block(i)[0][0]
            at, value = self.before(i, last)
            while i < len(self.starts) and (i in among or (last, at) in new and self.starts[i][0] == last):
                for k, seq, op, v in self.block(i):
                    if k != last:
                        last, at, value = k, None, None
                    if (k, seq) in new or (k, at) in new:
                        yield k, seq, op, 2 if op == GET and value is None else 0, value, at
                    if op != GET:
                        at, value = seq, v
                done, i = i, i + 1


class Replay(StatefulProcessor):
    """Answers the requests of a bucket of keys from its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "ks array<string>, seqs array<bigint>, writes array<boolean>")
        self.blocks = handle.getMapState("blocks", "k string, seq bigint", "ks array<string>, seqs array<bigint>, ops array<string>, vs array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = {(k, s): (k, s, op, v if op == PUT else None) for part in rows for k, s, op, v in zip(part["k"], part["seq"].tolist(), part["op"], part["v"])}
        history, out = History(self.index, self.blocks), []
        for k, seq, op, rc, value, at in history.answers(history.add([batch[x] for x in sorted(batch)])):
            out.append((seq, k, op, rc, value, at))
            if len(out) == ANSWERS:
                yield self.frame(out)
                out = []
        yield self.frame(out)

    @staticmethod
    def frame(answers: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(answers, columns=COLUMNS).astype({"of": "Int64"})

    def close(self) -> None:
        pass


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    # what a micro-batch, and so one key in it, can hold at most (but for larger files) is bounded
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream.option("maxBytesPerTrigger", BATCH_BYTES)
    return stream.parquet(path[:-1] + f"[{path[-1]}]")  # a pattern matches either


def replay_stream(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """ANSWER of each request of a stream of (seq, op, k, v); `of`: the seq of the write whose value it is.
    A request is answered from the write before it, in whatever order they arrive: when that write arrives later,
    the request is answered again, with a higher `of`. A request that is delivered again is not answered again."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a null key has no state of its own and is answered like a key that is missing
    keyed = log.where(F.col("k").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).groupBy("bucket")
    return keyed.transformWithStateInPandas(Replay(), ANSWER, "Append", "None")


def stream_replay(spark: SparkSession, path: str, folder: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The answers to all requests of a kv_log table, read as a stream to its present end.

    `folder` keeps the answers and the checkpoint: a later call with it goes on with new files only.
    """
    folder = folder or work_dir(spark, "replay")
    log = requests(file_stream(spark, path, files_per_trigger))
    answers = replay_stream(log).unionByName(log.where("k is null").select("seq", "k", "op", F.lit(2).alias("rc"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("bigint").alias("of")))
    query = answers.writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    # a request that was answered again, as an earlier write of its key came late: the latest write before it counts
    given = spark.read.schema(ANSWER).parquet(f"{folder}/answers")
    last = given.groupBy("seq").agg(F.max_by(F.struct("k", "op", "rc", "payload"), F.coalesce("of", F.lit(-(1 << 62)))).alias("a"))
    return last.select("seq", "a.*")


def stream_apply(spark: SparkSession, path: str, base: DataFrame, folder: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """(k, v, seq): `base` after all changes of a kv_log table, applied per micro-batch.

    The state is kept in APPLY_BUCKETS buckets of keys. Each batch writes a new version of the buckets that it touches, named
    by the batch's number; a batch that is run again after a failure writes the same version again. A small file per batch
    names the version of every bucket. Versions older than the last two are removed. Tombstones are kept in the versions, so that
    late changes do not bring a key back.
    """
    folder = folder or work_dir(spark, "applied")
    kinds = "k string, v string, seq bigint"
    bucket = F.pmod(F.xxhash64("k"), F.lit(APPLY_BUCKETS)).cast("int")

    def read(versions: dict) -> DataFrame:
        at = [f"{folder}/state/v={v}/b={b}" for b, v in versions.items()]
        return spark.read.schema(kinds).parquet(*at) if at else spark.createDataFrame([], kinds)

    def write(state: DataFrame, number: int) -> dict:
        state.withColumn("b", bucket).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{folder}/state/v={number}")
        system, at = opened(f"{folder}/state/v={number}")
        return {f.base_name[2:]: number for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("b=")}

    def known(number: int) -> dict:
        return json.loads(read_whole(f"{folder}/versions/{number:012d}.json"))

    def commit(versions: dict, number: int) -> None:
        write_whole(f"{folder}/versions/{number:012d}.json", [json.dumps(versions).encode()])

    system, at = opened(folder)
    if system.get_file_info(f"{at}/versions/{0:012d}.json").type == fs.FileType.NotFound:
        commit(write(base.select("k", "v", "seq").where(F.length("k") > 0), 0), 0)

    def apply(batch: DataFrame, number: int) -> None:
        number += 1  # version 0 is the base
        before = known(number - 1)
        batch = checkpoint(changes(batch))
        touched = {str(r[0]) for r in batch.select(bucket).distinct().collect()}
        new = apply_changes(read({b: v for b, v in before.items() if b in touched}), batch, tombstones=True)
        after = before | write(new, number)
        commit(after, number)
        used = {v for m in (before, after) for v in m.values()}
        # a version is removed when no bucket of this version or the last one is in it
        for f in system.get_file_info(fs.FileSelector(f"{at}/state")):
            if int(f.base_name[2:]) < number and int(f.base_name[2:]) not in used:
                system.delete_dir(f.path)

    query = file_stream(spark, path, files_per_trigger).writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(int(f.base_name[:-5]) for f in system.get_file_info(fs.FileSelector(f"{at}/versions")) if f.base_name.endswith(".json") and f.base_name[0] != ".")
    return read(known(last)).where("v is not null")
