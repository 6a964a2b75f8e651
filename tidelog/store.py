"""A store in a folder: writes go to a log, reads see the log over the levels, flush and compaction move data
down, and opening it again recovers from the log. Everything is batches; one writer at a time.

    store = Store(spark, folder)
    store.write(changes)          # (ord, op, k, v), returns (seq, k, op, rc, payload) with the values before
    store.multi_get(keys); store.get("k"); store.state()
    store.flush(); store.compact()
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import kv, lsm
from tidelog.operators.skew import running_sum
from tidelog.schema import GET, operation, valid_change
from tidelog.sources.files import opened, read_whole, write_new

#: Bytes of log after which a write flushes.
FLUSH_AT = 1 << 30
LOG = "seq bigint, op string, k string, v string"


class Store:
    def __init__(self, spark: SparkSession, folder: str, flush_at: int = FLUSH_AT, level_target: int = 256 << 20):
        """Opens the store, or begins one. What a write that died has left is not in it."""
        self.spark, self.folder, self.flush_at, self.level_target = spark, folder.rstrip("/"), flush_at, level_target
        self.levels = lsm.Levels(spark, f"{self.folder}/tree")

    def _parts(self) -> list[dict]:
        """[{"part", "end"}] of the committed batches of the log, in order; end: the log's length after it."""
        from pyarrow import fs

        system, path = opened(f"{self.folder}/commits")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [json.loads(read_whole(f"{self.folder}/commits/{f.base_name}")) for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".json") and f.base_name[0] != "."]

    def log(self, start: int | None = None) -> DataFrame:
        """Writes with a seq above `start`, by default those that are not flushed: what recovery replays."""
        start = self.levels.highest() if start is None else start
        parts = [p["part"] for p in self._parts() if start is None or p["end"] > start]
        if not parts:
            return self.spark.createDataFrame([], LOG)
        log = self.spark.read.schema(LOG).parquet(*[f"{self.folder}/log/{p}" for p in parts])
        return log if start is None else log.where(F.col("seq") > start)

    def write(self, requests: DataFrame) -> DataFrame:
        """Appends the puts and deletes of `requests` (ord bigint unique, op, k, v) in order of `ord`, and answers all
        its requests: the value before, among writes that are not flushed. Requests that are neither a get nor
        a valid change are answered by a code: 6 a put without value, 7 another malformed one.

        A seq is the log's length when the record was appended; gets have none. The batch is there as a whole,
        once its commit has been renamed into place, or not at all.
        """
        parts = self._parts()
        end = parts[-1]["end"] if parts else 0
        part = f"{int(parts[-1]['part']) + 1 if parts else 0:012d}"
        r = requests.select("ord", operation(F.col("op")).alias("op"), "k", "v")
        # puts and deletes with the log's bytes before them
        good = r.where(valid_change(F.col("op"), F.col("k"), F.col("v"))).withColumn("v", F.when(F.col("op") == "P", F.col("v")))
        placed = running_sum(good, "ord", kv.record_size(F.col("op"), F.col("k"), F.col("v")), "before")
        rows = placed.select("ord", (F.col("before") + end).alias("seq"), "op", "k", "v")
        staged = f"{self.folder}/log/{part}"
        rows.write.mode("overwrite").parquet(staged)
        written = self.spark.read.schema(f"ord bigint, {LOG}").parquet(staged)
        size = written.agg(F.coalesce(F.sum(kv.record_size(F.col("op"), F.col("k"), F.col("v"))), F.lit(0))).first()[0]
        older = kv.newest(self.log())
        write_new(f"{self.folder}/commits/{part}.json", json.dumps({"part": part, "end": end + size}).encode())
        gets = r.where(F.coalesce(F.col("op") == GET, F.lit(False)))
        answers = self._answers(written.select("ord", "seq", "op", "k", "v").unionByName(gets.select("ord", F.lit(None).cast("bigint").alias("seq"), "op", "k", F.lit(None).cast("string").alias("v"))), older)
        bad = r.where(~valid_change(F.col("op"), F.col("k"), F.col("v")) & ~F.coalesce(F.col("op") == GET, F.lit(False)))
        code = F.when(F.coalesce((F.col("op") == "P") & (F.length("k") > 0), F.lit(False)), 6).otherwise(7)
        out = answers.unionByName(bad.select("ord", F.lit(None).cast("bigint").alias("seq"), "k", "op", code.alias("rc"), F.lit(None).cast("string").alias("payload")))
        if end + size - (self.levels.highest() or 0) > self.flush_at:
            # the answers are of the log as it was; what is flushed now stays readable in its parts
            self.flush()
            self.compact()
        return out

    def _answers(self, batch: DataFrame, older: DataFrame) -> DataFrame:
        begun = batch.select("ord", "op", "k", "v").unionByName(older.select(F.lit(-1).cast("bigint").alias("ord"), F.lit("P").alias("op"), "k", "v"))
        replayed = kv.replay(begun.withColumnRenamed("ord", "seq")).where("seq >= 0").withColumnRenamed("seq", "ord")
        # a get sees the levels too, if the log has nothing of its key
        seqs = batch.select("ord", "seq")
        seen = batch.where(F.col("op") != GET).groupBy("k").agg(F.min("ord").alias("_first"))
        base = self.levels.state().select("k", F.col("v").alias("_base")).join(older.select("k"), "k", "left_anti")
        out = replayed.join(seqs, "ord").join(seen, "k", "left").join(base, "k", "left")
        falls = (F.col("op") == GET) & (F.col("_first").isNull() | (F.col("ord") < F.col("_first")))
        payload = F.when(falls & F.col("payload").isNull(), F.col("_base")).otherwise(F.col("payload"))
        return out.select("ord", "seq", "k", "op", F.when((F.col("op") == GET) & payload.isNull(), kv.NOT_FOUND).otherwise(kv.OK).alias("rc"), payload.alias("payload"))

    def state(self) -> DataFrame:
        """(k, v) of all keys: the log over the levels."""
        return kv.merge_on_read(kv.newest(self.log()), self.levels.state())

    def get(self, key: str) -> str | None:
        row = kv.newest(self.log().where(F.col("k") == key)).first()
        return row["v"] if row else self.levels.get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(k, rc, v) of each row of `keys`."""
        return kv.multi_get(keys, self.state())

    def flush(self) -> None:
        """The unflushed log as a new part of level 0; recovery then starts after it. Parts of the log that were flushed
        before are removed: those that this flush has taken may still be read by answers that were given."""
        old = self.levels.highest()
        self.levels.flush(kv.newest(self.log()))
        self.drop(old)

    def drop(self, seq: int | None) -> int:
        """Removes the parts of the log that hold nothing above `seq`, the last one excepted; how many. A part goes before its
        commit, which, if this is cut short, names a part that is no longer read."""
        system, path = opened(self.folder)
        gone = [p for p in self._parts()[:-1] if seq is not None and p["end"] <= seq]
        for p in gone:
            if system.get_file_info(f"{path}/log/{p['part']}").type.name == "Directory":
                system.delete_dir(f"{path}/log/{p['part']}")
            system.delete_file(f"{path}/commits/{p['part']}.json")
        return len(gone)

    def compact(self) -> None:
        self.levels.compact(self.level_target)
