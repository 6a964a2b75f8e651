"""Only new or changed records, through failures (problem 5).

A run that ended well has taken up the batches of its shard that it covers. The next run reads again
from the oldest change that is still open, i.e. was delivered in a batch that no such run covers, and an
anti-join of (key, version) pairs with the ledger of what was taken up removes the overlap.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.schema import operation, valid_change
from tidelog.session import checkpoint, small
from tidelog.sources.files import opened, read_whole, write_new


def covered_batches(run_log: DataFrame) -> DataFrame:
    """(shard, batch_no): distinct batches that a successful run covers. A run is successful if one of
    its rows says done; its shard and batches are those of any of its rows. Rows without one of these,
    or with batches in the wrong order, cover nothing. At most shards times batches, however many rows."""
    done = run_log.where(F.lower(F.trim("outcome")) == "done").select("run_id").distinct()
    runs = run_log.where("shard is not null and batch_from <= batch_to").join(done, "run_id", "left_semi")
    return runs.select("shard", F.explode(F.sequence("batch_from", "batch_to")).alias("batch_no")).distinct()


#: Shards up to which the batches that all of them have taken up are left out of the scan.
PRUNED_SHARDS = 1000


def maybe_open(covered: DataFrame) -> Column:
    """Whether a row of the log, by its shard and batch, may be one that no run has taken up: true but for the batches from
    the first one on that the runs cover without a gap, in every shard that they know. A plain comparison, for the scan."""
    at = Window.partitionBy("shard").orderBy("batch_no")
    runs = covered.withColumn("_gap", F.col("batch_no") - F.row_number().over(at)).withColumn("_first", F.first("_gap").over(at))
    first = runs.where("_gap = _first").groupBy("shard").agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi"))
    shards = first.limit(PRUNED_SHARDS + 1).collect()
    lo, hi = max((r.lo for r in shards), default=0), min((r.hi for r in shards), default=-1)
    if lo > hi or len(shards) > PRUNED_SHARDS:
        return F.lit(True)
    batch = F.col("batch_no")
    return (batch < lo) | (batch > hi) | batch.isNull() | F.col("shard").isNull() | ~F.col("shard").isin([r.shard for r in shards])


def pending_changes(kv_log: DataFrame, run_log: DataFrame) -> DataFrame:
    """(seq, op, k, v, shard): each valid change of `kv_log` of which no delivery is in a covered batch, once.

    Late and repeated deliveries are found by (k, seq), so a change whose record came in a covered batch
    is never repeated, and one that came only in batches of failed, killed or unended runs is never
    skipped. Rows without seq, shard or batch are not covered by any run; without seq they are no record.
    Without successful runs, all valid changes are pending. Columns of other names are ignored.

    Batches that all shards have taken up are not read for changes; of the ledger, the (k, seq) of the covered batches, only
    what is not older than the oldest change that is still open. Both are filters of the scan.
    """
    fields = ["shard", "batch_no"]
    covered = checkpoint(covered_batches(run_log))
    log = kv_log.select("seq", operation(F.col("op")).alias("op"), "k", "v", *fields).where("seq is not null")
    read = log.where(maybe_open(covered)).where(valid_change(F.col("op"), F.col("k"), F.col("v")))
    done = small(covered)
    again = read.join(done, (read["shard"] == done["shard"]) & (read["batch_no"] == done["batch_no"]), "left_anti")
    oldest = again.agg(F.min("seq")).first()[0]
    if oldest is not None:
        ledger = log.where(F.col("seq") >= oldest).join(done, fields, "left_semi").select("k", "seq")
        again = again.join(ledger, ["k", "seq"], "left_anti")
    new = again.select("seq", "op", "k", F.when(F.col("op") == "P", F.col("v")).alias("v"), "shard")
    return new.dropDuplicates(["k", "seq"])


#: Batches in the ledger, after which they are written as one.
LEDGER_BATCHES = 32


class Increments:
    """Runs over a growing table of (k, seq) records, each record in one committed run, through failures.

    A run freezes its batch in the folder, hands it to `process` with the run's number, and commits with one
    small file that is renamed into place. If it dies before that, the next run has the same number and a
    new batch in its place; `process` must put what it writes under the run's number, so that a
    repeated run replaces it. The batches of committed runs are the ledger: the last commit names those that reach up to the
    oldest record that was open, older ones are of no more use. Of two runs at the same time one fails to commit.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> dict | None:
        """The last commit: "run", "low", the oldest seq open when it ended, and "ledger", [{"path", "hi"}]. None before the first."""
        from pyarrow import fs

        system, path = opened(f"{self.folder}/commits")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [f.base_name for f in found if f.base_name.endswith(".json") and f.base_name[0] != "."]
        return json.loads(read_whole(f"{self.folder}/commits/{max(names)}")) if names else None

    def pending(self, source: DataFrame) -> DataFrame:
        """Records of `source` (k, seq and any other columns) that no committed run has taken up.

        The source is read again from the oldest record that was open when the last run committed; (k, seq)
        pairs of the ledger from there on are taken off. Both are filters of the scan. Repeated rows of a pair count once.
        """
        last, rows = self.last(), source.where("seq is not null")
        if last:
            rows = rows if last["low"] is None else rows.where(F.col("seq") >= last["low"])
            if last["ledger"]:
                ledger = self._ledger(last["ledger"], last["low"])
                rows = rows.join(ledger, (rows["seq"] == ledger["seq"]) & rows["k"].eqNullSafe(ledger["k"]), "left_anti")
        return rows.dropDuplicates(["k", "seq"])

    def _ledger(self, parts: list[dict], low: int | None) -> DataFrame:
        pairs = self.spark.read.parquet(*[f"{self.folder}/{p['path']}" for p in parts]).select("k", "seq")
        return pairs if low is None else pairs.where(F.col("seq") >= low)

    def run(self, source: DataFrame, process: Callable[[DataFrame, int], None], oldest_open: int | None = None) -> int:
        """One run; returns its number. `oldest_open`: the least seq at which records may still arrive, before
        which no run has to look; without it that of the run before. It never goes down: older records are no longer known."""
        last = self.last() or {"run": -1, "low": None, "ledger": []}
        number = last["run"] + 1
        oldest_open = max((x for x in (oldest_open, last["low"]) if x is not None), default=None)
        path = f"batches/{number}-{uuid.uuid4().hex}"
        self.pending(source).write.parquet(f"{self.folder}/{path}")
        batch = self.spark.read.parquet(f"{self.folder}/{path}")
        process(batch, number)
        hi = batch.agg(F.max("seq")).first()[0]
        ledger = [*last["ledger"], *([{"path": path, "hi": hi}] if hi is not None else [])]
        ledger = [p for p in ledger if oldest_open is None or p["hi"] >= oldest_open]
        if len(ledger) > LEDGER_BATCHES:
            one = f"ledger/{number}"
            self._ledger(ledger, oldest_open).write.mode("overwrite").parquet(f"{self.folder}/{one}")
            ledger = [{"path": one, "hi": max(p["hi"] for p in ledger)}]
        commit = {"run": number, "low": oldest_open, "ledger": ledger}
        write_new(f"{self.folder}/commits/{number:012d}.json", json.dumps(commit).encode())
        return number
