"""Sorted segments in levels: flush, lookup, statistics, overlap, compaction.

Entries are (lvl, sg, k, v, seq), null v a tombstone; a manifest has a row per segment. On disk a segment is
a Parquet file sorted by k, whose row-group statistics and bloom filter serve as index.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.skew import range_of, running_sums
from tidelog.sources.files import opened, read_whole, write_new

#: Size of the next level, in sizes of the one above.
RATIO = 10
#: Levels grow tenfold each, so there are never as many.
MOST_LEVELS = 64


def entry_size(k: Column, v: Column) -> Column:
    """Estimated bytes of an entry; a tombstone is charged as much overhead as a value."""
    return (25 + F.octet_length(k) + F.coalesce(F.octet_length(v), F.lit(0))).cast("bigint")


def segment_stats(entries: DataFrame) -> DataFrame:
    """Manifest rows (lvl, sg, mn, mx, hi, bytes, n) of entries."""
    return entries.groupBy("lvl", "sg").agg(F.min("k").alias("mn"), F.max("k").alias("mx"), F.max("seq").alias("hi"), F.sum(entry_size(F.col("k"), F.col("v"))).cast("bigint").alias("bytes"), F.count("*").alias("n"))


def healed_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """One right row per segment that has entries: key range, highest seq and number are those of its
    entries; bytes are the manifest's largest or, where it has none, the entries' estimate."""
    said = manifest.groupBy("lvl", "sg").agg(F.max("bytes").alias("_said"))
    own = segment_stats(entries)
    return own.join(said, ["lvl", "sg"], "left").select("lvl", "sg", "mn", "mx", "hi", F.coalesce("_said", "bytes").alias("bytes"), "n")


def level_stats(manifest: DataFrame, target: int, ratio: int = RATIO) -> DataFrame:
    """(lvl, bytes, segments, over): whether a level's segments exceed its target, `target` times ratio^lvl.
    Repeated rows of a segment count once, with its largest size; a segment of unknown size counts nothing."""
    each = manifest.groupBy("lvl", "sg").agg(F.max("bytes").alias("b"))
    total = each.groupBy("lvl").agg(F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("segments"))
    return total.withColumn("over", F.col("bytes") > F.lit(target) * F.pow(F.lit(ratio), F.col("lvl")))


def pick_newest(entries: DataFrame) -> DataFrame:
    """(k, v, seq): the entry of the highest seq; of copies the one of the lowest level, then the one with a
    value, then the largest value."""
    best = entries.groupBy("k").agg(F.max(F.struct(F.col("seq"), (-F.col("lvl")).alias("l"), F.col("v").isNotNull().alias("h"), F.col("v"))).alias("r"))
    return best.select("k", "r.v", "r.seq")


def level_lookup(entries: DataFrame) -> DataFrame:
    """(k, v, seq): the first hit from the top level down, the newest within a level; tombstones included."""
    best = entries.groupBy("k").agg(F.max(F.struct((-F.col("lvl")).alias("l"), F.col("seq"), F.col("v").isNotNull().alias("h"), F.col("v"))).alias("r"))
    return best.select("k", "r.v", "r.seq")


def compact(entries: DataFrame, bottom: bool = True) -> DataFrame:
    """Levels merged: the newest entry of each key; tombstones are dropped only at the bottom level."""
    out = pick_newest(entries)
    return out.where(F.col("v").isNotNull()) if bottom else out


def containing_segments(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(k, lvl, sg) of the segments of levels 1 and below whose range holds the key: ranges of a level do not
    overlap, so it is the one with the last `mn` up to the key. Found by order, not by pairs."""
    own = manifest.where("lvl >= 1 and mn is not null and mx is not null").groupBy("lvl", "sg").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    levels = [r[0] for r in own.select("lvl").distinct().limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    asked = keys.select("k").distinct().select("k", F.explode(F.lit(levels) if levels else F.array().cast("array<int>")).alias("lvl"))
    starts = own.select("lvl", F.col("mn").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("one"), "sg", "mx")
    rows = starts.unionByName(asked.select("lvl", F.col("k").alias("at"), F.lit(1).alias("o"), F.lit(0).alias("one")), True)
    ranked = running_sums(rows, ["at", "o"], {"before": F.col("one")}, ["lvl"])
    held = ranked.where("one = 1").select("lvl", (F.col("before") + 1).alias("before"), "sg", "mx")
    hits = ranked.where("one = 0").select("lvl", F.col("at").alias("k"), "before").join(held, ["lvl", "before"])
    return hits.where("k <= mx").select("k", "lvl", "sg")


def overlaps(manifest: DataFrame) -> DataFrame:
    """(lvl, sg, n_next): how many segments of the next level have keys in the segment's range.

    Those that start up to its end, less those that end before its start: two running counts over the
    sorted ends, instead of the pairs, of which there may be segments squared.
    """
    own = manifest.where("mn is not null and mx is not null").groupBy("lvl", "sg").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    none = F.lit(0)
    lower = own.withColumn("to", F.col("lvl") - 1)
    rows = (
        lower.select("to", F.col("mn").alias("at"), none.alias("o"), F.lit(1).alias("starts"), none.alias("ends"), none.alias("ask"), "sg")
        .union(lower.select("to", F.col("mx"), F.lit(2), none, F.lit(1), none, "sg"))
        .union(own.select("lvl", F.col("mx"), F.lit(1), none, none, F.lit(1), "sg"))
        .union(own.select("lvl", F.col("mn"), F.lit(1), none, none, F.lit(-1), "sg"))
    )
    counted = running_sums(rows, ["at", "o", "ask", "sg"], {"s": F.col("starts"), "e": F.col("ends")}, ["to"])
    answers = counted.where("ask <> 0").select(F.col("to").alias("lvl"), "sg", F.when(F.col("ask") == 1, F.col("s")).otherwise(-F.col("e")).alias("x"))
    return answers.groupBy("lvl", "sg").agg(F.sum("x").cast("bigint").alias("n_next"))


def intervals(parts: list[dict]) -> list[tuple[str, str]]:
    """Ranges of keys, in order, that segments cover together: those that overlap are one."""
    out: list[tuple[str, str]] = []
    for mn, mx in sorted((p["mn"], p["mx"]) for p in parts):
        if out and mn <= out[-1][1]:
            out[-1] = (out[-1][0], max(mx, out[-1][1]))
        else:
            out.append((mn, mx))
    return out


def overlapping(parts: list[dict], ranges: list[tuple[str, str]]) -> list[dict]:
    """The segments that have a part in some range; the ranges are in order and apart."""
    starts = [r[0] for r in ranges]
    at = lambda p: bisect_right(starts, p["mx"]) - 1
    return [p for p in parts if at(p) >= 0 and ranges[at(p)][1] >= p["mn"]]


class Levels:
    """A tree of levels in a folder: a Parquet file per segment and a numbered manifest of what is live.

    Segments of level 0 overlap, those of a lower level do not. Readers pin a version by reading its manifest once; a new
    version is one file that is renamed into place, so a crash leaves the old one. Files that no kept version names can be
    vacuumed. A manifest has some hundred bytes per segment, not per row: the driver reads it whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        from pyarrow import fs

        system, path = opened(f"{self.folder}/versions")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), default=0)

    def live(self, version: int | None = None) -> list[dict]:
        """[{"lvl", "file", "mn", "mx", "hi", "bytes", "n", "born"}] of a version, a row per segment; an absent manifest is
        an empty tree. born: the version in which the segment came."""
        version = self.version() if version is None else version
        return json.loads(read_whole(f"{self.folder}/versions/{version:012d}.json")) if version else []

    def _commit(self, parts: list[dict]) -> None:
        new = self.version() + 1
        write_new(f"{self.folder}/versions/{new:012d}.json", json.dumps([{"born": new} | p for p in parts]).encode())

    def _read(self, parts: list[dict]) -> DataFrame:
        out = self.spark.createDataFrame([], "lvl int, k string, v string, seq bigint")
        for lvl in sorted({p["lvl"] for p in parts}):
            files = [f"{self.folder}/{p['file']}" for p in parts if p["lvl"] == lvl]
            out = out.unionByName(self.spark.read.schema("k string, v string, seq bigint").parquet(*files).select(F.lit(lvl).alias("lvl"), "k", "v", "seq"))
        return out

    def entries(self, version: int | None = None) -> DataFrame:
        return self._read(self.live(version))

    def _write(self, rows: DataFrame, lvl: int, ranges: list[tuple[str, str]] | None = None) -> list[dict]:
        """The new segments; none goes over the borders of two of `ranges`."""
        name = f"segments/{uuid.uuid4().hex}"
        step, starts = max(1, round(len(ranges or []) ** 0.5)), [r[0] for r in ranges or []][1:]
        text = lambda some: F.from_json(F.lit(json.dumps(some)), "array<string>")
        part = range_of(F.concat("k", F.lit("\0")), text(starts), text(starts[step - 1 :: step]), F.lit(step)) if starts else F.lit(0)
        sorted_ = rows.select("k", "v", "seq", part.alias("i")).repartitionByRange("i", "k").sortWithinPartitions("i", "k")
        sorted_.write.partitionBy("i").option("parquet.bloom.filter.enabled#k", "true").parquet(f"{self.folder}/{name}")
        written = self.spark.read.schema("k string, v string, seq bigint, i int").parquet(f"{self.folder}/{name}")
        file = F.concat(F.lit(f"{name}/"), F.substring_index(F.input_file_name(), f"{name}/", -1))
        stats = written.groupBy(file.alias("file")).agg(F.min("k").alias("mn"), F.max("k").alias("mx"), F.max("seq").alias("hi"), F.sum(entry_size(F.col("k"), F.col("v"))).alias("bytes"), F.count("*").alias("n"))
        return [{"lvl": lvl} | r.asDict() for r in stats.orderBy("mn", "file").collect()]

    def flush(self, state: DataFrame) -> None:
        """New segments of level 0 from newest rows (k, v, seq), tombstones included."""
        parts = self._write(state, 0)
        if parts:
            self._commit([*self.live(), *parts])

    def highest(self) -> int | None:
        """The highest seq flushed: recovery of the log starts after it."""
        return max((p["hi"] for p in self.live()), default=None)

    @staticmethod
    def to_merge(parts: list[dict], lvl: int, most: int) -> list[dict]:
        """The segments of a level that are to go down, if it exceeds `most` bytes: all of level 0; of a lower one the oldest,
        until the rest is within it."""
        own = sorted((p for p in parts if p["lvl"] == lvl), key=lambda p: (p["born"], p["mn"]))
        left = sum(p["bytes"] for p in own)
        if left <= most or lvl == 0:
            return own if left > most else []
        taken = []
        while left > most:
            taken.append(own[len(taken)])
            left -= taken[-1]["bytes"]
        return taken

    def compact(self, target: int, ratio: int = RATIO) -> None:
        """Merges what exceeds a level's target into the next level, from the top down. Of the next level only segments that
        overlap with what comes are written anew, by intervals of keys; the others stay as they are."""
        lvl = 0
        while True:
            parts = self.live()
            taken = self.to_merge(parts, lvl, target * ratio**lvl)
            if taken:
                met = overlapping([p for p in parts if p["lvl"] == lvl + 1], intervals(taken))
                gone = {p["file"] for p in [*taken, *met]}
                rows = pick_newest(self._read([*taken, *met]))
                if not any(p["lvl"] > lvl + 1 for p in parts):
                    rows = rows.where(F.col("v").isNotNull())
                new = self._write(rows, lvl + 1, intervals([*taken, *met]))
                self._commit([*(p for p in parts if p["file"] not in gone), *new])
            elif not any(p["lvl"] > lvl for p in parts):
                return
            lvl += 1

    def state(self, version: int | None = None) -> DataFrame:
        return pick_newest(self.entries(version))

    def holding(self, key: str, version: int | None = None) -> list[dict]:
        """The segments whose range holds a key: of a level below 0 at most one."""
        return [p for p in self.live(version) if p["mn"] <= key <= p["mx"]]

    def get(self, key: str) -> str | None:
        """One key's value. Only segments that may hold it are opened; the filter reaches their statistics and bloom filters."""
        row = pick_newest(self._read(self.holding(key)).where(F.col("k") == key)).first()
        return row and row["v"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files of no version but the last `keep`; returns how many segments went."""
        from pyarrow import fs

        last = self.version()
        used = {p["file"] for v in range(max(1, last - keep + 1), last + 1) for p in self.live(v)}
        system, path = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(f"{path}/segments", recursive=True, allow_not_found=True))
        gone = [f for f in found if f.is_file and f.base_name.startswith("part-") and f.path[len(path) + 1 :] not in used]
        for f in gone:
            system.delete_file(f.path)
        return len(gone)
