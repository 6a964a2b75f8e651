"""Queries of the general data problems: 1 change feed, 4 small files, 5 increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.changes import apply_changes
from tidelog.operators.compaction import compact_log_files
from tidelog.operators.incremental import Increments, pending_changes
from tidelog.operators.lsm import healed_manifest
from tidelog.operators.skew import running_sum
from tidelog.schema import changes
from tidelog.session import checkpoint, table, work_dir
from tidelog.sources.parquet_blocks import MOST_GROUPS, TARGET, compact_parquet, write_groups

#: Bytes of a file that segments are put into.
SEGMENT_TARGET = 1 << 16
#: Last batches of the runs of p5_runs.
RUN_ENDS = (16, 32, 48)

_VALID = """
  SELECT seq, upper(trim(op)) AS op, k, v, shard, batch_no FROM kv_log
  WHERE seq IS NOT NULL AND length(k) > 0 AND (upper(trim(op)) = 'P' AND v IS NOT NULL OR upper(trim(op)) = 'D')"""


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv_log, kv_state = table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "kv_state")
    return apply_changes(kv_state, kv_log, total=kv_log.count() + kv_state.count())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_state(spark, sf_dir).select("k", "seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_log_files(table(spark, sf_dir, "wal_file")).sequence_numbers()


def _placed(own: DataFrame, target: int, least: int = 0) -> DataFrame:
    """Segments with the `file` each goes to, of about `target` bytes, in order of `sg` within a level; each counts `least` bytes at least."""
    placed = running_sum(own, "sg", F.greatest("bytes", F.lit(least)), "before", by=["lvl"])
    return placed.withColumn("file", F.floor(F.col("before") / target))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healed_manifest(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "kv_sst"))


def consolidate(spark: SparkSession, entries: DataFrame, segments: DataFrame, target: int = TARGET) -> tuple[DataFrame, DataFrame]:
    """The entries as one Parquet file per segment, whose blocks are copied into few files: the segments' files
    (path, lvl, sg, rows, bytes) and the WRITTEN rows of the new ones. A file takes segments of one level."""
    folder = work_dir(spark, "segments")
    small_files = write_groups(entries, ["lvl", "sg"], ["k", "seq"], folder)
    placed = _placed(segments, target, -(-target // MOST_GROUPS)).select(F.col("lvl").alias("_lvl"), F.col("sg").alias("_sg"), "file", "bytes")
    same = F.col("lvl").eqNullSafe(F.col("_lvl")) & F.col("sg").eqNullSafe(F.col("_sg"))
    placed = checkpoint(small_files.join(placed, same, "left").drop("_lvl", "_sg"))
    name = F.concat_ws("-", F.coalesce(F.col("lvl").cast("string"), F.lit("null")), F.lpad(F.coalesce("file", F.lit(0)).cast("string"), 9, "0"))
    _, written = compact_parquet(spark, folder, placing=placed.select("path", name.alias("name"), F.col("sg").alias("ord")))
    return placed, written


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of kv_sst, a Parquet file each, their column blocks copied into few files, read back."""
    entries = table(spark, sf_dir, "kv_sst")
    _, written = consolidate(spark, entries, _segments(spark, sf_dir))
    files = [r.file for r in written.select("file").collect()]
    return spark.read.schema(entries.schema).parquet(*files) if files else entries.limit(0)


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p4_blocks does, in one row: files and entries before and after."""
    placed, written = consolidate(spark, table(spark, sf_dir, "kv_sst"), _segments(spark, sf_dir))
    before = placed.agg(F.count("*").alias("files_before"), F.sum("rows").alias("n_before"))
    return before.crossJoin(written.agg(F.count("*").alias("files_after"), F.sum("n").alias("n_after"), F.sum("bytes").alias("bytes_after")))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the manifest, sizes mended from their entries, with the file of SEGMENT_TARGET bytes each goes to."""
    return _placed(_segments(spark, sf_dir), SEGMENT_TARGET).select("lvl", "sg", "bytes", "n", "file")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_changes(table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "run_log")).select("seq")


def open_marks(log: DataFrame, ends: tuple[int, ...]) -> list[int]:
    """For each of the batches `ends`, the least seq of a change that first arrives after it, as the source that has the open
    changes would tell it; beyond the last change where none does."""
    first = log.groupBy("seq").agg(F.min("batch_no").alias("batch_no"))
    own = first.agg(*[F.coalesce(F.min(F.when(F.col("batch_no") > end, F.col("seq"))), F.max("seq") + 1) for end in ends]).first()
    return [x or 0 for x in own]


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the growing log, each with all deliveries up to a batch, from the oldest change that was open when
    the run before it ended: the run that took up each change."""
    log = table(spark, sf_dir, "kv_log")
    valid = changes(log, "batch_no").select("k", "seq", "batch_no")
    runs, folder = Increments(spark, work_dir(spark, "runs")), work_dir(spark, "taken")
    for last, low in zip(RUN_ENDS, open_marks(valid, RUN_ENDS)):
        arrived = valid.where(F.col("batch_no") <= last).select("k", "seq")
        runs.run(arrived, lambda batch, n: batch.withColumn("run", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/n={n}"), low)
    return spark.read.parquet(*[f"{folder}/n={n}" for n in range(len(RUN_ENDS))]).select("seq", "run")


QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p4_found": p4_found, "p4_blocks": p4_blocks, "p4_files": p4_files, "p4_segments": p4_segments, "p5_found": p5_found, "p5_runs": p5_runs}

_P1 = f"""
  WITH c AS (SELECT k, CASE WHEN op = 'P' THEN v END AS v, seq FROM ({_VALID}) x
             UNION ALL SELECT k, v, seq FROM kv_state WHERE length(k) > 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM c)"""

SQL = {
    "p1_found": f"{_P1} SELECT k, seq FROM r WHERE rn = 1 AND v IS NOT NULL",
    "p1_state": f"{_P1} SELECT k, v, seq FROM r WHERE rn = 1 AND v IS NOT NULL",
    "p4_blocks": "SELECT * FROM kv_sst",
    "p4_segments": f"""
  WITH s AS (SELECT lvl, sg, CAST(sum(25 + strlen(k) + coalesce(strlen(v), 0)) AS bigint) AS own, count(*) AS n FROM kv_sst GROUP BY lvl, sg),
       t AS (SELECT lvl, sg, max(bytes) AS said FROM manifest GROUP BY lvl, sg),
       h AS (SELECT s.lvl, s.sg, coalesce(said, own) AS bytes, n FROM s LEFT JOIN t ON s.lvl = t.lvl AND s.sg = t.sg)
  SELECT lvl, sg, bytes, n, CAST(coalesce(sum(bytes) OVER (PARTITION BY lvl ORDER BY sg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) // {SEGMENT_TARGET} AS file FROM h""",
    "p5_runs": f"SELECT seq, min((batch_no - 1) // 16) AS run FROM ({_VALID}) x GROUP BY seq",
    "p5_found": f"""
  WITH ok AS (SELECT DISTINCT r.shard, r.batch_from, r.batch_to FROM run_log r
              WHERE r.run_id IN (SELECT run_id FROM run_log WHERE lower(trim(outcome)) = 'done')),
       d AS (SELECT seq, EXISTS (SELECT 1 FROM ok WHERE ok.shard = l.shard AND l.batch_no BETWEEN ok.batch_from AND ok.batch_to) AS c
             FROM kv_log l),
       s AS (SELECT DISTINCT seq FROM ({_VALID}) x)
  SELECT s.seq FROM s WHERE s.seq NOT IN (SELECT seq FROM d WHERE c AND seq IS NOT NULL)""",
}
