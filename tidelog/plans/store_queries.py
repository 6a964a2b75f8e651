"""Queries of the store's own operators, over the whole tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import wire
from tidelog.functions.segments import ends_after, segment_name
from tidelog.operators import kv, lsm, serve
from tidelog.operators.skew import running_sum
from tidelog.operators.wal import decode_files, encode_records, file_status, truncated
from tidelog.schema import GET, changes, requests
from tidelog.session import checkpoint, table, work_dir
from tidelog.sources.kvwal import KvWal
from tidelog.streaming.replay import stream_apply, stream_replay

#: Offset of the log of the test tables.
BASE = 1 << 55
SEGMENT, SMALL_SEGMENT = 65536, 4096
PRUNE_FROM, RECOVER_FROM = 100_000, BASE + 400_000
LEVEL_TARGET = 20_000


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The request log, with repeated deliveries, and the number of rows of its table."""
    raw = table(spark, sf_dir, "kv_log")
    return requests(raw), raw.count()


def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.latest(_log(spark, sf_dir)[0])


def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.tombstones(_log(spark, sf_dir)[0])


def kv_prev_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.previous_values(*_log(spark, sf_dir))


def kv_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(*_log(spark, sf_dir))


def kv_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.merge_on_read(kv.newest(_log(spark, sf_dir)[0]), table(spark, sf_dir, "kv_state"))


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "key_probe").where(F.length("k") > 0).select("k").distinct()
    return kv.multi_get(keys, kv_merge_on_read(spark, sf_dir))


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "kv_state")
    key = state.where("v is not null").agg(F.max("k")).first()[0]
    return kv.get(_log(spark, sf_dir)[0], state, key)


def kv_recover_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.recover_from(_log(spark, sf_dir)[0], RECOVER_FROM)


def kv_recover_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state before the first corrupt record, taken to be the first one in the last tenth of the log."""
    log = _log(spark, sf_dir)[0]
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    return kv.recover_prefix(log, F.lit(False) if lo is None else F.col("seq") >= lo + (hi - lo) * 9 // 10)


def wal_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of each write in a log without padding."""
    writes = changes(table(spark, sf_dir, "kv_log"))
    writes = writes.groupBy("seq", "op", "k", "v").agg(F.lit(1).alias("_")).drop("_")
    n = kv.record_size(F.col("op"), F.col("k"), F.col("v"))
    return running_sum(writes.select("seq", n.alias("n")), "seq", F.col("n"), "lsn")


def wal_segment_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal_lsn(spark, sf_dir).select("seq", segment_name(F.col("lsn"), SEGMENT).alias("segment"))


def wal_segment_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that recovery from a start has to read, with their numbers of records."""
    placed = wal_lsn(spark, sf_dir).withColumn("segment", F.floor(F.col("lsn") / SMALL_SEGMENT))
    ends = placed.groupBy("segment").agg(F.max(F.col("lsn") + F.col("n")).alias("ends"), F.count("*").alias("n"))
    return ends.where(F.col("ends") > PRUNE_FROM)


def wal_name_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of wal_file that can hold records from a start on, by their names alone."""
    files = table(spark, sf_dir, "wal_file").select("path", F.octet_length("content").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(ends_after(name, F.col("size"), 16, F.lit((1 << 54) + 20_000))).select("path", "size")


def wal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_files(table(spark, sf_dir, "wal_file"))


def wal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_status(table(spark, sf_dir, "wal_file"))


def wal_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each write as a record: its bytes and checksum."""
    return encode_records(changes(table(spark, sf_dir, "kv_log"))).select("seq", F.length("record").alias("n"), "crc")


def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct writes as log folders, one per task, and read back."""
    spark.dataSource.register(KvWal)
    folder = work_dir(spark, "logs")
    writes = changes(table(spark, sf_dir, "kv_log")).select("seq", "op", "k", "v").distinct()
    writes.sortWithinPartitions("seq").select("op", "k", "v").write.format("kvwal").option("segmentSize", SEGMENT).mode("append").save(folder)
    return spark.read.format("kvwal").option("segmentSize", SEGMENT).load(folder).select("op", "k", "v")


def wal_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct writes in log folders that are written in two goes, the second of which goes on where the first
    stopped, and read back with the log each is in: no log has a sequence number twice."""
    spark.dataSource.register(KvWal)
    folder = work_dir(spark, "logs")
    writes = changes(table(spark, sf_dir, "kv_log")).select("seq", "op", "k", "v").distinct()
    half = writes.agg((F.min("seq") + F.max("seq")) / 2).first()[0] or 0
    for part in (writes.where(F.col("seq") < half), writes.where(F.col("seq") >= half)):
        rows = part.sortWithinPartitions("seq").select("op", "k", "v")
        rows.write.format("kvwal").option("segmentSize", SMALL_SEGMENT).option("resume", "true").mode("append").save(folder)
    read = spark.read.format("kvwal").option("segmentSize", SMALL_SEGMENT).load(folder)
    log = F.regexp_extract("file", "([^/]*)/[^/]*$", 1)
    return read.groupBy(log.alias("log"), "seq").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("op", "k", "v")]).select("times", "op", "k", "v")


def wal_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that are left of each file when what cannot be read is cut off."""
    return truncated(table(spark, sf_dir, "wal_file")).select("path", F.length("content").alias("bytes"))


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = kv.newest(_log(spark, sf_dir)[0])
    return state.select(F.lit(0).alias("lvl"), F.substring("k", 1, 11).alias("sg"), "k", "v", "seq")


def sst_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows, tombstones included, written as segments of level 0, read back, and described by ranges of keys."""
    tree = lsm.Levels(spark, work_dir(spark, "tree"))
    tree.flush(kv.newest(_log(spark, sf_dir)[0]))
    return lsm.segment_stats(tree.entries().withColumn("sg", F.substring("k", 1, 11))).drop("lvl")


def sst_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four flushes, with compaction after each, down to where it stops: the state read from the levels."""
    log, tree = _log(spark, sf_dir)[0], lsm.Levels(spark, work_dir(spark, "tree"))
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    borders = [lo + (hi - lo) * i // 4 for i in range(5)] if lo is not None else []
    for i, (a, b) in enumerate(zip(borders, borders[1:])):
        tree.flush(kv.newest(log.where((F.col("seq") >= a) & ((F.col("seq") < b) | F.lit(i == 3)))))
        tree.compact(LEVEL_TARGET)
    return tree.state().where("v is not null")


def sst_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.healed_manifest(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "kv_sst"))


def sst_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.level_stats(table(spark, sf_dir, "manifest"), LEVEL_TARGET)


def sst_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.overlaps(table(spark, sf_dir, "manifest"))


def sst_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each asked key, the segments of the partitioned levels that a lookup has to open."""
    state = kv.newest(_log(spark, sf_dir)[0])
    levels = F.when(F.col("seq") % 3 == 0, 1).otherwise(2).alias("lvl")
    own = lsm.segment_stats(state.select(levels, F.substring("k", 1, 11).alias("sg"), "k", "v", "seq"))
    return lsm.containing_segments(table(spark, sf_dir, "key_probe").where(F.length("k") > 0), own)


def sst_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.compact(table(spark, sf_dir, "kv_sst"))


def sst_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.level_lookup(table(spark, sf_dir, "kv_sst"))


def sst_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest sequence number of all segments, after which recovery of the log starts."""
    return table(spark, sf_dir, "kv_sst").agg(F.max("seq").alias("hi"), F.count_distinct("sg").alias("segments"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of each distinct delivery, as its client would send it, valid or not."""
    raw = table(spark, sf_dir, "kv_log").select("seq", F.upper(F.trim("op")).alias("op"), "k", "v").distinct()
    return raw.select("seq", wire.encode_request(wire.correlation_id(F.col("seq")), F.col("op"), F.col("k"), F.col("v")).alias("frame"))


def wire_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("seq", F.hex("frame").alias("frame"))


def wire_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = wire.decode_requests(_frames(spark, sf_dir))
    return parsed.select("seq", "corr", "op", "k", "v", kv.return_code(F.col("error")).alias("rc"))


def wire_respond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response to each request of the log, in bytes."""
    answers = kv_replay(spark, sf_dir)
    return answers.select("seq", F.hex(wire.encode_response(wire.correlation_id(F.col("seq")), F.col("rc"), F.col("payload"))).alias("response"))


def _harmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the log, one in eleven harmed in one of nine ways, told by the seq."""
    frames = _frames(spark, sf_dir)
    raw, n = F.hex("frame"), F.pmod(F.col("seq"), F.lit(99))
    put = lambda at, two: F.concat(F.substring(raw, 1, at), F.lit(two), F.expr(f"substring(hex(frame), {at + len(two) + 1})"))
    harmed = (
        F.when(n == 0, put(8, "00"))  # magic
        .when(n == 11, put(48, "01"))  # version
        .when(n == 22, put(50, "03"))  # type: a ping
        .when(n == 33, put(50, "FF"))
        .when(n == 44, F.expr("substring(hex(frame), 1, length(hex(frame)) - 2)"))  # cut off
        .when(n == 55, F.concat(raw, F.lit("00")))  # a byte too many
        .when(n == 66, F.substring(raw, 1, 40))  # no headers
        .when(n == 77, F.when(F.length("frame") > 36, put(72, "FF")).otherwise(raw))  # first byte of the key
        .when(n == 88, put(64, "7FFFFFFF"))  # length of the key
        .otherwise(raw)
    )
    return checkpoint(frames.select("seq", F.unhex(harmed).alias("frame")))


def wire_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, some of them harmed, to responses."""
    return serve.respond(_harmed(spark, sf_dir)).select("seq", "corr", "rc", F.hex("response").alias("response"))


FILE_BYTES = 4096


def _made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes of the log as raw files, by ranges of seq: of three, one is as it is, one has the last byte of its
    record in the middle changed, and one ends in padding."""
    records = encode_records(changes(table(spark, sf_dir, "kv_log")))
    of = F.floor((F.col("seq") - BASE) / FILE_BYTES)
    # a file has some ten records, as many as fit a range of seq
    files = records.groupBy(of.alias("file")).agg(F.sort_array(F.collect_list(F.struct("seq", "record"))).alias("r"))
    middle = F.floor(F.size("r") / 2).cast("int")
    hexed = F.transform("r", lambda x, i: F.when((F.col("file") % 3 == 1) & (i == middle), F.concat(F.substring(F.hex(x["record"]), F.lit(1), F.length(F.hex(x["record"])) - 2), F.lit("5A"))).otherwise(F.hex(x["record"])))
    return files.select(F.col("file").cast("string").alias("path"), F.unhex(F.concat(F.array_join(hexed, ""), F.when(F.col("file") % 3 == 2, "0000000000").otherwise(""))).alias("content"))


def wal_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that can be read from the made files."""
    return decode_files(_made_files(spark, sf_dir))


def wal_damaged_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_status(_made_files(spark, sf_dir))


def wal_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made files cut to what can be read, and read again."""
    cut = checkpoint(truncated(_made_files(spark, sf_dir)))
    left = cut.select("path", F.length("content").alias("bytes"))
    return left.join(file_status(cut).select("path", "records", "status"), "path")


def kv_stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_replay(spark, f"{sf_dir}/kv_log.parquet")


def kv_stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_apply(spark, f"{sf_dir}/kv_log.parquet", table(spark, sf_dir, "kv_state"))


QUERIES = {
    f.__name__: f
    for f in (
        kv_replay, kv_latest, kv_tombstones, kv_prev_value, kv_merge_on_read, kv_multi_get, kv_get, kv_recover_from, kv_recover_prefix,
        wal_lsn, wal_segment_name, wal_segment_prune, wal_name_prune, wal_records, wal_status, wal_encoded, wal_round_trip, wal_resumed, wal_repaired,
        sst_flush, sst_levels, sst_manifest, sst_level_stats, sst_overlap, sst_containing, sst_compact, sst_level_lookup, sst_highest,
        wal_damaged, wal_damaged_status, wal_truncated,
        wire_encode, wire_decode, wire_respond, wire_serve, kv_stream_replay, kv_stream_apply,
    )
}

_LOG = f"""
  WITH log AS (SELECT DISTINCT seq, op, k, CASE WHEN op = 'P' THEN v END AS v
               FROM (SELECT seq, upper(trim(op)) AS op, k, v FROM kv_log) x
               WHERE seq IS NOT NULL AND (op = '{GET}' OR length(k) > 0 AND (op = 'P' AND v IS NOT NULL OR op = 'D'))),
       w AS (SELECT * FROM log WHERE op <> '{GET}'),
       m AS (SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM w) x WHERE rn = 1)"""
_REPLAY = f"""{_LOG},
       x AS (SELECT *, max(CASE WHEN op <> '{GET}' THEN seq END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM log),
       a AS (SELECT x.seq, x.k, x.op, CASE WHEN x.op = '{GET}' AND p.v IS NULL THEN 2 ELSE 0 END AS rc, p.v AS payload FROM x LEFT JOIN w p ON p.seq = x.ps)"""
_LSN = f"""{_LOG},
       n AS (SELECT seq, CAST(CASE WHEN op = 'P' THEN 25 + strlen(k) + strlen(v) ELSE 21 + strlen(k) END AS bigint) AS n FROM w),
       l AS (SELECT seq, n, CAST(coalesce(sum(n) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS lsn FROM n)"""
_MERGED = """ z AS (SELECT coalesce(m.k, b.k) AS k, CASE WHEN m.k IS NOT NULL THEN m.v ELSE b.v END AS v FROM m FULL OUTER JOIN kv_state b ON m.k = b.k)"""
_STATS = "min(k) AS mn, max(k) AS mx, max(seq) AS hi, CAST(sum(25 + strlen(k) + coalesce(strlen(v), 0)) AS bigint) AS bytes, count(*) AS n"
_FRAME = f"""
  WITH d AS (SELECT DISTINCT seq, upper(trim(op)) AS op, k, v FROM kv_log),
       f AS (SELECT *, printf('%032x', seq) AS h, CASE op WHEN 'D' THEN 0 WHEN 'G' THEN 1 ELSE 2 END AS t, coalesce(k, '') AS kk FROM d)"""
_CORR = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"

_FILES = f"""{_LOG},
       r AS (SELECT seq, op, k, v, (seq - {BASE}) // {FILE_BYTES} AS file, CASE WHEN op = 'P' THEN 25 + strlen(k) + strlen(v) ELSE 21 + strlen(k) END AS n FROM w),
       f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY file) AS c,
                    CAST(coalesce(sum(n) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos FROM r),
       g AS (SELECT *, file % 3 <> 1 OR i < c // 2 AS good FROM f),
       st AS (SELECT CAST(file AS varchar) AS path, count_if(good) AS records, CAST(sum(CASE WHEN good THEN n ELSE 0 END) AS bigint) AS readable,
                     CAST(sum(n) AS bigint) + CASE WHEN file % 3 = 2 THEN 5 ELSE 0 END AS bytes, CASE file % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'corrupted' ELSE 'padding' END AS status FROM g GROUP BY file)"""
#: The harmed frames' errors, in the order in which they are found; keys that hold letters beyond ASCII have no such first byte.
_SERVE = f"""{_FRAME},
       h2 AS (SELECT *, seq % 99 AS m, strlen(kk) AS lk FROM f),
       er AS (SELECT seq, op, kk AS k, v, {_CORR} AS corr, CASE
           WHEN m = 66 THEN 7 WHEN m = 0 THEN 255 WHEN m = 11 THEN 10 WHEN m IN (22, 33) THEN 8 WHEN m IN (44, 55, 88) THEN 7
           WHEN m = 77 AND lk > 0 THEN 4 WHEN m = 77 AND v IS NOT NULL THEN 7 WHEN op = 'P' AND v IS NULL THEN 6 WHEN op <> 'P' AND v IS NOT NULL THEN 7 WHEN op <> '{GET}' AND lk = 0 THEN 4 ELSE 0 END AS e FROM h2),
       ok AS (SELECT *, max(CASE WHEN op <> '{GET}' THEN seq END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM er WHERE e = 0),
       an AS (SELECT ok.seq, ok.corr, CASE WHEN ok.op = '{GET}' AND p.v IS NULL THEN 2 ELSE 0 END AS rc, p.v AS payload FROM ok LEFT JOIN ok p ON p.seq = ok.ps AND p.k = ok.k AND p.op <> '{GET}'
              UNION ALL SELECT seq, CASE WHEN seq % 99 = 66 THEN '00000000-0000-0000-0000-000000000000' ELSE corr END, e, NULL FROM er WHERE e <> 0)"""

SQL = {
    "wal_damaged": f"{_FILES} SELECT CAST(file AS varchar) AS path, pos, seq, op, k, v FROM g WHERE good",
    "wal_damaged_status": f"{_FILES} SELECT path, records, readable, bytes, status FROM st",
    "wal_truncated": f"{_FILES} SELECT path, CASE WHEN status = 'corrupted' THEN readable ELSE bytes END AS bytes, records, CASE WHEN status = 'corrupted' THEN 'clean' ELSE status END AS status FROM st",
    "wire_serve": f"{_SERVE} SELECT seq, corr, rc, CASE WHEN rc <> 255 THEN upper(replace(corr, '-', '')) || printf('%02X', rc) || hex(coalesce(payload, '')) END AS response FROM an",
    "kv_replay": f"{_REPLAY} SELECT seq, k, op, rc, payload FROM a",
    "kv_stream_replay": f"{_REPLAY} SELECT seq, k, op, rc, payload FROM a",
    "kv_latest": f"{_LOG} SELECT k, v, seq FROM m WHERE v IS NOT NULL",
    "kv_tombstones": f"{_LOG} SELECT k, seq FROM m WHERE v IS NULL",
    "kv_prev_value": f"{_LOG} SELECT seq, k, op, lag(v) OVER (PARTITION BY k ORDER BY seq) AS prev FROM w",
    "kv_merge_on_read": f"{_LOG},{_MERGED} SELECT k, v FROM z WHERE v IS NOT NULL",
    "kv_multi_get": f"""{_LOG},{_MERGED}, q AS (SELECT DISTINCT k FROM key_probe WHERE length(k) > 0)
  SELECT q.k, CASE WHEN z.v IS NULL THEN 2 ELSE 0 END AS rc, z.v FROM q LEFT JOIN z ON z.k = q.k""",
    "kv_get": f"{_LOG},{_MERGED} SELECT k, v FROM z WHERE k = (SELECT max(k) FROM kv_state WHERE v IS NOT NULL) AND v IS NOT NULL",
    "kv_recover_from": f"{_LOG} SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM w WHERE seq >= {RECOVER_FROM}) x WHERE rn = 1",
    "kv_recover_prefix": f"""{_LOG}, bad AS (SELECT min(seq) AS b FROM log WHERE seq >= (SELECT min(seq) + (max(seq) - min(seq)) * 9 // 10 FROM log))
  SELECT k, v, seq FROM (SELECT w.*, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM w, bad WHERE b IS NULL OR seq < b) x WHERE rn = 1""",
    "kv_stream_apply": f"""{_LOG}, u AS (SELECT k, v, seq FROM w UNION ALL SELECT k, v, seq FROM kv_state)
  SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM u) x WHERE rn = 1 AND v IS NOT NULL""",
    "wal_lsn": f"{_LSN} SELECT seq, n, lsn FROM l",
    "wal_segment_name": f"{_LSN} SELECT seq, printf('%08x%08x%08x.wal', 0, lsn >> 32, (lsn % 4294967296) // {SEGMENT}) AS segment FROM l",
    "wal_segment_prune": f"{_LSN} SELECT lsn // {SMALL_SEGMENT} AS segment, max(lsn + n) AS ends, count(*) AS n FROM l GROUP BY 1 HAVING max(lsn + n) > {PRUNE_FROM}",
    "wal_name_prune": f"""
  WITH f AS (SELECT path, octet_length(content) AS size, regexp_extract(path, '([^/]*)$', 1) AS name FROM wal_file)
  SELECT path, size FROM f WHERE regexp_full_match(name, '[0-9a-f]{{24}}\\.wal')
    AND {(1 << 54) + 20_000} < ('0x' || substr(name, 9, 8))::hugeint * 4294967296 + ('0x' || substr(name, 17, 8))::hugeint * 16 + size""",
    "wal_resumed": f"{_LOG} SELECT CAST(1 AS bigint) AS times, op, k, v FROM w",
    "wal_round_trip": f"{_LOG} SELECT op, k, v FROM w",
    "sst_levels": f"{_LOG} SELECT k, v, seq FROM m WHERE v IS NOT NULL",
    "sst_flush": f"{_LOG} SELECT substr(k, 1, 11) AS sg, {_STATS} FROM m GROUP BY 1",
    "sst_manifest": f"""
  WITH s AS (SELECT lvl, sg, {_STATS} FROM kv_sst GROUP BY lvl, sg), t AS (SELECT lvl, sg, max(bytes) AS said FROM manifest GROUP BY lvl, sg)
  SELECT s.lvl, s.sg, mn, mx, hi, coalesce(said, bytes) AS bytes, n FROM s LEFT JOIN t ON s.lvl = t.lvl AND s.sg = t.sg""",
    "sst_level_stats": f"""
  WITH e AS (SELECT lvl, sg, max(bytes) AS b FROM manifest GROUP BY lvl, sg)
  SELECT lvl, CAST(coalesce(sum(b), 0) AS bigint) AS bytes, count(*) AS segments, coalesce(sum(b), 0) > {LEVEL_TARGET} * pow({lsm.RATIO}, lvl) AS over FROM e GROUP BY lvl""",
    "sst_overlap": """
  WITH e AS (SELECT lvl, sg, min(mn) AS mn, max(mx) AS mx FROM manifest WHERE mn IS NOT NULL AND mx IS NOT NULL GROUP BY lvl, sg)
  SELECT a.lvl, a.sg, count(b.sg) AS n_next FROM e a LEFT JOIN e b ON b.lvl = a.lvl + 1 AND a.mn <= b.mx AND b.mn <= a.mx GROUP BY a.lvl, a.sg""",
    "sst_containing": f"""{_LOG},
       s AS (SELECT CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS lvl, substr(k, 1, 11) AS sg, min(k) AS mn, max(k) AS mx FROM m GROUP BY 1, 2),
       q AS (SELECT DISTINCT k FROM key_probe WHERE length(k) > 0)
  SELECT q.k, s.lvl, s.sg FROM q JOIN s ON q.k BETWEEN s.mn AND s.mx""",
    "sst_compact": "SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, lvl, v DESC NULLS LAST) AS rn FROM kv_sst) x WHERE rn = 1 AND v IS NOT NULL",
    "sst_level_lookup": "SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl, seq DESC, v DESC NULLS LAST) AS rn FROM kv_sst) x WHERE rn = 1",
    "sst_highest": "SELECT max(seq) AS hi, count(DISTINCT sg) AS segments FROM kv_sst",
    "wire_encode": f"""{_FRAME},
       b AS (SELECT *, printf('%08X', strlen(kk)) || hex(kk) || CASE WHEN v IS NULL THEN '' ELSE printf('%08X', strlen(v)) || hex(v) END AS body FROM f)
  SELECT seq, '00000018726B7673' || upper(h) || '00' || printf('%02X', t) || '0000' || printf('%08X', length(body) // 2) || body AS frame FROM b""",
    "wire_decode": f"""{_FRAME},
       e AS (SELECT *, CASE WHEN op = 'P' AND v IS NULL THEN 6 WHEN op <> 'P' AND v IS NOT NULL THEN 7 ELSE 0 END AS rc FROM f)
  SELECT seq, {_CORR} AS corr, op, CASE WHEN rc = 0 THEN kk END AS k, CASE WHEN rc = 0 AND op = 'P' THEN v END AS v, rc FROM e""",
    "wire_respond": f"{_REPLAY} SELECT seq, printf('%032X', seq) || printf('%02X', rc) || hex(coalesce(payload, '')) AS response FROM a",
}
