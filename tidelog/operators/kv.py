"""The key-value operators over a request log: (seq, op, k, v) with op P, D or G.

Order within a key is by seq alone; deliveries of the same record count once. A key's newest row decides,
a delete leaves a tombstone: a present row with a null value, which hides older rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.skew import last_before
from tidelog.schema import DELETE, GET, PUT

OK, NOT_FOUND = 0, 2


def newest(log: DataFrame) -> DataFrame:
    """(k, v, seq) of the newest write of each key; v is null for a tombstone. Aggregated before the shuffle."""
    last = log.where(F.col("op") != GET).groupBy("k").agg(F.max(F.struct("seq", "v")).alias("r"))
    return last.select("k", "r.v", "r.seq")


def latest(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("v").isNotNull())


def tombstones(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("v").isNull()).select("k", "seq")


def previous_values(log: DataFrame, total: int | None = None) -> DataFrame:
    """(seq, k, op, prev) of each write: the value before it, null where there was none or it was deleted.
    As in the store, values of flushed levels do not count."""
    writes = log.where(F.col("op") != GET)
    return last_before(writes, "k", "seq", F.struct("v"), total, ["seq", "op", "k", "v"]).select("seq", "k", "op", F.col("_last.v").alias("prev"))


def replay(log: DataFrame, total: int | None = None) -> DataFrame:
    """(seq, k, op, rc, payload): the answer to each request in order: the key's value before it. Only a get
    of a missing key is an error (2); a get of an empty or null key misses."""
    write = F.when(F.col("op") != GET, F.struct("v"))
    out = last_before(log, "k", "seq", write, total, ["seq", "op", "k", "v"])
    value = F.col("_last.v")
    return out.select("seq", "k", "op", F.when((F.col("op") == GET) & value.isNull(), NOT_FOUND).otherwise(OK).alias("rc"), value.alias("payload"))


def merge_on_read(delta: DataFrame, base: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """(k, v): newest rows `delta` over a snapshot `base` (k unique in each). A row of delta hides the
    base's even if it is a tombstone: presence decides, not the value."""
    d = delta.select("k", F.col("v").alias("_dv"), F.lit(True).alias("_in"))
    both = d.join(base.select("k", F.col("v").alias("_bv")), "k", "full_outer")
    out = both.select("k", F.when(F.col("_in").isNotNull(), F.col("_dv")).otherwise(F.col("_bv")).alias("v"))
    return out if keep_tombstones else out.where(F.col("v").isNotNull())


def get(log: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(k, v) of one key, from the log over the snapshot: one row or none. The key's filter reaches both scans."""
    return merge_on_read(newest(log.where(F.col("k") == key)), base.where(F.col("k") == key))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """(k, rc, v) of each row of `keys`; 2 for keys that are missing or deleted."""
    found = keys.select("k").join(state.where(F.col("v").isNotNull()).select("k", "v"), "k", "left")
    return found.select("k", F.when(F.col("v").isNull(), NOT_FOUND).otherwise(OK).alias("rc"), "v")


def recover_from(log: DataFrame, seq: int) -> DataFrame:
    """State, tombstones included, of the writes from `seq` on (inclusive)."""
    return newest(log.where(F.col("seq") >= seq))


def recover_prefix(log: DataFrame, corrupt: Column) -> DataFrame:
    """State, tombstones included, of the writes before the first corrupt record; all, if none is."""
    first = log.where(corrupt).agg(F.min("seq")).first()[0]
    return newest(log if first is None else log.where(F.col("seq") < first))


def return_code(error: Column) -> Column:
    """Code of an error's name; 0 for null. Fixed values."""
    codes = {"IoError": 1, "NotFound": 2, "Shutdown": 3, "InvalidKey": 4, "InvalidValue": 5, "MissingValue": 6, "MalformedPayload": 7, "InvalidRequestType": 8, "UnknownFlags": 9, "UnsupportedVersion": 10, "TimedOut": 11, "WrongMagicBytes": 255}
    out = F.when(error.isNull(), 0)
    for name, code in codes.items():
        out = out.when(error == name, code)
    return out


def record_size(op: Column, k: Column, v: Column) -> Column:
    """Bytes of a write's log record."""
    return F.when(op == PUT, 25 + F.octet_length(k) + F.octet_length(v)).when(op == DELETE, 21 + F.octet_length(k)).cast("bigint")
