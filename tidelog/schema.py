"""Tables of the store, and the log as operators take it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KV_LOG = "seq bigint, op string, k string, v string"
KV_STATE = "k string, v string, seq bigint"
KV_SST = "lvl int, sg int, k string, v string, seq bigint"
MANIFEST = "lvl int, sg int, mn string, mx string, hi bigint, bytes bigint, n bigint"
WAL_FILE = "path string, length bigint, content binary"

PUT, DELETE, GET = "P", "D", "G"


def operation(op: Column) -> Column:
    """P, D or G, whatever the letter case and the blanks around it."""
    return F.upper(F.trim(op))


def valid_change(op: Column, k: Column, v: Column) -> Column:
    """A put with a key and a value (which may be empty), or a delete with a key. Never null."""
    return F.coalesce((F.length(k) > 0) & ((op == PUT) & v.isNotNull() | (op == DELETE)), F.lit(False))


def requests(kv_log: DataFrame, *more: str) -> DataFrame:
    """(seq, op, k, v) of every delivery that asks for something: valid changes, and gets of any key.

    A delete's value is dropped. `more`: other columns to keep. Rows without `seq` have no place in the log and are left out.
    """
    r = kv_log.select("seq", operation(F.col("op")).alias("op"), "k", "v", *more)
    r = r.where(F.col("seq").isNotNull() & (valid_change(F.col("op"), F.col("k"), F.col("v")) | (F.col("op") == GET)))
    return r.withColumn("v", F.when(F.col("op") == PUT, F.col("v")))


def changes(kv_log: DataFrame, *more: str) -> DataFrame:
    """(seq, op, k, v) of every delivery of a valid change."""
    return requests(kv_log, *more).where(F.col("op") != GET)
