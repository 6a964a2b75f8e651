"""Frames in, responses out: the request loop over a table of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import wire
from tidelog.operators import kv
from tidelog.operators.skew import last_before
from tidelog.schema import GET, PUT

#: Errors after which the connection is closed without a response.
SILENT = ("WrongMagicBytes",)
NIL = "00000000-0000-0000-0000-000000000000"


def respond(frames: DataFrame, total: int | None = None) -> DataFrame:
    """(seq, corr, rc, response) of each frame of `frames` (seq bigint, frame binary), in order of seq.

    A right request is answered from the writes before it: code 0 and the key's value before, or 2 for a get that finds
    none. A frame that can't be read, or a put or delete of an empty key, is answered by the code of its error and changes nothing; one
    without an id has the nil id. After wrong magic bytes there is no response: null. Frames of equal seq and content are
    one delivery; a null frame is malformed; rows without seq come in no order and are left out.
    """
    each = wire.decode_requests(frames.where("seq is not null").select("seq", "frame").distinct())
    each = each.withColumn("corr", F.coalesce("corr", F.lit(NIL))).withColumn("error", F.when(F.col("error").isNull() & (F.col("op") != GET) & (F.length("k") == 0), "InvalidKey").otherwise(F.col("error")))
    # what is no request goes through with a null key, asks nothing and writes nothing: no second pass for it
    ok = F.col("error").isNull()
    rows = each.select("seq", F.when(ok, F.col("op")).alias("op"), F.when(ok, F.col("k")).alias("k"), F.when(ok & (F.col("op") == PUT), F.col("v")).alias("v"), "corr", "error")
    out = last_before(rows, "k", "seq", F.when(F.col("op") != GET, F.struct("v")), total, rows.columns)
    value = F.when(F.col("op").isNotNull(), F.col("_last.v"))
    rc = F.when((F.col("op") == GET) & value.isNull(), kv.NOT_FOUND).otherwise(kv.return_code(F.col("error")))
    out = out.select("seq", "corr", rc.alias("rc"), value.alias("payload"), "error")
    response = F.when(~F.coalesce(F.col("error").isin(*SILENT), F.lit(False)), wire.encode_response(F.col("corr"), F.col("rc"), F.col("payload")))
    return out.select("seq", "corr", "rc", response.alias("response"))
