"""The binary request and response frames, in built-in functions only (big-endian).

A request: u32 length of the headers (24), magic, 16-byte id, version, type, u16 flags; u32 length of the
payload; u32 key length, key and, for a put, u32 value length and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of a frame, and the types of requests by operation. Fixed values of the format.
MAGIC = "726B7673"
TYPES = {"D": 0, "G": 1, "P": 2}


def _u(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def correlation_id(n: Column) -> Column:
    """A number as an id: 32 hex digits in the usual groups."""
    h = F.lower(F.lpad(F.hex(n.cast("bigint")), 32, "0"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def encode_request(corr: Column, op: Column, k: Column, v: Column) -> Column:
    """A frame; a null value is left out, a null key is empty. The value goes in for any operation."""
    kind = F.coalesce(*[F.when(op == o, n) for o, n in TYPES.items()], F.lit(255))
    key = _bytes(F.coalesce(k, F.lit("")))
    body = F.concat(_u(F.length(key), 4), key)
    body = F.when(v.isNull(), body).otherwise(F.concat(body, _u(F.length(_bytes(v)), 4), _bytes(v)))
    return F.concat(F.unhex(F.lit("00000018" + MAGIC)), F.unhex(F.replace(corr, F.lit("-"), F.lit(""))), F.unhex(F.lit("00")), _u(kind, 1), F.unhex(F.lit("0000")), _u(F.length(body), 4), body)


def _int(frame: Column, at: Column, width: int) -> Column:
    """Number at a 1-based position; null beyond the end."""
    return F.when(F.length(frame) >= at + (width - 1), F.conv(F.hex(F.substring(frame, at, F.lit(width))), 16, 10).cast("bigint"))


def decode_requests(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """`frames` with corr, op, k, v and error, which take the place of columns of these names. error is null or its name; a
    frame that is too short, or whose lengths run past its end, is a MalformedPayload. Flags are not looked at.

    In steps, each a projection of what the one before found: as one expression it would hold the first ones many times over.
    """
    f, kept = F.col(frame), [F.col(c) for c in frames.columns if c not in ("corr", "op", "k", "v", "error")]
    raw = F.lower(F.hex(F.substring(f, F.lit(9), F.lit(16))))
    payload = F.lit(33)  # after the headers and the payload's own length
    steps = [
        {"_raw": F.when(F.length(f) >= 24, raw), "_magic": F.hex(F.substring(f, F.lit(5), F.lit(4))) == MAGIC, "_version": _int(f, F.lit(25), 1), "_kind": _int(f, F.lit(26), 1), "_size": _int(f, F.lit(29), 4), "_n": _int(f, payload, 4), "_length": F.length(f)},
        {"_rest": F.col("_size") - 4 - F.col("_n"), "_whole": F.coalesce((F.col("_length") == 32 + F.col("_size")) & (F.col("_n") + 4 <= F.col("_size")), F.lit(False)), "_put": F.col("_kind") == TYPES["P"]},
        {"_k": F.when(F.col("_whole"), F.try_validate_utf8(F.substring(f, payload + 4, F.col("_n")).cast("string"))), "_m": F.when(F.col("_whole") & (F.col("_rest") >= 4), _int(f, payload + 4 + F.col("_n"), 4))},
        {"_v": F.when(F.col("_m") + 4 == F.col("_rest"), F.substring(f, payload + 8 + F.col("_n"), F.col("_m")))},
        {"_text": F.try_validate_utf8(F.col("_v").cast("string"))},
        {
            "error": F.when(f.isNull() | (F.col("_length") < 28), "MalformedPayload")
            .when(~F.col("_magic"), "WrongMagicBytes")
            .when(F.col("_version") > 0, "UnsupportedVersion")
            .when(~F.col("_kind").isin(*TYPES.values()), "InvalidRequestType")
            .when(~F.col("_whole"), "MalformedPayload")
            .when(F.col("_k").isNull(), "InvalidKey")
            .when(F.col("_put") & (F.col("_rest") == 0), "MissingValue")
            .when(~F.col("_put") & (F.col("_rest") > 0), "MalformedPayload")
            .when(F.col("_put") & F.col("_v").isNull(), "MalformedPayload")
            .when(F.col("_put") & F.col("_text").isNull(), "InvalidValue")
        },
    ]
    out = frames
    for step in steps:
        out = out.withColumns(step)
    good, r = F.col("error").isNull(), F.col("_raw")
    corr = F.concat_ws("-", F.substring(r, 1, 8), F.substring(r, 9, 4), F.substring(r, 13, 4), F.substring(r, 17, 4), F.substring(r, 21, 12))
    op = F.coalesce(*[F.when(F.col("_kind") == n, o) for o, n in TYPES.items()])
    return out.select(*kept, F.when(r.isNotNull(), corr).alias("corr"), op.alias("op"), F.when(good, F.col("_k")).alias("k"), F.when(good & F.col("_put"), F.col("_text")).alias("v"), "error")


def encode_response(corr: Column, rc: Column, payload: Column) -> Column:
    """Id, code, value. No value and an empty one look the same."""
    return F.concat(F.unhex(F.replace(corr, F.lit("-"), F.lit(""))), _u(rc, 1), _bytes(F.coalesce(payload, F.lit(""))))


def close_notification() -> Column:
    """What is sent before an idle connection is closed: a nil id and the code of a time-out."""
    return encode_response(F.lit("00000000-0000-0000-0000-000000000000"), F.lit(11), F.lit(None).cast("string"))
