"""Best representative of each duplicate group (problem 2), by currency reasoning.

A group is all rows of a key. Each field takes its most current known value. Rows with a time are
ordered by it. For rows without a time, precedence between values is learned from all rows that have
one: how often a value was followed by another in the same key and field. Taken together these make a graph
of values; values in a cycle are one, and the longest chain of precedence up to a value is its rank, so that a
value ranks above all those it follows, directly or not. In a group the values without a time and the
latest one with a time are in this order, and the topologically latest is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.ranking import ranks
from tidelog.operators.membership import may_be_among
from tidelog.operators.skew import last_before
from tidelog.session import small, written

FIELDS = ("hash", "parent", "stamp", "size", "owner")
#: What says that a value is not known, after trimming and in lower case. Fixed values.
UNKNOWN = ("", "-", "--", "---", "?", "??", "n/a", "na", "n.a.", "n.n.", "nn", "nil", "none", "null", "nan", "unknown", "unk", "undefined", "missing", "tbd", "tba", "void")


def parsed(v: Column) -> Column:
    """The fields of a node record, as strings: a JSON object or `name=value;` pairs. Null if the
    record is null or cut off (a JSON text that does not parse, pairs that do not end in `;`)."""
    t = F.trim(v)
    json = F.from_json(t, "struct<hash:string,parent:string,stamp:string,size:string,owner:string,_bad:string>", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    of_json = F.struct(*[json[f].alias(f) for f in FIELDS])
    of_pairs = F.struct(*[F.nullif(F.regexp_extract(t, rf"(?:^|;)\s*{f}\s*=([^;]*);", 1), F.lit("")).alias(f) for f in FIELDS])
    whole_json = t.startswith("{") & t.endswith("}") & json["_bad"].isNull()
    return F.when(whole_json, of_json).when(t.endswith(";") & ~t.startswith("{"), of_pairs)


def known(field: str, raw: Column) -> Column:
    """The value if it is a known one of its field, else null."""
    t = F.trim(raw)
    ok = ~F.lower(t).isin(*UNKNOWN)
    if field == "hash":
        ok &= t.rlike("^[0-9A-Fa-f]{16}$") & ~t.rlike("^0+$")
    elif field == "parent":
        ok &= t.rlike("^tree/.")
    elif field == "stamp":
        ok &= t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$") & F.try_to_timestamp(t).isNotNull() & (t >= "2019")
    elif field == "size":
        ok &= t.rlike("^0*[1-9][0-9]*$")
    return F.when(ok, t)


def node_records(kv_sst: DataFrame) -> DataFrame:
    """(k, seq, dead, hash, parent, stamp, size, owner) per row; unknown values are null. `dead`: a tombstone.
    Rows with a null or empty key are no entries."""
    rows = kv_sst.where(F.length("k") > 0).select("k", "seq", F.col("v").isNull().alias("dead"), parsed(F.col("v")).alias("r"))
    return rows.select("k", "seq", "dead", *[known(f, F.col(f"r.{f}")).alias(f) for f in FIELDS])


def after_tombstones(rows: DataFrame, key: str = "k", order: str = "seq", dead: str = "dead") -> DataFrame:
    """The rows above their key's newest dead row in order of `order`; those of a key without one are all kept,
    as are rows without `order`."""
    tombs = small(rows.where(F.col(dead)).groupBy(F.col(key).alias("_k")).agg(F.max(order).alias("_tomb")))
    joined = rows.join(tombs, F.col(key).eqNullSafe(F.col("_k")), "left").where(~F.coalesce(F.col(dead), F.lit(False)))
    return joined.where(F.col("_tomb").isNull() | F.col(order).isNull() | (F.col(order) > F.col("_tomb"))).drop("_k", "_tomb")


#: How much more often a value must have followed another than the other way round.
SUPPORT = 2


def long(rows: DataFrame, key: str, time: str, fields: tuple[str, ...]) -> DataFrame:
    """(_k, _t, fld, val): a row per known value."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f).cast("string").alias("val")) for f in fields]))
    return rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), each).where("val is not null")


def precedence(rows: DataFrame, key: str, time: str, fields: tuple[str, ...], support: int = SUPPORT) -> DataFrame:
    """(fld, a, b): b follows a more often than a follows b, by `support`, in rows of the same key in order of time.
    Of several values at one time the largest counts. All fields are learned in one pass; a key that holds many rows is split."""
    timed = long(rows, key, time, fields).where("_t is not null")
    number = F.array_position(F.array(*map(F.lit, fields)), F.col("fld")).cast("string")
    one = F.concat_ws("/", number, F.when(F.col("_k").isNull(), "").otherwise(F.concat(F.lit("k"), F.col("_k").cast("string"))))
    timed = written(timed.select(one.alias("_one"), "_t", "val"))  # read for its hot keys, their ranges, and the moves
    moves = last_before(timed, "_one", "_t", F.col("val"), largest="val").where(F.col("_last") != F.col("val"))
    moves = moves.withColumn("fld", F.element_at(F.array(*map(F.lit, fields)), F.substring_index("_one", "/", 1).cast("int")))
    low, high = F.least("_last", "val"), F.greatest("_last", "val")
    balance = moves.groupBy("fld", low.alias("x"), high.alias("y")).agg(F.sum(F.when(F.col("_last") == low, 1).otherwise(-1)).alias("n"))
    up = F.col("n") > 0
    return balance.where(F.abs("n") >= support).select("fld", F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b"))


def best_records(rows: DataFrame, key: str = "k", time: str = "seq", fields: tuple[str, ...] = FIELDS, dead: str | None = "dead") -> DataFrame:
    """One row per key: `n` (its rows), and for each field a struct (t, val) or null.

    val is the known value (non-null) at the highest time; at equal times the largest value. Rows not
    newer than the newest dead row supply nothing. Where rows without a time know the field, their
    values and the timed one are compared by their rank in the learned precedence. Values that nothing learned connects
    with the timed one can't be told from it and give way to it; of the others the one of the highest rank is taken, at equal ranks
    the timed one first, then the one with more rows, then the largest. t is null if the value has no
    time. Rows without a time are never dead. A null key is a group like any other. Extra columns are
    ignored; an empty table gives an empty one.

    The groups are aggregated before the shuffle, so that a hot key costs one row per task; values without a time are
    joined with one rank each, by value.
    """
    timed = F.col(time).isNotNull()

    def newest(some: DataFrame) -> DataFrame:
        tomb = F.max(F.when(F.col(dead), F.col(time))) if dead else F.max(F.when(F.lit(False), F.col(time)))
        tops = [F.max(F.when(timed & F.col(f).isNotNull(), F.struct(F.col(time).alias("t"), F.col(f).cast("string").alias("val")))).alias(f) for f in fields]
        top = some.groupBy(key).agg(F.count("*").alias("n"), tomb.alias("_tomb"), *tops)
        return top.select(key, "n", *[F.when(F.col("_tomb").isNull() | (F.col(f"{f}.t") > F.col("_tomb")), F.col(f)).alias(f) for f in fields])

    best = newest(rows)
    ranked = small(ranks(precedence(rows, key, time, fields))).withColumnsRenamed({"fld": "_f", "val": "_v"})
    with_rank = lambda d: d.join(ranked, (F.col("fld") == F.col("_f")) & (F.col("val") == F.col("_v")), "left").drop("_f", "_v")
    loose = with_rank(long(rows.where(~timed), key, time, fields).groupBy("_k", "fld", "val").agg(F.count("*").alias("c")))
    # the timed values that they meet: of keys without such values nothing is shuffled once more
    named = lambda k: F.xxhash64(k.cast("string"))
    met = newest(may_be_among(rows, named(F.col(key)), rows.where(~timed), named(F.col(key))))
    held = long(met.select(key, F.lit(None).alias("_no"), *[F.col(f"{f}.val").alias(f) for f in fields]), key, "_no", fields).select("_k", "fld", "val")
    held = with_rank(held).select(F.col("_k").alias("_hk"), F.col("fld").alias("_hf"), F.col("val").alias("_hv"), F.col("part").alias("_hp"), F.col("rank").alias("_hr"))
    both = loose.join(held, F.col("_k").eqNullSafe(F.col("_hk")) & (F.col("fld") == F.col("_hf")), "left")
    # a value without a time takes the place of the timed one only if it is known to be later
    later = F.col("_hv").isNull() | (F.col("part") == F.col("_hp")) & (F.col("rank") > F.col("_hr"))
    order = F.struct(F.coalesce("rank", F.lit(0)), "c", "val")
    pick = both.where(later).groupBy("_k", "fld").agg(F.max_by("val", order).alias("val"))
    wide = pick.groupBy("_k").agg(*[F.max(F.when(F.col("fld") == f, F.col("val"))).alias(f"_{f}") for f in fields])
    out = best.join(wide, F.col(key).eqNullSafe(F.col("_k")), "left")
    none = F.lit(None).cast(rows.schema[time].dataType)
    return out.select(key, "n", *[F.when(F.col(f"_{f}").isNotNull(), F.struct(none.alias("t"), F.col(f"_{f}").alias("val"))).otherwise(F.col(f)).alias(f) for f in fields])


def by_field(best: DataFrame, key: str = "k", fields: tuple[str, ...] = FIELDS, time: str = "seq") -> DataFrame:
    """(key, fld, time): one row per key and known field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f"{f}.t").alias(time), F.col(f).isNotNull().alias("_has")) for f in fields])).alias("_e")
    return best.select(key, each).where("_e._has").select(key, "_e.fld", f"_e.{time}")
