"""Has this key been seen before? (problem 3) A Golomb-coded set in blocks.

Hashes of the earlier keys are reduced to a range of about 2^fp_bits times their number, sorted, and cut by
range into blocks of some thousand; a block holds the gaps between its hashes, Golomb-Rice coded (the
quotients in unary, then the remainders in fixed bits): about fp_bits + 1.5 bits a key. An incoming key's
hash names its block, only blocks that are asked for are decoded. A key that was there is always found; a
new one is taken for seen at a rate of about 2^-fp_bits. No task holds more than a few blocks, and ASK_ROWS keys that are
asked of one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.membership import may_be_among
from tidelog.session import checkpoint

FP_BITS = 12
#: Hashes in a block, about.
BLOCK_KEYS = 8192
#: Keys asked of a block in one task, about; a block that more are asked of goes to several tasks.
ASK_ROWS = 65_536
BLOCKS = "block bigint, n int, rice int, unary int, bits binary"


def encode_block(values: np.ndarray, rice: int) -> tuple[int, bytes]:
    """(bits in unary, coded gaps) of ascending distinct values from 0."""
    gaps = np.diff(values, prepend=-1) - 1
    quotient = gaps >> rice
    at = np.cumsum(quotient + 1)
    unary = np.zeros(int(at[-1]), dtype=np.uint8)
    unary[at - 1] = 1
    rest = ((gaps[:, None] >> np.arange(rice - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return len(unary), np.packbits(np.concatenate([unary, rest])).tobytes()


def decode_block(bits: bytes, n: int, rice: int, unary: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=unary + n * rice)
    quotient = np.diff(np.nonzero(flat[:unary])[0], prepend=-1) - 1
    rest = flat[unary:].reshape(n, rice).astype(np.int64) @ (1 << np.arange(rice - 1, -1, -1, dtype=np.int64)) if rice else 0
    return np.cumsum((quotient << rice) + rest + 1) - 1


@dataclass
class GolombSet:
    """blocks: one row each. bits: of a reduced hash. block_bits: of a block's number."""

    blocks: DataFrame
    bits: int
    block_bits: int

    def reduced(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.bits)

    def block(self, reduced: Column) -> Column:
        return F.shiftrightunsigned(reduced, self.bits - self.block_bits)

    @property
    def theoretical(self) -> Column:
        """Rate of false positives: hashes held, over the range."""
        return F.sum("n") / F.lit(float(2**self.bits))

    def save(self, path: str) -> None:
        self.blocks.withColumn("set_bits", F.lit(self.bits)).withColumn("set_block_bits", F.lit(self.block_bits)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> GolombSet:
        blocks = spark.read.parquet(path)
        first = blocks.select("set_bits", "set_block_bits").first()
        return GolombSet(blocks.drop("set_bits", "set_block_bits"), *(tuple(first) if first else (8, 0)))


def _encoded(block: int, values: np.ndarray, low: int):
    """One row of BLOCKS: the sorted distinct values of a block, of `low` bits each."""
    import pyarrow as pa

    rice = max(0, int(math.log2(max(1.0, 0.69 * (1 << low) / len(values)))))
    unary, bits = encode_block(values, rice)
    return pa.RecordBatch.from_pydict({"block": [block], "n": pa.array([len(values)], pa.int32()), "rice": pa.array([rice], pa.int32()), "unary": pa.array([unary], pa.int32()), "bits": [bits]})


def _hashes(held: GolombSet, keys: DataFrame, key: str) -> DataFrame:
    """(block, r): distinct reduced hashes of the non-empty keys, r within the block."""
    r = held.reduced(F.col(key))
    within = r.bitwiseAND(F.lit((1 << (held.bits - held.block_bits)) - 1))
    return keys.where(F.length(key) > 0).select(held.block(r).alias("block"), within.alias("r")).distinct()


def build(keys: DataFrame, key: str = "k", fp_bits: int = FP_BITS, size: int | None = None) -> GolombSet:
    """The set of the distinct non-empty keys. `size`: about how many; else it is estimated. More keys than that
    are held as well, at a higher rate of false positives (which the set reports)."""
    if size is None:
        size = keys.where(F.length(key) > 0).agg(F.approx_count_distinct(key, 0.02)).first()[0]
    bits = min(63, max(8, math.ceil(math.log2(max(size, 1)))) + fp_bits)
    block_bits = _block_bits(size)
    made = GolombSet(None, bits, block_bits)
    sorted_ = _hashes(made, keys, key).repartition(F.col("block")).sortWithinPartitions("block", "r")
    low = bits - block_bits

    def encode(batches):
        now, held = None, []
        for b in batches:
            block, r = b["block"].to_numpy(), b["r"].to_numpy()
            cuts = np.nonzero(np.diff(block))[0] + 1
            for part, values in zip(np.split(block, cuts), np.split(r, cuts)):
                if not len(part):
                    continue
                if part[0] != now and held:
                    yield _encoded(now, np.concatenate(held), low)
                    held = []
                now = int(part[0])
                held.append(values)
        if held:
            yield _encoded(now, np.concatenate(held), low)

    made.blocks = checkpoint(sorted_.mapInArrow(encode, BLOCKS))
    return made


def _block_bits(size: int) -> int:
    """Bits of a block's number for so many keys."""
    return max(0, math.ceil(math.log2(max(size, 1) / BLOCK_KEYS)))


def _decoded(blocks, i: int) -> np.ndarray:
    return decode_block(blocks["bits"][i].as_py(), blocks["n"][i].as_py(), blocks["rice"][i].as_py(), blocks["unary"][i].as_py())


def divided(held: GolombSet, block_bits: int) -> GolombSet:
    """The same set in more blocks: each is cut by the upper bits of its hashes. No shuffle."""
    more, low = block_bits - held.block_bits, held.bits - block_bits

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                values, block = _decoded(b, i), b["block"][i].as_py()
                at = np.searchsorted(values, np.arange(1, 1 << more) << low)
                for j, part in enumerate(np.split(values, at)):
                    if len(part):
                        yield _encoded((block << more) + j, part - (j << low), low)

    return GolombSet(held.blocks.mapInArrow(cut, BLOCKS), held.bits, block_bits) if more > 0 else held


def extended(held: GolombSet, keys: DataFrame, key: str = "k") -> GolombSet:
    """The set with more keys, e.g. those that have just come in: only blocks that get some are decoded and
    coded anew, in more blocks if they grow too large. The range stays, so false positives grow with the keys; build anew
    with twice the size when the rate that the set reports is too high."""
    keys = checkpoint(keys.where(F.length(key) > 0).select(key).distinct())
    size = keys.count() + (held.blocks.agg(F.sum("n")).first()[0] or 0)
    held = divided(held, max(held.block_bits, min(_block_bits(size), held.bits - 1)))
    low = held.bits - held.block_bits
    new = _hashes(held, keys, key)

    def merge(left, right):
        import pyarrow as pa

        values = [left["r"].to_numpy(), *[_decoded(right, i) for i in range(right.num_rows)]]
        return pa.Table.from_batches([_encoded(left["block"][0].as_py(), np.unique(np.concatenate(values)), low)])

    touched = new.select("block").distinct()
    merged = new.groupBy("block").cogroup(held.blocks.join(touched, "block", "left_semi").groupBy("block")).applyInArrow(merge, BLOCKS)
    return GolombSet(checkpoint(held.blocks.join(touched, "block", "left_anti").unionByName(merged)), held.bits, held.block_bits)


def asked_groups(held: GolombSet, asked: DataFrame, key: str, size: int | None = None) -> tuple[DataFrame, int]:
    """`asked` with `_block`, `_r`, the place in it, and `_sub` below the number returned: with `size` keys or fewer about
    ASK_ROWS have the same _block and _sub."""
    size = asked.count() if size is None else size
    subs = max(1, -(-size // (ASK_ROWS << held.block_bits)))
    reduced = held.reduced(F.col(key))
    within = reduced.bitwiseAND(F.lit((1 << (held.bits - held.block_bits)) - 1))
    sub = F.pmod(F.xxhash64(key, F.lit("sub")), F.lit(subs)).cast("int") if subs > 1 else F.lit(0)
    return asked.withColumn("_r", within).withColumn("_block", held.block(reduced)).withColumn("_sub", sub), subs


def probe(held: GolombSet, asked: DataFrame, key: str = "k", size: int | None = None) -> DataFrame:
    """`asked` (rows of distinct keys) with `maybe`: whether the key is in the set, never wrongly false. `size`: how many rows at
    most, else they are counted."""
    names = asked.columns
    groups, subs = asked_groups(held, asked, key, size)
    kinds = ", ".join(f"`{n}` {asked.schema[n].dataType.simpleString()}" for n in names)

    def look(left, right):
        import pyarrow as pa

        n = left.num_rows
        hit = np.zeros(n, dtype=bool)
        if n and right.num_rows:
            values, r = _decoded(right, 0), left["_r"].to_numpy()
            at = np.minimum(np.searchsorted(values, r), len(values) - 1)
            hit = values[at] == r
        return left.select(names).append_column("maybe", pa.array(hit))

    blocks = held.blocks.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))) if subs > 1 else F.lit(0))
    return groups.groupBy("_block", "_sub").cogroup(blocks.groupBy("block", "sub")).applyInArrow(look, f"{kinds}, maybe boolean")


@dataclass
class Seen:
    """held: the set of the earlier keys. first: (k, id, maybe), the first row of each incoming key, with the
    set's answer. confirmed: those of them that did occur. rows: every incoming row that was seen before. told: every row
    that the set alone takes for seen: all of `rows`, and others at the rate that it reports."""

    held: GolombSet
    first: DataFrame
    confirmed: DataFrame
    rows: DataFrame
    told: DataFrame

    def report(self) -> DataFrame:
        """One row: keys held and bits a key; keys asked; the rate of false positives in theory and as audited
        against the earlier keys themselves; false negatives."""
        size = self.held.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), 8 * F.sum(F.length("bits")) / F.sum("n"), self.held.theoretical).first()
        real = self.first.join(self.confirmed.select("id", F.lit(True).alias("real")), "id", "left").withColumn("real", F.coalesce("real", F.lit(False)))
        audit = real.agg(
            F.count("*").alias("keys_asked"),
            F.count_if(F.col("maybe") & ~F.col("real")).alias("false_positives"),
            F.count_if(~F.col("maybe") & F.col("real")).alias("false_negatives"),
            (F.count_if(F.col("maybe") & ~F.col("real")) / F.nullif(F.count_if(~F.col("real")), F.lit(0))).alias("fp_audited"),
        )
        return audit.withColumns({n: F.lit(v).cast(kind) for n, kind, v in zip(("keys_held", "bits_per_key", "fp_theory"), ("bigint", "double", "double"), size)})


def seen_before(earlier: DataFrame, incoming: DataFrame, key: str = "k", order: str = "in_id", fp_bits: int = FP_BITS, audit: bool = False) -> Seen:
    """Which rows of `incoming` have a key that occurs in `earlier` or in an incoming row of a smaller `order`
    (unique, not null). Null and empty keys are never seen. Keys are compared byte by byte.

    Of each incoming key, aggregated before the shuffle, only the first row is asked of the set; all later
    ones are seen: incoming keys are grouped anyway, so the set need not hold them. What the set finds is then checked against
    the earlier keys, so the answer is exact; with `audit`, all first rows are checked, to count the set's wrong answers. The
    check reads the earlier keys once more and shuffles only those whose hash is among the hashes to check. The rows that are
    new, one per key, are taken off by their unique id, so that a hot key is never shuffled to one task.
    """
    held = build(earlier, key, fp_bits)
    named = incoming.where(F.length(key) > 0)
    first = named.groupBy(F.col(key).alias("k")).agg(F.min(order).alias("id"))
    answers = checkpoint(probe(held, first, "k", incoming.count()))
    to_check = answers if audit else answers.where("maybe")
    known = earlier.where(F.length(key) > 0).select(F.col(key).alias("k"))
    near = may_be_among(known, F.xxhash64("k"), to_check, F.xxhash64("k"))
    confirmed = to_check.join(near.distinct(), "k", "left_semi")
    new = answers.select("id").join(confirmed.select("id"), "id", "left_anti")
    without = lambda some: named.join(some, named[order] == some["id"], "left_anti")
    return Seen(held, answers, confirmed, without(new), without(answers.where("not maybe").select("id")))
