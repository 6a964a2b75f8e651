"""Which rows may be among some members, told before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a table: so many rows of two numbers are broadcast at most, whatever the input.
WORDS = 1 << 20


def _word(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 6).bitwiseAND(F.lit(WORDS - 1))


def _bit(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(63)).cast("int")


def may_be_among(df: DataFrame, hash_: Column, members: DataFrame, member: Column) -> DataFrame:
    """The rows of `df` whose hash (bigint) may be that of a member: all that are, and about one in 64 * WORDS / members
    of the others. A row with a null hash is not among them. A table of bits is aggregated from the members and broadcast, so that
    what follows shuffles only these rows; with very many members all pass, and nothing is lost or gained.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(member))
    words = members.where(member.isNotNull()).groupBy(_word(member).alias("_word_of")).agg(F.bit_or(bit).alias("_bits_of"))
    asked = df.join(F.broadcast(words), _word(hash_) == F.col("_word_of"))
    return asked.where(F.call_function("shiftrightunsigned", F.col("_bits_of"), _bit(hash_)).bitwiseAND(F.lit(1)) == 1).drop("_word_of", "_bits_of")
