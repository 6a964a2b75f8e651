"""Mixing sources to target weights (problem 7).

Tokens are added up per source; a source's rate is the number of times its documents are used on average:
its share of the total size over its tokens. Each document is emitted floor(rate) times, and once more
with a probability of the rest, drawn from a hash of its id and a seed: the same in every run and on every
executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokens import BYTE_BPE_50K, count_tokens
from tidelog.session import checkpoint, small


def sized(documents: DataFrame, mix_target: DataFrame, path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *keep, tokens) of the documents whose source has a share; tokenized once and checkpointed. With
    `keep`, such as the text, the mix holds whole records, else they are joined by doc_id.

    The table of shares has a row per source, not per document, and is broadcast if it is small, so that
    texts are not shuffled by source; sources without a row or with a null name have no share.
    """
    named = mix_target.where("source is not null and target_share > 0").select("source").distinct()
    return checkpoint(count_tokens(documents.join(small(named), "source", "left_semi"), path=path, keep=("doc_id", "source", *keep)))


def rates(sizes: DataFrame, mix_target: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeat, held, rate): one row per source of the target.

    `total` is the size aimed at, in tokens. By default it is the largest at which no source needs more than
    `max_repeat` uses of a document, so that every source with documents reaches its share; with a larger
    one the rates are cut at max_repeat and the shares reached are lower. Sources without tokens have
    a rate of 0, and the other ones share what they leave. A null max_repeat counts as 1. Of several rows of
    a source, the largest share and the smallest max_repeat count.
    """
    target = mix_target.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("held"))
    both = target.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    if total is None:
        total = both.where("held > 0").agg(F.min(F.col("max_repeat") * F.col("held") / F.col("target_share"))).first()[0] or 0
    rate = F.least(F.col("target_share") * F.lit(float(total)) / F.col("held"), F.col("max_repeat").cast("double"))
    return both.withColumn("rate", F.when(F.col("held") > 0, rate).otherwise(0.0))


def mix(sizes: DataFrame, rated: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, copy, tokens) and what else `sizes` has: each document `copy` = 1.. times. Documents with equal ids
    are drawn alike.

    `rated` has a row per source; if these are few enough to be broadcast, a source that holds most documents needs
    no shuffle.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    used = sizes.join(small(rated.select("source", "rate")), "source").withColumn("_copies", copies).where("_copies > 0")
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "tokens")]
    return used.select("doc_id", "source", *more, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"), "tokens")


def shares(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, pages, rate, max_repeat): what the mix came to."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pages"))
    out = rated.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("pages", F.coalesce("pages", F.lit(0)))
    total = out.agg(F.sum("tokens")).first()[0] or None
    return out.select("source", "target_share", (F.col("tokens") / F.lit(total)).cast("double").alias("actual_share"), "tokens", "pages", "rate", "max_repeat")
