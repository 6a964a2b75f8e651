"""Order within a key when one key may hold a third of all rows.

A window by key puts a hot key into one task. Here the rows of hot keys are split by ranges of the
order column; ranges keep the order, so that what crosses a border is one row per range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import checkpoint

#: Rows that one task sorts of a key, at least: a key with fewer is never split.
RANGE_ROWS = 50_000
#: A range of a hot key has at most a shuffle partition's share of all rows, or one in so many where there are fewer partitions.
LEAST_RANGES = 1024
#: Ranges of a whole table for running sums, at least; more where the session has more shuffle partitions.
RUN_PARTS = 192
#: More ranges of a group than these are drawn in two steps, so that no task holds the digest of all of them.
COARSE = 512


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_rows(df: DataFrame, total: int) -> int:
    """Rows of a range, about, given the number of all rows."""
    return max(RANGE_ROWS, -(-total // max(LEAST_RANGES, shuffle_partitions(df))))


def _step(n: int) -> int:
    return max(1, round(n**0.5))


def _below(points: Column, value: Column) -> Column:
    return F.size(F.filter(points, lambda x: x < value))


def range_of(value: Column, points: Column, coarse: Column, step: Column) -> Column:
    """Index of the range among ascending points that holds the value; 0 without points. `coarse` has every
    `step`-th point: two short scans instead of a long one."""
    block = _below(coarse, value) * step
    return F.coalesce(F.when(points.isNotNull(), block + _below(F.slice(points, block + 1, step), value)), F.lit(0))


def _table(df: DataFrame, by: str, order: str, points: dict) -> DataFrame:
    """One row per group with its points, for _ranged."""
    kind = df.schema[order].dataType.simpleString()
    rows = [(k, p, p[_step(len(p)) - 1 :: _step(len(p))], _step(len(p))) for k, p in points.items()]
    return df.sparkSession.createDataFrame(rows, f"_group {df.schema[by].dataType.simpleString()}, _points array<{kind}>, _coarse array<{kind}>, _step int")


def _ranged(df: DataFrame, by: str, order: str, points: dict, name: str) -> DataFrame:
    """Adds `name`, the range of `order` within the row's group, 0 for groups without points; and `_hot`, whether it has some."""
    joined = df.join(F.broadcast(_table(df, by, order, points)), F.col(by).eqNullSafe(F.col("_group")), "left")
    out = joined.withColumn(name, range_of(F.col(order), F.col("_points"), F.col("_coarse"), F.col("_step"))).withColumn("_hot", F.col("_points").isNotNull())
    return out.drop("_group", "_points", "_coarse", "_step")


def split_points(df: DataFrame, by: str, order: str, ranges: dict) -> dict:
    """{group: ascending quantiles of `order`}; `ranges`: into how many ranges each group goes, a power of two or the same
    for all. As many numbers as ranges reach the driver. Other groups are left out."""
    sizes = df.sparkSession.createDataFrame(list(ranges.items()), f"_group {df.schema[by].dataType.simpleString()}, _n int")
    own = df.where(F.col(order).isNotNull()).join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("_group"))).select(by, order, "_n")

    def quantiles(rows: DataFrame, groups: list[str], size: Column, some: set[int]) -> list:
        each = [F.percentile_approx(F.when(size == n, F.col(order)), [i / n for i in range(1, n)], 4 * n) for n in sorted(some) if n > 1]
        return rows.groupBy(*groups).agg(F.coalesce(*each).alias("_points")).collect() if each else []

    first = quantiles(own, [by], F.least("_n", F.lit(COARSE)), {min(n, COARSE) for n in ranges.values()})
    points = {r[0]: list(r[1]) for r in first if r[1] is not None}
    finer = {-(-n // COARSE) for n in ranges.values() if n > COARSE}
    if finer:
        parts = _ranged(own.where(F.col("_n") > COARSE), by, order, points, "_r")
        for r in quantiles(parts, [by, "_r"], F.ceil(F.col("_n") / COARSE), finer):
            points[r[0]] += r[2] or []
        points = {k: sorted(p) for k, p in points.items()}
    return points


def range_among(value: Column, points: list, kind: str) -> Column:
    """As range_of, for points known to the driver. They go into the plan as one text, however many they are."""
    if not points:
        return F.lit(0)
    array = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast(f"array<{kind}>")
    step = _step(len(points))
    coarse = points[step - 1 :: step]
    return range_of(value, array(points), array(coarse), F.lit(step))


def whole_points(df: DataFrame, order: str, n: int) -> list:
    """Ascending quantiles of `order`, a number, that cut the whole table into n ranges, about."""

    def quantiles(rows: DataFrame, groups: list[str], m: int) -> list:
        return rows.groupBy(*groups).agg(F.percentile_approx(order, [i / m for i in range(1, m)], 4 * m).alias("_points")).collect()

    points = list(quantiles(df, [], min(n, COARSE))[0][0] or [])
    if n > COARSE and points:
        finer = df.withColumn("_r", range_among(F.col(order), points, df.schema[order].dataType.simpleString()))
        points = sorted(points + [x for r in quantiles(finer, ["_r"], -(-n // COARSE)) for x in r[1] or []])
    return points


def hot_split(df: DataFrame, key: str, order: str, total: int | None = None) -> tuple[DataFrame, bool]:
    """Adds `_part`, a range number that is 0 but for hot keys, and `_hot`. Second: whether there are hot keys.

    A key is hot if it has more rows than a range is to have (range_rows); it is split into ranges in proportion to its
    rows. So there are fewer hot keys than the larger of LEAST_RANGES and the shuffle partitions, and at most two ranges for
    each of these, whatever the input: hence the broadcast. `total` may be any number from the row count upwards
    to half of it downwards; without it the rows are counted.
    """
    most = range_rows(df, df.count() if total is None else total)
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > F.lit(most)).collect()
    if not counts:
        return df.withColumn("_part", F.lit(0)).withColumn("_hot", F.lit(False)), False
    points = split_points(df, key, order, {r[0]: 1 << max(1, math.ceil(math.log2(r[1] / most))) for r in counts})
    return _ranged(df, key, order, points, "_part"), True


def last_before(df: DataFrame, key: str, order: str, what: Column, total: int | None = None, unique: list[str] | None = None, largest: str | None = None) -> DataFrame:
    """Adds `_last`: the last non-null `what` of the key's rows before the row, in order of `order` (not null).

    `unique`: the columns of the rows, of which only distinct ones are to count; they are made distinct
    after the split, so that one shuffle serves both. `largest`: a column of which, of the rows of one key and place in the
    order, only the largest is to count; then there are no other columns, and `what` is made of it. What a range of a hot key hands on to the next one
    goes there as a row of its own, before the others.
    """
    split, hot = hot_split(df, key, order, total)
    names = unique if unique is not None else df.columns
    rows = split.select(*names, "_part")
    if hot:
        some = split.where("_hot").withColumn("_what", what)
        place = F.struct(order, "_what") if largest else F.col(order)
        ends = some.groupBy(key, "_part").agg(F.max_by("_what", F.when(F.col("_what").isNotNull(), place)).alias("_end"))
        earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(key, "_part", F.last("_end", True).over(earlier).alias("_carried")).where("_carried is not null")
        rows = rows.unionByName(carried, allowMissingColumns=True)
    rows = rows.repartition(F.col(key), F.col("_part"))
    if unique is not None:
        rows = rows.distinct()
    if largest:
        rows = rows.groupBy(key, "_part", order).agg(*[F.max(c).alias(c) for c in (largest, *(["_carried"] if hot else []))])
    value = F.when(F.col("_carried").isNotNull(), F.col("_carried")).otherwise(what) if hot else what
    w = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_what", value).withColumn("_last", F.last("_what", True).over(w))
    return out.where("_carried is null").drop("_carried", "_what", "_part") if hot else out.drop("_what", "_part")


def _same(other: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """What to join with for equal `names`, where null equals null; the other's columns are named `_same_` and the name."""
    on = F.lit(True)
    for c in names:
        on &= F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return other.withColumnsRenamed({c: f"_same_{c}" for c in names}), on


def running_sum(df: DataFrame, order: str, value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows (of the group `by`) before the row in order of
    `order`, from 0.

    No task sees more than a range, a shuffle partition's share of the rows: the sums of the ranges are added up (as many
    rows as ranges and groups), then the rows within each range. `order` is a number, not null, and should be unique.
    """
    by, points = by or [], whole_points(df, order, max(RUN_PARTS, shuffle_partitions(df)))
    split = df.withColumn("_part", range_among(F.col(order), points, df.schema[order].dataType.simpleString())).withColumn("_value", value)
    sums = split.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = split.withColumn("_in", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(*_same(start, [*by, "_part"]))
    return out.withColumn(name, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_start", "_in", "_part", "_value", *[f"_same_{c}" for c in [*by, "_part"]])


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `_part`: rows of a lower part come before those of a higher one in order of `order`, of any
    type. The parts are kept in the shared folder, as another run would draw the borders elsewhere."""
    parts = max(RUN_PARTS, shuffle_partitions(df))
    return checkpoint(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def running_sums(df: DataFrame, order: list[str], values: dict[str, Column], by: list[str]) -> DataFrame:
    """As running_sum, for orders of any type and several sums at once; `by` comes first in the order."""
    split = ranged(df.withColumns({f"_v_{n}": v for n, v in values.items()}), [*by, *order])
    sums = split.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*by, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in values])
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = split.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in values}).join(*_same(start, [*by, "_part"]))
    out = out.drop(*[f"_same_{c}" for c in [*by, "_part"]])
    out = out.withColumns({n: (F.col(f"_t_{n}") + F.col(f"_i_{n}")).cast("bigint") for n in values})
    return out.drop("_part", *[f"_{x}_{n}" for n in values for x in "vsti"])
