"""Joins that Spark's planner has no good plan for by itself: ranges, skewed keys, small sides of a checked size."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated bytes up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output, from file sizes; large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES, copies: float = 1) -> DataFrame:
    """The side marked for broadcast if its estimate allows that; else as it is, for a shuffled join.

    ``copies`` is the greatest number of rows that each row of the estimate becomes before the join.
    """
    return F.broadcast(df) if estimated_bytes(df) * copies <= most else df


#: How much coarser each level of buckets is; a range touches at most two buckets more.
FINER = 4


def level_of(span: Column, width: float) -> Column:
    """The finest level of buckets at which a span touches a few only: buckets of a level are ``width * FINER ** level`` wide."""
    above = F.ceil(F.log(span / F.lit(float(width))) / F.log(F.lit(float(FINER)))) - 1
    return F.when(span <= width * FINER, F.lit(0)).otherwise(F.greatest(above, F.lit(0))).cast("int")


def size_at(width: float, level: Column) -> Column:
    """How wide the buckets of a level are."""
    return F.lit(float(width)) * F.pow(F.lit(float(FINER)), level)


def dealt_size(df: DataFrame, level: Column, copies: Column, widest: float | None, width: float, axes: int = 1) -> tuple[int, float]:
    """How many levels rows are on, and the bytes they take once each is copied.

    Both follow from the greatest span where the caller says it; else rows and copies are counted, which takes a pass.
    """
    if widest is not None:
        levels = 1 if widest <= width * FINER else ceil(log(widest / width) / log(FINER))
        return levels, estimated_bytes(df) * (min(widest // width, FINER) + 2) ** axes
    found = df.agg(F.max(level).alias("level"), F.sum(copies.cast("double")).alias("copies"), F.count(F.lit(1)).alias("n")).first()
    return (found.level or 0) + 1, (found.copies or 0) * max(estimated_bytes(df) / max(found.n, 1), 64)


def on_levels(points: DataFrame, places: list[dict[str, Column]]) -> DataFrame:
    """Points with their buckets (columns by name) on each level."""
    if len(places) == 1:
        return points.withColumns({"_level": F.lit(0), **places[0]})
    dealt = F.array(*[F.struct(F.lit(k).alias("_level"), *[c.alias(n) for n, c in p.items()]) for k, p in enumerate(places)])
    return points.withColumn("_place", F.explode(dealt)).select("*", "_place.*").drop("_place")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, widest: float | None = None) -> DataFrame:
    """Pairs with low <= point <= high, by an equi-join on buckets of ``width`` and of coarser levels.

    A range is dealt to the buckets it touches at the finest level where those are few, a point to one bucket of each level
    that ranges have, so no pair is found twice and no range is copied more than FINER + 2 times, however wide it is. Null
    points and bounds, and ranges whose low is above high, match nothing; bounds must be finite. ``widest``, the greatest span,
    saves the pass that finds it; a range beyond it is found too, but copied to more buckets.
    """
    span = F.col(high).cast("double") - F.col(low).cast("double")
    valid = ranges.where((F.col(low) <= F.col(high)) & (span < float("inf")))
    bucket = lambda c, size: F.floor(F.col(c).cast("double") / size).cast("long")
    level = level_of(span, width)
    levels, total = dealt_size(valid, level, bucket(high, size_at(width, level)) - bucket(low, size_at(width, level)) + 1, widest, width)
    level = F.least(level, F.lit(levels - 1)) if levels > 1 else F.lit(0)
    own = size_at(width, level) if levels > 1 else F.lit(float(width))
    right = valid.withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(bucket(low, own), bucket(high, own))))
    left = on_levels(points.where(F.col(point).isNotNull()), [{"_bucket": bucket(point, F.lit(float(width * FINER**k)))} for k in range(levels)])
    right = F.broadcast(right) if total <= BROADCAST_BYTES else right.hint("merge")
    return left.join(right, ["_level", "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_level", "_bucket")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """A join whose keys are split into ``salts`` parts: the left side's rows at random, the right side's copied to each part.

    For keys that adaptive execution can't split, such as in joins below an aggregate on the same key. Left, semi, anti and
    inner joins keep their meaning, as each left row meets every right row of its key exactly once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't be salted on its left side")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN with SQL's nulls: nothing if the list has a null; rows with a null key only if the list is empty.

    The list's two facts are one row from a partial aggregate; the rows themselves are found by an ordinary anti join.
    """
    keys = right.select(F.col(right_key).alias("_k"))
    facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_k").isNull()).alias("_nulls"))
    kept = left.join(keys.where("_k IS NOT NULL"), F.col(left_key) == F.col("_k"), "left_anti")
    return kept.join(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(left_key).isNotNull())).drop("_n", "_nulls")


def star(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]], filters: list[Column] = ()) -> DataFrame:
    """A fact table joined with dimensions (table, fact's key, its key); each is broadcast if small enough."""
    for dim, fact_key, dim_key in dimensions:
        fact = fact.join(small(dim), F.col(fact_key) == F.col(dim_key))
    for f in filters:
        fact = fact.where(f)
    return fact
