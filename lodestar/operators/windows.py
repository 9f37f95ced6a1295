"""Window functions over a whole table, without one task for all rows."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.joins import estimated_bytes

#: Keys that are sampled for each range; bytes of a table that one task numbers.
SAMPLED, ALONE = 50, 8 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def range_number(df: DataFrame, order: list[str], bounds: list) -> Column:
    """How many of some ascending bounds (rows of the order's columns) are not above a row's keys; nulls come first.

    The bounds are literals in blocks, of which one is searched, so a row is compared with about twice the root of their number.
    """
    types = dict(df.dtypes)
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    made = [F.struct(*[F.lit(v).cast(types[c]).alias(f"k{i}") for i, (c, v) in enumerate(zip(order, b, strict=True))]) for b in bounds]
    if not made:
        return F.lit(0)
    size = ceil(sqrt(len(made)))
    blocks = [made[i : i + size] for i in range(0, len(made), size)]
    upto = lambda some: F.size(F.filter(some, lambda b: b <= key))
    block = upto(F.array(*[b[0] for b in blocks]))
    return F.when(block == 0, 0).otherwise((block - 1) * size + upto(F.element_at(F.array(*[F.array(*b) for b in blocks]), block)))


def with_global_rank(df: DataFrame, order: list[str], name: str, alone: int = ALONE) -> DataFrame:
    """A global row number in an ascending order of unique keys, nulls first; all columns stay.

    A table whose estimated size is at most ``alone`` bytes is numbered by one task, which saves two passes.

    Ranges of keys are bounded by a sample of them. Which range a row is in follows from its keys alone, so that their counts
    and their rows agree whatever else the plan holds; each range is numbered apart, from the number of rows before it. Rows
    are shuffled once, and a few numbers for each range go to the driver.
    """
    if estimated_bytes(df) <= alone:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order)
    rows = keys.count()
    some = keys.sample(min(1.0, SAMPLED * parts / max(rows, 1)), seed=7).orderBy(*order).collect()
    bounds = sorted({i * len(some) // parts for i in range(1, parts)} - {0}) if some else []
    number = range_number(df, order, [some[i] for i in bounds])
    counts = {r.part: r["count"] for r in keys.groupBy(number.alias("part")).count().collect()}
    before = [sum(n for p, n in counts.items() if p < i) for i in range(len(bounds) + 1)]
    part = fresh(df, "_part")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col(part) + 1)
    return df.withColumn(part, number).withColumn(name, own + offset).drop(part)


def ntile(ranked: DataFrame, rank: str, buckets: int, rows: int) -> Column:
    """The bucket of each row number: the first ``rows % buckets`` have one row more."""
    size, more = divmod(rows, buckets)
    i = F.col(rank) - 1
    return (F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / max(size, 1))) + 1).cast("long")
