"""Recursive queries that add only rows not seen before."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from lodestar.sources.lineage import cut


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WITH RECURSIVE ... UNION: the seed's different rows, and what ``step`` makes of the last round's until nothing is new.

    Each round sees the rows that the round before added, less all that are known, nulls being alike; so it ends on cycles.
    Rounds are written once, and only they are read by the next ones.
    """
    rounds = [cut(seed.distinct())]
    while not rounds[-1].isEmpty():
        known = reduce(DataFrame.unionAll, rounds)
        rounds.append(cut(step(rounds[-1]).toDF(*seed.columns).subtract(known)))
    return reduce(DataFrame.unionAll, rounds)
