"""Spatial joins by grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.joins import BROADCAST_BYTES, FINER, dealt_size, level_of, on_levels, size_at

Box = tuple[str, str, str, str]


def _cell(c: str, size: Column) -> Column:
    return F.floor(F.col(c).cast("double") / size).cast("long")


def _extent(box: Box) -> Column:
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in box)
    return F.greatest(x1 - x0, y1 - y0)


def _valid(df: DataFrame, box: Box) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)) & (_extent(box) < float("inf")))


def _cells(box: Box, size: Column) -> Column:
    """How many cells a box touches."""
    x0, y0, x1, y1 = box
    return (_cell(x1, size) - _cell(x0, size) + 1) * (_cell(y1, size) - _cell(y0, size) + 1)


def grid_join(points: DataFrame, x: str, y: str, shapes: DataFrame, box: Box, size: float, exact: Column | None = None, widest: float | None = None) -> DataFrame:
    """Pairs of points and shapes whose boxes hold them, then an exact condition.

    A shape is dealt to each cell that its box touches, on the finest level of cells where those are few, and a point to its
    cell on each level that shapes have; so pairs meet by an equi-join, none is found twice, and no shape is copied more than
    (FINER + 2)^2 times. A hot cell's points can be split by adaptive execution, as no aggregate stands below the join.
    ``widest``, the greatest side of a box, saves the pass that finds it.
    """
    x0, y0, x1, y1 = box
    valid = _valid(shapes, box)
    level = level_of(_extent(box), size)
    levels, total = dealt_size(valid, level, _cells(box, size_at(size, level)), widest, size, 2)
    level = F.least(level, F.lit(levels - 1)) if levels > 1 else F.lit(0)
    own = size_at(size, level) if levels > 1 else F.lit(float(size))
    at = lambda c, k: _cell(c, F.lit(float(size * FINER**k)))
    left = on_levels(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [{"_cx": at(x, k), "_cy": at(y, k)} for k in range(levels)])
    right = valid.withColumn("_level", level).withColumn("_cx", F.explode(F.sequence(_cell(x0, own), _cell(x1, own)))).withColumn("_cy", F.explode(F.sequence(_cell(y0, own), _cell(y1, own))))
    right = F.broadcast(right) if total <= BROADCAST_BYTES else right.hint("merge")
    met = left.join(right, ["_level", "_cx", "_cy"]).where(F.col(x).between(F.col(x0), F.col(x1)) & F.col(y).between(F.col(y0), F.col(y1)))
    return (met.where(exact) if exact is not None else met).drop("_level", "_cx", "_cy")


def forms_join(places: DataFrame, x: str, y: str, shapes: DataFrame, form: list[str], box: Box, size: float, exact: Column | None = None, widest: float | None = None) -> DataFrame:
    """``grid_join`` of places, each given once, with each form of shape once: shapes equal in the columns ``form`` hold the same points.

    For aggregates over the points of each shape, which is joined with its form's aggregate afterwards: points on one place and
    shapes of one form then cost a row each and not a pair each. ``form`` must determine the box and the exact condition.
    """
    return grid_join(places, x, y, shapes.dropDuplicates(form).select(*dict.fromkeys([*form, *box])), box, size, exact, widest)


def least_of_places(points: DataFrame, x: str, y: str, key: str, n: int) -> DataFrame:
    """The ``n`` least keys of the points on each place; rows are cut down before they are shuffled."""
    own = F.row_number().over(Window.partitionBy(x, y).orderBy(key))
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_own", own).where(F.col("_own") <= n).drop("_own")


def boxes_join(a: DataFrame, a_box: Box, b: DataFrame, b_box: Box, size: float, widest: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes have a point in common; the sides' columns must differ in name.

    Two boxes meet on the coarser of their levels, in cells that both touch, and count in the least of these; so no pair is
    found twice and no box is copied more than (FINER + 2)^2 times a level.
    """
    a, b = _valid(a, a_box), _valid(b, b_box)
    sizes = [dealt_size(df, level_of(_extent(box), size), _cells(box, size_at(size, level_of(_extent(box), size))), widest, size, 2) for df, box in ((a, a_box), (b, b_box))]
    levels = max(n for n, _ in sizes)
    level = lambda box: F.least(level_of(_extent(box), size), F.lit(levels - 1)) if levels > 1 else F.lit(0)

    def dealt(df: DataFrame, box: Box, own: str) -> DataFrame:
        x0, y0, x1, y1 = box
        df = df.withColumn(own, level(box)).withColumn("_level", F.explode(F.sequence(F.col(own), F.lit(levels - 1))))
        at = size_at(size, F.col("_level"))
        return df.withColumn("_cx", F.explode(F.sequence(_cell(x0, at), _cell(x1, at)))).withColumn("_cy", F.explode(F.sequence(_cell(y0, at), _cell(y1, at))))

    right = dealt(b, b_box, "_lb")
    right = F.broadcast(right) if sizes[1][1] * levels <= BROADCAST_BYTES else right.hint("merge")
    met = dealt(a, a_box, "_la").join(right, ["_level", "_cx", "_cy"]).where(F.col("_level") == F.greatest("_la", "_lb"))
    at = size_at(size, F.col("_level"))
    least = lambda p, q: F.floor(F.greatest(F.col(p).cast("double"), F.col(q).cast("double")) / at).cast("long")
    met = met.where((F.col("_cx") == least(a_box[0], b_box[0])) & (F.col("_cy") == least(a_box[1], b_box[1])))
    common = (F.col(a_box[0]) <= F.col(b_box[2])) & (F.col(b_box[0]) <= F.col(a_box[2])) & (F.col(a_box[1]) <= F.col(b_box[3])) & (F.col(b_box[1]) <= F.col(a_box[3]))
    return met.where(common).drop("_level", "_cx", "_cy", "_la", "_lb")
