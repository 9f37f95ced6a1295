"""Hexagonal grid cells as 64-bit numbers: functions on their bits, in Spark's expressions only.

Bit 63 is 0, bits 62-59 are the mode (1), 58-56 reserved (0), 55-52 the resolution, 51-45 the base cell, and three bits
follow for each of 15 digits, 7 where a cell is coarser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grid: the base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
BASE_CELLS, FINEST = 122, 15


def _shifted(cell: Column, bits: int, mask: int) -> Column:
    return F.shiftright(cell, bits).bitwiseAND(F.lit(mask).cast("long"))


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value.cast("long"), bits.cast("int"))


def resolution(cell: Column) -> Column:
    return _shifted(cell, 52, 15)


def base_cell(cell: Column) -> Column:
    """-1 for cell 0."""
    return F.when(cell == 0, F.lit(-1).cast("long")).otherwise(_shifted(cell, 45, 127))


def digit(cell: Column, n: int) -> Column:
    """The n-th digit, from 1."""
    return _shifted(cell, 45 - 3 * n, 7)


def is_valid(cell: Column) -> Column:
    """Mode, reserved bits, base cell, digits up to the resolution and those beyond it; NULL for NULL.

    Digits are tested together: beyond the resolution all bits are set, and up to it no digit has all three.
    """
    beyond = _left(F.lit(1), F.lit(45) - 3 * resolution(cell)) - 1
    digits = cell.bitwiseAND(F.lit((1 << 45) - 1).cast("long"))
    sevens = digits.bitwiseAND(F.shiftright(digits, 1)).bitwiseAND(F.shiftright(digits, 2)).bitwiseAND(F.lit(sum(1 << 3 * n for n in range(FINEST))).cast("long"))
    head = (cell > 0) & (_shifted(cell, 59, 15) == 1) & (_shifted(cell, 56, 7) == 0) & (_shifted(cell, 45, 127) < BASE_CELLS)
    return head & (digits.bitwiseAND(beyond) == beyond) & (sevens.bitwiseAND(F.bitwise_not(beyond)) == 0)


def parent(cell: Column, res: int) -> Column:
    """The ancestor at a resolution; raises for an invalid cell or one coarser than that; NULL for NULL."""
    if not 0 <= res <= FINEST:
        raise ValueError(f"no such resolution: {res}")
    below = (1 << (3 * (FINEST - res))) - 1
    out = cell.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit((res << 52) | below).cast("long"))
    fits = is_valid(cell) & (resolution(cell) >= res)
    return F.when(~fits, F.raise_error(F.concat(F.lit("no ancestor of cell "), cell.cast("string"))).cast("long")).otherwise(out)


def center_child(cell: Column, res: int) -> Column:
    """The descendant with only zero digits below the cell; 0 for an invalid cell or a coarser resolution."""
    own = resolution(cell)
    fresh = _left(F.lit(1), 45 - 3 * own) - F.lit(1 << (45 - 3 * res))  # the bits of the new digits
    out = cell.bitwiseAND(F.bitwise_not(fresh)).bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit(res << 52).cast("long"))
    return F.when(cell.isNull(), F.lit(None).cast("long")).when(is_valid(cell) & (own <= res), out).otherwise(F.lit(0).cast("long"))


def is_pentagon(cell: Column) -> Column:
    """A pentagon's base cell and no digit but zeros."""
    upto = F.call_function("shiftright", cell.bitwiseAND(F.lit((1 << 45) - 1).cast("long")), (F.lit(45) - 3 * resolution(cell)).cast("int"))
    return base_cell(cell).isin(*PENTAGONS) & (upto == 0)


def is_class_iii(cell: Column) -> Column:
    return resolution(cell) % 2 == 1


def child_count(cell: Column, res: int) -> Column:
    """7^n descendants; a pentagon has 1 + 5 (7^n - 1) / 6."""
    own = resolution(cell)
    power = F.pow(F.lit(7.0), (res - own).cast("double"))  # exact: below 2^53
    return F.when(own > res, F.lit(0).cast("long")).when(is_pentagon(cell), (1 + 5 * (power - 1) / 6).cast("long")).otherwise(power.cast("long"))


def children(cell: Column, res: int) -> Column:
    """All descendants as an array, level by level; below a pentagon the digit 1 is left out."""

    def level(cells: Column, n: Column) -> Column:
        shift = 45 - 3 * n

        def step(c: Column) -> Column:
            head = c.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseAND(F.bitwise_not(_left(F.lit(7), shift))).bitwiseOR(_left(n, F.lit(52)))
            digits = F.when(is_pentagon(c), F.array(*[F.lit(d).cast("long") for d in (0, 2, 3, 4, 5, 6)])).otherwise(F.array(*[F.lit(d).cast("long") for d in range(7)]))
            return F.transform(digits, lambda d: head.bitwiseOR(_left(d, shift)))

        return F.flatten(F.transform(cells, step))

    own = resolution(cell)
    levels = F.when(own < res, F.sequence(own + 1, F.lit(res).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(own > res, F.array().cast("array<bigint>")).otherwise(F.aggregate(levels, F.array(cell), level))
