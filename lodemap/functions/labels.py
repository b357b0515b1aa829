"""Packed labels and class maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMANTIC_BITS = 0xFFFF
#: What one public decoder keeps of a label before it multiplies: an addition that binds tighter than the bit operation.
ODD_MASK = 0xFFFF + 10


def semantic(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(SEMANTIC_BITS).cast("long"))


def instance(packed: Column, mode: str = "clean") -> Column:
    """``clean``: the upper 16 bits. ``reference``: the published decoder's value modulo 2³², where several classes are 0."""
    upper = F.shiftright(packed, 16)
    if mode == "clean":
        return upper
    return F.pmod(F.shiftleft(upper, 16) * packed.bitwiseAND(F.lit(ODD_MASK).cast("long")), F.lit(1 << 32).cast("long"))


def panoptic(packed: Column) -> Column:
    """The instance, or the class of points without one."""
    upper = F.shiftright(packed, 16)
    return F.when(upper == 0, semantic(packed)).otherwise(upper)


def packed(sem: Column, inst: Column) -> Column:
    return sem.cast("long") + F.shiftleft(inst.cast("long"), 16)


def packed_thousands(sem: Column, inst: Column) -> Column:
    """Class times 1000 plus instance, in 16 bits."""
    return F.pmod(sem.cast("long") * 1000 + inst.cast("long"), F.lit(65536).cast("long"))


def unpacked_thousands(value: Column) -> Column:
    return F.pmod(value, F.lit(1000).cast("long"))


def remapped(raw: Column, table: dict[int, int], default: int | None = None) -> Column:
    """A class through a map; a missing one is ``default``."""
    pairs = F.create_map(*(F.lit(v) for pair in sorted(table.items()) for v in pair))
    return F.coalesce(pairs[raw], F.lit(default))
