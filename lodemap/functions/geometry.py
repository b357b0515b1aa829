"""Rigid transforms, projections and distances as column expressions; matrices are arrays of doubles, row by row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Elevation offset of the HDL-64 sensor, in degrees.
CALIBRATION_DEGREES = 0.205


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def norm(*axes: Column | str) -> Column:
    return F.sqrt(squared(*axes))


def squared(*axes: Column | str) -> Column:
    total = F.lit(0.0)
    for a in axes:
        total = total + _col(a) * _col(a)
    return total


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return squared(*(a - b for a, b in zip(left, right, strict=True)))


def transformed(matrix: Column | str, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> list[Column]:
    """The point moved by a 4×4 or 3×4 matrix column."""
    m, p = _col(matrix), [_col(a) for a in (x, y, z)]
    return [m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)]


def transformed_back(matrix: Column | str, x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> list[Column]:
    """The point moved by the inverse of a rigid matrix: its rotation is transposed."""
    m, p = _col(matrix), [_col(a) for a in (x, y, z)]
    d = [p[r] - m[4 * r + 3] for r in range(3)]
    return [m[c] * d[0] + m[4 + c] * d[1] + m[8 + c] * d[2] for c in range(3)]


def matrix(rotation: Sequence[Column], translation: Sequence[Column]) -> Column:
    """A 4×4 from nine rotation entries and three of translation."""
    rows = [c for r in range(3) for c in (*rotation[3 * r : 3 * r + 3], translation[r])]
    return F.array(*rows, *(F.lit(float(v)) for v in (0, 0, 0, 1)))


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The nine rotation entries of a unit quaternion."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def calibrated(x: Column | str = "x", y: Column | str = "y", z: Column | str = "z", degrees: float = CALIBRATION_DEGREES) -> list[Column]:
    """A ray turned upwards about its horizontal normal; a point on the vertical axis has no such normal and gives nulls."""
    x, y, z = _col(x), _col(y), _col(z)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    rho = F.sqrt(x * x + y * y)
    scale = F.when(rho > 0, F.lit(c) - F.lit(s) * z / rho)
    return [x * scale, y * scale, F.when(rho > 0, z * c + rho * s)]


def pixel(x: Column, y: Column, z: Column, focal: float, cu: float, cv: float) -> tuple[Column, Column]:
    """Pinhole pixel (u, v), halves to even; null where the depth isn't positive."""
    depth = F.when(z > 0, z)
    return F.rint(x / depth * focal + cu).cast("int"), F.rint(y / depth * focal + cv).cast("int")


def cell(axis: Column | str, size: float, origin: Column | float = 0.0) -> Column:
    """The number of the grid cell."""
    return F.floor((_col(axis) - origin) / size).cast("long")


def unit(v: Sequence[Column], least: float = 1e-6) -> list[Column]:
    """The direction of a vector, with ``least`` added to its length."""
    return [a / (norm(*v) + least) for a in v]


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    dot = sum((x * y for x, y in zip(unit(a), unit(b), strict=True)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def upward(normal: Sequence[Column], within_degrees: float = 10.0) -> Column:
    """Whether a normal points up within an angle."""
    return (angle(normal, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]) <= math.radians(within_degrees)) & (normal[2] > 0)


def fourier(axis: Column | str, scale: float, bands: int) -> Column:
    """Sines, then cosines, of an axis at frequencies from 1 to ``scale`` on a logarithmic scale."""
    steps = [scale ** (i / max(1, bands - 1)) for i in range(bands)]
    values = [_col(axis) * f * math.pi for f in steps]
    return F.array(*(F.sin(v) for v in values), *(F.cos(v) for v in values))


def scaled_index(index: Column | str, small: int, large: int) -> Column:
    """A pixel's index on a coarser raster, cut towards zero."""
    return (_col(index) * (small / large)).cast("int")
