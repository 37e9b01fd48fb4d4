"""Measures of grey pictures as expressions over arrays: a flat array of pixels, row by row, and a width.

The same measures as ``kernels.quality``, for small pictures that are columns already: no Python.
Borders mirror without their edge; pictures of a row or a column repeat it. Memory is that of the array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the nine neighbours, row by row.
LAPLACE = (0, 1, 0, 1, -4, 1, 0, 1, 0)
NOISE = (1, -2, 1, -2, 4, -2, 1, -2, 1)


def _mirrored(k: Column, n: Column) -> Column:
    """A place just outside 0 to n - 1, mirrored into it."""
    return F.when(n == 1, 0).when(k < 0, -k).when(k >= n, 2 * n - 2 - k).otherwise(k)


def filtered(pixels: Column, width: Column, weights: tuple[int, ...]) -> Column:
    """Each pixel's weighted sum of its neighbours."""
    height = F.floor(F.size(pixels) / width).cast("int")

    def at(i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), i % width
        terms = [F.get(pixels, _mirrored(y + dy, height) * width + _mirrored(x + dx, width)) * weights[3 * (dy + 1) + dx + 1] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if weights[3 * (dy + 1) + dx + 1]]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total

    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), at)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Of the whole population, from exact sums of whole numbers."""
    n = F.size(values).cast("double")
    squares = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v)
    return (squares - total(values).cast("double") * total(values) / n) / n


def noise(pixels: Column, width: Column) -> Column:
    """Immerkaer's estimate of the noise; 0 where a side has fewer than three pixels."""
    height = F.floor(F.size(pixels) / width)
    rough = total(F.transform(filtered(pixels, width, NOISE), F.abs))
    return F.when((width < 3) | (height < 3), 0.0).otherwise(rough * F.lit(math.sqrt(math.pi)) / (6 * (width - 2) * (height - 2)))


def quality(pixels: Column, width: Column) -> dict[str, Column]:
    """blur, contrast, noise and brightness; null where there is no pixel."""
    some = F.size(pixels) > 0
    edges = F.element_at(F.transform(F.array(filtered(pixels, width, LAPLACE)), variance), 1)  # filtered once
    return {
        "blur": F.when(some, edges), "contrast": F.when(some, F.sqrt(variance(pixels))), "noise": F.when(some, noise(pixels, width)), "brightness": F.when(some, mean(pixels)),
    }
