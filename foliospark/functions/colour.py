"""Luminance and weighted difference of colours (structs of r, g, b and a, 0 to 255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of red, green and blue in the axes Y, I and Q, and those of the axes in a difference.
Y = (0.29889531, 0.58662247, 0.11448223)
I = (0.59597799, -0.27417610, -0.32180189)  # noqa: E741
Q = (0.21147017, -0.52261711, 0.31114694)
FIRST, SECOND = (0.48, 0.48), (0.3, 0.3)
CHANNELS = ("r", "g", "b", "a")


def _axis(weights: tuple, c: Column) -> Column:
    return sum((F.lit(w) * c[n] for w, n in zip(weights[1:], "gb", strict=True)), F.lit(weights[0]) * c["r"])


def luminance(c: Column) -> Column:
    return _axis(Y, c)


def difference(a: Column, b: Column) -> Column:
    """The root of two weighted sums of squares over Y, I and Q; brightness (and one I term) by the mean opacity."""
    y, i, q = (_axis(w, a) - _axis(w, b) for w in (Y, I, Q))
    opacity = (a["a"] + b["a"]) / F.lit(510.0)
    one = opacity * (y * y + FIRST[0] * i * i) + FIRST[1] * q * q
    two = opacity * y * y + SECOND[0] * i * i + SECOND[1] * q * q
    return F.sqrt(F.greatest(one, F.lit(0.0)) + F.greatest(two, F.lit(0.0)))
