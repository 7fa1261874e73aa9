"""Small groups as rows: what links rows of one group only is solved a batch of groups at a time, with the distributed way for groups of any size.

A group (a page, say) of at most `most` rows becomes one row with arrays; numpy sees an Arrow batch of these. Larger groups, and rows
that can't be compared in numpy, are left to the joins and components of the caller.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rows of a group up to which it is one row.
MOST = 1 << 14


def split(rows: DataFrame, keys: list[str], plain: Column | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that are solved as one row, and the others (None if there are none). Rows are read twice: they should be a table.

    `plain` says which rows numpy can compare; a group with another one is left to the joins, as is one with a null key.
    """
    odd = F.lit(False) if plain is None else ~F.coalesce(plain, F.lit(False))
    none = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(odd | none).alias("_odd")).filter((F.col("_n") > most) | F.col("_odd")).select(*keys)
    if large.isEmpty():
        return rows, None
    same = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    met = lambda how: rows.alias("r").join(large.alias("l"), same, how)
    return met("left_anti"), met("left_semi")


def single(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other has, or is null, and the others (None if there are none). The keys that several rows have are written, so that Spark knows how few they are."""
    twice = written(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), "twice")
    if twice.isEmpty():
        return rows, None
    return rows.join(twice, key, "left_anti"), rows.join(twice, key, "left_semi")


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) reach from it."""
    label = np.arange(n)
    while len(a):
        # the greater root hangs below the smaller one, then every node below the root of its root
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places i < j of each group, for groups that lie one after the other."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    after = np.repeat(sizes, sizes) - 1 - place
    first = np.repeat(np.arange(len(place)), after)
    step = np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
    return first, first + 1 + step


def lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sizes of the lists of an array of structs without nulls, and the fields of all elements, one after the other."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
