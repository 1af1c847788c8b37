"""Set measures between two label arrays already reduced to distinct, non-null elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (overlap_size(a, b) == F.size(a))


def jaccard(a: Column, b: Column, empty_is_match: bool = True) -> Column:
    """|a∩b| / |a∪b|; two empty sets score 1 or 0 as chosen."""
    union = F.size(F.array_union(a, b))
    empty = F.lit(1.0 if empty_is_match else 0.0)
    return F.when(union == 0, empty).otherwise(overlap_size(a, b) / union)


def disjoint(a: Column, b: Column) -> Column:
    """No common element; an empty array is disjoint from everything."""
    return ~F.arrays_overlap(a, b)


def has_label(items: Column, label: str) -> Column:
    return F.array_contains(items, label)
