"""Distributed LSD radix sort: stable counting-sort passes over the digits of a composite key.

Rows have a position; ``BLOCK`` of them in a row are a block. A pass counts the rows of each block by digit, and
prefix sums of these counts over (digit, block) are the places where each block's rows of a digit begin. A task then
moves one block: its rows, in the order of their positions, go to that place plus their number within the digit.
So no task holds more than a block, whatever values the keys have, and after the last pass the position is the rank.
Every pass is written to the shared folder: a lost executor costs the blocks it was moving.

Defined results: NULL keys come last; equal keys keep the order in which the rows were first stored; digits in which
no two keys differ need no pass; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

DIGIT_BITS = 16
BLOCK = 1 << 19

POSITION = "_position"


def ascending(value: Column) -> list[Column]:
    """Keys of an integer column: whether it is NULL, and its value."""
    return [value.isNull().cast("long"), F.coalesce(value.cast("long"), F.lit(0).cast("long"))]


def descending(value: Column) -> list[Column]:
    return [value.isNull().cast("long"), ascending(F.bitwise_not(value.cast("long")))[1]]


def _unsigned(name: str, lowest: int, highest: int) -> Column:
    """The key counted from its lowest value; over the widest ranges, its bits with the sign turned."""
    if highest - lowest < 1 << 63:
        return F.col(name) - F.lit(lowest)
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def _numbered(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Stored rows with dense positions: within the part that wrote them, after all parts before it."""
    placed = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), spark, "radix-rows")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per writing task
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(POSITION, F.col("_before") + within).drop("_part", "_before", "_place")


def _offsets(rows: DataFrame, digit: Column) -> DataFrame:
    """_of (the block), _digit, _start: where the rows of a block with a digit begin after the pass.

    The sum over blocks runs within each digit; the one window without a key sees a row per digit at most.
    """
    counts = rows.groupBy("_block", digit.alias("_digit")).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    smaller = W.orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
    totals = totals.select("_digit", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_below"))
    # At most 2 ** DIGIT_BITS totals.
    joined = counts.join(F.broadcast(totals), "_digit")
    return joined.select(F.col("_block").alias("_of"), "_digit", (F.col("_start") + F.col("_below")).alias("_start"))


def _move(digit_key: str, shift: int, bits: int):
    def move(rows: pa.Table, starts: pa.Table) -> pa.Table:
        position = rows.column(POSITION).to_numpy()
        first = int(position.min())
        at = np.empty(len(position), dtype=np.int64)
        at[position - first] = np.arange(len(position))  # positions of a block are dense
        key = rows.column(digit_key).to_numpy()[at].view(np.uint64)
        digit = (key >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        start = np.zeros(1 << bits, dtype=np.int64)
        start[starts.column("_digit").to_numpy()] = starts.column("_start").to_numpy()
        # Counting sort within the block: places by digit, then the number within the digit.
        below = np.cumsum(np.bincount(digit, minlength=1 << bits)) - np.bincount(digit, minlength=1 << bits)
        order = np.argsort(digit.astype(np.uint16), kind="stable")
        place = np.empty(len(digit), dtype=np.int64)
        place[order] = np.arange(len(digit)) - below[digit[order]]
        moved = rows.take(pa.array(at))
        return moved.set_column(moved.schema.get_field_index(POSITION), POSITION, pa.array(start[digit] + place))

    return move


def radix_sort(
    spark: SparkSession, rows: DataFrame, keys: list[Column], block: int = BLOCK, digit_bits: int = DIGIT_BITS
) -> DataFrame:
    """The rows with ``_position``, from 0 in the order of ``keys``: integers, of which the first weighs most."""
    if not 1 <= digit_bits <= 16:
        raise ValueError("a digit has 1 to 16 bits")
    names = [f"_key{i}" for i in range(len(keys))]
    held = materialize(rows.withColumns(dict(zip(names, keys, strict=True))), spark, "radix-keys")
    ends = held.agg(*[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return held.drop(*names).withColumn(POSITION, F.lit(0).cast("long"))
    from_zero = {n: _unsigned(n, ends[f"min{n}"], ends[f"max{n}"]) for n in names}
    held = _numbered(held.withColumns(from_zero), spark)
    found = held.agg(*[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.bit_and, F.bit_or)]).first()
    schema = T.StructType(held.schema.fields)
    for name in reversed(names):
        varying = (found[f"bit_or{name}"] & ~found[f"bit_and{name}"]) & ((1 << 64) - 1)
        for shift in range(0, 64, digit_bits):
            bits = min(digit_bits, 64 - shift)
            if not varying >> shift & ((1 << bits) - 1):
                continue
            blocks = held.withColumn("_block", F.floor(F.col(POSITION) / block))
            digit = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << bits) - 1))
            starts = _offsets(blocks, digit)
            both = blocks.groupBy("_block").cogroup(starts.groupBy("_of"))
            into = T.StructType([*schema.fields, T.StructField("_block", T.LongType())])
            moved = both.applyInArrow(_move(name, shift, bits), into).drop("_block")
            held = materialize(moved, spark, "radix-pass")
    return held.drop(*names)
