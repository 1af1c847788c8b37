"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of bits, the signs of its products with random directions that are
orthogonal within the tree. A tree's strings are kept as one sorted array, cut into leaves by prefix: dense
prefixes are cut deeper, so that leaves stay small wherever the vectors crowd. A query descends to its longest
prefixes and then ascends in all trees at once, one bit at a time, until the subtrees that share its prefix hold
enough candidates together; these are scored exactly.

Equal vectors are one entry that keeps its k + 1 smallest ids: no others can be among the k nearest of a query.
The number of candidates asked for grows as ``n ** GROWTH``, which keeps the recall level as the table grows.

Defined results: vectors that are NULL, zero, hold NULL or non-finite components, or have another length than
the most common one take no part, nor do rows without an id; ties go to the smaller id; of several vectors of one id
the least in array order counts; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, with_output

TREES = 24
BITS = 60
#: Candidates of a query over all trees: FACTOR * n ** GROWTH, counted with repeats.
FACTOR = 20.0
GROWTH = 0.7
#: Most vectors of a leaf that are worked on together with the queries that reach it; larger leaves go in parts.
LEAF = 20_000
SEED = 20_260
PLACE = [("tree", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32()), ("entry", pa.int64())]


def directions(dimensions: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Trees x bits x dimensions; orthogonal within a tree as far as there are dimensions."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, bits, dimensions))
    for t in range(trees):
        for start in range(0, bits, dimensions):
            basis, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
            part = out[t, start : start + dimensions]
            part[:] = basis[: len(part)]
    return out


def codes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Vectors x trees: each tree's bit string as a number, the first bit highest."""
    found = np.empty((len(vectors), len(planes)), dtype=np.int64)
    for t, plane in enumerate(planes):
        bits = vectors @ plane.T > 0
        found[:, t] = bits @ (1 << np.arange(plane.shape[0] - 1, -1, -1, dtype=np.int64))
    return found


class Directory:
    """The leaves of every tree in order: first string, depth and number of vectors.

    A leaf of more than ``largest`` vectors is worked on in parts.
    """

    def __init__(self, leaves: list[tuple[int, int, int, int]], trees: int, bits: int, largest: float) -> None:
        self.bits = bits
        self.starts, self.totals, self.depths, self.parts = [], [], [], []
        for t in range(trees):
            own = sorted((prefix << (bits - depth), depth, n) for tree, prefix, depth, n in leaves if tree == t)
            self.starts.append(np.array([s for s, _, _ in own], dtype=np.int64))
            self.depths.append(max((d for _, d, _ in own), default=0))
            self.totals.append(np.concatenate(([0], np.cumsum([n for _, _, n in own], dtype=np.int64))))
            self.parts.append(np.array([int(-(-n // largest)) for _, _, n in own], dtype=np.int64))

    def leaf(self, tree: int, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[tree], code, side="right") - 1

    def _range(self, tree: int, code: int, level: int) -> tuple[int, int]:
        """Leaves that hold strings with the first ``level`` bits of ``code``."""
        low = code >> (self.bits - level) << (self.bits - level)
        high = low + (1 << (self.bits - level))
        starts = self.starts[tree]
        a = max(0, int(np.searchsorted(starts, low, side="right")) - 1)
        return a, max(a + 1, int(np.searchsorted(starts, high, side="left")))

    def ascend(self, code: list[int], wanted: float) -> list[tuple[int, int, int]]:
        """(tree, first leaf, last leaf + 1) at the deepest common level whose subtrees hold ``wanted`` vectors."""
        for level in range(max(self.depths), -1, -1):
            reached = [self._range(t, c, level) for t, c in enumerate(code)]
            held = sum(int(self.totals[t][b] - self.totals[t][a]) for t, (a, b) in enumerate(reached))
            if held >= wanted and level:
                return [(t, a, b) for t, (a, b) in enumerate(reached)]
        return [(0, *self._range(0, code[0], 0))]  # the root of any tree is the whole table


def usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & sound & F.exists(embedding, lambda x: x != 0)


def nearest(asked: np.ndarray, stored: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``asked`` the places of the ``keep`` highest inner products in ``stored`` (all, if fewer), ties to the
    first place, and the products, each summed in one order wherever the two vectors meet.

    A matrix product, whose sums depend on its shape, only finds the rows that can be among them.
    """
    rough = asked @ stored.T
    keep = min(keep, len(stored))
    if keep == len(stored):
        at = np.broadcast_to(np.arange(keep), rough.shape)
        return at, _products(asked, stored, at)
    order = np.argpartition(-rough, [keep - 1, keep], axis=1)
    at = np.sort(order[:, :keep], axis=1)
    row = np.arange(len(asked))
    least, next_ = rough[row, order[:, keep - 1]], rough[row, order[:, keep]]
    doubt = 1e-12 * np.linalg.norm(asked, axis=1) * np.linalg.norm(stored, axis=1).max()
    for i in np.flatnonzero(next_ >= least - doubt):  # more than ``keep`` rows may belong to the highest
        may = np.flatnonzero(rough[i] >= least[i] - doubt[i])
        exact = _products(asked[i : i + 1], stored, may[None, :])[0]
        at[i] = may[np.lexsort((may, -exact))[:keep]]
    return at, _products(asked, stored, at)


def _products(asked: np.ndarray, stored: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of each row with its places, in parts of bounded size."""
    out = np.empty(at.shape)
    step = max(1, (1 << 21) // max(1, at.shape[1] * stored.shape[1]))
    for k in range(0, len(at), step):
        out[k : k + step] = (stored[at[k : k + step]] * asked[k : k + step, None, :]).sum(axis=2)
    return out


class HashForest:
    """An index over all usable rows of a table of vectors."""

    def __init__(
        self, spark: SparkSession, vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding",
        trees: int = TREES, factor: float = FACTOR, growth: float = GROWTH,
    ) -> None:
        self.spark, self.k = spark, k
        rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[value].cast("array<double>").alias("v"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        self.dimensions = lengths[0].d if lengths else 0
        self.rows = rows.where(F.size("v") == self.dimensions).groupBy("id").agg(F.min("v").alias("v"))
        order = W.partitionBy("h", "v").orderBy("id")
        hashed = self.rows.select("id", "v", F.xxhash64("v").alias("h"))
        first = hashed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        entries = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        self.entries = materialize(entries.select(F.col("ids")[0].alias("entry"), "h", "v", "ids"), spark, "entries")
        self.n = self.entries.count()
        self.wanted = factor * self.n**growth
        # Leaves grow with the candidates asked for, so the directory grows as n ** (1 - GROWTH) only.
        self.aim = max(64.0, self.wanted / (2 * trees))
        self.trees, self.bits = trees, BITS
        self.planes = directions(self.dimensions, trees) if self.n else None
        if self.n:
            self.strings = materialize(self._strings(), spark, "strings")
            self.directory = Directory(self._leaves(), trees, self.bits, min(LEAF, 4 * self.aim))

    def _strings(self) -> DataFrame:
        planes = self.spark.sparkContext.broadcast(self.planes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = codes(_matrix(batch.column(1)), planes.value)
                    offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                    packed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
                    yield with_output([("entry", None), ("codes", None)], [batch.column(0), packed])

        return self.entries.select("entry", "v").mapInArrow(run, "entry long, codes array<long>")

    def _leaves(self) -> list[tuple[int, int, int, int]]:
        """(tree, prefix, depth, vectors) of all leaves; too large ones are cut by four more bits, again and again."""
        aim = self.aim
        depth = min(self.bits, max(0, int(np.ceil(np.log2(self.n / aim)))))
        flat = self.strings.select(F.posexplode("codes").alias("tree", "code"))
        leaves, heavy = [], None
        while True:
            found = flat.withColumn("prefix", F.shiftright("code", self.bits - depth))
            if heavy is not None:
                shallow = F.shiftright("code", self.bits - last).alias("above")
                above = self.spark.createDataFrame(heavy, "tree int, above long")
                found = found.withColumn("above", shallow).join(F.broadcast(above), ["tree", "above"], "left_semi")
            counted = found.groupBy("tree", "prefix").agg(F.count("*").alias("n")).collect()
            large = 4 * aim if depth < self.bits else float("inf")
            leaves += [(r.tree, r.prefix, depth, r.n) for r in counted if r.n <= large]
            heavy = [(r.tree, r.prefix) for r in counted if r.n > large]
            if not heavy:
                return leaves
            last, depth = depth, min(self.bits, depth + 4)

    def search(self, queries: Callable[[Column], Column]) -> DataFrame:
        """query_id, rank, id, score: the k nearest others found of every usable row whose id ``queries`` holds for."""
        schema = "query_id long, rank int, id long, score double"
        if not self.n:
            return self.spark.createDataFrame([], schema)
        asked = self.rows.where(queries(F.col("id"))).select("id", F.xxhash64("v").alias("h"), "v")
        asked = asked.join(self.entries.select("entry", "h", "v"), ["h", "v"]).select(F.col("id").alias("query_id"), "entry")
        asked = materialize(asked, self.spark, "asked")
        best = self._nearest(asked.select("entry").distinct())
        spread = best.join(self.entries.select(F.col("entry").alias("near"), F.explode("ids").alias("id")), "near")
        pairs = asked.join(spread, "entry").where("id <> query_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return pairs.select("query_id", rank.alias("rank"), "id", "score").where(F.col("rank") <= self.k)

    def _nearest(self, asked: DataFrame) -> DataFrame:
        """entry, near, score: the k + 1 best entries of every asked entry, itself included."""
        sent = self.spark.sparkContext.broadcast((self.directory, self.wanted))
        keep, trees = self.k + 1, self.trees

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directory, wanted = sent.value
            for batch in batches:
                out = []
                for entry, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for t, a, b in directory.ascend(code, wanted):
                        out += [(t, leaf, part, entry) for leaf in range(a, b) for part in range(directory.parts[t][leaf])]
                yield with_output(PLACE, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directory, _ = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = _matrix(batch.column(1), np.int64)
                leaf = np.stack([directory.leaf(t, code[:, t]) for t in range(trees)], axis=1).astype(np.int32)
                parts = np.stack([directory.parts[t][leaf[:, t]] for t in range(trees)], axis=1)
                tree = np.tile(np.arange(trees, dtype=np.int32), len(code))
                entry = np.asarray(batch.column(0))
                mixed = (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                part = (mixed[:, None] % parts).astype(np.int32)
                yield with_output(PLACE, [tree, leaf.reshape(-1), part.reshape(-1), np.repeat(entry, trees)])

        def scored(index: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
            if not len(index) or not len(reached):
                none = pd.Series(dtype=object)
                return pd.DataFrame({"entry": pd.Series(dtype="int64"), "near": none, "score": none})
            index = index.sort_values("entry")
            stored, near = np.stack(index["v"].to_numpy()), index["entry"].to_numpy()
            parts = []
            for start in range(0, len(reached), 256):
                part = reached.iloc[start : start + 256]
                at, score = nearest(np.stack(part["v"].to_numpy()), stored, keep)
                parts.append(pd.DataFrame({"entry": part["entry"], "near": list(near[at]), "score": list(score)}))
            return pd.concat(parts)

        triple = "tree int, leaf int, part int, entry long"
        values = self.entries.select("entry", "v")
        reached = asked.join(self.strings, "entry").select("entry", "codes").mapInArrow(visits, triple).join(values, "entry")
        used = reached.select("tree").distinct()
        index = self.strings.select("entry", "codes").mapInArrow(places, triple)
        index = index.join(used, "tree", "left_semi").join(values, "entry")
        found = index.groupBy("tree", "leaf", "part").cogroup(reached.groupBy("tree", "leaf", "part")).applyInPandas(
            scored, "entry long, near array<long>, score array<double>"
        )
        pairs = found.select("entry", F.explode(F.arrays_zip("near", "score")).alias("p")).select("entry", "p.near", "p.score")
        pairs = pairs.groupBy("entry", "near").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("entry").orderBy(F.desc("score"), "near"))
        return pairs.withColumn("r", rank).where(F.col("r") <= keep).drop("r")


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)
