"""Source divergence audit: which sources of a language use words differently, and which words set them apart.

Texts are factored into chunks between ASCII blanks, which no term crosses. Chunks are counted per document and folded
by language and source inside the task; every globally distinct chunk is tokenized once, and its terms are joined back
to its counts. The occurrences of a term are the sum over its chunks. Whether a term stands in enough documents follows
for nearly all terms from the chunks' own document counts (the greatest of them is too few, their sum too many); only
for terms in between are documents told apart.

Groups are compared over all kept terms of their language in dense tiles: ``SOURCES`` by ``SOURCES`` sources and about
``TERMS`` terms, so that no task holds a whole language. Terms that neither group of a tile uses all have the value of
two zero counts, and are added by their number. The divergence is symmetric, so each tile is computed once.

Defined results: NULL text, language and source are empty ones; groups without terms are groups; a language without kept
terms gives pairs of value 0 and no term rows; documents are rows, so repeated ones count again; an empty table gives
no rows. All arithmetic is exact: shares are integers out of ``SHARE``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy
from .decontam import _sized

#: Everything that is no term character: left are the letters a-z, and all of Unicode beyond ASCII.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 10
SHARE = 1_000_000_000
TOP = 10
SOURCES = 128
TERMS = 1024
#: Bytes of text whose chunks are folded together.
RUN_BYTES = 16 << 20
#: 2 ** BITS bits tell which chunks a second reading is after (2 MB to each task), by this many bytes of a chunk.
BITS = 24
HASHED = 24
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Terms of a chunk that are counted within its row.
FEW = 32
#: Bytes of a longer text that are split at a time.
PIECE = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes that end at blanks."""
    start = 0
    while len(text) - start > PIECE:
        end = _BLANK.search(text, start + PIECE)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:] if start else text


def _distinct(batch: pa.RecordBatch, asked=None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: their distinct chunks, and for every chunk of every document its row, its number among them and how
    often it stands there. Only chunks that ``asked`` marks, if given."""
    texts = batch.column("text")
    for k, part in _runs(texts):
        if len(part) == 1 and pc.binary_length(part)[0].as_py() > RUN_BYTES:
            found: Counter = Counter()
            for piece in _pieces(part[0].as_py().encode()):
                found.update(piece.split())
            chunks, times = pa.array([*found], pa.string()), np.array([*found.values()], dtype=np.int64)
            code = np.flatnonzero(asked(chunks)) if asked else np.arange(len(chunks))
            yield chunks, np.full(len(code), k), code, times[code]
            continue
        split = pc.ascii_split_whitespace(part)
        coded = split.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(split.offsets.to_numpy()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        if asked:
            use = asked(coded.dictionary)[index]
            row, index = row[use], index[use]
        key = np.sort(row * size + index)
        start = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(start, append=len(key))
        row, code = np.divmod(key[start], size)
        # Blanks at the ends of a text, or nothing but blanks, give an empty chunk.
        full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[code] > 0
        yield coded.dictionary, row[full] + k, code[full], times[full]


def _runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """First row and texts of runs of about ``RUN_BYTES``; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
        yield start, texts.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g (the group), chunk, occurrences and documents, folded over runs of rows."""
    for batch in batches:
        groups = batch.column("g").to_numpy()
        for chunks, row, code, times in _distinct(batch):
            size = max(1, len(chunks))
            known, group = np.unique(groups[row], return_inverse=True)
            key = group.astype(np.int64) * size + code
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            if not len(start):
                continue
            of, code = np.divmod(key[order][start], size)
            counts = [np.add.reduceat(times[order], start), np.diff(start, append=len(order))]
            columns = [pa.array(known[of]), chunks.take(pa.array(code)), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "chunk", "occurrences", "documents"])
        tidy()


def _places(chunks: pa.Array) -> np.ndarray:
    """Where the bit of each chunk stands: a hash of its length and its first bytes."""
    size = pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(chunks.buffers()[2] or b"", dtype=np.uint8)
    wide = pa.types.is_large_string(chunks.type)
    first = np.frombuffer(chunks.buffers()[1], dtype=np.int64 if wide else np.int32)[chunks.offset : chunks.offset + len(chunks)]
    found = size.astype(np.uint64)
    for k in range(min(HASHED, int(size.max(initial=0)))):
        more = np.flatnonzero(size > k)
        found[more] = (found[more] ^ data[first[more].astype(np.int64) + k]) * _PRIME
    return (found ^ found >> np.uint64(29)) * _PRIME >> np.uint64(64 - BITS)


def _chunks_met(bits: np.ndarray):
    """did, lang and each distinct chunk of a document whose bit is set."""

    def asked(chunks: pa.Array) -> np.ndarray:
        place = _places(chunks)
        return bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunks, row, code, _ in _distinct(batch, asked):
                columns = [batch.column(c).take(pa.array(row)) for c in ("did", "lang")]
                yield pa.RecordBatch.from_arrays([*columns, chunks.take(pa.array(code))], names=["did", "lang", "chunk"])
            tidy()

    return run


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0)).astype(np.int64))], names=["place"])


def _bitmap(chunks: DataFrame) -> np.ndarray:
    """The bits of all chunks, folded in Spark to at most ``2 ** BITS / 64`` numbers."""
    placed = chunks.select("chunk").mapInArrow(_place_rows, "place long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << BITS - 6, dtype=np.uint64)
    for row in placed.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        out[row["word"]] = row["bits"] % (1 << 64)
    return out


def _group_id() -> Column:
    return F.xxhash64("lang", "source").alias("g")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (count + 2) / (total + 2 * terms)), exactly."""
    wide = "decimal(38,0)"
    above = F.lit(SHARE).cast("decimal(10,0)") * (count + 2).cast("decimal(25,0)")
    return 1 + F.call_function("div", above.cast(wide), (total + 2 * terms).cast(wide))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Vocabulary:
    """Counts of the kept terms of every language, and the groups there are; all stored."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str, lang: str, source: str, min_documents: int):
        self.spark, self.min_documents = spark, min_documents
        empty = F.lit("")
        named = [F.coalesce(docs[c].cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
        self.docs = docs.select(F.coalesce(docs[text], empty).alias("text"), *named)
        self.groups = materialize(self._groups(), spark, "groups")
        # Nearly all rows of a run differ, so a fold in front of the shuffle would only cost.
        rows = self.docs.select(_group_id(), "text").mapInArrow(_count_chunks, "g long, chunk string, occurrences long, documents long")
        counted = rows.repartition("chunk").groupBy("g", "chunk")
        counted = counted.agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
        counted = materialize(counted, spark, "chunks").join(_sized(self.groups), "g")
        # One row per distinct chunk, with the languages it occurs in; one shuffle serves both folds.
        spoken = counted.select("chunk", "lang", "documents").repartition("chunk").groupBy("chunk", "lang").agg(F.sum("documents").alias("documents"))
        chunks = spoken.groupBy("chunk").agg(F.collect_list(F.struct("lang", "documents")).alias("langs"))
        self.chunks = materialize(chunks.withColumn("cid", F.monotonically_increasing_id()), spark, "distinct-chunks")
        tokenized = self._tokenized().select("cid", "chunk", "term", "times", F.inline("langs"))
        self.spellings = materialize(tokenized, spark, "chunk-terms")
        self.kept = materialize(self._kept(), spark, "kept-terms")
        wanted = self.spellings.join(_sized(self.kept), ["lang", "term"], "left_semi").select("lang", "chunk", "term", "times")
        wanted = materialize(wanted, spark, "kept-chunks")
        cells = counted.select("lang", "source", "chunk", "occurrences").join(_sized(wanted), ["lang", "chunk"]).groupBy("lang", "source", "term")
        self.cells = materialize(cells.agg(F.sum(F.col("occurrences") * F.col("times")).alias("count")), spark, "term-counts")

    def _groups(self) -> DataFrame:
        """g, lang, source of every group, read without the texts. Groups are told by a hash while chunks are counted;
        should two share one, the audit fails instead of mixing them."""
        groups = self.docs.select(_group_id(), "lang", "source").distinct()
        alone = F.count("*").over(W.partitionBy("g")) == 1
        return groups.withColumn("g", F.when(alone, F.col("g")).otherwise(F.raise_error(F.lit("two groups share a hash")).cast("long")))

    def _tokenized(self) -> DataFrame:
        """cid, chunk, langs, term, times: each distinct chunk's terms, with how often it holds them."""
        lowered = F.translate("chunk", ascii_uppercase, ascii_lowercase)
        split = self.chunks.withColumn("terms", F.array_remove(F.split(lowered, SEPARATORS), ""))
        few = split.where(F.size("terms") <= FEW).withColumn("term", F.explode(F.array_distinct("terms")))
        times = (F.size("terms") - F.size(F.array_remove("terms", F.col("term")))).cast("long")
        few = few.select("cid", "chunk", "langs", "term", times.alias("times"))
        # Comparing each term with all would be quadratic in the rare chunks of very many; these are counted as rows.
        many = split.where((F.length("chunk") > 2 * FEW) & (F.size("terms") > FEW))
        counted = many.select("cid", F.explode("terms").alias("term")).groupBy("cid", "term").agg(F.count("*").alias("times"))
        return few.unionByName(counted.join(many.select("cid", "chunk", "langs"), "cid"))

    def _kept(self) -> DataFrame:
        """(lang, term) that stand in enough documents of the language."""
        bounds = self.spellings.groupBy("lang", "term").agg(F.max("documents").alias("least"), F.sum("documents").alias("most"))
        bounds = materialize(bounds.where(F.col("most") >= self.min_documents), self.spark, "bounds")
        sure = bounds.where(F.col("least") >= self.min_documents).select("lang", "term")
        # A document may hold several spellings of these; each spelling is rare in the language.
        open_ = bounds.where(F.col("least") < self.min_documents).select("lang", "term")
        spelled = self.spellings.join(_sized(open_), ["lang", "term"], "left_semi").select("lang", "chunk", "term")
        spelled = materialize(spelled, self.spark, "open-terms")
        if spelled.isEmpty():
            return sure
        rows = self.docs.select(F.monotonically_increasing_id().alias("did"), "lang", "text")
        # The bits only spare most chunks the way to the join, which decides.
        met = rows.mapInArrow(_chunks_met(_bitmap(spelled)), "did long, lang string, chunk string")
        met = met.join(_sized(spelled), ["lang", "chunk"]).select("lang", "term", "did").distinct()
        settled = met.groupBy("lang", "term").agg(F.count("*").alias("documents"))
        return sure.unionByName(settled.where(F.col("documents") >= self.min_documents).select("lang", "term"))

    def group_sizes(self) -> DataFrame:
        """lang, source, n (occurrences of kept terms), v (kept terms of the language), zero (share of no occurrence)."""
        n = self.cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        v = self.kept.groupBy("lang").agg(F.count("*").alias("v"))
        sized = self.groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
        zero = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v")))
        return sized.withColumn("zero", zero)


def _compare_tile(rows: pa.Table) -> pa.Table:
    """Partial sums for all pairs of sources of a tile, in both directions, over the terms that the tile holds."""
    frame = rows.select(["source", "block", "zero", "term", "share"]).to_pandas()
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    told = frame[frame.term.isna()].drop_duplicates("source").sort_values("source").reset_index(drop=True)
    cells = frame[frame.term.notna()]
    place = pd.Series(told.index, index=told.source)
    columns, seen = pd.factorize(cells.term)
    zero = told.zero.fillna(0).to_numpy().astype(np.int64)
    shares = np.repeat(zero[:, None], len(seen), axis=1)
    shares[place[cells.source].to_numpy(), columns] = cells.share.to_numpy().astype(np.int64)
    left, right = np.flatnonzero(told.block == low), np.flatnonzero(told.block == high)
    names = told.source.to_numpy()
    out: list[list] = [[], [], [], [], []]
    for i in left:
        others = right[right > i] if low == high else right
        p, q = shares[i][None, :], shares[others]
        # Without kept terms all shares are 0, and so is the value.
        part = ((p - q) ** 2 // np.maximum(p + q, 1)).sum(axis=1)
        none = (zero[i] - zero[others]) ** 2 // np.maximum(zero[i] + zero[others], 1)
        for one, two in ((np.repeat(i, len(others)), others), (others, np.repeat(i, len(others)))):
            for column, values in zip(out, (names[one], names[two], part, none, np.repeat(len(seen), len(others))), strict=True):
                column.append(values)
    joined = [np.concatenate(c) if c else [] for c in out]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(joined, kinds, strict=True)]
    return pa.table([pa.array([rows.column("lang")[0].as_py()] * len(columns[0]), pa.string()), *columns],
                    names=["lang", "source", "item", "part", "none", "seen"])


def _pairs(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language."""
    langs = sizes.groupBy("lang").agg(F.count("*").alias("g"), F.max("v").alias("v"))
    langs = langs.select("lang", F.ceil(F.col("g") / SOURCES).alias("blocks"), F.ceil(F.greatest("v", F.lit(1)) / TERMS).alias("slices"))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    placed = sizes.join(langs, "lang").withColumn("block", of("source", "blocks"))
    # Every slice of terms is told of all sources, those without a term in it included.
    markers = placed.select(
        "lang", "source", "block", "blocks", "zero", F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("long").alias("share"), F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"),
    )
    cells = shares.join(placed.select("lang", "source", "block", "blocks", "slices", "zero"), ["lang", "source"])
    cells = cells.select("lang", "source", "block", "blocks", "zero", "term", "share", of("term", "slices").alias("slice"))
    rows = markers.unionByName(cells)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    tiles = rows.select("*", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    schema = "lang string, source string, item string, part long, none long, seen long"
    partial = tiles.groupBy("lang", "slice", "low", "high").applyInArrow(_compare_tile, schema)
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"), F.first("none").alias("none"), F.sum("seen").alias("seen"))
    v = sizes.select("lang", "v").distinct()
    value = F.col("part") + (F.col("v") - F.col("seen")) * F.col("none")
    return summed.join(_sized(v), "lang").select("lang", "source", "item", value.alias("value"))


def divergence(
    spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_documents: int = MIN_DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: every other source of the language by divergence,
    and the ``top`` terms that the group uses more than its language does."""
    words = Vocabulary(spark, docs, text, lang, source, min_documents)
    sizes = materialize(words.group_sizes(), spark, "group-sizes")
    shares = words.cells.join(_sized(sizes), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "count", _share(F.col("count"), F.col("n"), F.col("v")).alias("share"))
    shares = materialize(shares, spark, "shares")
    pairs = _pairs(sizes, shares.drop("count")).withColumn("part", F.lit("pair"))
    whole = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    spoken = shares.groupBy("lang", "term").agg(F.sum("count").alias("count")).join(_sized(whole), "lang")
    spoken = spoken.select("lang", "term", _share(F.col("count"), F.col("n"), F.col("v")).alias("usual"))
    more = shares.join(spoken, ["lang", "term"]).where(F.col("share") > F.col("usual"))
    value = _value(F.col("share"), F.col("usual")).alias("value")
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", order]
    return pairs.select(*columns).unionByName(terms.select(*columns).where(F.col("rank") <= top))
