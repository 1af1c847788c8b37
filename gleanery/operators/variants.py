"""Spellings of one tag brought together: normal forms, blocking by deletions, and components of near forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

#: Accented letters and the plain ones they are compared as.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Shortest normal form that may differ by a letter; shorter ones are words of their own.
NEAR_LENGTH = 6


def normal_form(tag: Column) -> Column:
    """Lower case without accents, blanks and marks."""
    return F.regexp_replace(F.translate(F.lower(tag), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+", "")


def tag_variants(rows: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """``tag, canonique, nb``: for every tag of ``id, tag`` rows its rows, and the spelling that stands for it.

    Tags of one normal form belong together, and so do those whose forms of at least ``near_length`` characters
    differ by one letter put in, left out or replaced, with the same digits; what is linked by a chain of these is one
    group. Its most frequent tag stands for it, ties by tag. Tags without a letter or digit stand for themselves.
    """
    counts = rows.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("nb"))
    counts = _stored(counts.withColumn("forme", normal_form(F.col("tag"))), "tags")
    forms = counts.where("forme <> ''").select("forme").distinct()
    group = components(forms, near_forms(forms, near_length))
    placed = counts.join(group, "forme", "left")
    # A tag without a normal form is a group of its own.
    of = Window.partitionBy(F.coalesce("groupe", F.concat(F.lit(" "), "tag"))).orderBy(F.desc("nb"), "tag")
    return placed.select("tag", F.first("tag").over(of).alias("canonique"), "nb")


def near_forms(forms: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """Links ``a, b`` (a < b) between forms one letter apart.

    Two such forms share a string that each reaches by leaving out at most one letter. Only forms within two letters of
    that string can share it, so blocks are small however many forms there are.
    """
    size = F.length("forme")
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.col("forme").substr(F.lit(1), i - 1), F.col("forme").substr(i + 1, size)))
    blocks = forms.where(size >= near_length).select("forme", F.explode(F.array_distinct(F.array_append(without, F.col("forme")))).alias("bloc"))
    met = blocks.withColumnRenamed("forme", "a").join(blocks.withColumnRenamed("forme", "b"), "bloc").where("a < b")
    digits = lambda c: F.regexp_replace(c, "[^0-9]+", "")
    near = (F.levenshtein("a", "b", 1) == 1) & (digits("a") == digits("b"))
    return met.where(near).select("a", "b").distinct()


def components(forms: DataFrame, links: DataFrame) -> DataFrame:
    """``forme, groupe``: the least form that links lead to. Every round takes over the least group among the
    neighbours and then that group's own group, so long chains take few rounds; each round is stored."""
    links = _stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    groups = _stored(forms.select("forme", F.col("forme").alias("groupe")), "groups")
    while True:
        near = links.join(groups, F.col("b") == F.col("forme")).groupBy("a").agg(F.min("groupe").alias("least"))
        taken = groups.join(near, F.col("forme") == F.col("a"), "left").select("forme", "groupe", F.least("groupe", "least").alias("nouveau"))
        taken = _stored(taken, "groups")
        roots = taken.select(F.col("forme").alias("f"), F.col("nouveau").alias("racine"))
        jumped = taken.join(roots, F.col("nouveau") == F.col("f")).select("forme", F.col("racine").alias("groupe"), "nouveau")
        changed = taken.where("groupe <> nouveau").limit(1).count()
        if not changed:
            return groups
        groups = _stored(jumped.select("forme", "groupe"), "groups")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
