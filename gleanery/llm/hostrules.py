"""Quality rules for documents and for the hosts they come from, in DataFrame operations only.

Every document is measured once, inside its row; rules are comparisons of these counts. Failures of each rule are
then counted by host, with a map-side fold, so that a host with a third of all rows sends a row per task. A host's
failure rate is shrunk towards the rate of the corpus by a beta prior whose strength is estimated from how far hosts
differ beyond chance (moments of the beta-binomial); few documents therefore never condemn a host. A host fails if the
shrunk rate of a rule reaches ``RATE`` and its odds exceed ``ODDS`` times those of the corpus; its documents go with it.

Defined results: NULL and empty texts have no words and fail the base rules; a document without host is judged by
itself alone, though it counts for the corpus; with a single host nothing stands out, so no host fails; repeated rows
are rows of their own; an empty table gives no rows. Other columns are carried along; the measures may be given a
prefix where the table has columns of their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .decontam import _sized

BLANK = " \t\n\x0b\f\r"
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
RUN = 3
RATE = 0.5
ODDS = 4.0
#: Documents the prior counts as at least: where hosts differ very much, one failure must not condemn a small host.
WEAKEST = 10.0
#: Documents the prior counts as at most; hosts that do not differ beyond chance would ask for infinitely many.
STRONGEST = 1e9

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(w: Column) -> Column:
    """Number of words that stand in a run of ``RUN`` words found twice or more in the list: the runs are sorted with
    their places, so that equal ones are neighbours."""
    runs = w
    for k in range(1, RUN):
        # Runs that the end cuts off become NULL, and are cut away below.
        runs = F.zip_with(runs, F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    whole = F.slice(runs, F.lit(1), F.greatest(F.size(w) - (RUN - 1), F.lit(0)))
    placed = F.transform(whole, lambda run, i: F.struct(run.alias("run"), i.alias("at")))

    def neighbours(ordered: Column) -> Column:
        later = F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1)))
        pairs = F.zip_with(ordered, later, lambda a, b: F.when(a["run"] == b["run"], F.array(a["at"], b["at"])))
        starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
        places = F.transform(starts, lambda at: F.array(*[at + k for k in range(RUN)]))
        return F.size(F.array_distinct(F.flatten(places)))

    return _let(F.sort_array(placed), neighbours)


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with their counts: n_words, word_chars, n_symbols, n_lines and n_dup_lines (of lines with a word),
    n_repeat_words."""
    whole = F.coalesce(docs[text], F.lit(""))
    words = F.array_remove(F.split(whole, WORD_SEPARATORS), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.trim(line, F.lit(BLANK)) != "")
    found = {
        "n_words": F.col("_words.n"),
        "word_chars": F.col("_words.chars"),
        "n_symbols": F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.col("_words.repeated"),
    }
    once = _let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated")
        ),
    )
    return (
        docs.withColumn("_words", once)
        .withColumns({prefix + name: value.cast("long") for name, value in found.items()})
        .drop("_words")
    )


def rules(prefix: str = "") -> dict[str, Column]:
    """Name and condition of failing of every rule, over the measures. The first two are the base rules."""
    n, chars, symbols, lines, dup, repeated = (
        F.col(prefix + name) for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    )
    return {
        "too_short": n < MIN_WORDS,
        "repetitive": 100 * repeated > 50 * n,
        "symbols": 10 * symbols > n,
        "word_length": (chars < 3 * n) | (chars > 10 * n),
        "repeated_lines": 10 * dup > 3 * lines,
    }


BASE = ("too_short", "repetitive")


def _strengths(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Per rule the mean and the strength (a + b) of the beta prior; all sums over hosts, one row."""
    n, told = F.col("n"), []
    for name in names:
        f = F.col(name)
        told += [F.sum(f).alias(f"f_{name}"), F.sum(f.cast("double") * f / n).alias(f"q_{name}")]
    whole = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n.cast("double") * n).alias("nn"), *told).first()
    found = {}
    for name in names:
        if not whole.n:
            found[name] = (0.0, STRONGEST)
            continue
        mean = whole[f"f_{name}"] / whole.n
        chance = mean * (1 - mean)
        between = whole[f"q_{name}"] - mean * whole[f"f_{name}"] - chance * (whole.hosts - 1)
        room = chance * (whole.n - whole.nn / whole.n - (whole.hosts - 1))
        # The intra-host correlation is 1 / (1 + a + b).
        share = between / room if room > 0 else 0.0
        found[name] = (mean, min(max(1 / share - 1, WEAKEST), STRONGEST) if share > 0 else STRONGEST)
    return found


def host_verdicts(spark: SparkSession, failures: DataFrame, host: str, names: list[str]) -> DataFrame:
    """Per host: n, and for every rule its failures, its shrunk rate (``rate_…``) and whether it is the host's fault
    (``bad_…``); ``host_failed`` if any is. ``failures`` holds a host and a boolean column per rule for each document."""
    counts = failures.where(F.col(host).isNotNull()).groupBy(host)
    counts = counts.agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in names])
    hosts = materialize(counts, spark, "hosts")
    found = hosts
    for name, (mean, strength) in _strengths(hosts, names).items():
        rate = (F.col(name) + mean * strength) / (F.col("n") + strength)
        stands_out = rate * (1 - mean) > ODDS * mean * (1 - rate)
        found = found.withColumn(f"rate_{name}", rate).withColumn(f"bad_{name}", (rate >= RATE) & stands_out)
    return found.withColumn("host_failed", reduce(or_, [F.col(f"bad_{c}") for c in names], F.lit(False)))


def judge(spark: SparkSession, docs: DataFrame, host: str = "source", text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with their measures, ``base_failed``, ``host_failed`` and ``kept``."""
    names = list(rules())
    counted = measured(docs, text, prefix)
    failing = rules(prefix)
    kinds = counted.withColumn("_failed", F.struct(*[F.coalesce(failing[c], F.lit(False)).alias(c) for c in names]))
    kinds = materialize(kinds.drop(text) if text not in MEASURES else kinds, spark, "measures")
    flags = kinds.select(F.col(host).alias("_host"), "_failed.*")
    verdicts = host_verdicts(spark, flags, "_host", names).where("host_failed").select("_host")
    # One row per failing host, joined back to all documents; adaptive execution splits a hot host if it must shuffle.
    bad = materialize(verdicts.withColumn("_bad", F.lit(True)), spark, "bad-hosts")
    joined = kinds.join(_sized(bad), kinds[host] == bad["_host"], "left")
    base = F.greatest(*[F.col(f"_failed.{c}") for c in BASE])
    verdict = {
        prefix + "base_failed": base,
        prefix + "host_failed": F.coalesce("_bad", F.lit(False)),
        prefix + "kept": ~base & F.col("_bad").isNull(),
    }
    return joined.withColumns(verdict).drop("_failed", "_host", "_bad")
