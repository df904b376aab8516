"""Host-level quality rules, in column expressions only.

Every document is measured once. Rule failures are added up per host (a `source` column, or any other
the caller names), each host's failure rate is shrunk towards the rate of all hosts with a beta prior
whose two parameters are estimated from the hosts themselves, and the verdicts on hosts are joined back
to the documents. A host is judged against that prior: its rate has to be worse than several times what
is usual, with the certainty that its number of documents gives.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.staging import stage

MIN_WORDS = 50
REPEATED_PERCENT = 50
SYMBOL_PERCENT = 30  # symbols per characters of words
DUPLICATE_LINE_PERCENT = 50
HOT_SHARE = 1_000  # a host with at least a thousandth of the rows is hot; there are at most a thousand
# A host is refused where the lower bound of its failure rate, `SURE` standard deviations of the posterior
# below its mean, exceeds `WORSE` times the mean of all hosts; that limit stays between the two given here.
WORSE = 4.0
SURE = 3.0
LIMITS = (0.25, 0.9)
MOST_STRENGTH = 100.0  # documents the prior weighs at most, so that clean hosts do not hide a bad one
MIN_HOSTS = 3  # with fewer hosts a prior cannot be estimated; a weak uniform one is used
_SPACE = r"[ \t-\r]+"


def _let(value: Column, body) -> Column:
    """Evaluate `value` once for `body`; a repeated column expression would be computed each time."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """A hash of each three-word window, in order."""
    last = F.size(words) - 2
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
        ),
    ).otherwise(F.array().cast("array<long>"))


def _covered(h: Column) -> Column:
    """Number of word places in windows whose hash occurs more than once."""

    def places(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) & (i > 0) | (F.get(pairs, i + 1)["h"] == p["h"]),
        )
        spread = F.flatten(F.transform(same, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))
        return F.size(F.array_distinct(spread))

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # Most texts repeat no window, which one comparison of sizes tells.
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, places))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), _let(_windows(words), _covered).cast("long").alias("n_repeat_words")
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    full = F.coalesce(text, F.lit(""))
    bare = F.translate(full, " \t\n\x0b\x0c\r", "")
    words = F.filter(F.split(full, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(full, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return F.struct(
        _let(words, of_words).alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, of_lines).alias("n_dup_lines"),
    )


def rules() -> dict[str, Column]:
    """Rule failures of one document from its measures."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeated": F.col("n_repeat_words") * 100 > n * REPEATED_PERCENT,
        "symbols": F.col("n_symbols") * 100 > F.col("word_chars") * SYMBOL_PERCENT,
        "lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * DUPLICATE_LINE_PERCENT,
    }


def measured(docs: DataFrame, host: str) -> DataFrame:
    m = F.col("m")
    return (
        docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m"),
                    F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")).alias("breaks"))
        .select(
            "doc_id", "host", m["words"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
            m["words"]["n_repeat_words"].alias("n_repeat_words"), (F.col("breaks") + 1).alias("n_lines"),
        )
    )


def host_verdicts(docs: DataFrame, names: list[str], worse: float = WORSE, sure: float = SURE) -> DataFrame:
    """(host, n_docs, <rule>_rate ..., refused): shrunk failure rates from 0/1 columns `names`.

    The beta prior of a rule has the mean m of the host rates and, by moments, the strength
    m(1-m)/v - 1, where v is the variance of the rates beyond what binomial counts explain. A host is
    refused if for some rule its posterior, by its mean and standard deviation, lies beyond the limit."""
    hosts = stage(
        docs.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(r).cast("int")).alias(r) for r in names]), "hosts"
    )
    facts = []
    for r in names:
        rate = F.col(r) / F.col("n_docs")
        facts += [F.avg(rate), F.var_pop(rate), F.avg(rate * (1 - rate) / F.col("n_docs"))]
    row = hosts.agg(F.count("*"), *facts).first()
    rates, beyond_limit = [], []
    for k, r in enumerate(names):
        mean, var, noise = (row[1 + 3 * k + j] for j in range(3))
        mean = min(max(mean or 0.0, 1e-4), 1 - 1e-4)
        beyond = max((var or 0.0) - (noise or 0.0), 1e-6)
        strength = min(max(mean * (1 - mean) / beyond - 1, 2.0), MOST_STRENGTH) if row[0] >= MIN_HOSTS else 2.0
        if row[0] < MIN_HOSTS:
            mean = 0.5
        weight = F.col("n_docs") + strength
        rate = (F.col(r) + mean * strength) / weight
        limit = min(max(worse * mean, LIMITS[0]), LIMITS[1])
        rates.append(rate.alias(f"{r}_rate"))
        beyond_limit.append((rate - sure * F.sqrt(rate * (1 - rate) / (weight + 1))) > limit)
    return hosts.select("host", "n_docs", *rates, reduce(or_, beyond_limit, F.lit(False)).alias("refused"))


def with_verdicts(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`found` with the column `refused` of its `host`. Rows of hot hosts, whose number is bounded by
    their share, are looked up in place; only the rows of all other hosts are shuffled by host."""
    total = found.count()
    hosts = verdicts.select(F.col("host").alias("_host"), "n_docs", "refused")
    is_hot = F.col("n_docs") * HOT_SHARE >= total
    hot, others = hosts.where(is_hot).drop("n_docs"), hosts.where(~is_hot).drop("n_docs")
    same = F.col("host").eqNullSafe(F.col("_host"))
    common = found.join(F.broadcast(hot), same)
    rest = found.join(F.broadcast(hot.select("_host")), same, "left_anti").join(others, same)
    return common.unionByName(rest).drop("_host")


def host_rules(docs: DataFrame, host: str = "source", worse: float = WORSE, sure: float = SURE) -> DataFrame:
    """Per row of `docs` (doc_id, text, `host`): the measures, base_failed, host_refused, kept.

    A null or empty text has no words and fails the base rule. Rows without a host form a host of
    their own. Repeated rows count each. An empty table gives an empty result."""
    found = stage(measured(docs, host).withColumns(rules()), "measures")
    names = list(rules())
    joined = with_verdicts(found, host_verdicts(found, names, worse, sure))
    failed = F.col("short") | F.col("repeated")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.col("refused").alias("host_refused"),
        (~failed & ~F.col("refused")).alias("kept"),
    )
