"""Quality rules on documents, pooled by host.

Rule failures are summed by host, each host's failure rate is shrunk towards
the corpus by an empirical beta prior, and the host's verdict is joined back
to its documents.  Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.columns import free_name, let
from hydrospark.storage import write_table

MIN_WORDS = 50
#: A host is rejected where its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
GAPS = "[ \\t-\\r]+"
BLANKS = " \t\n\x0b\x0c\r"


def _words(text):
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def _repeats(words):
    """Words inside 3-word windows that occur at least twice.

    Window hashes are sorted; only texts with some equal neighbours pay for
    sorting (hash, position) pairs and measuring the union of their windows.
    """

    def measure(hashes):
        def covered(pairs):
            # positions of windows whose hash equals a neighbour's in sorted order
            same = F.filter(
                F.sequence(F.lit(1), F.size(pairs)),
                lambda i: ((i > 1) & (F.get(pairs, i - 2)["h"] == F.get(pairs, i - 1)["h"]))
                | ((i < F.size(pairs)) & (F.get(pairs, i)["h"] == F.get(pairs, i - 1)["h"])),
            )
            at = F.sort_array(F.transform(same, lambda i: F.get(pairs, i - 1)["i"]))
            return let(
                at,
                lambda a: F.aggregate(
                    F.transform(a, lambda x, k: F.when(k + 1 < F.size(a), F.least(F.lit(3), F.get(a, k + 1) - x)).otherwise(3)),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            )

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        distinct = F.size(F.array_distinct(hashes))
        return F.when(distinct < F.size(hashes), let(pairs, covered)).otherwise(0)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 3, let(windows, measure)).otherwise(0)


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts that the rules use, for each row; a null text has no words and fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeats(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n"), F.col("w.r")
    return counted.select(
        "doc_id",
        "host",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        r.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed"),
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed``; partial sums come before the shuffle. Rows without a host belong to none."""
    return (
        counts.where("host is not null")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """Alpha and beta by the method of moments over hosts; a weak prior at the mean where the moments give none."""
    one = rates.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("k"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("kk"),
        F.sum(F.lit(1.0) / F.col("n_docs")).alias("inv"),
    ).first()
    if not one.n:
        return 1.0, 1.0
    mean = min(max(one.k / one.n, 1e-4), 1 - 1e-4)
    spread = max(one.kk - one.n * mean * mean, 0.0) / one.n  # weighted variance of the rates
    noise = mean * (1 - mean) * one.hosts / one.n  # what binomial draws alone would show
    true = spread - noise
    strength = mean * (1 - mean) / true - 1 if true > 0 else 1e4
    strength = min(max(strength, 2.0), 1e4)
    return mean * strength, (1 - mean) * strength


def host_verdicts(rates: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, host_rate, host_failed`` with rates shrunk by the prior."""
    a, b = beta_prior(rates)
    rate = (F.col("n_failed") + a) / (F.col("n_docs") + a + b)
    return rates.select("host", rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def judge_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts and verdict of every row, repeated rows included.

    ``kept`` is false if the row fails a rule itself or its host is rejected.
    A null or empty text has no words and fails; a text may be of any length.
    A null host is never rejected.  An empty table gives an empty result.
    Other columns are ignored.  The counts are written once and read for both
    the host sums and the join.
    """
    counts = write_table(rule_counts(docs, host), "counts").df
    verdicts = write_table(host_verdicts(host_rates(counts), max_rate), "verdicts").df
    out = counts.join(verdicts, "host", "left")
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
        F.col("host").alias("host"),
        F.round("host_rate", 9).alias("host_rate"),
    )


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the rules and whose host is not rejected; rows as in ``judge_documents``.

    Texts are judged in one pass, which writes the rows with a flag; the host
    sums read the flag and the host of what was written.
    """
    key, flag = free_name(docs, "host_key"), free_name(docs, "rule_failed")
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = let(_words(text), lambda w: (F.size(w) < MIN_WORDS) | (100 * _repeats(w) > 50 * F.size(w)))
    marked = write_table(docs.withColumn(flag, failed), "marked").df
    rates = host_rates(marked.select(F.col(host).alias("host"), F.col(flag).alias("base_failed")))
    verdicts = host_verdicts(write_table(rates, "rates").df, max_rate)
    rejected = write_table(verdicts.where("host_failed").select(F.col("host").alias(key)), "rejected").df
    return marked.where(~F.col(flag)).drop(flag).join(rejected, F.col(host) == F.col(key), "left_anti")
