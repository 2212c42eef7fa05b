"""URL filter: host rules first, then naive Bayes on segmented host names and paths.

Names that are written together are split into words by Viterbi search under a
unigram model, whose counts are those of the words in the texts of all pages.
Multinomial naive Bayes over the words of host and path judges urls that no
rule fits; it is fitted on all urls that a rule does judge, with the rule's
verdict as label.  Words that the rules name themselves are left out of it:
they decide the label, and would carry a rule beyond the hosts it is for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from hydrospark.storage import write_table

# Fixed values: (verdict, host, path); the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A url without a rule is blocked where naive Bayes with equal priors finds blocking at least as likely.
BLOCK_AT = 0.95
#: Letters by which a word is looked up; a longer word is found by as many first letters and then compared.
KEY = 24
#: Natural logarithm of how much less likely an unknown word gets with each letter.
LETTER = log(26)
NUMBER = "<number>"
WORDS = ArrayType(StringType())
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = r"(\p{L}+|\p{N}+)"
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>"


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``: host up to ``/?#`` with A-Z lower-cased, path up to ``?#``; both empty without ``://``."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *ASCII)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def rule_columns(host, path, rules=RULES):
    """The longest fitting rule as text, and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, at + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def rule_words(rules=RULES) -> list[str]:
    return sorted({w for _, host, path in rules for w in re.findall(r"[^\W\d_]+", f"{host} {path}".lower())})


def word_counts(texts: DataFrame, column: str = "html") -> DataFrame:
    """``word, n``: counts of the letter runs in all texts, markup aside; summed before the shuffle."""
    words = F.split(F.lower(F.regexp_replace(F.col(column), MARKUP, " ")), r"[^\p{L}]+")
    return texts.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest words that make up a name, of equally cheap ones the fewest.

    ``cost`` holds the negative log probability of each known word; a stretch
    of unknown letters of any length costs ``unknown`` and ``LETTER`` each.
    """
    longest = max(map(len, cost), default=0)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # by end: cost, words, start of the last word
    stretch = None  # the best way in which an unknown stretch ends here
    for end in range(1, len(name) + 1):
        opened = (best[end - 1][0] + unknown + LETTER, best[end - 1][1] + 1, end - 1)
        stretch = opened if stretch is None else min(opened, (stretch[0] + LETTER, *stretch[1:]))
        ways = [stretch]
        for start in range(max(0, end - longest), end):
            known = cost.get(name[start:end])
            if known is not None:
                ways.append((best[start][0] + known, best[start][1] + 1, start))
        best.append(min(ways))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][2] : end])
        end = best[end][2]
    return out[::-1]


@F.pandas_udf(WORDS)
def pieces(names: pd.Series) -> pd.Series:
    """The distinct stretches of a name by which words are looked up."""
    return pd.Series([sorted({x[k:end] for end in range(1, len(x) + 1) for k in range(max(0, end - KEY), end)}) for x in names])


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for each of the distinct names; only the sum of all counts reaches the driver.

    Words of all lengths are found: a word longer than ``KEY`` meets the names
    that hold its first ``KEY`` letters.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1

    @F.pandas_udf(WORDS)
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([split_name(name, {r["word"]: log(total / r["n"]) for r in known}, log(total)) for name, known in zip(*batch, strict=True)])

    keyed = counts.select(F.substring("word", 1, KEY).alias("piece"), "word", "n")
    met = names.select("name", F.explode(pieces("name")).alias("piece")).join(keyed, "piece").where(F.contains("name", "word"))
    known = met.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    found = names.join(known, "name", "left").select("name", F.coalesce("known", F.array().cast("array<struct<word:string,n:bigint>>")).alias("known"))
    return found.select("name", split("name", "known").alias("words"))


def fit_odds(words: DataFrame) -> DataFrame:
    """``word, odds`` of multinomial naive Bayes with add-one smoothing.

    ``words`` holds ``word, blocked, allowed``: how often a word occurs in urls
    that rules block and allow.  Words that occur in neither say nothing and
    have no row; where rules give one verdict only, no word has.
    """
    words = words.where("blocked + allowed > 0")
    b, a, v = words.agg(F.sum("blocked"), F.sum("allowed"), F.count(F.lit(1))).first()
    odds = F.log((F.col("blocked") + 1) / F.lit(float((b or 0) + v))) - F.log((F.col("allowed") + 1) / F.lit(float((a or 0) + v)))
    return words.where(F.lit(bool(a and b))).select("word", F.round(odds, 9).alias("odds"))


def judge_urls(pages: DataFrame, rules=RULES, text: str = "html", block_at: float = BLOCK_AT) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, score, evidence`` for every row, repeated rows included.

    ``score`` is the log odds of blocking, ``evidence`` the number of words
    behind it.  A url without evidence scores 0 and is allowed unless a rule
    says otherwise.  A null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed.  Urls and names may be of any length.
    Without a column ``text``, or with null texts, no word is known to the
    segmenter and names stay whole.  An empty table gives an empty result.
    Other columns are ignored.

    Names are counted and split once, however many urls hold them, and joined
    back to the urls' parts.
    """
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parse(pages).select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    parsed = write_table(parsed, "urls").df
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(PARTS), 1)
    parts = parsed.select("row", "ruled", F.posexplode(runs).alias("pos", "name")).where(~F.col("name").isin(rule_words(rules)))
    parts = write_table(parts.withColumn("name", F.when(F.col("name").rlike(r"^\p{N}"), NUMBER).otherwise(F.col("name"))), "url-parts").df

    of = lambda kind: F.count(F.when(F.col("ruled") == kind, True))
    names = write_table(parts.groupBy("name").agg(of("block").alias("blocked"), of("allow").alias("allowed")), "url-names").df
    if text in pages.columns:
        counts = word_counts(pages, text)
    else:
        counts = pages.sparkSession.createDataFrame([], "word string, n long")
    split = split_names(names.where(F.col("name") != NUMBER).select("name"), write_table(counts, "words").df)
    split = names.join(split, "name", "left").withColumn("words", F.coalesce("words", F.array("name")))
    split = write_table(split, "url-splits").df

    words = split.select("name", "blocked", "allowed", F.explode("words").alias("word"))
    odds = fit_odds(write_table(words.groupBy("word").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")), "url-words").df)
    scored = words.join(odds, "word").groupBy("name").agg(F.sum("odds").alias("odds"), F.count(F.lit(1)).alias("seen"))
    scored = write_table(split.select("name", "words").join(scored, "name", "left"), "url-scores").df

    found = parts.select("row", "pos", "name").join(scored, "name").groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"),
        F.sum("odds").alias("odds"),
        F.sum("seen").alias("seen"),
    )
    score = F.round(F.coalesce("odds", F.lit(0.0)), 6)
    own = F.when(score >= round(log(block_at / (1 - block_at)), 6), "block").otherwise("allow")
    return parsed.join(found, "row", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", own).alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        score.alias("score"),
        F.coalesce("seen", F.lit(0)).cast("long").alias("evidence"),
    )
