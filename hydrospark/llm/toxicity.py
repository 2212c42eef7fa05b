"""Toxicity classifier that is kept from reacting to mentions of groups.

A logistic regression on hashed words and word beginnings is fitted together
with counterfactuals: where a labelled sentence names a group, the name is
swapped for others of its set; where it names none, two terms of a set are put
into the same place in turn.  The change of score from one to the other is
penalised, so that group words themselves carry no evidence.  Each set has a
neutral word, which keeps the whole set near what ordinary words say.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.columns import in_holdout
from hydrospark.llm.hashed_features import bucketed, labelled_sample
from hydrospark.llm.logistic import Model, fit, score_column

BITS = 20
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 12000
THRESHOLD = 0.3
HOLDOUT = (4, 2)
PENALTY = 0.5
#: Counterfactual pairs made of one text that names a group, at most one per other term of the set.
SWAPS = 3
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")

# Sets of terms that may stand for each other in a sentence, the neutral one last.
IDENTITY_TERMS = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("girls", "boys", "children"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("black", "white", "asian", "latino", "arab", "local"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "local"),
    ("immigrants", "refugees", "natives", "foreigners", "people"),
    ("disabled", "blind", "deaf", "autistic", "local"),
    ("frauen", "männer", "leute"),
    ("muslime", "christen", "juden", "leute"),
    ("femmes", "hommes", "gens"),
    ("musulmans", "chrétiens", "juifs", "gens"),
    ("mujeres", "hombres", "gente"),
    ("musulmanes", "cristianos", "judíos", "gente"),
)


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their beginnings, each with weight 1, since one word can decide."""
    made = []
    for word in set(words):
        code = word.encode("utf-8", "replace")
        made.append(zlib.crc32(code))
        made += [zlib.crc32(word[:n].encode("utf-8", "replace"), n) for n in BEGINNINGS if len(word) >= n]
    index = np.unique(bucketed(np.array(made, dtype=np.uint64), BITS))
    return index, np.ones(len(index), dtype=np.float32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return word_features(word_list(text))


def counterfactual_pairs(words: list[str], sets: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[list[str], list[str]]]:
    """Pairs of word sequences that differ in an identity term and should score alike.

    A sequence that names groups is paired with itself after each of up to
    ``SWAPS`` swaps, in which each term gives way to the neutral one of its
    first set, then to those that follow it there.  In any other, two
    neighbours of one set take the same place; set, terms and place follow
    from a hash of the words.
    """
    home = {term: (terms[-1], *terms[k + 1 : -1], *terms[:k]) for terms in reversed(sets) for k, term in enumerate(terms[:-1])}
    named = [k for k, w in enumerate(words) if w in home]
    if named:
        out = []
        for step in range(min(SWAPS, max(len(home[words[k]]) for k in named))):
            other = list(words)
            for k in named:
                other[k] = home[words[k]][step % len(home[words[k]])]
            out.append((words, other))
        return out
    if not sets:
        return []
    h = zlib.crc32(" ".join(words).encode("utf-8", "replace"))
    terms, at = sets[h % len(sets)], h // 7 % (len(words) + 1)
    k = h // 31 % len(terms)
    return [tuple([*words[:at], term, *words[at:]] for term in (terms[k], terms[(k + 1) % len(terms)]))]


def with_counterfactuals(text: str | None, sets: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple]:
    """Features of the text, then for each counterfactual pair the buckets by which its two texts differ, with 1 or -1."""
    words = word_list(text)
    own, every = word_features(words), set(words)
    out = [own]
    for one, two in counterfactual_pairs(words, sets):
        common = set(one) & set(two)
        shared = own[0] if common == every else word_features(common)[0]
        i, j = (np.setdiff1d(word_features(set(x) - common)[0], shared, assume_unique=True) for x in (one, two))
        moved = np.setxor1d(i, j, assume_unique=True)
        out.append((moved, np.where(np.isin(moved, i), 1, -1).astype(np.float32)))
    return out


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY, sets: Sequence[Sequence[str]] = IDENTITY_TERMS
) -> Model:
    """Model of ``labels.toxic`` from labelled rows whose id is not held out; ``pairs`` counts the counterfactuals used.

    Without labelled rows, or with one class alone, every text scores alike.
    """
    learn = lambda doc_id: ~in_holdout(doc_id, *HOLDOUT)
    samples = labelled_sample(docs, labels, "toxic", learn, max_rows, partial(with_counterfactuals, sets=sets))
    return fit(samples, BITS, alpha=1.0, l1=3.0, epochs=6, pair_penalty=penalty)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, scored on its whole text however long.

    Repeated rows and null ids keep their rows, null texts score as empty, a
    score at the threshold is predicted 1, an empty table gives an empty
    result.  Other columns are ignored.
    """
    scored = docs.select("doc_id", score_column(F.col("text"), model, features).alias("score"))
    return scored.select(
        "doc_id", in_holdout(F.col("doc_id"), *HOLDOUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
