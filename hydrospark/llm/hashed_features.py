"""Hashed sparse features of whole texts and the bounded sample that classifiers are fitted on."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits, and runs of other marks, of the lower-cased text."""
    return TOKEN.findall((text or "").lower().encode("utf-8", "replace"))


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))


def bucketed(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int32)


#: Hashes of the n-grams in which equal words are replaced by one placeholder: ``X X`` and ``X * X``.
SAME_PAIR, SAME_AROUND = np.uint64(1), np.uint64(2)


def ngram_features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word 1- and 2-grams with unit-length log-frequency weights.

    Two equal words in a row also count as the 2-gram of a placeholder, and
    equal words around another as the 3-gram of a placeholder and any word,
    whatever the word is; they are features like any other.  An empty or null
    text has no features.
    """
    h = hashes(tokens(text))
    if not len(h):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    pairs = (h[:-1] << _SHIFT) ^ (h[1:] * np.uint64(3))
    same = np.repeat([SAME_PAIR, SAME_AROUND], [(h[1:] == h[:-1]).sum(), (h[2:] == h[:-2]).sum()])
    index, count = np.unique(np.concatenate([bucketed(h, bits), bucketed(pairs + np.uint64(7), bits), bucketed(same, bits)]), return_counts=True)
    value = 1 + np.log(count)
    return index, (value / np.sqrt((value * value).sum())).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: int, features, seed: int = 17) -> list[tuple]:
    """At most ``max_rows`` labelled rows as ``(label, indexes, values)``, in an order fixed by id and label.

    ``learn`` is a predicate on ``doc_id`` that keeps held-out rows away.  Rows
    are chosen by a hash of the id.  Features are made where the texts are;
    only the sparse features of at most ``max_rows`` rows meet in one task and
    reach the driver, each row's bounded by the number of buckets.
    ``features(text)`` gives ``(index, value)`` of the text, then of the
    differences that a fit should not react to.  Rows with a null label or
    text are no examples; repeated ids count once per pair of rows; an empty
    table gives an empty list.
    """
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where("y is not null")
    marked = marked.where(learn(F.col("label_id")))
    order = F.xxhash64(F.lit(seed), "label_id")
    n = marked.count()
    # a threshold on the hash, so that about 1.2 * max_rows ids are left before the exact cut
    share = min(1.0, 1.2 * max_rows / max(n, 1) + 50 / max(n, 1))
    marked = marked.withColumn("o", order).where(F.pmod("o", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    chosen = marked.join(docs.select(F.col("doc_id").alias("label_id"), "text"), "label_id").where("text is not null")

    def extract(batches):
        binary = pa.list_(pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [features(x) for x in part.column(3).to_pylist()]
                index = [[np.asarray(i, dtype="<i4").tobytes() for i, _ in m] for m in made]
                value = [[b"" if (v == 1).all() else np.asarray(v, dtype="<f4").tobytes() for _, v in m] for m in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(0), part.column(2), pa.array(index, binary), pa.array(value, binary)], ["o", "label_id", "y", "index", "value"]
                )

    made = chosen.select(F.col("label_id").cast("long"), "o", "y", "text").mapInArrow(
        extract, "o long, label_id long, y int, index array<binary>, value array<binary>"
    )
    rows = made.orderBy("o", "label_id", "y", "index", "value").limit(max_rows).collect()
    out, ones = [], np.ones(1 << 20, dtype=np.float32)
    for r in rows:
        index = [np.frombuffer(x, dtype="<i4") for x in r["index"]]  # views on what was received
        out.append((r.y, index, [np.frombuffer(v, dtype="<f4") if v else ones[: len(i)] for i, v in zip(index, r["value"], strict=True)]))
    return out
