"""The pipeline against plain Python on a small corpus; nothing of the operators is used on the plain side."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, sqrt

import pytest

import corpus_pipeline
from hydrospark.llm import packing, tokens

ITEM = "the long known question of a benchmark that should never be part of any training text at all"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('tables')}"
    r = random.Random(8)
    rows = []
    for i in range(200):
        w = [f"w{r.randrange(3000)}" for _ in range(r.choice([20, 70, 90]))]
        if i % 10 == 0:
            w = [x + "!!" for x in w]
        if i % 25 == 1:
            w[30:30] = ITEM.split()
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " end", "en", "s0", 0) for i in range(40)]
    rows += [(500 + i, f"w{i} w{i + 1} w{i + 2} " * 40, "en", "s1", 0) for i in range(6)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), rows[3], (7, rows[2][1].upper(), "en", None, 1), (7, " ".join(f"w{k}" for k in range(60)), "en", "s2", 0)]
    # columns whose names stages might want for themselves
    clash = ", row long, Row_Number string, quality_score double, leaks int, rule_failed boolean, host_key string, cid long, ids binary"
    rows = [(*x, 1, "r", 0.5, 3, True, "k", 9, b"x") for x in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + clash).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def ngrams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\s]+", (text or "").lower())
    found = Counter(w) + Counter(zip(w, w[1:], strict=False))
    found["same"] += sum(a == b for a, b in zip(w, w[1:], strict=False))
    found["around"] += sum(a == b for a, b in zip(w, w[2:], strict=False))
    value = {k: 1 + log(c) for k, c in found.items() if c}
    norm = sqrt(sum(v * v for v in value.values())) or 1.0
    return {k: v / norm for k, v in value.items()}


def plain_quality(learn):
    """Weights of follow the regularised leader over n-grams that are not hashed."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        bound = 0.1 if k != "bias" else 0.0
        return 0.0 if abs(z[k]) <= bound else -(z[k] - (bound if z[k] > 0 else -bound)) / ((1 + sqrt(n[k])) / 5.0)

    for _ in range(3):
        for text, y in learn:
            x = ngrams(text) | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            off = 1 / (1 + exp(-sum(w[k] * x[k] for k in x))) - y
            for k in x:
                g = off * x[k]
                z[k] += g - (sqrt(n[k] + g * g) - sqrt(n[k])) / 5.0 * w[k]
                n[k] += g * g
    return lambda text: 1 / (1 + exp(-sum(weight(k) * v for k, v in (ngrams(text) | {"bias": 1.0}).items())))


def plain_failed(text):
    w = (text or "").split()
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {g for g, c in Counter(grams).items() if c > 1}
    return len(w) < 50 or 100 * len({k + j for k, g in enumerate(grams) if g in often for j in range(3)}) > 50 * len(w)


def plain_groups(rows):
    """Rows that come first, by id and place, in their group of linked texts."""
    sets = []
    for d in rows:
        w = (d.text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    top = list(range(len(rows)))

    def root(k):
        return k if top[k] == k else root(top[k])

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]:
                top[root(i)] = root(j)
    best = {}
    for k, d in sorted(enumerate(rows), key=lambda x: x[1].doc_id):
        best.setdefault(root(k), d)
    return list(best.values())


def test_stages_match_plain_python(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left, kept = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.columns == columns
        kept.append(Counter((d.doc_id, d.text) for d in left.collect()))
    rows = docs.collect()
    text_of = {d.doc_id: d.text for d in rows[:200]}
    learn = [(text_of[i], int(i % 10 != 0)) for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    score = plain_quality(learn)
    want = [d for d in rows if score(d.text) >= 0.3]
    assert kept[0] == Counter((d.doc_id, d.text) for d in want) and 20 <= len(rows) - len(want) < 60
    shares = Counter(d.source for d in want if plain_failed(d.text)), Counter(d.source for d in want)
    assert all(shares[0][s] < 0.5 * n for s, n in shares[1].items() if s)  # so no host is rejected
    want = [d for d in want if not plain_failed(d.text)]
    assert kept[1] == Counter((d.doc_id, d.text) for d in want)
    want = plain_groups(want)
    assert kept[2] == Counter((d.doc_id, d.text) for d in want) and kept[2].total() < kept[1].total()
    want = [d for d in want if ITEM not in d.text]
    assert kept[3] == Counter((d.doc_id, d.text) for d in want) and kept[3].total() < kept[2].total()
    out = corpus_pipeline.run(spark, folder).collect()
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    size = Counter()
    for d in want:
        size[d.doc_id] += len(plain.encode(d.text, add_special_tokens=False).ids) + 1
    held = Counter()
    for r in out:
        held[r.doc_id] += r.length
    assert held == size and set(spark.createDataFrame([], packing.PIECES).columns) == set(out[0].asDict())


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_results_outlive_later_runs(spark, folder):
    from hydrospark.storage import written

    before = written()
    first = corpus_pipeline.run(spark, folder)
    left = len(written() - before)
    second = corpus_pipeline.run(spark, folder)
    assert len(written() - before) == 2 * left <= 6  # what stages kept for themselves is gone
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = corpus_pipeline.pack(spark, docs, folder)
    b = corpus_pipeline.near_duplicates(spark, docs, folder)
    again = [corpus_pipeline.pack(spark, docs, folder), corpus_pipeline.near_duplicates(spark, docs, folder)]
    key = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
    assert key(first) == key(second) and len(key(first)) > 0
    assert key(a) == key(again[0]) and key(b) == key(again[1])
