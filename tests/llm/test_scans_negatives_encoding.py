"""Secret scans, hard negatives and time-ordered encoding against plain Python, on small awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest

from hydrospark.llm import entry, hard_negatives, secret_scan, time_encoding

TABLES = Path("/root/testdata/sf0.01")
DOCS = "doc_id long, text string, source string, repository string, owner string, key string, row long, kind string"
LIVE = "q7Zp2LxV9sKd4RtY8wBn"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", "o", "k", 0, "x") for i, t, s in rows], DOCS)


def plain_base(text):
    """The base scan word for word: the patterns of the contract, failing matches dropped."""
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


PIECES = ["password", "Passwd", "api_key", "APIKEY", "token", "ſecret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "deadbeef", "x.y-z_w", "\n", "é", LIVE, "="]


def test_base_scan_is_the_plain_one():
    r = random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(1, 14)))
        found = secret_scan.base_matches(text)
        assert [secret_scan.span_text([x]) for x in found] == plain_base(text), text


def test_candidates_touch_nothing():
    text = f"{LIVE}ab12 token={LIVE} eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK -----BEGIN RSA PRIVATE KEY-----\nMIIa1\n-----END"
    base = secret_scan.base_matches(text)
    spans = sorted([x[1:3] for x in base + secret_scan.more_candidates(text, base)])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {x[0] for x in secret_scan.more_candidates(text, base)} == {"random", "jwt", "pem"}


def test_owners_tell_copies_from_live_values(spark):
    rows = [(1, f"key {LIVE}ab", "a"), (2, f"key {LIVE}ab again", "a"), (3, f"use {LIVE[::-1]}", "a"), (4, f"use {LIVE[::-1]}", "b"), (5, None, "a"), (6, "", None), (None, f"token={LIVE}9", None)]
    rows += [(7, "token = 9233A8ECF7C5B09FE5949719B6B82BC4", "a"), (8, "token = 9233A8ECF7C5B09FE5949719B6B82BC4", "c"), (9, "password=exampleexample12", "a"), (9, "password=exampleexample12", "a")]
    rows += [(10, "lorem ipsum " * 50_000 + f" {LIVE}Qq1 " + "dolor " * 50_000, "a")]
    got = defaultdict(list)
    for x in secret_scan.scan_secrets(docs_of(spark, rows)).collect():
        got[x.doc_id].append(x)
    assert got[1][0].spans == got[1][0].live == "random:4:26" and got[2][0].live == "random:4:26"  # two repositories, one owner
    assert got[3][0].spans == "" and got[3][0].n_copied == got[4][0].n_copied == 1
    assert got[5][0].spans == got[6][0].spans == "" and got[5][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None][0].live == got[None][0].spans == "assign:0:27"
    assert got[7][0].spans == "assign:0:40" and got[7][0].live == "" and got[7][0].n_copied == 1
    assert len(got[9]) == 2 and all(x.spans == "assign:0:25" and x.live == "" and x.n_copied == 0 for x in got[9])
    assert got[10][0].live == "random:600001:600024"
    assert secret_scan.scan_secrets(docs_of(spark, [])).count() == 0


def plain_negatives(rows):
    """Every pair; rows ``(id, label, vector)`` as they are in the table."""
    kept = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        by = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in kept if b is not a)
        for s, i, _ in [x for x in by if x[2] == a[1]][:5]:
            fits = [x for x in by if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, block int, anchor int, search long, list int, score double"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, 0, 0, 0, 0.0) for i, label, v in rows], VECTORS)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    centres = [[r.gauss(0, 0.4) for _ in range(8)] for _ in range(9)]
    rows = [(i, r.randrange(4), [x + r.gauss(0, 0.1) for x in centres[i % 9]]) for i in range(1200)]
    rows += [(2000 + i, i % 3, [0.25] * 8) for i in range(60)]  # ties, two of them anchors
    rows += [rows[200], rows[200], (None, 1, [0.5] * 8), (1300, None, [0.5] * 8), (1400, 1, None), (1500, 1, [0.5, None]), (1600, 1, [float("nan")] * 8), (1700, 1, [float("inf")] * 8)]
    return [*rows, (1800, 2, [0.3, 0.2]), (1900, 2, []), (5000, 77, [0.1] * 8)]


def test_negatives_are_those_of_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PIECE", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "VISITS", (2, 3))
    want = plain_negatives(vectors)
    assert len(want) > 300
    for lists in (1, 16):
        got = hard_negatives.mine(vectors_of(spark, vectors), n_lists=lists, fit_rows=500)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.mine(vectors_of(spark, [])).count() == 0
    assert hard_negatives.mine(vectors_of(spark, [(100, 1, [0.5])])).count() == 0


def test_bounds_spare_lists(spark, vectors):
    rows = hard_negatives.write_table(hard_negatives.prepared(vectors_of(spark, [v for v in vectors if v[2] and len(v[2]) == 8])), "vectors")
    index = hard_negatives.build_index(rows, 16)
    # the radius of each list covers its rows, and every row is in one list
    held = 0
    for p in index.pieces.collect():
        q = np.frombuffer(p["q"], dtype="<f8").reshape(-1, 8)
        held += len(q)
        assert (np.sqrt(((q - index.centroids[p["list"]]) ** 2).sum(axis=1)) <= index.radii[p["list"]] + 1e-6).all()
    assert held == rows.df.count()
    state = rows.df.where("vec_id = 100").selectExpr("0 AS block", "1 AS anchor", "q", "double('-inf') AS low", "double('inf') AS high", "double('-inf') AS floor")
    every = hard_negatives.wanted(state, index, (0, None)).count()
    high = hard_negatives.wanted(state.selectExpr("block", "anchor", "q", "low", "high", "30000D AS floor"), index, (0, None)).count()
    assert high < every == (index.radii >= 0).sum()


def plain_encoding(lines, sales, kinds, nations, segments):
    sold = {s[0]: s for s in sales if s[0] is not None and s[2] is not None}
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in sold:
            item, client = -1 if item is None else item, -1 if sold[sale][1] is None else sold[sale][1]
            rows.append((sale, item, vendor, client, sold[sale][2], zlib.crc32(str(sale).encode()) % 5, flag == "returned", kinds.get(item), nations.get(vendor), segments.get(client)))
    out = {}
    for a in rows:
        past = [b for b in rows if b[5] != a[5] and b[4] < a[4]]

        def counts(col, a=a, past=past):
            same = [b for b in past if col is None or b[col] == a[col]]
            return len(same), sum(b[6] for b in same)

        def rate(n, s, p):
            return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

        first, made = rate(*counts(None), 500_000), []
        for child, parent in ((1, 7), (2, 8), (3, 9)):
            n, s = counts(child)
            made += [n, rate(n, s, rate(*counts(parent), first))]
        key = a[:3]
        own = [b for b in rows if b[:3] == key]
        out[key] = (*key, len(own), sum(b[6] for b in own), *made)
    return sorted(out.values(), key=repr)


def shop(spark, lines, sales, kinds, nations, segments):
    text = lambda d, name, kind: spark.createDataFrame([(*x, "n") for x in d.items()], f"{name} long, {kind}, t string")
    return (
        spark.createDataFrame([(*x, 1, 2.0) for x in lines], "sale_id long, item_id long, vendor_id long, flag string, t int, n double"),
        spark.createDataFrame([(*x, "s", 5) for x in sales], "sale_id long, client_id long, sold_at timestamp_ntz, segment string, slice int"),
        text(kinds, "item_id", "kind string"),
        text(nations, "vendor_id", "nation_id int"),
        text(segments, "client_id", "segment string"),
    )


@pytest.mark.parametrize("hot,zone", [(False, "UTC"), (True, "Europe/Berlin")])
def test_encoding_is_that_of_all_pairs(spark, hot, zone):
    r = random.Random(4)
    some = lambda *x: r.choice(x)
    # the hour that summer time repeats and skips, the same times again and again, one time with most sales
    times = [datetime(2024, 3, 31, 1) + timedelta(minutes=15 * k) for k in range(12)] + [datetime(2024, 10, 27, 0) + timedelta(minutes=20 * k, microseconds=k) for k in range(12)]
    sales = [(i, some(None, 1, 1, 2, 3, 9), times[5] if hot and r.random() < 0.7 else some(None, *times)) for i in range(150)] + [(None, 1, times[0])]
    lines = [(some(None, 7, *range(160)), some(None, 1, 1, 2, 3, 50), some(None, 1, 2, 3, 60), some("kept", "returned", None)) for _ in range(500)] + [(7, 1, 1, "returned")] * 60
    tables = shop(spark, lines, sales, {1: "a", 2: "a", 3: None, 4: "b"}, {1: 5, 2: 6, 3: None}, {1: "x", 2: "y", 3: "x"})
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sorted((tuple(x) for x in time_encoding.encode(*tables).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_encoding(lines, sales, {1: "a", 2: "a"}, {1: 5, 2: 6}, {1: "x", 2: "y", 3: "x"})


def test_encoding_of_empty_and_repeated_tables(spark):
    t = datetime(2024, 1, 1)
    lines, sales = [(1, 1, 1, "returned"), (2, 1, 1, "kept")], [(1, 1, t), (2, 1, t + timedelta(seconds=1)), (2, 1, t + timedelta(seconds=1))]
    tables = shop(spark, lines, sales, {1: "a"}, {}, {})
    # an item with two kinds counts once
    tables = [x.unionByName(x.withColumn("kind", x.t)) if "kind" in x.columns else x for x in tables]
    got = {x.sale_id: x for x in time_encoding.encode(*tables).collect()}
    assert len(got) == 2 and got[2].n_lines == 2  # a line for each row of its sale
    tables = shop(spark, [], [], {}, {}, {})
    assert time_encoding.encode(*tables).count() == 0


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_ownership_secrets", "op12_hard_negatives", "op13_time_encoding"])
def test_new_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "sale_lines", "sales", "items", "vendors", "clients"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got = entry.queries()[name](spark, str(TABLES))
    want = duck.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*names).fetchall(), key=repr)
