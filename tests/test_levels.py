"""Several levels of division against plain Python on the cells."""

from __future__ import annotations

import random
from collections import defaultdict

from hydrospark.operators import basins


def forest(seed: int, n: int, trees: int):
    """Random trees of cells, ``nxt`` and accumulation; cells are numbered at random."""
    r = random.Random(seed)
    names = r.sample(range(10 * n), n)
    nxt = {}
    for k, c in enumerate(names):
        nxt[c] = None if k < trees else names[r.randrange(max(0, k - 12), k)] if r.random() < 0.8 else names[r.randrange(k)]
    acc = dict.fromkeys(nxt, 0)
    for c in nxt:
        at = c
        while at is not None:
            acc[at] += 1
            at = nxt[at]
    return nxt, acc


def plain_level(code, nxt, acc, size, th):
    """Codes of the next level, cell by cell."""
    groups = defaultdict(list)
    for c, b in code.items():
        groups[b].append(c)
    ranked = sorted(groups, key=lambda b: (sum(size[c] for c in groups[b]), b), reverse=True)
    n = 2 * len(ranked) // 8 + 1
    out = {c: b + "1" for c, b in code.items()}
    for b in ranked[: n if n < len(ranked) else 1]:
        inflows = defaultdict(list)
        for c in groups[b]:
            if nxt[c] in code and code[nxt[c]] == b:
                inflows[nxt[c]].append(c)
        stem = [max(groups[b], key=lambda c: (acc[c], -c))]
        if acc[stem[0]] < th:
            continue
        tribs = []
        while rivers := sorted((c for c in inflows[stem[-1]] if acc[c] >= th), key=lambda c: (-acc[c], c)):
            tribs += [(stem[-1], c) for c in rivers[1:]]
            stem.append(rivers[0])
        if not tribs:
            continue
        four = sorted(tribs, key=lambda t: (-acc[t[1]], t[1]))[:4]
        four.sort(key=lambda t: (-acc[t[0]], t[1]))
        label = {c: 1 + 2 * sum(acc[j] > acc[c] for j, _ in four) for c in stem}
        label |= {c: 2 * k for k, (_, c) in enumerate(four, 1)}
        for c in groups[b]:
            at = c
            while at is not None and at not in label and nxt[at] in code and code[nxt[at]] == b:
                at = nxt[at]
            if at in label:
                out[c] = b + str(label[at])
    return out


def test_levels_equal_a_division_of_the_cells(spark, monkeypatch):
    nxt, acc = forest(5, 900, 4)
    size = {c: float(c % 5 + 1) for c in nxt}

    def root(c):
        while nxt[c] is not None:
            c = nxt[c]
        return c

    code = {c: f"b{root(c)}" for c in nxt}
    thresholds = [9, 4, 6]
    rows = [(code[c], c, nxt[c], acc[c], size[c]) for c in nxt]
    written = []
    plain = basins.write_table

    def counted(df, name="table", watch=None):
        out = plain(df, name, watch)
        written.append((name, out.df.count()))
        return out

    monkeypatch.setattr(basins, "write_table", counted)
    cells = spark.createDataFrame(rows, "basin string, cell long, nxt long, acc long, size double")
    got = {r.cell: r.pfaf for r in basins.divide_levels(cells, thresholds, basins.F.col("size")).collect()}
    for th in thresholds:
        code = plain_level(code, nxt, acc, size, th)
    assert got == code
    assert len({c[-3:] for c in code.values()}) > 12  # the case does divide
    # cells are written twice, whatever the levels; all else is as large as the tree
    large = [name for name, n in written if n == len(nxt)]
    assert large == ["basin-flow", "pieces"] and max(n for name, n in written if name not in large or n < len(nxt)) < len(nxt) / 2


def test_levels_of_small_tables(spark):
    schema = "basin string, cell long, nxt long, acc long"
    assert basins.divide_levels(spark.createDataFrame([], schema), [1, 1]).count() == 0
    one = spark.createDataFrame([("7", 3, None, 2), ("7", 4, 3, 1)], schema)
    assert {tuple(r) for r in basins.divide_levels(one, []).collect()} == {(3, "7"), (4, "7")}
    assert {tuple(r) for r in basins.divide_levels(one, [5, 1]).collect()} == {(3, "711"), (4, "711")}
