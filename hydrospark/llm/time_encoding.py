"""Time-ordered target encoding: return rates of items, vendors and clients from what was sold before, without own folds.

Lines are summed by sale, item and vendor and dealt out into time slices, runs
of equal size in order of time, so that no time, sale or id is too large for a
slice.  Sums per value and slice, combined over the slices before, give the
state in which each slice opens.  Then every slice of every kind, nation and
segment is swept once in order of time: one pass keeps the counters of the
ids (the dictionary of the children) and of the kind, nation or segment (the
parent).  The counters over everything are scanned apart, slice by slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.storage import write_table

# Folds, the unit of rates, the weight of a prior and the first prior.
FOLDS = 5
UNIT = 1_000_000
WEIGHT = 50
FIRST_PRIOR = 500_000
#: Stands for a missing item or client.
MISSING = -1
#: Child column, parent column.
FAMILIES = (("item_id", "kind"), ("vendor_id", "nation_id"), ("client_id", "segment"))
#: Sums for each fold: lines, returned lines, and both of the slice's last time alone.
PARTS = ("n", "s", "last_n", "last_s")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp; one without a zone is read as it stands, whatever the session's zone."""
    at = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    seconds = F.extract(F.lit("SECOND"), at).cast("decimal(14,6)") * 1_000_000
    return (F.unix_date(F.to_date(at)).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)) * 60_000_000 + seconds.cast("long")


def lookup(df: DataFrame, key: str, value: str):
    """A written table of one row for each key; of several values the least counts."""
    return write_table(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)), "lookup").df


def sold_cells(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Lines with a time, summed by sale, item and vendor, with fold, client and the three parents."""
    own = lines.where("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(MISSING)).cast("long").alias("item_id"), "vendor_id")
    own = own.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("flag") == "returned", 1)).alias("s"))
    sold = sales.where("sale_id is not null and sold_at is not null")
    sold = sold.select("sale_id", micros(sales, "sold_at").alias("t"), F.coalesce("client_id", F.lit(MISSING)).cast("long").alias("client_id"))
    sold = write_table(sold.groupBy("sale_id", "t", "client_id").agg(F.count(F.lit(1)).alias("times")), "sold").df
    out = own.join(sold.hint("merge"), "sale_id").withColumns({x: F.col(x) * F.col("times") for x in "ns"}).drop("times")
    for df, (key, value) in zip((items, vendors, clients), FAMILIES, strict=True):
        out = out.join(lookup(df, key, value).hint("merge"), key, "left")
    fold = F.crc32(F.col("sale_id").cast("string").cast("binary")) % FOLDS
    parents = [F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("")).alias(p) for _, p in FAMILIES]
    return out.select("sale_id", "item_id", "vendor_id", "client_id", *parents, "t", fold.cast("int").alias("fold"), "n", "s")


def sliced(cells: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Cells with ``slice, first, last`` (whether at the slice's first and last time), the slices, and whether any share a time.

    There are as many slices as shuffle partitions.  A time with many sales
    may lie in several slices; ``in_run`` of a slice names the slices before
    that end at the time it begins with, ``out_run`` is the name under which
    its own last time is known.
    """
    spark = cells.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = write_table(cells, "cells").df
    dealt = write_table(kept.repartitionByRange(n, "t", "sale_id", "item_id", "vendor_id", "client_id").withColumn("slice", F.spark_partition_id()), "slices").df
    edges = sorted(tuple(r) for r in dealt.groupBy("slice").agg(F.min("t"), F.max("t")).collect())  # one row for each shuffle partition
    rows, run = [], None  # run: the name of the time at which the slice before ends
    for k, (slice_, low, high) in enumerate(edges):
        in_run = run if k and edges[k - 1][2] == low else None
        run = in_run if in_run is not None and high == low else slice_
        rows.append((slice_, low, high, in_run, run))
    slices = spark.createDataFrame(rows, "slice int, low long, high long, in_run int, out_run int")
    at = F.broadcast(slices.select("slice", "low", "high"))
    own = dealt.join(at, "slice").select(*dealt.columns, (F.col("t") == F.col("low")).alias("first"), (F.col("t") == F.col("high")).alias("last"))
    return own, slices, any(r[3] is not None for r in rows)


def openings(sums: DataFrame, slices: DataFrame, tied: bool, *keys: str) -> DataFrame:
    """For each value and slice, the sums by fold of all slices before, and of them those at the slice's first time.

    ``sums`` holds ``keys, slice`` and the sums of ``PARTS`` for each fold.
    A value has at most one row for each slice.  The second half is only
    there if slices share a time at all (``tied``).
    """
    names = fold_names(tied)
    sofar, last = names[: 2 * FOLDS], names[2 * FOLDS :]
    nothing = lambda these: [F.lit(0).cast("long").alias(x) for x in these]
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    full = sums.select(*keys, "slice", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in sofar), *nothing(last))
    if not tied:
        return full
    runs = sums.join(F.broadcast(slices.select("slice", "in_run", "out_run")), "slice")
    give = runs.join(F.broadcast(slices.where("in_run is not null").select(F.col("in_run").alias("out_run")).distinct()), "out_run", "left_semi")
    give = give.select(*keys, "slice", F.col("out_run").alias("run"), *last, F.lit(False).alias("asks"))
    ask = runs.where("in_run is not null").select(*keys, "slice", F.col("in_run").alias("run"), *nothing(last), F.lit(True).alias("asks"))
    within = Window.partitionBy(*keys, "run").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    at_first = give.unionByName(ask).select(*keys, "slice", "asks", *nothing(sofar), *(F.coalesce(F.sum(x).over(within), F.lit(0)).alias(x) for x in last))
    # put together by sums, since a join would lose null ids
    return full.unionByName(at_first.where("asks").drop("asks")).groupBy(*keys, "slice").agg(*(F.sum(x).alias(x) for x in names))


def fold_names(tied: bool) -> list[str]:
    return [f"{p}{f}" for p in PARTS[: 4 if tied else 2] for f in range(FOLDS)]


def fold_sums(tied: bool) -> list[Column]:
    at = {"n": F.col("n"), "s": F.col("s"), "last_n": F.when(F.col("last"), F.col("n")), "last_s": F.when(F.col("last"), F.col("s"))}
    return [F.coalesce(F.sum(F.when(F.col("fold") == int(x[-1]), at[x[:-1]])), F.lit(0)).alias(x) for x in fold_names(tied)]


def _strictly_before(group: np.ndarray, t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, the sums of ``values`` over the rows of its group with a smaller ``t``."""
    order = np.lexsort((t, group))
    g, at, v = group[order], t[order], values[order]
    upto = np.concatenate([np.zeros((1, v.shape[1]), dtype=v.dtype), np.cumsum(v, axis=0)])
    place = np.arange(len(g))
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_time = new_group | np.concatenate([[True], at[1:] != at[:-1]])
    start = lambda new: np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty_like(v)
    out[order] = upto[start(new_time)] - upto[start(new_group)]
    return out


def _history(code: np.ndarray, rows: dict[str, np.ndarray], opened: np.ndarray) -> np.ndarray:
    """Lines and returned lines of other folds before each row: what the slice opened with, and what it holds itself.

    ``opened[value, part, fold]`` holds the opening sums; at the slice's first
    time, those of slices before at the same time don't count.  They are in
    the last two parts, if there are any.
    """
    fold, values = rows["fold"], np.stack([rows["n"], rows["s"]], axis=1)
    inside = _strictly_before(code, rows["t"], values) - _strictly_before(code.astype(np.int64) * FOLDS + fold, rows["t"], values)
    other = opened.sum(axis=2)[code] - opened[code, :, fold]
    return inside + other[:, :2] - (np.where(rows["first"][:, None], other[:, 2:], 0) if other.shape[1] > 2 else 0)


def _sweep(left: pa.Table, right: pa.Table, child: str, parent: str) -> pa.Table:
    """One slice of one parent: its cells with the history of their child and of the parent."""
    if not left.num_rows:
        return pa.table({**{c: left.column(c) for c in left.column_names}, **{f"{x}_{y}": pa.array([], pa.int64()) for x in (child, parent) for y in "ns"}})
    rows = {c: left.column(c).to_numpy() for c in ("t", "fold", "n", "s", "first")}
    parts = [p for p in PARTS if f"{p}0" in right.column_names]
    state = np.stack([np.stack([right.column(f"{p}{f}").to_numpy() for f in range(FOLDS)], axis=1) for p in parts], axis=1)
    whole = right.column("whole").to_numpy()
    # ids of both sides as numbers from 0, a null id like any other
    both = pa.chunked_array([pa.concat_arrays([*left.column(child).chunks, *right.column(child).filter(pa.array(~whole)).chunks])])
    codes = pc.dictionary_encode(both, null_encoding="encode").chunk(0).indices.to_numpy().astype(np.int64)
    code, known = codes[: left.num_rows], codes[left.num_rows :]
    opened = np.zeros((codes.max() + 1, len(parts), FOLDS), dtype=np.int64)
    opened[known] = state[~whole]
    of_child = _history(code, rows, opened)
    of_parent = _history(np.zeros_like(code), rows, state[whole])
    out = {c: left.column(c) for c in left.column_names}
    out |= {f"{x}_{y}": pa.array(h[:, k]) for x, h in ((child, of_child), (parent, of_parent)) for k, y in enumerate("ns")}
    return pa.table(out)


def with_family(cells: DataFrame, base: DataFrame, slices: DataFrame, tied: bool, child: str, parent: str) -> DataFrame:
    """``cells`` with the history counts of a child column and of its parent."""
    sums = write_table(base.groupBy(parent, child, "slice").agg(*fold_sums(tied)), "sums").df
    of_child = openings(sums, slices, tied, parent, child).withColumn("whole", F.lit(False))
    of_parent = openings(sums.groupBy(parent, "slice").agg(*(F.sum(x).alias(x) for x in fold_names(tied))), slices, tied, parent)
    of_parent = of_parent.withColumns({child: F.lit(None).cast("long"), "whole": F.lit(True)})
    opened = write_table(of_child.unionByName(of_parent), "openings").df
    schema = ", ".join([f"{c} {t}" for c, t in cells.dtypes] + [f"{x}_{y} long" for x in (child, parent) for y in "ns"])
    return cells.groupBy(parent, "slice").cogroup(opened.groupBy(parent, "slice")).applyInArrow(lambda left, right: _sweep(left, right, child, parent), schema)


def with_total(cells: DataFrame, slices: DataFrame, tied: bool) -> DataFrame:
    """``cells`` with ``all_n, all_s``: the history over everything, scanned slice by slice."""
    opened = openings(cells.groupBy(F.lit(0).alias("every"), "slice").agg(*fold_sums(tied)), slices, tied, "every").drop("every")
    before = lambda *keys: Window.partitionBy("slice", *keys).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    inside = {f"all_{x}": F.coalesce(F.sum(x).over(before()), F.lit(0)) - F.coalesce(F.sum(x).over(before("fold")), F.lit(0)) for x in "ns"}
    other = lambda part: sum((F.when(F.col("fold") != f, F.col(f"{part}{f}")).otherwise(0) for f in range(FOLDS)), F.lit(0))
    out = cells.withColumns(inside).join(F.broadcast(opened), "slice")  # one row for each slice
    again = lambda x: F.when(F.col("first"), other(f"last_{x}")).otherwise(0) if tied else F.lit(0)
    return out.select(*cells.columns, *((F.col(f"all_{x}") + other(x) - again(x)).alias(f"all_{x}") for x in "ns"))


def rate(n: str, s: str, prior: str) -> str:
    """SQL for a rate in whole units, the prior where there is no history."""
    return f"CASE WHEN {n} < 1 THEN {prior} ELSE ({UNIT} * {s} + {WEIGHT} * {prior}) DIV ({n} + {WEIGHT}) END"


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """One row for each sale, item and vendor: own lines, and the history of its item, vendor and client as counts and rates.

    The history of a line is every line of other folds with an earlier time;
    lines of the same time, and so of the same sale, are not in it.  A rate is
    shrunk towards that of the kind, nation or segment, and these towards the
    rate of all history, each taken from the same history.

    Null items and clients are the id -1.  A null vendor is a value of its
    own.  Ids without a row, or with a null kind, nation or segment, share
    one; of several rows of an id the least value counts.  Repeated lines
    count as often as they are there, and once for each row of their sale; a
    sale with several times or clients has rows for each.  Lines without a
    sale or a time are left out.  Empty tables give empty results; other
    columns are ignored.
    """
    base, slices, tied = sliced(sold_cells(lines, sales, items, vendors, clients))
    out = with_total(base, slices, tied)
    out = out.withColumn("all_rate", F.expr(rate("all_n", "all_s", f"{FIRST_PRIOR}L"))).drop("all_n", "all_s", "last")
    for child, parent in FAMILIES:
        name = child.removesuffix("_id")
        out = with_family(out, base, slices, tied, child, parent)
        shrunk = rate(f"{child}_n", f"{child}_s", rate(f"{parent}_n", f"{parent}_s", "all_rate"))
        # a sweep hands on what is asked for and drops what no later one needs
        out = out.withColumns({f"{name}_n": F.col(f"{child}_n"), f"{name}_rate": F.expr(shrunk)}).drop(parent, *(f"{x}_{y}" for x in (child, parent) for y in "ns" if f"{x}_{y}" != f"{name}_n"))
    counts = [f"{c.removesuffix('_id')}_{x}" for c, _ in FAMILIES for x in ("n", "rate")]
    return out.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *counts)
