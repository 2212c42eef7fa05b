"""Operators on the flow graph, in which each cell has at most one next cell.

Everything global rests on doubling: after k rounds a cell knows its 2**k-th
successor, so sums over all upstream cells or along the whole downstream path
take as many rounds as the logarithm of the longest path.  Rounds are written
to the shared folder.  Where values are whole numbers, paths are first followed
within spans of cells (``spans``), and only what leaves a span takes part in
the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hydrospark.functions.cells import STEPS, cell_key, code_8, in_grid, step
from hydrospark.operators import spans
from hydrospark.operators.blocks import NONE, around, each_block, within
from hydrospark.operators.ranking import global_rank
from hydrospark.storage import Table, read_tables, write_table

#: Doubling rounds cover paths of 2**MAX_ROUNDS cells; a longer one is a cycle.
MAX_ROUNDS = 40
MOVING = "nxt is not null"
#: Stands for all that lies beyond the grid; cells are numbered from 0.
OUTSIDE = -1


def flow_graph(cells: DataFrame, directions: DataFrame, width: int, height: int, code: str = "dir") -> DataFrame:
    """``cell, nxt`` for all cells, packed keys; ``nxt`` is null at pits and where flow leaves the grid.

    ``code`` names a column of the 8-system, or of the 128-system if it ends
    in ``128``.  A table of directions that has a row for each cell may be
    given as both, and is not joined then.
    """
    d = code_8(F.col(code)) if code.endswith("128") else F.col(code)
    to = directions.select("x", "y", d.alias("d"))
    nx, ny = F.col("x") + step(F.col("d"), 0), F.col("y") + step(F.col("d"), 1)
    nxt = F.when(in_grid(nx, ny, width, height), cell_key(nx, ny, width))
    every = to if cells is directions else cells.select("x", "y").join(to, ["x", "y"], "left")
    return every.select(cell_key(F.col("x"), F.col("y"), width).alias("cell"), nxt.alias("nxt"))


def _doubling(first: Table, advance: Callable[[list[Table]], DataFrame], name: str) -> list[Table]:
    """The tables of all rounds, each of which advances the rows that still move.

    ``advance`` gets the tables so far.  Rows that are done have a null
    ``nxt``; they are written once and take part in no later round.
    """
    tables = [first]
    for _ in range(MAX_ROUNDS):
        if not tables[-1].watched:
            return tables
        tables.append(write_table(advance(tables), name, watch=MOVING))
    for t in tables:
        t.drop()
    raise ValueError("the flow graph has a cycle")


def _done(tables: list[Table]) -> DataFrame:
    return read_tables(tables).where("nxt is null")


@dataclass(frozen=True)
class Gather:
    """A value that cells collect from upstream: what each starts with, what it sends, and how values are combined.

    ``combine`` is one of ``F.sum``, ``F.min`` and ``F.max``.
    """

    start: Column
    sent: Column
    combine: Callable = F.sum

    def merged(self, mine: Column, got: Column) -> Column:
        if self.combine is F.sum:
            return F.coalesce(mine + got, mine, got)
        return {F.min: F.least, F.max: F.greatest}[self.combine](mine, got)


def gather(flow: DataFrame, values: dict[str, Gather], step: Column | None = None) -> DataFrame:
    """``cell`` and each of ``values``, combined over all cells upstream and the cell's own.

    In a round every moving cell sends what it has to its 2**k-th successor and
    takes over that one's successor.  A cell whose successor is done is done
    as well: its value, and what later rounds send to such a cell, are entries
    in the tables, added up at the end.  So a round touches moving cells
    alone.  ``step``, if given, is a column ``step`` that is added up along the
    way to the successor, for use in ``sent``.  What is sent to cells that the
    graph doesn't have is dropped.
    """
    names = list(values)
    columns = [v.start.alias(n) for n, v in values.items()] + ([step.alias("step")] if step is not None else [])
    begun = flow.select("cell", "nxt", *columns, F.lit(True).alias("own__"))
    whole = {f.name for f in begun.schema if isinstance(f.dataType, IntegralType)}  # sums of them are longs
    first = write_table(begun.withColumns({n: F.col(n).cast("long") for n in names if n in whole and values[n].combine is F.sum}), "gather", watch=MOVING)

    def advance(tables: list[Table]) -> DataFrame:
        moving = tables[-1].df.where(MOVING)
        got = moving.groupBy(F.col("nxt").alias("cell")).agg(*(v.combine(v.sent).alias(f"{n}__") for n, v in values.items()))
        further = [F.col("step").alias("more__")] if step is not None else []
        hop = moving.select(F.col("cell").alias("nxt"), F.col("nxt").alias("far__"), *further)
        out = moving.join(hop, "nxt", "left").join(got, "cell", "full")
        merged = [v.merged(F.col(n), F.col(f"{n}__")).alias(n) for n, v in values.items()]
        along = [(F.col("step") + F.coalesce("more__", F.lit(0.0))).alias("step")] if step is not None else []
        return out.select("cell", F.col("far__").alias("nxt"), *merged, *along, F.coalesce("own__", F.lit(False)).alias("own__"))

    tables = _doubling(first, advance, "gather")
    every = _done(tables).groupBy("cell").agg(*(v.combine(n).alias(n) for n, v in values.items()), F.max("own__").alias("own__"))
    out = write_table(every.where("own__").select("cell", *names), "gathered")
    for t in tables:
        t.drop()
    return out.df


def push(flow: DataFrame, start: dict[str, Column], combine=F.sum) -> DataFrame:
    """``cell`` and, for each name, ``combine`` of the start values of all cells upstream, its own included.

    ``flow`` may hold further columns for the start values.  ``combine`` is an
    aggregate that may be nested (sum, min, max).
    """
    begun = flow.select("cell", "nxt", *(c.alias(n) for n, c in start.items()))
    if combine is F.sum and _whole(begun) and not any(begun.schema[n].nullable for n in start):
        return _push_spans(begun, list(start))
    return gather(flow, {n: Gather(c, F.col(n), combine) for n, c in start.items()})


def last(mine: Column, ahead: Column) -> Column:
    """For ``pull``: the value of the last cell that has one."""
    return F.coalesce(ahead, mine)


def plus(mine: Column, ahead: Column) -> Column:
    """For ``pull``: the sum; null counts as 0."""
    return F.coalesce(mine, F.lit(0)) + F.coalesce(ahead, F.lit(0))


def pull(flow: DataFrame, start: dict[str, Column], combine=F.greatest, kept: Sequence[str] = ()) -> DataFrame:
    """``cell`` and, for each name, ``combine`` of the start values of all cells on the downstream path, its own included.

    Whole numbers are combined by spans if ``combine`` is ``F.greatest`` or
    ``plus``, all other values by doubling alone.  Columns of ``flow`` that
    ``kept`` names come out as they are.
    """
    begun = flow.select("cell", "nxt", *(c.alias(n) for n, c in start.items()), *kept)
    if combine in (F.greatest, plus) and _whole(begun):
        return _pull_spans(begun, list(start), combine, kept)
    made = _pull_rounds(begun.drop(*kept), list(start), combine)
    return made.join(begun.select("cell", *kept), "cell") if kept else made


def _pull_rounds(begun: DataFrame, names: list[str], combine) -> DataFrame:
    """Moving cells look up their 2**k-th successor, which may be done already; those that are done aren't written again."""
    first = write_table(begun, "pull", watch=MOVING)

    def advance(tables: list[Table]) -> DataFrame:
        moving = tables[-1].df.where(MOVING)
        every = _done(tables).unionByName(moving)
        ahead = every.select(F.col("cell").alias("nxt"), F.col("nxt").alias("far__"), *(F.col(n).alias(f"{n}__") for n in names))
        out = moving.join(ahead, "nxt", "left")
        return out.select("cell", F.col("far__").alias("nxt"), *(combine(F.col(n), F.col(f"{n}__")).alias(n) for n in names))

    return _done(_doubling(first, advance, "pull")).select("cell", *names)


def roots(flow: DataFrame) -> DataFrame:
    """``cell, root``: the last cell of each downstream path that is a cell of the graph."""
    if _whole(flow.select("cell", "nxt")):
        return _pull_spans(flow.select("cell", "nxt", F.col("cell").alias("root")), ["root"], last)
    known = flow.select(F.col("cell").alias("nxt"), F.lit(True).alias("in_graph"))
    inside = flow.join(known, "nxt", "left").select("cell", F.when(F.col("in_graph"), F.col("nxt")).alias("nxt"))
    return _pull_rounds(inside.withColumn("root", F.col("cell")), ["root"], last)


def _whole(table: DataFrame) -> bool:
    return all(isinstance(f.dataType, IntegralType) for f in table.schema)


def _span(cell: Column) -> Column:
    return F.floor(cell / spans.SPAN).cast("long")


def _packed(begun: DataFrame, names: list[str], sums=None) -> Table:
    rows = begun.select(_span(F.col("cell")).alias("span"), *(F.col(c).cast("long").alias(c) for c in ("cell", "nxt", *names)))
    packed = write_table(rows.groupBy("span").applyInArrow(spans.pack(names, sums), spans.pack_schema(names)), "spans", watch="looped")
    if packed.watched:
        packed.drop()
        raise ValueError("the flow graph has a cycle")
    return packed


def _with_lists(packed: DataFrame, rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Packed spans with lists of the rows that belong to each, of which a span has no more than cells at its borders."""
    listed = rows.groupBy("span").agg(F.collect_list(F.struct(*more)).alias("l"))
    return packed.select("span", "cell", "nxt", *names).join(listed, "span", "left").select("cell", "nxt", *names, *(F.col(f"l.{c}").alias(f"got_{c}") for c in more))


def _entries(packed: DataFrame, names: list[str], made, columns: list[str]) -> DataFrame:
    """The cells at which paths enter a span, one row each, with what ``made`` tells of them."""
    entered = packed.select(F.explode("out").alias("entry")).distinct().withColumn("span", _span(F.col("entry")))
    asked = _with_lists(packed.join(entered.select("span").distinct(), "span", "left_semi"), entered, names, "entry")

    def rows(paths, values, got):
        at, there = spans.look_up(paths.cell, got["entry"])
        at = at[there]
        return {"entry": got["entry"][there], **made(paths, values, at)}

    return write_table(asked.mapInArrow(spans.each_span(names, rows), ", ".join(f"{c} bigint" for c in ("entry", *columns))), "entries").df


def _typed(made: DataFrame, begun: DataFrame, *names: str) -> DataFrame:
    return made.select(F.col("cell").cast(begun.schema["cell"].dataType).alias("cell"), *(F.col(n).cast(begun.schema[n].dataType).alias(n) for n in names))


def _pull_spans(begun: DataFrame, names: list[str], combine, kept: Sequence[str] = ()) -> DataFrame:
    """``pull`` within spans, then by doubling over the cells at which paths enter a span, then from there to all cells."""
    every = [*names, *kept]
    packed = _packed(begun, every)
    adds, ends_only, none = combine is plus, combine is last, spans.NONE

    def within(paths, values):
        ends = paths.ends()[:-1]
        if ends_only:
            return ends, [v[ends] for v in values]
        if adds:
            return ends, [paths.pulled(np.where(v == none, 0, v), np.add, 0)[:-1] for v in values]
        return ends, [paths.pulled(v, np.maximum, none)[:-1] for v in values]

    def entry(paths, values, at):
        ends, sums = within(paths, values)
        return {"nxt": paths.out[ends[at]], **{n: v[at] for n, v in zip(names, sums, strict=True)}}

    entries = _entries(packed.df, names, entry, ["nxt", *names])
    below = write_table(_pull_rounds(entries.withColumnRenamed("entry", "cell"), names, combine), "below").df
    left = packed.df.select("span", F.explode("out").alias("entry")).distinct().join(below.withColumnRenamed("cell", "entry"), "entry")

    def finish(paths, values, got):
        ends, sums = within(paths, values[: len(names)])
        order = np.argsort(got["entry"])
        at, there = spans.look_up(got["entry"][order], paths.out[ends])
        for n, v in zip(names, sums, strict=True):
            more = got[n][order][at[there]]
            v[there] = more if ends_only else v[there] + more if adds else np.maximum(v[there], more)
        return {"cell": paths.cell, **dict(zip(every, [*sums, *values[len(names) :]], strict=True))}

    final = _with_lists(packed.df, left, every, "entry", *names).mapInArrow(spans.each_span(every, finish), ", ".join(f"{c} bigint" for c in ("cell", *every)))
    return _typed(write_table(final, "pulled").df, begun, *every)


def _arrived(packed: DataFrame, names: list[str], entries: DataFrame | None = None) -> DataFrame:
    """``entry`` and, for each name, the sum of what all cells above send to where paths enter a span, by doubling over the cells at which they leave one."""
    entries = _ends(packed, names) if entries is None else entries
    gates = packed.select(F.explode(F.arrays_zip("gate", "out", *(f"{n}_sent" for n in names))).alias("g")).select("g.*")
    gates = write_table(gates.join(entries.withColumnRenamed("entry", "out"), "out").select(F.col("gate").alias("cell"), F.col("end").alias("nxt"), "out", *(F.col(f"{n}_sent").alias(n) for n in names)), "gates").df
    total = gather(gates, {n: Gather(F.col(n), F.col(n)) for n in names})
    return gates.select("cell", "out").join(total, "cell").groupBy(F.col("out").alias("entry")).agg(*(F.sum(n).alias(n) for n in names))


def _ends(packed: DataFrame, names: list[str]) -> DataFrame:
    return _entries(packed, names, lambda paths, values, at: {"end": paths.cell[paths.ends()[at]]}, ["end"])


def _push_spans(begun: DataFrame, names: list[str], along: bool = False) -> DataFrame:
    """``push`` of sums within spans, then by doubling over the cells at which paths leave a span, then from where they enter on.

    With ``along`` also ``nxt``, null where the graph doesn't have that cell.
    """
    packed = _packed(begun, names, lambda paths, v: paths.pushed(v, np.add, 0))
    entries = _ends(packed.df, names)
    arrived = _arrived(packed.df, names, entries)

    def finish(paths, values, got):
        at, _ = spans.look_up(paths.cell, got["entry"])
        out = {"cell": paths.cell}
        for n, v in zip(names, values, strict=True):
            v = v.copy()
            v[at] += got[n]
            out[n] = paths.pushed(v, np.add, 0)[:-1]
        if along:
            out |= {"nxt": np.append(paths.cell, spans.NONE)[paths.to[:-1]], "far": paths.out[:-1]}
        return out

    columns = ["cell", *names, *(["nxt", "far"] if along else [])]
    final = _with_lists(packed.df, arrived.withColumn("span", _span(F.col("entry"))), names, "entry", *names).mapInArrow(spans.each_span(names, finish), ", ".join(f"{c} bigint" for c in columns))
    made = write_table(final.withColumn("cell", F.col("cell").cast(begun.schema["cell"].dataType)), "pushed").df
    if not along:
        return made
    # only cells at which paths leave a span have to look for the next one
    known = entries.select(F.col("entry").alias("far"), F.lit(True).alias("known"))
    left = made.where("far is not null").drop("nxt").join(known, "far", "left").withColumn("nxt", F.when(F.col("known"), F.col("far")))
    return made.where("far is null").select("cell", "nxt", *names).unionByName(left.select("cell", "nxt", *names))


def sized(flow: DataFrame) -> DataFrame:
    """``cell, nxt, acc``: the flow graph with its accumulation; ``nxt`` is null where the graph doesn't have that cell."""
    begun = flow.select("cell", "nxt", F.lit(1).cast("long").alias("acc"))
    if _whole(begun):
        return _push_spans(begun, ["acc"], along=True)
    known = flow.select(F.col("cell").alias("nxt"), F.lit(True).alias("in_graph"))
    inside = flow.join(known, "nxt", "left").select("cell", F.when(F.col("in_graph"), F.col("nxt")).alias("nxt"))
    return write_table(inside.join(accumulation(flow), "cell"), "sizes").df


def accumulation(flow: DataFrame) -> DataFrame:
    """``cell, acc``: number of cells whose path passes through the cell, itself included."""
    return push(flow, {"acc": F.lit(1).cast("long")})


def repair_accumulation(cells: DataFrame, width: int, edge_contamination: bool = False) -> DataFrame:
    """Fill in missing accumulation: ``cell, acc`` of cells that have a direction and no ``acc`` but can be resolved.

    ``cells`` holds ``cell, nxt, has_dir, acc, on_edge`` of all tiles together.
    A target is 1 plus its upstream cells.  It stays unresolved if an upstream
    cell has an unusable value, or, with ``edge_contamination``, if it lies on
    the outer edge and nothing flows in, and so does everything below.
    """
    target = F.col("has_dir") & F.col("acc").isNull()
    rows = write_table(cells.withColumn("target", target), "tiles").df
    into = rows.where("nxt is not null").groupBy(F.col("nxt").alias("cell")).agg(
        F.sum(F.when(~F.col("target"), F.col("acc")).otherwise(0)).alias("known"),
        F.max(F.when(~F.col("target") & (F.coalesce("acc", F.lit(0)) <= 0), 1).otherwise(0)).alias("bad"),
        F.count(F.lit(1)).alias("n"),
    )
    own = rows.where("target").join(into, "cell", "left")
    lost = F.coalesce("bad", F.lit(0)) > 0
    if edge_contamination:
        lost = lost | (F.col("on_edge") & F.col("n").isNull())
    flow = own.select("cell", "nxt", (F.coalesce("known", F.lit(0)) + 1).alias("base"), lost.cast("long").alias("lost"))
    return push(flow, {"acc": F.col("base"), "lost": F.col("lost")}).where("lost = 0").select("cell", "acc")


def with_lengths(flow: DataFrame, width: int) -> DataFrame:
    """``flow`` with ``len``, the distance to the next cell (0 where there is none)."""
    straight = (F.abs(F.col("nxt") - F.col("cell")) == 1) | (F.abs(F.col("nxt") - F.col("cell")) == width)
    return flow.select("cell", "nxt", F.when(F.col("nxt").isNull(), 0.0).when(straight, 1.0).otherwise(sqrt(2.0)).alias("len"))


def upstream_lengths(flow: DataFrame, width: int) -> DataFrame:
    """``cell, longest, total``: longest upstream path and total length of all upstream channels."""
    own = write_table(with_lengths(flow, width), "lengths").df
    made = gather(
        own,
        {"longest": Gather(F.lit(0.0), F.col("longest") + F.col("step"), F.max), "total": Gather(F.col("len"), F.col("total"))},
        step=F.col("len"),
    )
    return made.join(own.select("cell", "len"), "cell").select("cell", "longest", (F.col("total") - F.col("len")).alias("total"))


#: Kinds of cells in the rounds of ``strahler``: known, one inflow unknown, more inflows unknown.
KNOWN, CHAIN, FORK = 0, 1, 2


def _one_unknown(lo: Column, q: Column, x: Column) -> Column:
    """Order of a cell below an order ``x``: ``q`` below ``lo``, one more up to ``q``, and ``x`` itself above."""
    return F.when(x < lo, q).when(x <= q, q + 1).otherwise(x)


def _composed(lo: Column, q: Column, lo_up: Column, q_up: Column) -> tuple[Column, Column]:
    """The function of ``lo, q`` after that of ``lo_up, q_up``, which is of the same form."""
    never = lambda v: v + 1  # noqa: E731  the lower bound at which no step is left
    new_lo = F.when(q < q_up, lo_up).when(q == q_up, F.when(lo <= q, never(q + 1)).otherwise(lo_up)).when(q_up >= lo, never(q + 1)).when(q_up + 1 == lo, lo_up).otherwise(lo)
    new_q = F.when(q < q_up, q_up).when(q == q_up, F.when(lo <= q, q + 1).otherwise(q)).when(q_up >= lo, q + 1).otherwise(q)
    return new_lo, new_q


def strahler(flow: DataFrame) -> DataFrame:
    """``cell, strahler``, by contraction of the tree.

    A cell whose inflows are all known but one is a function of that one's
    order, ``_one_unknown``, and such functions compose.  So in a round a cell
    with one unknown inflow takes over the function and the inflow of the cell
    it waits for, which halves every chain, and cells with more unknown
    inflows take in the orders found in the round before.  Rounds grow with
    the logarithm of the number of cells; each is one written table and reads
    only the last one's cells that are still unknown or were found in it.
    """
    cells = flow.select("cell", F.col("nxt").alias("to"))
    into = cells.where("to is not null").groupBy(F.col("to").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("cell").alias("ids"))
    none = F.lit(0).cast("int")
    first = cells.join(into, "cell", "left").select(
        "cell",
        "to",
        F.when(F.col("n").isNull(), KNOWN).when(F.col("n") == 1, CHAIN).otherwise(FORK).alias("kind"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("ids", F.lit(0)).cast("long").alias("ids"),  # the sum of unknown inflows: the last one is told by it
        none.alias("top"),
        none.alias("twice"),
        (none + 1).alias("lo"),
        none.alias("q"),
        F.when(F.col("n").isNull(), 1).cast("int").alias("strahler"),
    )
    columns = first.columns
    open_ = f"kind <> {KNOWN}"
    tables = [write_table(first, "orders", watch=open_)]
    for _ in range(2 * MAX_ROUNDS):
        if not tables[-1].watched:
            return read_tables(tables).where(f"kind = {KNOWN}").select("cell", "strahler")
        last = tables[-1].df
        known = last.where(f"kind = {KNOWN}")
        # a chain cell whose inflow is known is done, and so is one that waits for such a cell; the others skip the cell they wait for
        at = known.select(F.col("cell").alias("ids"), F.col("strahler").alias("known_"))
        chains = last.where(f"kind = {CHAIN}").join(at, "ids", "left").withColumn("strahler", F.when(F.col("known_").isNotNull(), _one_unknown(F.col("lo"), F.col("q"), F.col("known_"))).cast("int"))
        ahead = chains.select(F.col("cell").alias("ids"), F.col("ids").alias("ids_"), F.col("lo").alias("lo_"), F.col("q").alias("q_"), F.col("strahler").alias("strahler_"))
        chains = chains.join(ahead, "ids", "left")
        lo, q = _composed(F.col("lo"), F.col("q"), F.col("lo_"), F.col("q_"))
        order = F.coalesce("strahler", F.when(F.col("strahler_").isNotNull(), _one_unknown(F.col("lo"), F.col("q"), F.col("strahler_"))))
        chains = chains.withColumns({
            "strahler": order.cast("int"),
            "kind": F.when(order.isNotNull(), KNOWN).otherwise(CHAIN),
            "ids": F.coalesce("ids_", "ids"),
            "lo": F.when(F.col("ids_").isNotNull(), lo).otherwise(F.col("lo")).cast("int"),
            "q": F.when(F.col("ids_").isNotNull(), q).otherwise(F.col("q")).cast("int"),
        })
        # a fork takes in what was found in the round before
        best = known.where("to is not null").groupBy(F.col("to").alias("cell"), "strahler").agg(F.count(F.lit(1)).alias("m"), F.sum("cell").alias("i"))
        best = best.groupBy("cell").agg(F.max(F.struct("strahler", (F.col("m") > 1).cast("int").alias("twice"))).alias("b"), F.sum("m").alias("m"), F.sum("i").alias("i"))
        forks = last.where(f"kind = {FORK}").join(best, "cell", "left")
        b, b2 = F.coalesce("b.strahler", F.lit(0)), F.coalesce("b.twice", F.lit(0))
        forks = forks.withColumns({
            "top": F.greatest("top", b).cast("int"),
            "twice": F.when(b > F.col("top"), b2).when(b < F.col("top"), F.col("twice")).otherwise(F.when(b > 0, 1).otherwise(0)).cast("int"),
            "n": F.col("n") - F.coalesce("m", F.lit(0)),
            "ids": F.col("ids") - F.coalesce("i", F.lit(0)),
        })
        value = F.col("top") + F.col("twice")
        forks = forks.withColumns({
            "kind": F.when(F.col("n") == 0, KNOWN).when(F.col("n") == 1, CHAIN).otherwise(FORK),
            "strahler": F.when(F.col("n") == 0, value).cast("int"),
            # with two of the greatest order known, one more of it changes nothing
            "lo": F.when(F.col("twice") == 1, value + 1).otherwise(F.col("top")).cast("int"),
            "q": value.cast("int"),
        })
        tables.append(write_table(chains.select(columns).unionByName(forks.select(columns)), "orders", watch=open_))
    for t in tables:
        t.drop()
    raise ValueError("the flow graph has a cycle")


def pass_levels(passes: DataFrame, out: DataFrame) -> DataFrame:
    """``root, level``: the lowest level by which each basin reaches the outside.

    ``passes`` holds ``root, other, height`` for neighbouring basins, both
    ways; ``out`` holds ``root, height`` for those that border the outside.
    In a round every group of basins takes its lowest pass, so that at least
    halves the groups that have not reached the outside.  A basin must rise to
    the pass of each group it belonged to, and need not rise higher: from any
    pass of a group its lowest one is reached below the first.  A basin with
    no way out has a null level.
    """
    both = passes.select(F.col("root").alias("a"), F.col("other").alias("b"), "height")
    edges = write_table(both.unionByName(out.select(F.col("root").alias("a"), F.lit(OUTSIDE).cast("long").alias("b"), "height")), "passes", watch="true")
    state = write_table(passes.select("root").union(out.select("root")).distinct().select("root", F.col("root").alias("grp"), F.lit(None).cast("double").alias("level")), "levels")
    for _ in range(MAX_ROUNDS):
        if not edges.watched:
            closed = F.col("grp") != OUTSIDE
            return state.df.select("root", F.when(~closed, F.col("level")).alias("level"))
        # passes of equal height are told apart by their two groups, so that no group is chosen in a circle
        key = F.struct("height", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")
        chosen = write_table(edges.df.groupBy("a").agg(F.min(key).alias("k")).select("a", F.col("k.b").alias("b"), F.col("k.height").alias("height")), "chosen").df
        back = chosen.select(F.col("a").alias("b"), F.col("b").alias("back"))
        link = chosen.join(back, "b", "left").select(F.col("a").alias("cell"), F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), None).otherwise(F.col("b")).alias("nxt"))
        link = link.unionByName(link.sparkSession.range(1).select(F.lit(OUTSIDE).cast("long").alias("cell"), F.lit(None).cast("long").alias("nxt")))
        group = write_table(_pull_rounds(link.withColumn("to", F.col("cell")), ["to"], last), "groups").df
        moved = state.df.join(chosen.select(F.col("a").alias("grp"), "height"), "grp", "left").join(group.select(F.col("cell").alias("grp"), "to"), "grp", "left")
        new_state = write_table(moved.select("root", F.coalesce("to", "grp").alias("grp"), F.greatest("level", "height").alias("level")), "levels")
        ends = lambda c: group.select(F.col("cell").alias(c), F.col("to").alias(f"to_{c}"))
        merged = edges.df.join(ends("a"), "a").join(ends("b"), "b").where(F.col("to_a").isNotNull() & (F.col("to_a") != F.col("to_b")) & (F.col("to_a") != OUTSIDE))
        new_edges = write_table(merged.groupBy(F.col("to_a").alias("a"), F.col("to_b").alias("b")).agg(F.min("height").alias("height")), "passes", watch="true")
        for t in (state, edges):
            t.drop()
        state, edges = new_state, new_edges
    raise RuntimeError("basins did not settle")


def _passes(there: np.ndarray, left: int, top: int, z: np.ndarray, root: np.ndarray) -> dict[str, np.ndarray]:
    """The lowest pass of a block between each two basins, and to the outside (no other basin) at cells with fewer than 8 neighbours."""
    own = within(there)
    rim = own & (sum(around(there, s, False).astype(np.int8) for s in STEPS.values()) < 8)
    a, b, h = [root[rim]], [np.full(np.count_nonzero(rim), NONE)], [z[rim]]
    for s in STEPS.values():
        other = around(root, s, NONE)
        met = own & (other != NONE) & (other != root)
        a.append(root[met])
        b.append(other[met])
        h.append(np.fmax(z, around(z, s, np.nan))[met])
    a, b, h = (np.concatenate(v) for v in (a, b, h))
    order = np.lexsort((h, b, a))
    a, b, h = a[order], b[order], h[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return {"root": a[first], "other": b[first], "height": h[first]}


def fill_pits(dem: DataFrame, directions: DataFrame, width: int, height: int, z: str = "z") -> DataFrame:
    """``x, y, z, filled``: the least surface above the terrain from which every cell drains off the grid.

    A cell first falls to the pit of its basin, so only the pit's level
    matters: the lowest pass by which the basin leaves over its neighbours.
    Passes are told block by block, and the search runs on groups of basins,
    whose number at least halves in a round.  ``dem`` may be ``directions`` as
    well, as for ``flow_graph``.
    """
    flow = flow_graph(dem, directions, width, height)
    root = roots(flow)
    own = dem.select("x", "y", F.col(z).alias("z"), cell_key(F.col("x"), F.col("y"), width).alias("cell")).join(root, "cell")
    own = write_table(own, "basins").df
    passes = write_table(each_block(own.select("x", "y", F.col("z").cast("double").alias("z"), "root"), _passes, "root bigint, other bigint, height double"), "block-passes").df
    near = passes.where("other is not null").groupBy("root", "other").agg(F.min("height").alias("height"))
    out = passes.where("other is null").groupBy("root").agg(F.min("height").alias("height"))
    levels = write_table(pass_levels(write_table(near, "near").df, write_table(out, "out").df), "filled").df
    return own.join(levels, "root", "left").select("x", "y", "z", F.greatest("z", "level").alias("filled"))


def basin_labels(flow: DataFrame, outlets: DataFrame) -> DataFrame:
    """``cell, label`` of all cells above an outlet (``cell, label``); a nested outlet starts a basin of its own."""
    cut = flow.join(outlets.select("cell", F.lit(True).alias("is_outlet")), "cell", "left").select("cell", F.when(F.col("is_outlet").isNull(), F.col("nxt")).alias("nxt"))
    return roots(cut).join(outlets.select(F.col("cell").alias("root"), "label"), "root").select("cell", "label")


def reaches(flow: DataFrame, rivers: DataFrame) -> DataFrame:
    """``cell, reach``: river cells with the last cell of their chain between heads and confluences."""
    own = write_table(flow.join(rivers.select("cell"), "cell", "left_semi"), "rivers").df
    known = own.select(F.col("cell").alias("nxt"), F.lit(1).alias("is_river"))
    inflow = own.where("nxt is not null").groupBy(F.col("nxt").alias("n_cell")).agg(F.count(F.lit(1)).alias("n"))
    links = own.join(known, "nxt", "left").join(inflow, F.col("nxt") == F.col("n_cell"), "left")
    chain = links.select("cell", F.when(F.col("is_river").isNotNull() & (F.col("n") < 2), F.col("nxt")).alias("nxt"))
    return roots(chain).withColumnRenamed("root", "reach")


def reach_tree(flow: DataFrame, reach: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """One row per reach: ``reach, n_cells, down_reach, n_up`` and ``strahler`` if orders are given."""
    down = flow.join(reach.select("reach").distinct(), flow["cell"] == F.col("reach")).select("reach", "nxt")
    down = down.join(reach.select(F.col("cell").alias("nxt"), F.col("reach").alias("down_reach")), "nxt", "left").select("reach", "down_reach")
    size = reach.groupBy("reach").agg(F.count(F.lit(1)).alias("n_cells"))
    up = down.where("down_reach is not null").groupBy(F.col("down_reach").alias("reach")).agg(F.count(F.lit(1)).alias("n_up"))
    out = size.join(down, "reach").join(up, "reach", "left").select("reach", "n_cells", "down_reach", F.coalesce("n_up", F.lit(0)).alias("n_up"))
    if order is not None:
        out = out.join(order.select(F.col("cell").alias("reach"), "strahler"), "reach")
    return out


def reach_points(reach: DataFrame, flow: DataFrame) -> DataFrame:
    """``reach, pos, cell, nxt``: the cells of each reach in flow order from 0, with the cell that each drains into.

    A cell's place is the number of cells above it on its chain, counted by
    doubling, so that no task orders a whole reach.
    """
    own = reach.join(flow.select("cell", "nxt"), "cell")
    inside = own.join(reach.select(F.col("cell").alias("nxt"), F.col("reach").alias("next_reach")), "nxt", "left")
    chain = inside.select("cell", "reach", F.col("nxt").alias("down"), F.when(F.col("next_reach") == F.col("reach"), F.col("nxt")).alias("nxt"))
    chain = write_table(chain, "chain").df
    above = push(chain.select("cell", "nxt"), {"n": F.lit(1).cast("long")})
    return chain.join(above, "cell").select("reach", (F.col("n") - 1).alias("pos"), "cell", F.col("down").alias("nxt"))


def watersheds(flow: DataFrame, reach: DataFrame) -> DataFrame:
    """``cell, watershed``: the reach that each cell drains into first; cells that reach none have no row."""
    return basin_labels(flow, reach.select("cell", F.col("reach").alias("label"))).withColumnRenamed("label", "watershed")


def revise_lakes(rivers: DataFrame, water: DataFrame, width: int, max_rounds: int = 10_000) -> DataFrame:
    """Water cells ``cell`` after lakes have grown along rivers, to the least fixpoint.

    ``rivers`` holds ``cell, nxt`` of river cells.  A river cell becomes water
    if the next cell is water and so is a cell beside the step: beside the
    river cell for straight steps, at one of the two corners for diagonal ones.
    """
    d = F.col("nxt") - F.col("cell")
    vertical, level = F.abs(d) == width, F.abs(d) == 1
    x = F.col("cell") % width
    dx = F.when(F.pmod(d, F.lit(width)) == 1, 1).otherwise(-1)  # of a diagonal step
    one = F.when(vertical, F.when(x > 0, F.col("cell") - 1)).when(level, F.col("cell") - width).otherwise(F.col("cell") + dx)
    two = F.when(vertical, F.when(x < width - 1, F.col("cell") + 1)).when(level, F.col("cell") + width).otherwise(F.col("nxt") - dx)
    tests = rivers.where("nxt is not null").select("cell", "nxt", F.explode(F.array(one, two)).alias("beside")).where("beside is not null")
    tests = write_table(tests.join(water.select("cell"), "cell", "left_anti"), "tests").df
    tables = [write_table(water.select("cell").distinct(), "water")]
    for _ in range(max_rounds):
        fresh, state = tables[-1].df, read_tables(tables)
        # a new fact needs one new premise: the next cell or the cell beside
        touched = tests.join(fresh.select(F.col("cell").alias("nxt")), "nxt", "left_semi").unionByName(tests.join(fresh.select(F.col("cell").alias("beside")), "beside", "left_semi").select("nxt", "cell", "beside"))
        # all water, round after round, is dealt out to tasks and never sent to all of them by the driver
        held = lambda c: state.select(F.col("cell").alias(c)).hint("merge")  # noqa: B023, E731
        ready = touched.join(held("nxt"), "nxt", "left_semi").join(held("beside"), "beside", "left_semi")
        table = write_table(ready.select("cell").distinct().join(held("cell"), "cell", "left_anti"), "fresh", watch="true")
        if not table.watched:
            return state
        tables.append(table)
    raise RuntimeError(f"lakes did not settle in {max_rounds} rounds")


def recode_watersheds(flow: DataFrame, rivers: DataFrame, watershed: DataFrame, lakes: DataFrame | None = None) -> DataFrame:
    """``cell, watershed`` with one river chain in each: all but the longest chain of a watershed get new ids.

    ``rivers`` holds ``cell, acc``; heads claim the cells below them in order
    of (acc, cell), up to the first cell that is taken.  New ids follow the
    greatest one in use, in order of claim, and pass on to all cells that drain
    into the chain without crossing another river or lake cell.
    """
    own = write_table(flow.join(rivers.select("cell", "acc"), "cell"), "rivers").df
    claim = push(own, {"head": F.struct("acc", F.col("cell").alias("from_cell"))}, F.min)
    chains = claim.join(watershed, "cell").select("cell", "head", "watershed")
    size = write_table(chains.groupBy("watershed", "head").agg(F.count(F.lit(1)).alias("n")), "chains").df
    keep = size.groupBy("watershed").agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "head")).alias("k"))
    others = size.join(keep, "watershed").where(F.col("head") != F.col("k.head")).select("watershed", "head")
    top = watershed.agg(F.max("watershed")).first()[0] or 0
    ids = global_rank(others, F.col("head"), F.col("watershed"), name="place").select("watershed", "head", (F.col("place") + top).alias("new_id"))
    outlets = chains.join(ids, ["watershed", "head"], "left").select("cell", F.coalesce("new_id", F.lit(-1)).alias("label"))
    stops = outlets if lakes is None else outlets.unionByName(lakes.select("cell", F.lit(-1).cast("long").alias("label")).join(outlets, "cell", "left_anti"))
    moved = basin_labels(flow, stops).where("label >= 0")
    return watershed.join(moved, "cell", "left").select("cell", F.coalesce("label", "watershed").alias("watershed"))

