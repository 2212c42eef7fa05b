"""Hard-negative mining over inverted lists with stored radii.

Vectors are put into the lists of their nearest centroids, and each list keeps
its centroid and its radius.  By Cauchy and Schwarz no row of a list scores
above ``anchor . centroid + |anchor| * radius`` or below the same with a minus.
An anchor visits lists from the highest bound down, in rounds; it skips lists
that lie outside its score window and stops when a list's bound falls strictly
below the k-th score it holds, so the result is exact.  A round joins packed
blocks of anchors with packed pieces of the lists that any of them still
needs, and hands on only candidates that beat what is held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.storage import Table, write_table

# Units of a component, anchors, re-labelled rows, positives, negatives, and the window in hundredths.
UNITS = 256
ANCHORS = 100
MOVED = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
#: Lists, and the rows that centroids are fitted on, at most; every row is put into a list.
N_LISTS = 64
FIT_ROWS = 8192
FIT_ROUNDS = 8
#: Rows in a piece of a list, anchors in a block.
PIECE = 4096
BLOCK = 512
#: Lists that an anchor visits in its first rounds; the last round visits all that are left.
VISITS = (8,)
#: Added to bounds, which are floating-point numbers where scores are whole ones.
SLACK = 0.5


def prepared(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, dim, q``: rows that take part, labels moved where the id is divisible by 7, components as whole numbers packed in little-endian doubles."""

    def pack(batches):
        for b in batches:
            ids, labels, q, dims = [], [], [], []
            vectors = b.column(2)
            for i in range(b.num_rows):
                v = vectors[i].values
                if v.null_count:
                    continue
                x = np.floor(UNITS * v.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(b.column(0)[i]), labels.append(b.column(1)[i]), q.append(x.astype("<f8").tobytes()), dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(q, pa.binary())], ["vec_id", "label", "dim", "q"])

    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null")
    return rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), "embedding").mapInArrow(pack, "vec_id long, label long, dim int, q binary").distinct()


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Rows of equal length; shorter ones are filled up with zeros."""
    out = np.zeros((len(packed), dim))
    for i, b in enumerate(packed):
        x = np.frombuffer(b, dtype="<f8")
        out[i, : len(x)] = x
    return out


@dataclass
class Index:
    """``centroids`` and ``radii`` of the lists; ``pieces`` is a table of packed rows by list."""

    centroids: np.ndarray
    radii: np.ndarray
    pieces: DataFrame
    rows: Table


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; empty lists keep their centroid."""
    k = min(n_lists, len(sample))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def build_index(rows: Table, n_lists: int = N_LISTS, fit_rows: int = FIT_ROWS) -> Index:
    """Index of every row; centroids are fitted on at most ``fit_rows`` rows, those with the least hashes of their ids."""
    spark = rows.spark
    chosen = rows.df.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(fit_rows).select("q").collect()
    dim = rows.df.agg(F.max("dim")).first()[0] or 0
    if not chosen:
        return Index(np.zeros((0, dim)), np.zeros(0), spark.createDataFrame([], "list int, piece int, ids binary, labels binary, q binary"), rows)
    centroids = fit_centroids(matrix([r.q for r in chosen], dim), n_lists)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(2).to_pylist(), dim)
            near = nearest(x, centroids)
            away = np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)), pa.array(away)], ["vec_id", "label", "q", "list", "away"])

    placed = write_table(rows.df.select("vec_id", "label", "q").mapInArrow(assign, "vec_id long, label long, q binary, list int, away double"), "placed").df
    lists = placed.groupBy("list").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row for each list
    radii = np.full(len(centroids), -1.0)
    for r in lists:
        radii[r["list"]] = r["radius"]
    cuts = F.element_at(F.create_map(*(F.lit(v) for r in lists for v in (r["list"], -(-r["n"] // PIECE)))), F.col("list"))
    # the piece is drawn by row, so that a list of any size is cut evenly
    cut = placed.select("vec_id", "label", "q", "list", F.pmod(F.xxhash64("vec_id", "label", "q"), cuts).cast("int").alias("piece"))

    def pack(key, t):
        q = matrix(t.column("q").to_pylist(), dim).tobytes()
        ids, labels = (np.asarray(t.column(c)).astype("<i8").tobytes() for c in ("vec_id", "label"))
        return pa.table({"list": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "ids": [ids], "labels": [labels], "q": [q]}, schema=PIECES)

    pieces = write_table(cut.groupBy("list", "piece").applyInArrow(pack, "list int, piece int, ids binary, labels binary, q binary"), "lists").df
    return Index(centroids, radii, pieces, rows)


PIECES = pa.schema([("list", pa.int32()), ("piece", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())])


def wanted(state: DataFrame, index: Index, visit: tuple[int, int | None]) -> DataFrame:
    """``block, anchor, list`` of the lists that anchors visit in a round.

    ``state`` holds ``block, anchor, q, low, high, floor`` for each search:
    its window of scores and the k-th score held.  Lists go by their upper
    bound; a list is skipped below the window or above it, and all are left
    where the bound is strictly below ``floor``.
    """
    centroids, radii, (start, stop) = index.centroids, index.radii, visit

    def bounds(batches):
        for b in batches:
            x = matrix(b.column(2).to_pylist(), centroids.shape[1])
            low, high, floor = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            middle, reach = x @ centroids.T, np.sqrt((x**2).sum(axis=1))[:, None] * radii[None, :] * (1 + 1e-9) + SLACK
            upper, lower = middle + reach, middle - reach
            upper[:, radii < 0] = -np.inf
            place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
            keep = (upper >= np.maximum(low, floor)[:, None]) & (lower <= high[:, None]) & (place >= start) & (radii >= 0)
            if stop is not None:
                keep &= place < stop
            at, which = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(which.astype(np.int32))], ["block", "anchor", "list"])

    return state.select("block", "anchor", "q", "low", "high", "floor").mapInArrow(bounds, "block int, anchor int, list int").distinct()


def visit_lists(state: DataFrame, index: Index, same: bool, k: int, visit: tuple[int, int | None]) -> DataFrame:
    """``search, score, vec_id, label``: candidates of one round, at most the best ``k`` of a piece for each search.

    Blocks meet the pieces of the lists that any of their anchors wants.
    ``same`` asks for rows of the anchor's label other than the anchor, else
    for rows of other labels; scores lie in the search's window and at or
    above the k-th score held, so that ties are decided by id afterwards.
    """
    want = wanted(state, index, visit).groupBy("block", "list").agg(F.collect_set("anchor").alias("anchors"))  # at most BLOCK anchors
    own = state.groupBy("block", "anchor", "vec_id", "label", "q").agg(F.collect_list(F.struct("search", "low", "high", "floor")).alias("searches"))
    blocks = own.groupBy("block").agg(F.collect_list(F.struct("anchor", "vec_id", "label", "q", "searches")).alias("own"))
    dim = index.centroids.shape[1]

    def score(batches):
        for b in batches:
            for row in range(b.num_rows):
                anchors = set(b.column(0)[row].as_py())
                own = [x for x in b.column(1)[row].as_py() if x["anchor"] in anchors]
                ids, labels = (np.frombuffer(b.column(c)[row].as_py(), dtype="<i8") for c in (2, 3))
                rows = np.frombuffer(b.column(4)[row].as_py(), dtype="<f8").reshape(len(ids), dim)
                scores = matrix([x["q"] for x in own], dim) @ rows.T
                out: list[tuple] = []
                for x, s in zip(own, scores, strict=True):
                    fits = (labels == x["label"]) if same else (labels != x["label"])
                    for i in np.nonzero(ids == x["vec_id"])[0] if same else ():
                        fits[i] &= not np.array_equal(rows[i], matrix([x["q"]], dim)[0])
                    for y in x["searches"]:
                        at = np.nonzero(fits & (s >= max(y["low"], y["floor"])) & (s <= y["high"]))[0]
                        if len(at) > k:
                            at = at[np.lexsort((labels[at], ids[at], -s[at]))[:k]]
                        out += [(y["search"], s[i], ids[i], labels[i]) for i in at]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["search", "score", "vec_id", "label"])

    joined = want.join(blocks.hint("merge"), "block").join(index.pieces.select(F.col("list"), "ids", "labels", F.col("q").alias("rows")).hint("merge"), "list")
    return joined.select("anchors", "own", "ids", "labels", "rows").mapInArrow(score, "search long, score double, vec_id long, label long")


def best(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of each search with their ``rank``."""
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id", "label")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(searches: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """``search, rank, score, vec_id, label``: the first ``k`` rows of each search, exactly.

    ``searches`` holds ``search, block, anchor, vec_id, label, q, low, high``.
    """
    held: Table | None = None
    edges = [0, *np.cumsum(VISITS), None]
    for start, stop in zip(edges, edges[1:], strict=False):
        state = searches.withColumn("floor", F.lit(float("-inf")))
        if held is not None:
            floor = held.df.where(F.col("rank") == k).select("search", F.col("score").alias("held"))
            state = searches.join(floor, "search", "left").withColumn("floor", F.coalesce("held", F.lit(float("-inf")))).drop("held")
        found = visit_lists(state, index, same, k, (int(start), None if stop is None else int(stop)))
        every = found if held is None else found.unionByName(held.df.drop("rank"))
        table = write_table(best(every, k), "held")
        if held is not None:
            held.drop()
        held = table
    return held.df


def mine(embeddings: DataFrame, n_lists: int = N_LISTS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows whose id is divisible by 100.

    Positives are the best rows of the anchor's label, negatives the best rows
    of other labels whose score lies in the window that the positive's score
    sets; ties go to the smaller id.

    Rows with a null id, label or vector, or with any null or non-finite
    component, take no part.  Vectors may differ in length, the missing
    components being 0; an empty one scores 0.  Equal rows count once; rows
    that share an id and differ are rows of their own.  Scores are exact up to
    2**53.  An anchor without a row of its label, or without a row in the
    window, has no result.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = write_table(prepared(embeddings), "vectors")
    index = build_index(rows, n_lists, fit_rows)
    anchors = rows.df.where(F.col("vec_id") % ANCHORS == 0)
    n = anchors.count()
    blocks = max(1, -(-n // BLOCK))
    # blocks of about BLOCK anchors; the number within the block is free, so long as it is the anchor's own
    block = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)).cast("int")
    order = Window.partitionBy("block").orderBy("vec_id", "label", "q")
    own = anchors.withColumn("block", block).withColumn("anchor", F.row_number().over(order).cast("int"))
    own = write_table(own.withColumn("search", F.monotonically_increasing_id()), "anchors").df
    free = own.select("search", "block", "anchor", "vec_id", "label", "q", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    positives = top_k(free, index, True, POSITIVES)
    pairs = positives.select("search", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(own, "search").drop("search")
    pairs = write_table(pairs.withColumn("search", F.monotonically_increasing_id()), "pairs").df
    edge = lambda share: F.col("positive_score") * share / 100
    # the least and the greatest whole score in the window, found without rounding
    windows = pairs.select("search", "block", "anchor", "vec_id", "label", "q", F.ceil(edge(LOW)).cast("double").alias("low"), F.floor(edge(HIGH)).cast("double").alias("high"))
    negatives = top_k(windows.where("low <= high"), index, False, NEGATIVES)
    return negatives.join(pairs.select("search", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), "search").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("positive_score").cast("long").alias("positive_score"),
        F.col("score").cast("long").alias("negative_score"),
    )
