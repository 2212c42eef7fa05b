"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering.

Texts with equal n-gram sets form a class and take part once.  N-grams are
ordered by how rare they are, counted over all texts in a hashed table of a
fixed size; a class shows only its rarest n-grams, its prefix, and two classes
meet where prefixes meet.  Length, positional and suffix filters drop pairs,
the rest is verified on the words themselves.

Large groups of near copies don't become all their pairs.  In the first round
every class is compared only with the class that holds a shared n-gram at the
lowest position, which for copies of one original is the original.  In the
second round only classes of different components still meet.  Pairs inside a
component are thus not verified for the components; ``find_links`` verifies
every pair that can link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.llm.columns import free_name
from hydrospark.operators.components import connected_components
from hydrospark.storage import drop_path, write_table, written

N = 5
#: Two texts link where PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Cells of the hashed count table, in blocks; 4 bytes each, whatever the corpus.
CELL_BITS = 20
BLOCKS = 64
#: Groups of tasks whose count tables are added up first.
FAN = 64
#: Ranges of the hash space in the suffix filter.
RANGES = 32
#: N-grams whose cell holds more than this many times the mean (and FLOOR) are spread over several tasks.
HOT_FACTOR, HOT_FLOOR = 4, 1000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Words of the text between ASCII blanks, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(found: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word windows; a shorter text is one window, an empty one has none."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    size = min(n, len(h))
    mixed = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + len(mixed)]) * _P
        mixed ^= mixed >> np.uint64(31)
    mixed *= _Q
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def class_id(sorted_hashes: np.ndarray) -> int:
    """64-bit name of an n-gram set; two different sets share one with a chance of about pairs / 2**64."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(sorted_hashes.tobytes()))))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_length(n, percent: int = PERCENT):
    """N-grams of which one at least is shared by any two linked sets of which one has n."""
    return n - (percent * n + 99) // 100 + 1


def keyed(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` written once with a number for each row in column ``row``, a name that it doesn't have yet."""
    return write_table(docs.withColumn(row, F.monotonically_increasing_id()), "texts").df


def describe(docs: DataFrame, row: str = "row", n: int = N) -> DataFrame:
    """One pass over all texts: a row ``row, doc_id, n_shingles, cid, ranges`` each, and per task the blocks ``block, part, counts`` of its count table."""
    schema = "row long, doc_id long, n_shingles long, cid long, ranges array<short>, block int, part int, counts binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, cid, ranges = [], [], []
                for text in part.column(2).to_pylist():
                    h = shingle_hashes(words(text), n)
                    size.append(len(h))
                    cid.append(class_id(h) if len(h) else None)
                    spread = np.bincount((h & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
                    ranges.append(np.minimum(spread, 32767).astype(np.int16) if len(h) else None)
                    np.add.at(table, _cells(h), 1)
                none = [None] * len(size)
                columns = [pa.array(c, t) for c, t in zip((size, cid, ranges, none, none, none), types[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)
        if table.any():
            none, task = [None] * BLOCKS, [TaskContext.get().partitionId()] * BLOCKS
            parts = [x.tobytes() for x in np.split(table, BLOCKS)]
            columns = (none, none, none, none, none, list(range(BLOCKS)), task, parts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def count_table(described: DataFrame) -> np.ndarray:
    """Sums of the tasks' count tables; 2**CELL_BITS cells reach the driver.

    They are added up in two levels, ``FAN`` groups of tasks first.  A task
    adds tables as they come and holds one sum for each key it has, so its
    memory doesn't grow with the number of tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block, part, counts = (c[at].as_py() for c in batch.columns)
                own = np.frombuffer(counts, dtype=np.uint32)
                held = total.setdefault((block, part), np.zeros(len(own), dtype=np.uint64))
                held += own
        for (block, part), held in total.items():
            capped = np.minimum(held, np.uint64(2**32 - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([capped.tobytes()], pa.binary())], ["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    own = described.where("block is not null").select("block", F.pmod("part", F.lit(FAN)).alias("part"), "counts")
    some = own.repartition("block", "part").mapInArrow(add, schema)
    every = some.select("block", F.lit(0).alias("part"), "counts").repartition("block").mapInArrow(add, schema)
    table = np.zeros((BLOCKS, (1 << CELL_BITS) // BLOCKS), dtype=np.uint32)
    for row in every.collect():
        table[row.block] = np.frombuffer(row.counts, dtype=np.uint32)
    return table.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``gram, salt, cid, size, pos``: the rarest n-grams of each class, each task showing a class once.

    ``pos`` is the n-gram's place among all of the class in order of (cell
    count, hash).  ``salt`` spreads n-grams of crowded cells: a cell's count
    bounds how many texts hold the n-gram.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    hot = int(max(HOT_FLOOR, HOT_FACTOR * float(counts.mean())))
    names = ["gram", "salt", "cid", "size", "pos"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made = []
                for text in batch.column(0).slice(at, 512).to_pylist():
                    h = shingle_hashes(words(text), n)
                    if not len(h):
                        continue
                    cid = class_id(h)
                    if cid in seen:
                        continue
                    seen.add(cid)
                    crowd = table[_cells(h)]
                    p = prefix_length(len(h), percent)
                    first = np.lexsort((h, crowd))[:p]
                    own = np.full(p, cid, dtype=np.int64)
                    salts = (crowd[first] // hot).astype(np.int64) + 1
                    salt = np.where(salts > 1, (cid & 0xFFFFFFFF) % salts, -1)
                    made.append((h[first].view(np.int64), salt, own, np.full(p, len(h)), np.arange(p)))
                if made:
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*made, strict=True)]
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)
                if len(seen) > 1_000_000:
                    seen.clear()

    return docs.select("text").mapInArrow(emit, "gram long, salt int, cid long, size int, pos int")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Prefix rows whose n-gram several classes show.

    Windows run over (gram, salt), which holds a bounded number of rows.  Rows
    of n-grams that are spread over several salts (``salt >= 0``; others have
    -1) all stay; sums over the n-gram settle them later.
    """
    w = Window.partitionBy("gram", "salt")
    mixed = F.min("cid").over(w) != F.max("cid").over(w)
    return rows.withColumn("mixed", mixed | (F.col("salt") >= 0)).where("mixed").select("gram", "salt", "cid", "size", "pos")


def spread(grams: DataFrame) -> DataFrame:
    """A row for each salt that a gram has, so that joins with prefix rows run on gram and salt; ``salts`` holds them."""
    return grams.withColumn("salt", F.explode("salts")).drop("salts")


def overlap_needed(a, b, percent: int):
    """Least intersection of linked sets of sizes a and b."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def may_link(na, pa_, nb, pb, percent: int):
    """Length filter, and positional filter at one shared n-gram: what is left behind it must hold the rest of the overlap.

    It is sound at the first shared n-gram of the two prefixes, at which
    nothing before is shared; a linked pair passes there.
    """
    length = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return length & (F.least(na - pa_, nb - pb) >= overlap_needed(na, nb, percent))


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose n-gram counts by hash range already differ too much."""
    one = lambda s: classes.select(F.col("cid").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("ranges").alias(f"r{s}"), F.col("row").alias(f"row_{s}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    room = F.col("na") + F.col("nb") - 2 * overlap_needed(F.col("na"), F.col("nb"), percent)
    return both.where(apart <= room).select("a", "b", "row_a", "row_b")


def verify(pairs: DataFrame, docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` that link, decided on the sets of word windows of one text each, those of ``row_a`` and ``row_b``.

    Pairs and the rows they need grow with the corpus, so texts meet them in
    merge joins, at every size; only texts that are needed take part in two.
    """
    kept = write_table(pairs, "pairs", watch="true")
    if not kept.watched:  # then no text need be read
        return kept.df.select("a", "b")
    pairs = kept.df.hint("merge")
    needed = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct().hint("merge")
    texts = write_table(docs.select("row", "text").join(needed, "row", "left_semi"), "representatives").df
    left = pairs.join(texts.select(F.col("row").alias("row_a"), F.col("text").alias("ta")), "row_a").hint("merge")
    both = left.join(texts.select(F.col("row").alias("row_b"), F.col("text").alias("tb")), "row_b")

    def grams(text):
        w = words(text)
        size = min(n, len(w))
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}

        def grams_of(cid: int, text: str) -> set:
            if cid not in known:
                if len(known) > 8:
                    known.clear()
                known[cid] = grams(text)
            return known[cid]

        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # texts become Python objects a few at a time
                part = batch.slice(at, 128)
                good = []
                for k, (a, b, ta, tb) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    x, y = grams_of(a, ta), grams_of(b, tb)
                    common = len(x & y)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(k)
                kept = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(decide, "a long, b long")


def prepare(docs: DataFrame, described: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The classes, ``cid, doc_id, row, n_shingles, ranges``, and the n-grams that several of them show, ``gram, salt, cid, size, pos``."""
    classes = described.where("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("ranges").alias("ranges")
    )
    classes = write_table(classes, "classes").df
    rows = prefixes(docs, count_table(described), n, percent)
    return classes, write_table(shared_prefixes(rows), "prefixes").df


def length_step(size, percent: int):
    """Number of the length range that a size lies in; linked sets lie in the same range or in neighbours."""
    if percent >= 100:
        return size
    return F.floor(F.log(size.cast("double")) / F.lit(log(100 / percent)) + F.lit(1e-9)).cast("int")


def link_classes(docs: DataFrame, described: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``cid, label, doc_id``: the component of every class, its least cid, and the least id of the class."""
    classes, shared = prepare(docs, described, n, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        before = written()
        links = write_table(verify(suffix_filter(pairs, classes, percent), docs, n, percent), "links")
        for path in written() - before - {links.path}:  # pairs and texts
            drop_path(docs.sparkSession, path)
        return links.df

    na, nb, pa_, pb = F.col("size"), F.col("size_b"), F.col("pos"), F.col("pos_b")
    heads = shared.groupBy("gram").agg(
        F.min(F.struct("pos", "cid", "size")).alias("h"), (F.min("cid") != F.max("cid")).alias("mixed"), F.collect_set("salt").alias("salts")
    )
    heads = spread(heads.where("mixed").select("gram", "salts", F.col("h.cid").alias("b"), F.col("h.size").alias("size_b"), F.col("h.pos").alias("pos_b")))
    met = shared.join(write_table(heads, "heads").df, ["gram", "salt"]).where((F.col("cid") != F.col("b")) & may_link(na, pa_, nb, pb, percent))
    tried = met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
    tried = write_table(tried, "tried").df
    labels = connected_components(verified(tried), "a", "b").select(F.col("node").alias("cid"), "label")

    # what still may link lies in different components
    marked = shared.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    marked = write_table(marked, "marked").df
    open_grams = marked.groupBy("gram").agg((F.min("label") != F.max("label")).alias("mixed"), F.collect_set("salt").alias("salts")).where("mixed")
    open_grams = write_table(spread(open_grams.select("gram", "salts")), "open").df
    rest = marked.join(open_grams, ["gram", "salt"], "left_semi").withColumn("step", length_step(na, percent))
    rest = write_table(rest.drop("salt"), "rest").df
    # a set meets those that are as long or longer, in its own range and the next
    longer = rest.select("gram", "step", F.col("cid").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"), F.col("label").alias("label_b"))
    shorter = rest.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    ordered = F.struct("size", "cid") < F.struct("size_b", "b")
    met = shorter.join(longer, ["gram", "step"]).where(ordered & (F.col("label") != F.col("label_b")) & may_link(na, pa_, nb, pb, percent))
    again = met.select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(again)
    if more.limit(1).count():
        # link the components that the second round joined
        end = lambda s: labels.select(F.col("cid").alias(s), F.col("label").alias(f"l{s}"))
        ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
        ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        top = write_table(connected_components(ends, "a", "b").select(F.col("node").alias("old"), F.col("label").alias("new")), "tops").df
    else:
        top = None
    every = classes.select("cid", "doc_id").join(labels, "cid", "left").select("cid", "doc_id", F.coalesce("label", "cid").alias("label"))
    if top is not None:
        every = every.join(top, every["label"] == top["old"], "left").select("cid", "doc_id", F.coalesce("new", "label").alias("label"))
    return every


def find_links(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_a, doc_b``: every verified link between texts of different n-gram sets, once, by the least id that has each set.

    A group of k near copies has up to k * (k - 1) / 2 links, and the result
    and its cost grow with them.  Rows with a null id take no part.
    """
    own = keyed(docs.select("doc_id", "text").where("doc_id is not null"), "row")
    described = write_table(describe(own, n=n), "described").df
    classes, shared = prepare(own, described, n, percent)
    other = shared.select("gram", F.col("cid").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    met = shared.drop("salt").join(other, "gram").where((F.col("cid") < F.col("b")) & may_link(F.col("size"), F.col("pos"), F.col("size_b"), F.col("pos_b"), percent))
    tried = write_table(met.select(F.col("cid").alias("a"), "b").distinct(), "tried").df
    links = verify(suffix_filter(tried, classes, percent), own, n, percent)
    one = lambda s: classes.select(F.col("cid").alias(s), F.col("doc_id").alias(f"d{s}"))
    named = links.join(one("a"), "a").join(one("b"), "b")
    return named.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))


def components_by_row(docs: DataFrame, row: str = "row", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, n_shingles, cid`` of every row, and ``cid, label, least`` of every class: its component and the least id in that."""
    own = docs.select(F.col(row).alias("row"), "doc_id", "text")
    described = write_table(describe(own, n=n), "described").df
    before = written()
    components = write_table(link_classes(own, described, n, percent), "components")
    for path in written() - before - {components.path}:  # what the search for links has left
        drop_path(docs.sparkSession, path)
    labels = components.df
    least = write_table(labels.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("classes")), "least").df
    alone = labels.join(least.where("classes > 1"), "label", "left").select("cid", "label", F.when(F.col("classes").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"))
    return described.where("block is null").select("row", "doc_id", "n_shingles", "cid"), write_table(alone, "labels").df


def join_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the least id that links reach.  A text without words,
    or a null one, links with nothing and is its own component.  A row with a
    null id links like any other; where no id is reached, ``component_id`` is
    null.  Rows of one id with different texts are rows of their own.
    Repeated rows come out each.  An empty table gives an empty result.  Other
    columns are ignored.

    The texts are written once with a row number, by which one text for each
    class is found again.  Components are settled on classes; rows meet their
    class last, in a join whose hot keys Spark can split.
    """
    rows, classes = components_by_row(keyed(docs.select("doc_id", "text"), "row"), "row", n, percent)
    return rows.join(classes.select("cid", "least"), "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of its least id, of equal ids the first.

    Rows are told apart by a number of their own, so an id that stands for
    different texts loses none of them.  Rows without words stay.  Null ids
    come after all others.  An empty table gives an empty result.
    """
    row = free_name(docs, "row_number")
    own = keyed(docs, row)
    rows, classes = components_by_row(own, row, n, percent)
    labelled = rows.where("cid is not null").join(classes.select("cid", "label"), "cid").select("row", "label", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row").alias("place"))
    labelled = write_table(labelled, "places").df
    first = write_table(labelled.groupBy("label").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "firsts").df
    gone = labelled.join(first.select("label", F.col("first.row").alias("first")), "label").where("row <> first").select(F.col("row").alias(row))
    return own.join(gone, row, "left_anti").drop(row)
