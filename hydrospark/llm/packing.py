"""Packing documents into sequences of a fixed number of tokens.

Documents are encoded and packed where they are read, in chunks of a bounded
number of tokens, so that ids are never shuffled: whole windows are cut from
long documents, a non-negative least squares fit says how often each shallow
combination of the remaining lengths should be used, and what rounding leaves
over is packed greedily.  What a chunk leaves short of a window goes into the
next one; what a task leaves is packed together with that of other tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.tokens import VOCABULARY, encoder
from hydrospark.storage import write_table

WINDOW = 2048
END_ID = 1
#: Tokens that are packed together, beside the document that passes the bound; a task holds their ids.
CHUNK_TOKENS = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(present: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns ``k, a, b`` of all mixes of k pieces of length a and at most one of length b that fill the window.

    ``b`` is 0 where k times a fills it alone.  At most two different lengths
    take part, so there are at most ``window * ln(window)`` mixes.
    """
    has = np.zeros(window + 1, dtype=bool)
    has[present] = True
    has[0] = True
    ks, parts, rest = [], [], []
    for a in present.tolist():
        k = np.arange(1, window // a + 1)
        b = window - k * a
        ok = has[b] & ((k > 1) | (b <= a))  # a pair of single pieces counts once
        ks.append(k[ok])
        parts.append(np.full(ok.sum(), a))
        rest.append(b[ok])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(ks), join(parts), join(rest)


def least_squares_counts(histogram: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that bring the pieces used close to the histogram, by accelerated projected gradient."""
    if not len(k):
        return np.zeros(0)
    size, h = len(histogram), histogram.astype(float)
    h[0] = 0
    two = (b > 0).astype(float)
    scale = 1 / np.sqrt(k * k + two)  # columns of unit norm
    ka, wb = k * scale, two * scale

    def used(x):
        return np.bincount(a, ka * x, size) + np.bincount(b, wb * x, size)

    v = np.ones(len(k))
    for _ in range(20):  # largest eigenvalue by powers
        r = used(v)
        v = ka * r[a] + wb * r[b]
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = np.zeros(len(k))
    t = 1.0
    for _ in range(steps):
        r = used(y) - h
        new = np.maximum(0, y - (ka * r[a] + wb * r[b]) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)`` that hold every token of every document once.

    All sequences but the last are full.  Documents are cut only into whole
    windows and where greedy packing finds no piece that fits a gap.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    stock: list[list[tuple[int, int]]] = [[] for _ in range(window)]  # by length: (document, start)
    for doc, n in enumerate(lengths):
        whole = n // window * window
        sequences += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            stock[n - whole].append((doc, whole))
    for same in stock:
        same.reverse()  # taken from the end, in order of document
    left = np.array([len(x) for x in stock])
    k, a, b = combinations(np.flatnonzero(left), window)
    x = least_squares_counts(left, k, a, b)
    for c in np.argsort(-x, kind="stable"):
        if x[c] < 0.5:
            break
        ka, la, lb = int(k[c]), int(a[c]), int(b[c])
        for _ in range(int(x[c] + 0.5)):
            if len(stock[la]) < ka + (la == lb) or (lb and not stock[lb]):
                break
            parts = [la] * ka + [lb] * (lb > 0)
            sequences.append([(*stock[n].pop(), n) for n in parts])
    mask = sum(1 << n for n in range(window) if stock[n])

    def take(n: int) -> tuple[int, int]:
        nonlocal mask
        item = stock[n].pop()
        if not stock[n]:
            mask &= ~(1 << n)
        return item

    while mask:
        row, gap = [], window
        while gap and mask:
            n = (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if n > 0:
                row.append((*take(n), n))
                gap -= n
            else:  # nothing fits: cut the longest
                n = mask.bit_length() - 1
                doc, start = take(n)
                row.append((doc, start, gap))
                stock[n - gap].append((doc, start + gap))
                mask |= 1 << (n - gap)
                gap = 0
        sequences.append(row)
    return sequences


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` chunk by chunk; ``ids`` are little-endian unsigned 32-bit integers.

    ``feed`` gives the record batches that are ready, ``close`` those of the
    last chunk.  Sequences are numbered from ``first``.  With ``last_open`` the
    pieces of the last sequence, if it isn't full, come out with their ids and
    without a sequence, to be packed elsewhere.
    """

    def __init__(self, window: int, first: int, with_ids: bool, last_open: bool, chunk_tokens: int):
        self.window, self.next, self.with_ids, self.last_open, self.chunk_tokens = window, first, with_ids, last_open, chunk_tokens
        self.rows: list[tuple] = []
        self.held = 0

    def feed(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> Iterator[pa.RecordBatch]:
        self.rows.append((doc_id, start, ids, doc_tokens))
        self.held += len(ids) // 4
        if self.held >= self.chunk_tokens:
            yield from self.pack(False)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.pack(True)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        rows, self.rows, self.held = self.rows, [], 0
        sequences = plan([len(ids) // 4 for _, _, ids, _ in rows], self.window)
        out = []
        for sequence in sequences:
            pieces = [(rows[d][0], rows[d][1] + at, rows[d][2][4 * at : 4 * (at + n)], rows[d][3]) for d, at, n in sequence]
            full = sum(n for _, _, n in sequence) == self.window
            if not full and not last:  # the next chunk fills it
                self.rows = pieces
                self.held = sum(len(x[2]) // 4 for x in pieces)
                continue
            is_open, offset = not full and self.last_open, 0
            for doc_id, start, ids, doc_tokens in pieces:
                place = (None, None) if is_open else (self.next, offset)
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, *place, ids if is_open or self.with_ids else None))
                offset += len(ids) // 4
            self.next += not is_open
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """One row per piece; see ``PIECES``, with ``ids`` (binary) too if asked for.

    Every input partition packs its own rows, so neither copies nor hot
    sources meet in one task, and a task holds about ``chunk_tokens`` ids.  The
    pieces are written once; those of each task's last sequence, under a
    window of tokens, are shuffled and packed in tasks of ``chunk_tokens``,
    each with at most one sequence that isn't full.  Every row is packed,
    repeated rows, null ids and null or empty texts (the end id alone)
    included; a document may be longer than a chunk.  An empty table gives no
    pieces.  Other columns are ignored.  ``sequence_id`` is the task and a
    number in it; bit 62 marks sequences of the second pass.
    """
    schema = PIECES + ", ids binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, end = encoder(vocabulary), np.uint32(end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 32, with_ids, True, chunk_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for doc_id, text in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                    ids = np.append(ids_of(text), end).astype("<u4").tobytes()
                    yield from packer.feed(doc_id, 0, ids, len(ids) // 4)
        yield from packer.close()

    def pack_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(window, (1 << 62) + (TaskContext.get().partitionId() << 32), with_ids, False, chunk_tokens)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from packer.feed(*row)
        yield from packer.close()

    out = write_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, schema), "pieces").df
    rest = out.where("sequence_id is null")
    tasks = max(1, -(-(rest.agg(F.sum("length")).first()[0] or 0) // chunk_tokens))
    again = rest.select("doc_id", "start", "ids", "doc_tokens").repartition(tasks).mapInArrow(pack_rest, schema)
    every = out.where("sequence_id is not null").unionByName(again)
    return every if with_ids else every.drop("ids")
