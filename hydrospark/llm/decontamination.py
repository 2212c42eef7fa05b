"""Benchmark decontamination on canonical templates.

Numbers, names and units become typed placeholders.  Windows of the template
are hashed and joined with those of the benchmark, and aligned windows are
extended to runs in which every slot is filled consistently, so a question
with other numbers or names in it is still found.  A capital at a sentence's
start may or may not be a name, so windows are hashed in both readings.
Windows with little beside slots, and items of one window, are also looked for
by their words, slots included.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.columns import free_name

#: Template tokens in a hashed window.
WINDOW = 8
#: A run of so many tokens, or the whole item if that is shorter, is a leak.
MIN_RUN = 13
#: Items of fewer tokens say too little to be looked for inside texts; they are found where they are the whole text.
MIN_ITEM = 4
#: Characters of benchmark texts that one pass holds in memory, as an index of some 100 MB; a larger benchmark is met in several passes.
BLOCK_CHARS = 8_000_000
#: Bits by which windows are looked up first.
TOP_BITS = 20
#: Distinct raw tokens that a worker remembers.
CACHE = 300_000

LITERAL, NUMBER, NAME, UNIT, NONE = 0, 1, 2, 3, 7
NAMED, ENDS, PLAIN = 8, 16, 32
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
DIGIT = re.compile(r"[0-9]")
NUMERIC = re.compile(r"[+-]?\d[\d.,:/-]*(?:st|nd|rd|th)?")
GLUED = re.compile(r"(?<=\d)(?=[^\W\d_])|(?<=[$€£%])(?=\d)")

# Words that are numbers, and words that are units after a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNIT_WORDS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters cent cents dollar dollars euro euros usd eur percent "
    "degree degrees celsius fahrenheit mph kph watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb".split()
)
# Words that are no names, wherever they stand.
PLAIN_WORDS = frozenset(
    "the an this that these those some any each every all both no not if when while after before since because although as at by for from in into of on to "
    "with without and or but so then there here it its he she they we you his her their our your my who whom whose what which where why how "
    "is are was were be been do does did has have had can could would should must".split()
)


class Tokens(dict):
    """Raw token -> its number; ``flags`` and ``code`` tell what each number is.

    Flags hold the kind, ``NAMED`` for one capital at the start, with ``PLAIN``
    if the word is none of a name, ``ENDS`` for the end of a sentence.
    """

    def __init__(self):
        super().__init__()
        self.reserve(CACHE)
        self.word: list[str] = []

    def reserve(self, n: int) -> None:
        """Room for n tokens; what is there stays."""
        flags, code = bytearray(n), array("Q", bytes(8 * n))
        if self:
            flags[: len(self.flags)], code[: len(self.code)] = self.flags, self.code
        self.flags, self.code = flags, code

    def __missing__(self, raw: str) -> int:
        n = len(self.word)
        if n == len(self.flags):
            self.reserve(2 * n)
        if raw.isalpha():
            core, ends = raw, 0
            low = raw.lower()
            kind = NUMBER if low in NUMBER_WORDS else LITERAL
        else:
            core = EDGE.sub("", raw)
            low = core.lower()
            ends = ENDS if raw[-1] in ".!?:;\x00" or raw.endswith(('."', '!"', '?"')) else 0
            kind = NONE if not core else NUMBER if low in NUMBER_WORDS or NUMERIC.fullmatch(core) else LITERAL
        if kind == LITERAL:
            self.code[n] = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"))
            if core != low and core[0].isupper() and core[1:] == low[1:] and len(core) > 1:
                ends |= NAMED | PLAIN if low in PLAIN_WORDS else NAMED
        else:
            self.code[n] = xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) if kind == NUMBER else 0
        self.flags[n] = kind | ends
        self.word.append(low)
        self[raw] = n
        return n

    def forget(self) -> None:
        """Start anew once too many tokens are known; numbers given before lose their meaning."""
        if len(self.word) > CACHE:
            self.clear()
            self.word = []


@dataclass
class Template:
    """Kind, hash and number of each template token.

    ``names`` is the other reading: its kinds and hashes, or None where it is
    the same.  ``plain`` hashes the words as they are.
    """

    kind: np.ndarray
    code: np.ndarray
    number: np.ndarray
    plain: np.ndarray
    names: tuple[np.ndarray, np.ndarray] | None


def template(text: str | None, cache: Tokens) -> Template:
    """Template tokens of a text; a null text has none.

    First reading: a capitalised word inside a sentence is a name, and a
    literal at a sentence's start.  Other reading: it is a name wherever it
    stands, unless it is one of ``PLAIN_WORDS``.  Words all in capitals are
    literals.
    """
    cache.forget()
    text = text or ""
    if DIGIT.search(text):
        text = GLUED.sub(" ", text)
    raw = text.replace("\n", " \x00 ").split()
    number = np.fromiter(map(cache.__getitem__, raw), dtype=np.int32, count=len(raw))
    flags = np.frombuffer(cache.flags, dtype=np.uint8)[number]
    code = np.frombuffer(cache.code, dtype=np.uint64)[number]
    kind = flags & 7
    named = flags & NAMED > 0
    other = named & (flags & PLAIN == 0)
    named[1:] &= flags[:-1] & ENDS == 0
    named[:1] = False
    units = [i + 1 for i in np.flatnonzero(kind[:-1] == NUMBER).tolist() if cache.word[number[i + 1]] in UNIT_WORDS]
    seen = kind != NONE

    def reading(named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, mixed = kind.copy(), code.copy()
        own[named] = NAME
        own[units] = UNIT
        slots = own > LITERAL
        mixed[slots] = own[slots]
        return own[seen], mixed[seen]

    first = reading(named)
    return Template(*first, number[seen], code[seen], reading(other) if (named != other).any() else None)


def window_hashes(kind: np.ndarray | None, code: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window; 0 where less than half of its tokens are literal, unless kinds are not given."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x100000001B3) + code[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    if kind is None:
        return mixed
    slots = kind != LITERAL
    if slots.any():
        filled = np.concatenate([[0], np.cumsum(slots)])
        mixed[(filled[size:] - filled[:-size]) > size // 2] = 0
    return mixed


class Windows:
    """Window hashes of one kind and, in the same order, the places ``item, at`` that hold them."""

    def __init__(self):
        self.hash, self.item, self.at = array("Q"), array("I"), array("I")

    def add(self, h: int, item: int, at: int) -> None:
        self.hash.append(h)
        self.item.append(item)
        self.at.append(at)

    def freeze(self) -> None:
        order = np.argsort(np.frombuffer(self.hash, dtype=np.uint64), kind="stable")
        self.hash, self.item, self.at = (np.frombuffer(x, dtype=t)[order] for x, t in ((self.hash, np.uint64), (self.item, np.uint32), (self.at, np.uint32)))
        self.seen = np.zeros(1 << TOP_BITS, dtype=bool)  # which values of a window's top bits occur at all
        self.seen[self.hash >> np.uint64(64 - TOP_BITS)] = True

    def places(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``at, item, item_at`` for each window of a text that is known."""
        likely = np.flatnonzero(self.seen[h >> np.uint64(64 - TOP_BITS)])
        if not len(likely):
            return
        low = np.searchsorted(self.hash, h[likely], "left")
        high = np.searchsorted(self.hash, h[likely], "right")
        for at, i, j in zip(likely[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for k in range(i, j):
                yield at, int(self.item[k]), int(self.at[k])


@dataclass
class Index:
    """Windows of one block of benchmark items, held in arrays: 16 bytes a window, and a reference and 2 bytes a token."""

    window: int
    items: list[tuple] = field(default_factory=list)  # (item_id, kind, words, whether a capital may be a name)
    windows: dict[tuple[int, bool], Windows] = field(default_factory=lambda: defaultdict(Windows))  # by (size, by words)
    short: dict[tuple[str, ...], list[int]] = field(default_factory=lambda: defaultdict(list))  # words of short items -> ids

    def add(self, item_id: int, text: str, cache: Tokens) -> None:
        found = template(text, cache)
        words = [cache.word[n] for n in found.number.tolist()]
        if len(words) < MIN_ITEM:
            if words:
                self.short[tuple(words)].append(item_id)
            return
        size = min(self.window, len(words))
        first = window_hashes(found.kind, found.code, size)
        other = window_hashes(*found.names, size) if found.names else first
        plain = window_hashes(None, found.plain, size).tolist()
        for at, pair in enumerate(zip(first.tolist(), other.tolist(), strict=True)):
            for h in dict.fromkeys(pair):
                if h:
                    self.windows[size, False].add(h, len(self.items), at)
            if not all(pair) or len(words) == size:
                self.windows[size, True].add(plain[at], len(self.items), at)
        maybe = (found.kind == LITERAL) & (found.names[0] == NAME) if found.names else np.zeros(len(words), dtype=bool)
        self.items.append((item_id, found.kind, words, maybe))

    def freeze(self) -> None:
        self.windows, self.short = dict(self.windows), dict(self.short)
        for known in self.windows.values():
            known.freeze()

    def leaks(self, text: str | None, cache: Tokens) -> list[tuple[int, int, int, int, int, int, bool]]:
        """``(item_id, run, item_tokens, doc_at, item_at, slots, changed)``: for each leaked item its longest run."""
        own = template(text, cache)
        if len(own.number) < MIN_ITEM:
            words = tuple(cache.word[n] for n in own.number.tolist())
            slots = int((own.kind != LITERAL).sum())
            return [(item_id, len(words), len(words), 0, 0, slots, False) for item_id in self.short.get(words, ())]
        lines: dict[tuple[int, int], set[int]] = defaultdict(set)  # (item, shift) -> item tokens covered
        for (size, by_words), known in self.windows.items():
            readings = [(None, own.plain)] if by_words else [(own.kind, own.code), own.names]
            for reading in filter(None, readings):
                for at, item, start in known.places(window_hashes(*reading, size)):
                    lines[item, at - start].update(range(start, start + size))
        if not lines:
            return []
        words = [cache.word[n] for n in own.number.tolist()]
        best: dict[int, tuple] = {}
        for (item, shift), covered in lines.items():
            item_id, item_kind, item_words, maybe = self.items[item]
            for start, stop, slots, changed in runs(sorted(covered), shift, item_kind, item_words, words, maybe):
                # equal words next to a run belong to it, however they were typed
                while start and start + shift and item_words[start - 1] == words[start + shift - 1]:
                    start -= 1
                while stop < len(item_words) and stop + shift < len(words) and item_words[stop] == words[stop + shift]:
                    stop += 1
                run = stop - start
                if run >= min(MIN_RUN, len(item_words)) and (item not in best or run > best[item][1]):
                    best[item] = (item_id, run, len(item_words), start + shift, start, slots, changed)
        return list(best.values())


def runs(
    covered: list[int], shift: int, kind: np.ndarray, item_words: list[str], doc_words: list[str], maybe: np.ndarray
) -> Iterator[tuple[int, int, int, bool]]:
    """Stretches of adjacent covered tokens in which equal slots of the item hold equal words of the text, and other slots other words.

    Where ``maybe`` is set a literal of the item that meets another word is taken for a name.
    """
    start = None
    there: dict = {}
    back: dict = {}
    changed, slots, last = False, 0, None
    for t in covered:
        mine, theirs, k = item_words[t], doc_words[t + shift], int(kind[t])
        if maybe[t] and mine != theirs:
            k = NAME
        agrees = k == LITERAL or (there.get((k, mine), theirs) == theirs and (k != NAME or back.get((k, theirs), mine) == mine))
        if start is None or t != last + 1 or not agrees:
            if start is not None:
                yield start, last + 1, slots, changed
            start, there, back, changed, slots = t, {}, {}, False, 0
        if k != LITERAL:
            there[k, mine], back[k, theirs] = theirs, mine
            slots += 1
            changed |= mine != theirs
        last = t
    if start is not None:
        yield start, last + 1, slots, changed


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes that together hold every benchmark item, each of about ``block_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        index, cache = Index(window), Tokens()
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect():
            index.add(row.item_id, row.text, cache)
        index.freeze()
        yield index


def leak_column(column, shared):
    """Leaks of one block as an array of structs for each text."""
    kind = "array<struct<item_id:bigint,matched_tokens:int,item_tokens:int,doc_token:int,item_token:int,slots:int,changed:boolean>>"

    @F.pandas_udf(kind)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, cache = shared.value, Tokens()
        names = ("item_id", "matched_tokens", "item_tokens", "doc_token", "item_token", "slots", "changed")
        for batch in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in index.leaks(text, cache)] for text in batch])

    return leaks(column)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` and benchmark item found in it, with the place and length of the longest consistent run.

    An item of ``MIN_ITEM`` tokens or more is found wherever a run of
    ``MIN_RUN`` tokens, or all of it, stands; a shorter one where it is the
    whole text.  Items and texts without tokens match nothing; an item with a
    null id is reported with a null; repeated rows are reported each; equal
    item ids with different texts are different items; an empty benchmark or
    table gives no rows.  Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    columns = ("item_id", "matched_tokens", "item_tokens", "doc_token", "item_token", "slots", "changed")
    found = None
    for index in benchmark_blocks(benchmark):
        rows = docs.select("doc_id", F.explode(leak_column(F.col("text"), sc.broadcast(index))).alias("leak"))
        rows = rows.select("doc_id", *(F.col(f"leak.{c}").alias(c) for c in columns))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        schema = "doc_id long, item_id long, matched_tokens int, item_tokens int, doc_token int, item_token int, slots int, changed boolean"
        return docs.sparkSession.createDataFrame([], schema)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_leaks`` finds no benchmark item; texts aren't shuffled.

    Null and empty texts and null ids stay; each of repeated rows is judged
    alike; an empty benchmark drops nothing.
    """
    sc = docs.sparkSession.sparkContext
    name = free_name(docs, "leaks")
    for index in benchmark_blocks(benchmark):
        docs = docs.withColumn(name, F.size(leak_column(F.col("text"), sc.broadcast(index)))).where(F.col(name) == 0).drop(name)
    return docs
