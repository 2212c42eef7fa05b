"""Secret scans with ownership frequency over the whole corpus.

Every text is searched once, where it is read.  Values that look like
credentials are named by a 128-bit digest, and the digests alone are counted
over the corpus: in how many repositories and by how many owners each is used.
A value that several owners use is an example that was copied; one that a
single owner uses and that looks random is taken for a live credential.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b, sha256
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.storage import Table, write_table

#: A value that more owners use is a copied example.
MAX_OWNERS = 1
#: Bits per character that a random value has at least; a key of 16 hex digits has about 3.
MIN_ENTROPY = 2.8
#: Texts of a batch that are searched before their rows are handed on.
CHUNK_ROWS = 256

# The kinds of the base scan in order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

# Public formats of credentials, after the base kinds in order.
FORMATS = {
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x20\t\r\n]*"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vendor": re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}"),
    "random": re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"),
}
ORDER = (*KINDS, *FORMATS)
SAMPLE_WORDS = re.compile(r"example|sample|dummy|changeme|placeholder|your_?|xxxx|test|1234567|abcdef", re.IGNORECASE)
FOUND = "array<struct<kind:string,start:long,end:long,key:string,odd:boolean>>"


def looks_random(value: str) -> bool:
    """No sample word, letters and digits, and many bits per character."""
    if SAMPLE_WORDS.search(value) or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return False
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


def mixed(value: str) -> bool:
    """Small and capital letters and digits, as in base 64."""
    return all(re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]"))


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of the base scan, leftmost and non-overlapping for each kind, by start and kind.

    A run of hex digits or an access key that is long enough is matched from
    its first character just as a pattern without a least length would; an
    assignment with too short a value is passed over as a whole.
    """
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def more_candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Spans of known formats and of random base 64 that touch neither the base scan nor each other; earlier formats first."""
    taken, found = [(start, end) for _, start, end, _ in base], []
    for kind, pattern in FORMATS.items():
        taken.sort()
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for m in pattern.finditer(text):
            if kind == "random" and not (mixed(m[0]) and looks_random(m[0])):
                continue
            before = bisect_left(starts, m.end())  # so many spans start before this one ends
            if not before or reach[before - 1] <= m.start():
                found.append((kind, m.start(), m.end(), m[0]))
        taken += [(s, e) for k, s, e, _ in found if k == kind]
    return found


def span_text(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def scan(docs: DataFrame, repository: str, owner: str) -> Table:
    """A written table, one row for each row of ``docs``: base counts and digest, and all that was found with its digest.

    ``row`` numbers the rows, so that repeated and null ids stay apart.
    """

    def search(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string()), ("odd", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                base, found = [], []
                for text in part.column(3).to_pylist():
                    text = text or ""
                    own = base_matches(text)
                    base.append(own)
                    found.append([
                        {"kind": k, "start": s, "end": e, "key": blake2b(v.encode("utf-8", "replace"), digest_size=16).hexdigest(), "odd": looks_random(v)}
                        for k, s, e, v in own + more_candidates(text, own)
                    ])
                counts = [pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in KINDS]
                digest = pa.array([sha256(span_text(own).encode()).hexdigest() for own in base], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), *counts, digest, pa.array(found, kind)],
                    ["doc_id", "repository", "owner", *(f"n_{k}" for k in KINDS), "base_sha256", "found"],
                )

    schema = f"doc_id long, repository string, owner string, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, found {FOUND}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), "text")
    return write_table(rows.mapInArrow(search, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(candidates: DataFrame) -> DataFrame:
    """``key, n_owners, n_repositories``; a null owner or repository counts as one.

    Uses are made distinct before they are counted, first by repository, then
    by owner, so a value that is everywhere is spread over its repositories
    until few rows are left of it.
    """
    uses = candidates.select("key", "owner", "repository").distinct()
    by_owner = uses.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("key").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def _ordered(spans: Column) -> Column:
    """Spans as text by start, then kind as listed."""
    rank = lambda kind: F.array_position(F.array(*(F.lit(k) for k in ORDER)), kind)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row for each row of ``docs``: what the base scan finds, and what use over the whole corpus says of it.

    ``spans`` holds every base span and, of the other candidates, those that
    are live.  ``live`` holds the live ones of either sort: values that look
    random and that at most ``max_owners`` owners use; ``n_copied`` counts
    those that look random but have more owners.  Positions are code points.

    A null or empty text has no spans, and texts are searched whole, however
    long.  Repeated rows count as one use of a value (they share repository
    and owner) and keep their rows; null ids keep theirs too.  Copies of a
    text at another owner make its values copied.  Ties in start go by kind.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = scan(docs, repository, owner).df
    each = rows.select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    uses = ownership(each)
    judged = each.where("odd").join(uses, "key").select("row", "kind", "start", "end", (F.col("n_owners") <= max_owners).alias("is_live"))
    spans = F.struct("kind", "start", "end")
    verdicts = judged.groupBy("row").agg(F.collect_list(F.when(F.col("is_live"), spans)).alias("live"), F.sum((~F.col("is_live")).cast("long")).alias("n_copied"))
    out = rows.select("row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    out = out.join(verdicts, "row", "left")
    live = F.coalesce("live", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS))
    return out.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        _ordered(F.array_union(base, live)).alias("spans"),
        _ordered(live).alias("live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
