"""Results on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import exp, log, sqrt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hydrospark.llm import chat_format, decontamination, hashed_features, host_rules, length_histogram, ngram_join, packing, quality_classifier, sharding, tokens, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, slot string, label string, cid string, host string"
TABLES = Path("/root/testdata/sf0.01")
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(15_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z", "c", "h") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind."""
    r = random.Random(5)
    prose = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(80)) for _ in range(6)]
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "a"), (5, prose[0], "b"), (6, prose[0], "b"), (6, prose[0], "b"), (7, prose[1], None), (8, "one two", "b"), (9, "One  TWO", "c"), (None, prose[2], "c"), (None, None, None)]
    rows += [(20 + k, p, "b") for k, p in enumerate(prose[3:])] + [(40, prose[3] + " tail", "b")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_slots_keep_every_row_and_balance_bytes(odd, none):
    out = sharding.shard_documents(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.collect())
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out if r.doc_id)
    assert sharding.shard_documents(none).count() == 0


def test_shards_are_nearly_equal_and_the_map_is_stored(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, "x" * r.randrange(400), "s") for i in range(20_000)] + [(20_000 + i, "y" * 300, "s") for i in range(10_000)]
    path = f"file://{tmp_path}/slots"

    def load(out, n):
        held = Counter()
        for row in out:
            held[row.shard] += row.size
        assert len(held) == n
        return max(held.values()) - min(held.values())

    one = sharding.shard_documents(docs_of(spark, rows), map_path=path).collect()
    mean = sum(r.size for r in one) / 40
    assert load(one, 40) <= 0.001 * mean
    stored = sharding.SlotMap.load(spark, path)
    assert stored.version == 1 and all(r.map_version == 1 and stored.shard_of[r.virtual_slot] == r.shard for r in one)
    two = sharding.shard_documents(docs_of(spark, rows), n_shards=41, map_path=path).collect()
    assert load(two, 41) <= 0.001 * mean and {r.map_version for r in two} == {2}
    before = {r.doc_id: (r.shard, r.virtual_slot) for r in one}
    assert all(before[r.doc_id][1] == r.virtual_slot for r in two)
    assert sum(before[r.doc_id][0] != r.shard for r in two) < 0.1 * len(two)


def test_slot_map_moves_slots_only_as_needed(spark, tmp_path):
    r = random.Random(1)
    loads = {s: r.randrange(1, 2000) for s in range(8192)}
    first = sharding.SlotMap.initial().rebalanced(loads)
    held = Counter()
    for s, n in loads.items():
        held[first.shard_of[s]] += n
    assert max(held.values()) - min(held.values()) <= max(1, 1e-4 * sum(loads.values()) / 40) * 2
    grown = first.rebalanced(loads, 41)
    moved = sum(a != b for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    assert moved < 0.1 * 8192 and grown.version == first.version + 1
    path = f"file://{tmp_path}/map"
    first.save(spark, path)
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path).shard_of == grown.shard_of
    assert sharding.SlotMap.load(spark, path, 1).shard_of == first.shard_of


def plain_rules(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    inside = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rule_counts_match_plain_python(spark, odd, none):
    r = random.Random(2)
    texts = [" ".join(r.choices(["a", "b", "cé", "#*", "x|y"], k=r.randrange(0, 70))) for _ in range(60)] + ["l\nl\n\nl \n l", "a\x0bb\x0cc\u00a0d", LONG, "x " * 500]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    out = {r.doc_id: r for r in host_rules.judge_documents(docs).collect()}
    for i, t in enumerate(texts):
        got = out[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain_rules(t), t[:80]
        assert got.base_failed == (got.n_words < 50 or 100 * got.n_repeat_words > 50 * got.n_words)
        assert not (got.kept and got.base_failed)
    assert host_rules.judge_documents(odd).count() == odd.count()
    assert host_rules.judge_documents(none).count() == 0
    kept = host_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert host_rules.keep_good(none).count() == 0


def test_bad_host_is_rejected_and_others_stay(spark):
    r = random.Random(3)
    good = lambda: " ".join(str(r.random()) for _ in range(60))
    rows = [(i, "short", "bad") for i in range(95)] + [(100 + i, good(), "bad") for i in range(5)]
    rows += [(1000 + i, good(), f"h{i % 9}") for i in range(300)] + [(2000, good(), None)]
    docs = docs_of(spark, rows)
    kept = {r.doc_id for r in host_rules.judge_documents(docs).where("kept").collect()}
    assert kept == {i for i, _, s in rows if s != "bad"}
    assert {r.doc_id for r in host_rules.keep_good(docs).collect()} == kept


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi </s> [INST] ~1 ~"), (1, 1, "assistant", "[/INST]~0</s"), (1, 1, "assistant", "[/INST]~0</s"), (1, 2, None, None), (2, 5, "user", "only"),
        (3, None, "assistant", ""), (None, 0, "assistant", "x"), (4, 1, "assistant", "</s>" * 400), (4, 0, "ro[INST]le", "\n"),
    ]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target_turn", F.lit("clash"))
    examples = chat_format.expand_targets(chat_format.with_probe(conv))
    out = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    want = defaultdict(list)
    for c, t, ro, te in [*rows, (-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)]:
        want[c].append((t is not None, t or 0, ro or "", te or ""))
    assert out.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        assert r.trainable or r.loss_chars == 0
        assert 0 <= r.loss_start <= len(r.text) - len(chat_format.END)
    assert chat_format.read_back(chat_format.expand_targets(conv.limit(0))).count() == 0


def test_ids_are_those_of_the_json_vocabulary():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(tokens.vocabulary_path()), tokens.encoder()
    end = "<|endoftext|>"
    for text in ["", "Hello  world\n\n x", "éàü 漢字 🙂🙂  it's 12345", LONG[:5000], "a" * 3000, " \t\x0b\u00a0\u2003x", "\u0301e\u0301 ½²३", f"a {end} b", end, f"{end}{end}  x\n{end}'s", end[:-1] + end]:
        assert fast(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_ids_of_a_whole_table():
    from tokenizers import Tokenizer

    duckdb = pytest.importorskip("duckdb")
    plain, fast = Tokenizer.from_file(tokens.vocabulary_path()), tokens.encoder()
    texts = [x or "" for (x,) in duckdb.sql(f"SELECT text FROM '{TABLES}/documents.parquet'").fetchall()]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast(text).tolist() == want.ids


def test_packing_places_each_id_once(odd, none):
    out = packing.pack_documents(odd, with_ids=True, chunk_tokens=5000).collect()
    fast = tokens.encoder()
    want = Counter(([*fast(r.text).tolist(), 1].__str__(), r.doc_id) for r in odd.collect())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        ids = memoryview(bytes(r.ids)).cast("I").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, ids, r.doc_tokens))
    for s in sequences.values():
        s.sort()
        assert all(a == sum(n for _, n in s[:k]) for k, (a, _) in enumerate(s)) and sum(n for _, n in s) <= 2048
    for doc_id in {d for _, d in want if d is not None}:
        copies = sum(n for (_, d), n in want.items() if d == doc_id)
        got = Counter()
        for start, length, ids, _ in pieces[doc_id]:
            got.update((start + k, x) for k, x in enumerate(ids))
        text = next(t for t, d in want if d == doc_id)
        assert got == Counter({(k, x): copies for k, x in enumerate(map(int, text[1:-1].split(", ")))})
    assert packing.pack_documents(none).count() == 0
    whole = packing.pack_documents(odd.repartition(7)).collect()
    assert len({r.sequence_id for r in whole}) == -(-sum(r.length for r in whole) // 2048)  # at most one isn't full
    special = packing.pack_documents(docs_of(odd.sparkSession, [(1, "a <|endoftext|> b", "s")])).first()
    assert (special.doc_tokens, special.ids_crc32) == (5, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in (64, 220, 50256, 275, 1))))


def test_plan_wastes_little():
    r = random.Random(4)
    for top, n in ((200, 3000), (2047, 800), (9000, 500), (1, 5000)):
        lengths = [r.randrange(1, top + 1) for _ in range(n)]
        plan = packing.plan(lengths)
        assert all(sum(x for *_, x in s) == 2048 for s in plan[:-1])
        seen = defaultdict(list)
        for s in plan:
            for d, start, length in s:
                seen[d].append((start, length))
        for d, n_tokens in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[d]):
                assert start == at
                at += length
            assert at == n_tokens
    assert packing.plan([]) == []


def test_least_squares_finds_an_exact_mix():
    import numpy as np

    histogram = np.zeros(2048)
    histogram[[1500, 548, 1024]] = 30, 30, 10
    k, a, b = packing.combinations(np.flatnonzero(histogram), 2048)
    x = packing.least_squares_counts(histogram, k, a, b)
    used = Counter()
    for n, i, j, c in zip(k, a, b, x, strict=True):
        used[int(i)] += n * c
        used[int(j)] += c * (j > 0)
    assert abs(used[1500] - 30) < 0.5 and abs(used[548] - 30) < 0.5 and abs(used[1024] - 10) < 0.5


def test_length_totals_match_brute_force(spark, odd, none):
    totals = length_histogram.length_totals(length_histogram.length_histogram(odd))
    fast = tokens.encoder()
    n = [len(fast(r.text)) for r in odd.collect()]
    got = {r.length: r for r in totals.collect()}
    assert got.keys() == set(n)
    for k, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.docs_to, r.truncated_total) == (sum(x <= k for x in n), sum(min(x, k) for x in n))
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
    for limit in (0, 1, 50, 10**6):
        r = length_histogram.answer(totals, limit).first()
        assert (r.docs_cut, r.truncated_total) == (sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert length_histogram.quantile(totals, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    assert length_histogram.length_totals(length_histogram.length_histogram(none)).count() == 0


def plain_components(rows, percent=80):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = ngram_join.words(t)
        size = min(5, len(w))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    ids = defaultdict(list)
    for i in sets:
        ids[root(i)].append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs(spark, seed):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [str(r.randrange(400)) for _ in range(r.randrange(3, 90))]
        for _ in range(r.choice([1, 2, 2, 12])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                own[r.randrange(len(own))] = str(r.randrange(400, 2000))
            rows.append((n, " ".join(own)))
            n += 1
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(n + k, shared + f" own{k} more{k}") for k in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "One two"), (n + 43, "one  TWO")]
    r.shuffle(rows)
    rows.append(rows[0])
    got = Counter(map(tuple, ngram_join.join_components(docs_of(spark, [(*x, "s") for x in rows])).collect()))
    assert got == plain_components(rows)


def test_join_on_odd_rows(odd, none):
    got = Counter(map(tuple, ngram_join.join_components(odd).collect()))
    assert got == plain_components([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.join_components(none).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8, 20, 21, 22] and ids.count(None) == 2


def test_one_row_of_each_group_stays_whatever_its_id(spark, none):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, text["a"], "s"), (1, text["b"], "s"), (2, text["c"], "s")]
    assert ngram_join.keep_one(docs_of(spark, rows)).count() == 3
    rows += [(2, text["b"] + " end", "s"), (3, text["a"].upper(), "s"), (None, text["d"], "s"), (None, text["d"] + " end", "s"), (None, text["c"], "s"), (4, None, "s"), (4, "", "s"), (5, text["e"], "s"), (5, text["e"], "s"), (0, text["f"] + " end", "s"), (1, text["f"], "s")]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs_of(spark, rows)).collect()]
    want = [(1, text["a"]), (1, text["b"]), (2, text["c"]), (4, None), (4, ""), (5, text["e"]), (0, text["f"] + " end")]
    assert Counter(kept) - Counter([(None, text["d"]), (None, text["d"] + " end")]) == Counter(want) and len(kept) == len(want) + 1
    got = Counter(map(tuple, ngram_join.join_components(docs_of(spark, rows)).collect()))
    assert got == plain_components([r[:2] for r in rows])
    assert ngram_join.keep_one(none).count() == 0


def test_lengths_of_linked_sets_are_neighbours():
    step = lambda n, p: int(log(n) / log(100 / p) + 1e-9)
    for percent in (50, 80, 90):
        for a in range(1, 400):
            b = a * 100 // percent
            assert step(b, percent) in (step(a, percent), step(a, percent) + 1)


def test_leaks_with_other_slots(spark, none):
    item = "Anna bought 12 apples for 3 dollars and Anna then sold 5 of the apples to a friend in town."
    bench = spark.createDataFrame([(7, item), (8, "short one item here"), (9, None), (None, "x"), (10, "")], "item_id long, text string")
    filler = " ".join(f"filler{i} plain text." for i in range(40))
    texts = {
        1: f"{filler} {item} {filler}",
        2: f"{filler} so Peter bought 40 apples for 9 euros and Peter then sold 2 of the apples to a friend in town. {filler}",
        3: f"{filler} so Peter bought 40 apples for 9 euros and Maria went",
        4: filler,
        5: None,
        6: "",
        7: "a short one, item, HERE!",
        8: item.upper().replace(" ", "!! "),
        9: LONG,
        10: "In town a friend of mine sold apples and then bought some for dollars",
    }
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()] + [(1, texts[1], "s")])
    found = decontamination.find_leaks(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(1, 7): 2, (2, 7): 1, (7, 8): 1, (8, 7): 1})
    assert {r.doc_id for r in found if r.changed} == {2}
    kept = decontamination.drop_leaked(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9, 10] and kept.columns == docs.columns
    assert decontamination.find_leaks(none, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_leaked(docs, bench.limit(0)).count() == docs.count()


def test_inconsistent_slots_are_no_leak():
    index, cache = decontamination.Index(8), decontamination.Tokens()
    index.add(1, "Give 3 to them and 3 to us and 3 to me and 3 to you all.", cache)
    index.freeze()
    assert index.leaks("Give 5 to them and 5 to us and 5 to me and 5 to you all.", cache)
    assert not index.leaks("Give 5 to them and 6 to us and 7 to me and 8 to you all.", cache)


def leaks_of(items, text):
    index, cache = decontamination.Index(8), decontamination.Tokens()
    for i, item in enumerate(items):
        index.add(i, item, cache)
    index.freeze()
    return {x[0]: x[1:3] for x in index.leaks(text, cache)}


def test_names_at_sentence_starts_are_slots():
    item = "Anna has 5 red apples. Anna buys 3 more apples. How many apples does Anna have now?"
    other = item.replace("Anna", "Peter").replace("5", "7").replace("3", "2")
    filler = "some plain text stands here."
    assert leaks_of([item], f"{filler} {other} {filler}") == {0: (17, 17)}
    assert leaks_of([item], f"{filler} {item} {filler}") == {0: (17, 17)}
    assert leaks_of([item], f"{filler} {item.lower()} {filler}") == {0: (17, 17)}
    assert not leaks_of([item], other.replace("Peter buys", "Maria buys"))
    assert leaks_of(["Anna walks along the long river until noon."], f"{filler} Peter walks along the long river until noon.") == {0: (8, 8)}
    assert not leaks_of(["The owner walks along the long river."], f"{filler} Peter owner walks along the long river.")


SLOTTED = ["Solve 3x + 5 = 20", "Compute 12 * 7 + 5", "Sort 9, 4, 7, 1, 3, 8, 2, 6, 5, 10 in order", "What is 15% of 80?", "Paris London Rome 5 km 3 Madrid 2 days 7"]


@pytest.mark.parametrize("item", SLOTTED)
def test_verbatim_items_full_of_slots_are_found(item):
    for before in ("", "- ", "1) ", "plain words stand here ", "plain words stand here. "):
        assert leaks_of(SLOTTED, f"{before}{item}\nMore words follow.").keys() == {SLOTTED.index(item)}, before
    assert not leaks_of(["Solve 3x + 5 = 20", "Sort 9, 4, 7, 1, 3, 8, 2, 6, 5, 10 in order"], "Solve 3x + 6 = 20 and Sort 9, 4, 7, 1, 3, 8, 2, 6, 5, 11 in order")


def test_short_items_are_found_as_whole_texts():
    items = ["What is 7?", "Yes", "Anna sold 5 books to 4 friends"]
    assert leaks_of(items, "what is 7 ?").keys() == {0}
    assert leaks_of(items, "YES!").keys() == {1}
    assert not leaks_of(items, "What is 8?") and not leaks_of(items, "Yes it is") and not leaks_of(items, "") and not leaks_of(["", "..."], "")
    assert leaks_of(items, "Peter sold 7 books to 9 friends").keys() == {2}


def test_every_item_of_a_table_is_found_verbatim_and_reparameterised():
    """Items of all shapes, among them each template filled anew: verbatim copies all come back, new ones nearly all."""
    r = random.Random(12)
    names, things, places, units = "Anna Peter Maria Oskar Lena Viktor".split(), "apples books coins letters maps".split(), "town harbour forest school".split(), "km miles hours kg".split()
    shapes = [
        "{n} has {i} {t} and buys {j} more {t} in the {p}. How many {t} does {n} have now?",
        "A train needs {i} {u} to the {p} while {n} walks {j} {u} with {t}. What is left of them at last?",
        "{n} paid {m} {i} dollars for {j} {t} .",
        "What is {i} + {j} - 7 * {k} ?",
        "Solve {i}x + {j} = {k}",
        "{n} and {m} share {i} {t} at the {p}, {n} takes {j} of them and {m} gets the rest of all {t}.",
    ]

    def fill(shape, t, p, u):
        n, m = r.sample(names, 2)
        i, j, k = r.sample(range(2, 99), 3)
        return shape.format(n=n, m=m, i=i, j=j, k=k, t=t, p=p, u=u)

    items, again = [], []
    for at in range(240):
        shape, words = shapes[at % len(shapes)], (r.choice(things), r.choice(places), r.choice(units))
        items.append(fill(shape, *words))
        again.append(fill(shape, *words))
    index, cache = decontamination.Index(8), decontamination.Tokens()
    for at, item in enumerate(items):
        index.add(at, item, cache)
    index.freeze()
    filler = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30)) + "."
    for at, item in enumerate(items):
        assert at in {x[0] for x in index.leaks(f"{filler()} {item} {filler()}", cache)}, item
    long = [at for at in range(240) if shapes[at % len(shapes)][0] in "{A" and len(items[at].split()) >= 13]
    found = [at in {x[0] for x in index.leaks(f"{filler()} {again[at]} {filler()}", cache)} for at in long]
    assert len(long) > 100 and sum(found) >= 0.9 * len(found)
    assert not any(index.leaks(f"{filler()} {filler()}", cache) for _ in range(200))


def test_items_without_an_id_are_found(spark):
    bench = spark.createDataFrame([(None, SLOTTED[0]), (1, SLOTTED[1])], "item_id long, text string")
    docs = docs_of(spark, [(1, f"so {SLOTTED[0]} holds", "s"), (2, "nothing of it", "s")])
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()] == [(1, None)]
    assert [r.doc_id for r in decontamination.drop_leaked(docs, bench).collect()] == [2]


def test_block_by_block_finds_the_same(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    one = sum(len(b.items) for b in decontamination.benchmark_blocks(bench))
    many = list(decontamination.benchmark_blocks(bench, block_chars=500))
    assert len(many) > 5 and one == sum(len(b.items) for b in many) == 30


def labelled(spark, n=600):
    r = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        junk, toxic = r.random() < 0.3, r.random() < 0.3
        w = [r.choice(["red", "green", "blue", "sun", "moon", "women", "men"]) for _ in range(40)]
        if toxic:
            w[r.randrange(40)] = "scum" + r.choice(["", "bag", "my"])
        rows.append((i, " ".join(x + ("!!" if junk else "") for x in w), "s"))
        marks.append((i, int(not junk), int(toxic), "t"))
    marks += [(None, 1, 1, "t"), (10**6, 1, 1, "t"), (3, None, None, "t")]
    return docs_of(spark, [*rows, (2000, None, None), (2001, "", "s"), (2002, LONG, "s"), (None, "x", "s"), (5, "again", "s")]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")


def test_classifiers_on_held_out_rows(spark, none):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    for fit, score, column, mod, rest in (
        (quality_classifier.fit_quality, quality_classifier.score_quality, "quality", 5, 0),
        (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic", 4, 2),
    ):
        out = score(docs, fit(docs, labels)).collect()
        assert len(out) == docs.count()
        held = [r for r in out if r.held_out and r.doc_id in truth]
        assert len(held) > 50 and sum(r.predicted == truth[r.doc_id][column] for r in held) >= 0.95 * len(held)
        for r in out:
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
            assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % mod == rest)
        assert fit(docs, labels).weight.tolist() == fit(docs, labels).weight.tolist()
        assert score(none, fit(docs, labels)).count() == 0
        assert score(docs, fit(docs, labels.limit(0))).count() == docs.count()
    kept = quality_classifier.keep_quality(docs, quality_classifier.fit_quality(docs, labels))
    assert kept.columns == docs.columns


def plain_ftrl(samples, alpha, l1, l2=0.0, epochs=3, beta=1.0, pair_penalty=0.0):
    """Follow the regularised leader, one coordinate at a time; the intercept has no l1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        bound = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= bound else -(z[i] - (bound if z[i] > 0 else -bound)) / ((beta + sqrt(n[i])) / alpha + l2 * (i != "bias"))

    def learn(gradients):
        for i, (w, g) in gradients.items():
            z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / alpha * w
            n[i] += g * g

    for _ in range(epochs):
        for y, indexes, values in samples:
            own = {"bias": 1.0} | dict(zip(indexes[0].tolist(), values[0].tolist(), strict=True))
            w = {i: weight(i) for i in own}
            off = 1 / (1 + exp(-sum(w[i] * own[i] for i in own))) - y
            learn({i: (w[i], off * own[i]) for i in own})
            for i, v in zip(indexes[1:], values[1:], strict=True):
                change = dict(zip(i.tolist(), v.tolist(), strict=True)) if pair_penalty else {}
                w = {i: weight(i) for i in change}
                shift = sum(w[i] * change[i] for i in change)
                if shift:  # an implicit step: what is left of the shift is what a full step would leave
                    reach = sum(change[i] ** 2 * alpha / (beta + sqrt(n[i])) for i in change)
                    learn({i: (w[i], 2 * pair_penalty * shift / (1 + 2 * pair_penalty * reach) * change[i]) for i in change})
    return {i: weight(i) for i in z}


@pytest.mark.parametrize("penalty", [0.0, 1.5])
def test_fit_matches_plain_python(penalty):
    from hydrospark.llm.logistic import fit

    r = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["women", "men", "muslim", "deaf"]
    samples = []
    for _ in range(150):
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))
        made = toxicity.with_counterfactuals(text) if penalty else [quality_classifier.features(text)]
        samples.append((int(("w1 " in text) != (r.random() < 0.1)), [i for i, _ in made], [v for _, v in made]))
    model = fit(samples, 20, alpha=0.7, l1=0.2, pair_penalty=penalty)
    want = plain_ftrl(samples, 0.7, 0.2, pair_penalty=penalty)
    assert model.pairs == (sum(len(s[1]) - 1 for s in samples) if penalty else 0)
    assert abs(model.bias - want.pop("bias")) < 1e-5
    got = model.dense()
    assert len(model.index) > 20 and all(abs(got[i] - w) < 1e-4 for i, w in want.items()) and set(model.index.tolist()) <= want.keys()


def test_quality_features_are_ngrams():
    plain = Counter()
    text = "a b a b b, c"
    found = [x.decode() for x in hashed_features.tokens(text)]
    assert found == ["a", "b", "a", "b", "b", ",", "c"]
    for k, w in enumerate(found):
        plain[w] += 1
        if k:
            plain[found[k - 1], w] += 1
            plain["same pair"] += found[k - 1] == w
        if k > 1:
            plain["same around"] += found[k - 2] == w
    plain = +plain
    index, value = quality_classifier.features(text)
    norm = sqrt(sum((1 + log(c)) ** 2 for c in plain.values()))
    assert len(index) == len(plain) and sorted(round(float(v), 5) for v in value) == sorted(round((1 + log(c)) / norm, 5) for c in plain.values())
    assert len(quality_classifier.features(None)[0]) == len(quality_classifier.features(" \n")[0]) == 0


def test_counterfactual_pairs_differ_in_a_term_only():
    words = "the women and the deaf man walk".split()
    pairs = toxicity.counterfactual_pairs(words)
    assert [(one, " ".join(two)) for one, two in pairs] == [
        (words, "the people and the local person walk"),
        (words, "the men and the autistic woman walk"),
        (words, "the people and the disabled person walk"),
    ]
    for text in ("plain words only", "", None):
        ((one, two),) = toxicity.counterfactual_pairs(toxicity.word_list(text))
        (at,) = [k for k, (a, b) in enumerate(zip(one, two, strict=True)) if a != b]
        assert any(one[at] in terms and two[at] in terms for terms in toxicity.IDENTITY_TERMS)
        assert one[:at] + one[at + 1 :] == toxicity.word_list(text)
    own, (moved, change) = toxicity.with_counterfactuals("plain words only")
    ((one, two),) = toxicity.counterfactual_pairs(["plain", "words", "only"])
    i, j = (set(toxicity.word_features(x)[0].tolist()) for x in (one, two))
    assert set(moved.tolist()) == i ^ j and all((c == 1) == (m in i) for m, c in zip(moved.tolist(), change.tolist(), strict=True))


def test_neutral_mentions_of_groups_keep_their_score(spark):
    """Toxic sentences mostly name one group; without the penalty its name alone counts, with it hardly."""
    r = random.Random(6)
    plain = "red green blue sun moon river field stone bird tree".split()
    rows, marks = [], []
    for i in range(1500):
        toxic = r.random() < 0.4
        w = [r.choice(plain) for _ in range(12)]
        w[3] = r.choice(["muslims"] * 4 + ["christians"]) if toxic else r.choice(["christians", "people", "people", "jews", "muslims"])
        if toxic:
            w[7] = r.choice(["scum", "vermin", "filth"]) if r.random() < 0.8 else w[7]
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(toxic)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    moved = {}
    for penalty in (0.0, 4.0):
        model = toxicity.fit_toxicity(docs, labels, penalty=penalty)
        weight, worst = model.dense(), 0.0
        for _ in range(50):
            w = [r.choice(plain) for _ in range(12)]
            scores = []
            for term in ("muslims", "christians", "jews", "hindus", "people"):
                i, v = toxicity.word_features([*w, term])
                scores.append(1 / (1 + exp(-(float(weight[i] @ v) + model.bias))))
            worst = max(worst, max(scores) - min(scores))
        moved[penalty] = worst
        assert (model.pairs > 1000) == (penalty > 0)
        truth = dict((i, t) for i, _, t in marks)
        held = [x for x in toxicity.score_toxicity(docs.where("text rlike 'scum|vermin|filth'"), model).collect() if x.held_out]
        assert len(held) > 50 and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert moved[4.0] < 0.05 and moved[4.0] < 0.25 * moved[0.0]


def test_scores_of_the_tables_hardly_move_with_identity_terms(spark):
    if not TABLES.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{TABLES}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.pairs > 100
    weight = model.dense()
    for row in docs.join(labels.where("toxic = 0"), "doc_id").limit(100).collect():
        words = toxicity.word_list(row.text)
        for terms in toxicity.IDENTITY_TERMS:
            lines = []
            for term in terms:
                i, v = toxicity.word_features([*words, term])
                lines.append(1 / (1 + exp(-(float(weight[i] @ v) + model.bias))))
            assert max(lines) - min(lines) < 0.02


def test_urls(spark):
    urls = ["http://A.b.com/x?y#z", "https://www.example.com/en/1", "http://example.com/en/2", "http://m.example.com/en/", "http://x.net/es/1", "net://net/fr/", "http://x.com", None, "", "no url", "http://notexample.com/en/", "http://freebets.example.org/win", "ftp://É.org#f://b/", "http://x.org/" + "a" * 5000, "http://dailynews.example.org/science", "x://" * 3]
    pages = spark.createDataFrame([(i, u, "h", "w") for i, u in enumerate(urls)] + [(0, urls[0], None, None)], "page_id long, url string, host string, words string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert url_filter.judge_urls(pages).count() == len(urls) + 1
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)
        cut = __import__("re").match(r"([^/?#]*)([^?#]*)", rest[1], 16) if len(rest) > 1 else None
        host = cut[1].translate(str.maketrans(*url_filter.ASCII)) if cut else ""
        path = cut[2] if cut else ""
        fits = [(a + p, v) for v, a, p in url_filter.RULES if (host == a or host.endswith("." + a)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule[0]), u
        assert rule[1] in (None, out[i].verdict)
    assert (out[9].verdict, out[9].score, out[9].evidence, out[9].words) == ("allow", 0.0, 0, [])
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def all_splits(name):
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in all_splits(name[k:]):
            yield [name[:k], *rest]


def cost_of(split, cost, unknown):
    """Of one split: a word has its own cost if it is known, neighbouring unknown pieces count as one."""
    return sum(cost.get(w, unknown + len(w) * log(26)) for w in split)


def test_split_is_the_cheapest_of_all():
    r = random.Random(4)
    for _ in range(60):
        counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))): r.randrange(1, 50) for _ in range(6)}
        total = sum(counts.values())
        cost = {w: log(total / n) for w, n in counts.items()}
        name = "".join(r.choice("abc") for _ in range(r.randrange(1, 10)))
        got = url_filter.split_name(name, cost, log(total))
        assert "".join(got) == name
        assert abs(cost_of(got, cost, log(total)) - min(cost_of(x, cost, log(total)) for x in all_splits(name))) < 1e-9
    assert url_filter.split_name("abc", {}, 0.0) == ["abc"] and url_filter.split_name("", {}, 1.0) == []


def test_words_of_any_length_are_known_to_the_segmenter(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    html = f"<p class='casinobonus'>casino bonus casino bonus win</p><script>casinobonus casinobonus</script> {long} {long}z zq " + "of the " * 50
    urls = ["http://casinobonuswin.org/zqof", f"http://{long}casino.org/{long[:30]}", "http://thezzzzxxxxjof.org/"]
    pages = spark.createDataFrame([(i, u, html if i == 0 else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = {r.page_id: r.words for r in url_filter.judge_urls(pages).collect()}
    assert out[0] == ["casino", "bonus", "win", "org", "zq", "of"]
    assert out[1][:2] == [long, "casino"]
    assert out[2] == ["the", "zzzzxxxxj", "of", "org"]
    assert {r.word: r.n for r in url_filter.word_counts(pages).collect()}["casino"] == 2


def plain_urls(pages, rules=url_filter.RULES):
    """Rule, words, score and verdict of every page in plain Python."""
    import re

    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ", html or "")
        counts.update(re.findall(r"[^\W\d_]+", text.lower()))
    total = sum(counts.values()) or 1
    cost = {w: log(total / n) for w, n in counts.items()}
    named = {w for _, h, p in rules for w in re.findall("[a-z]+", h + p)}

    def viterbi(name, memo={}):  # noqa: B006
        if not name:
            return 0.0, ()
        if name not in memo:
            ways = []
            for k in range(1, len(name) + 1):
                c, rest = viterbi(name[k:])
                ways.append((cost.get(name[:k], log(total) + k * log(26)) + c, (name[:k], *rest)))
            memo[name] = min(ways, key=lambda x: (round(x[0], 9), len(x[1])))
        return memo[name]

    seen, words = [Counter(), Counter()], {}
    judged = {}
    for page, url, _ in pages:
        rest = (url or "").split("://", 1)
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest[1], 16).groups() if len(rest) > 1 else ("", "")
        host = host.lower()
        fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged[page] = max(fits, key=lambda x: len(x[0]), default=(None, None))[1]
        parts = [x for x in re.findall(r"[^\W\d_]+|\d+", f"{host} {path}".lower()) if x not in named]
        words[page] = [w for x in parts for w in (["<number>"] if x.isdigit() else viterbi(x)[1])]
        if judged[page]:
            seen[judged[page] == "block"].update(words[page])
    known = seen[0].keys() | seen[1].keys()
    size = [sum(x.values()) + len(known) for x in seen]
    odds = {w: log((seen[1][w] + 1) / size[1]) - log((seen[0][w] + 1) / size[0]) for w in known} if all(seen) else {}
    out = {}
    for page, found in words.items():
        score = sum(odds.get(w, 0.0) for w in found)
        own = "block" if score >= log(url_filter.BLOCK_AT / (1 - url_filter.BLOCK_AT)) - 1e-6 else "allow"
        out[page] = (found, score, judged[page] or own)
    return out


def test_urls_of_a_table_match_plain_python(spark):
    where = TABLES.parent / "sf0.001"
    if not where.exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{where}/pages.parquet")
    want = plain_urls([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    out = url_filter.judge_urls(pages).collect()
    assert len(out) == len(want)
    for r in out:
        words, score, verdict = want[r.page_id]
        assert (r.words, r.verdict) == (words, verdict) and abs(r.score - score) < 1e-5


def test_naive_bayes_learns_from_urls_that_rules_judge(spark):
    html = "casino bonus garden letters river stone " * 5
    urls = [f"http://casinobonus{i}.net/es/{i}" for i in range(40)] + [f"http://gardenletters.com/{i}" for i in range(40)]
    urls += ["http://bonuscasinobonus.org/de/1", "http://lettersgarden.org/de/1", "http://riverstone.org/de/1", "http://casinogarden.org/es/1"]
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [out[k].verdict for k in (80, 81, 82, 83)] == ["block", "allow", "allow", "allow"]
    assert {k: out[k].verdict for k in range(80)} == {k: "block" if k < 40 else "allow" for k in range(80)}
    assert {r.page_id: (r.words, r.verdict) for r in out.values()} == {k: (v[0], v[2]) for k, v in plain_urls([(i, u, html) for i, u in enumerate(urls)]).items()}


def test_links_are_all_pairs_of_different_sets(spark):
    r = random.Random(3)
    base = [str(r.randrange(400)) for _ in range(200)]
    rows = []
    for k in range(24):
        own = list(base)
        for _ in range(k % 3):
            own[r.randrange(len(own))] = f"other{r.randrange(1000)}"
        rows.append((k, " ".join(own)))
    rows += [(50, rows[3][1]), (51, None), (None, rows[2][1]), (52, "one two"), (53, "One  TWO"), (54, "far away from all of the others")]
    least = {}
    for i, t in rows:
        w = ngram_join.words(t)
        size = min(5, len(w))
        grams = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if w else None
        if grams and i is not None:
            least[grams] = min(i, least.get(grams, i))
    want = {tuple(sorted((i, j))) for a, i in least.items() for b, j in least.items() if i != j and 100 * len(a & b) >= 80 * len(a | b)}
    got = [tuple(x) for x in ngram_join.find_links(docs_of(spark, [(*x, "s") for x in rows])).collect()]
    assert len(want) > 60 and len(got) == len(set(got)) and set(got) == want
