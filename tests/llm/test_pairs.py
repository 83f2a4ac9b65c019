"""SimHash classes, near copies and contamination against brute force."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from netlens.llm import decontaminate, nearcopies, simhash

SCHEMA = "doc_id long, text string, component_id long, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in texts], SCHEMA)


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    root = {n: n for n in nodes}
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            ra, rb = root[a], root[b]
            if ra != rb:
                low, high = min(ra, rb), max(ra, rb)
                root = {n: low if r == high else r for n, r in root.items()}
    return root


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=n)) for n in (200, 120, 60, 30, 6)]
    texts = [None, "", "  \n", "a", "A", "a b", "ÀB c", *base]
    for b in base[:3]:
        for _ in range(6):
            w = b.split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), "word " * 5000]
    return list(enumerate(texts, 10))


def test_fingerprints_and_components_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in simhash.classes(docs(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    want = reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("crowded", [0, 1000])
def test_links_by_pairs_and_by_points_connect_the_same(spark, crowded):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centres for _ in range(25)} | {0, 1 << 63, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded=crowded)
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    want = reachable(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {p: got.get(p, p) for p in signed} == want


def test_empty_table_and_null_ids(spark):
    assert simhash.classes(docs(spark, [])).collect() == []
    got = simhash.classes(docs(spark, [(None, "same words here"), (4, "same words here"), (4, "same words here")])).collect()
    assert len(got) == 3 and {x.component_id for x in got} == {4}


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_copies_match_jaccard(spark):
    r = random.Random(11)
    words = [f"v{i}" for i in range(2000)]
    texts = [None, "", "one two"]
    for n in (400, 150, 80, 40):
        base = r.choices(words, k=n)
        texts.append(" ".join(base))
        for edits in (1, 2, n // 40 + 1, n // 10, n // 4):
            w = list(base)
            for i in r.sample(range(n), edits):
                w[i] = "edited"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t) for i, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y)

    got = {x.doc_id: x.component_id for x in nearcopies.classes(docs(spark, rows)).collect()}
    assert got == reachable([i for i, _ in rows], linked)
    kept = nearcopies.keep_one(docs(spark, rows + [(None, "no id"), (3, texts[3])]))
    assert kept.columns == ["doc_id", "text", "component_id", "key"]
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(got.values())) and None in ids


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    long = " ".join(f"t{i}" for i in range(40))
    rows = [(5, long), (5, "a text of its own with some words"), (5, long), (7, long), (7, "a text of its own with some words"), (None, long), (9, "third"), (None, None)]
    kept = nearcopies.keep_one(spark.createDataFrame([(i, t, "k", "d") for i, t in rows], "doc_id long, text string, kept string, digest string"))
    assert kept.columns == ["doc_id", "text", "kept", "digest"]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[5], rows[6], rows[7]], "doc_id long, text string").collect()))
    assert nearcopies.keep_one(kept.where("false")).count() == 0


def test_copies_of_rows_that_share_an_id_are_verified_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, c), (4, c + " end")]
    got = {tuple(x) for x in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, a), (1, b), (None, c), (4, c + " end")}


def test_only_rows_that_may_be_wanted_are_moved(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20_000)] + [(None, None)] * 3, "doc_id long, text string")
    wanted = rows.where("doc_id % 20 = 0 or doc_id is null").distinct()
    got = nearcopies.sifted(rows, ["doc_id", "text"], wanted, "near").collect()
    assert len(got) == 20_003 and all(x.near for x in got if x.doc_id is None or x.doc_id % 20 == 0)
    assert sum(x.near for x in got) < 1.1 * 1_003 + 0.05 * 19_000
    assert not any(x.near for x in nearcopies.sifted(rows, ["doc_id"], rows.where("false"), "near").collect())


def test_a_hub_is_dealt_over_parts(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(i, i - 1) for i in range(5000, 5100)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0, 4999}
    rows = spark.createDataFrame([(1, i) for i in range(50, 900)] + [(2, 7)], "k long, salt long")
    assert {tuple(r) for r in simhash.with_least(rows, "k", "salt", "m").select("k", "m").collect()} == {(1, 50), (2, 7)}


@pytest.mark.parametrize("common", [32, 36, 40, 48, 64, 80, 120, 160, 168, 176, 240, 320])
def test_copies_at_the_similarity_share_a_block(common):
    import numpy as np

    rng, missed = np.random.default_rng(common), 0
    for _ in range(2000):
        x = rng.integers(1, 1 << 63, common + common // 4, dtype=np.uint64)
        a, b = x[: common + common // 8], np.concatenate([x[:common], x[common + common // 8 :]])
        missed += not np.intersect1d(nearcopies.blocks(a), nearcopies.blocks(b)).size
    assert missed <= 1


def test_small_texts_match_jaccard(spark):
    r = random.Random(8)
    rows = []
    for n in (9, 37, 60):  # a word less, a fifth less: similarity 0.8 exactly for the first
        for _ in range(60):
            w = [f"s{r.randrange(10**9)}" for _ in range(n)]
            rows += [" ".join(w), " ".join(w[: n - (n - 4) // 5])]
    rows = list(enumerate(rows))
    sets = {i: shingle_set(t) for i, t in rows}
    got = {x.doc_id: x.component_id for x in nearcopies.classes(docs(spark, rows)).collect()}
    assert got == reachable(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_copies_around_a_shared_passage_match_jaccard(spark):
    r = random.Random(4)
    own = lambda n: " ".join(f"o{r.randrange(10**9)}" for _ in range(n))
    rows = []
    for hub in range(6):  # short additions are near copies of each other, longer ones of nothing
        passage = " ".join(f"h{hub}x{i}" for i in range(124))
        rows += [passage + " " + own(n) for n in (5, 5, 6, *[55] * 150)]
    rows = list(enumerate(rows))
    sets = {i: shingle_set(t) for i, t in rows}
    got = {x.doc_id: x.component_id for x in nearcopies.classes(docs(spark, rows)).collect()}
    assert got == reachable(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def brute_contamination(text, items):
    import hashlib
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words, hit, found = pattern.findall(low(text)), set(), set()
    for item, t in items:
        w = pattern.findall(low(t))
        n = min(10, len(w))
        spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in spans:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_matches_brute_force(spark, limit):
    r = random.Random(2)
    words = [f"b{i}" for i in range(400)] + ["é", "x1"]
    items = [(1, " ".join(r.choices(words, k=40))), (22, "Short item, here"), (3, None), (4, "  ...  "), (5, "é"), (6, " ".join(r.choices(words, k=10)))]
    texts = [None, "", "nothing shared at all in this text with any item of the benchmark"]
    for _, t in items[:1]:
        w = t.split()
        texts += [t.upper(), " ".join(w[5:15]), " ".join(w[5:14]), "pre-fix " + ",\n".join(w[3:30]) + " tail", t + " " + t, "z " * 3000 + t]
    texts += ["a short ITEM here b", "short item", "É", "é", items[5][1], "b1" * 40, "b" * 200_000]
    rows = list(enumerate(texts))
    table = spark.createDataFrame([(i, t, 1) for i, t in [*rows, rows[4]]], "doc_id long, text string, n_words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontaminate.contamination(table, bench, broadcast_bytes=limit).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in rows}
    kept = {x.doc_id for x in decontaminate.keep_clean(table, bench, broadcast_bytes=limit).collect()}
    assert kept == {i for i, t in rows if not brute_contamination(t, items)[4]}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_rows_are_judged_by_their_own_text(spark, limit):
    """One id with two texts, rows without an id, items that share spans, more items than are compared at once."""
    text = " ".join(f"w{i}" for i in range(30))
    items = [(i, f"own{i} " + text) for i in range(150)] + [(None, text)]
    table = spark.createDataFrame([(1, text, "a"), (1, "clean text", "b"), (None, text, "c"), (None, "other", "d"), (1, "clean text", "b")], "doc_id long, text string, rid string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.keep_clean(table, bench, broadcast_bytes=limit)
    assert kept.columns == table.columns and sorted(x["rid"] for x in kept.collect()) == ["b", "b", "d"]
    got = decontaminate.contamination(table, bench, broadcast_bytes=limit).where("contaminated").collect()
    assert {(x.doc_id, *tuple(x)[1:]) for x in got} == {(i, *brute_contamination(text, [("null" if k is None else k, t) for k, t in items])) for i in (1, None)}


def test_the_index_takes_about_eight_times_its_text():
    r = random.Random(0)
    items = [(str(i), " ".join(f"word{r.randrange(50_000)}" for _ in range(200))) for i in range(500)]
    assert decontaminate.Index(items).nbytes < 9 * sum(len(t) for _, t in items)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).collect() == []
    some = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert decontaminate.contamination(some, bench).select("n_words", "n_hit").collect() == [(2, 0)]
    assert decontaminate.keep_clean(some.where(F.lit(False)), bench).count() == 0
