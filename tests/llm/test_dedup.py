"""Exact, near and line deduplication, and decontamination, against brute force and on odd tables."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, exact_dedup, line_dedup, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, pairs, kind="doc_id long, text string"):
    return spark.createDataFrame(pairs, kind)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns named like results."""
    text = "word " * 50_000
    rows = [(1, None, None, "x", True), (2, "", None, None, None), (3, text, "k", None, True), (4, text, "k", None, True), (4, text, "k", None, True), (None, "a b", None, None, None), (None, None, None, None, None), (5, "a b", "z", "x", False)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, run string, kept boolean")


def empty(spark):
    return spark.createDataFrame([], DOC)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None, "", "é", f"t{r.randrange(30)}"])) for i in range(200)]
    best = max if keep == "largest" else min
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    found = {x.doc_id: tuple(x) for x in exact_dedup.exact_dedup(docs(spark, rows), keep=keep).collect()}
    assert found == {i: (i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), sha(t)) for i, t in rows}


def test_exact_odd_rows(spark):
    found = exact_dedup.exact_dedup(odd(spark)).collect()
    assert len(found) == 8
    by = defaultdict(list)
    for x in found:
        by[x.text_sha256].append(x)
    assert {x.keep_id for x in by[sha("a b")]} == {5} and [x.kept for x in by[sha("a b")]].count(True) == 1
    assert sum(x.kept for x in by[sha("word " * 50_000)]) == 1 and {x.keep_id for x in by[sha("word " * 50_000)]} == {4}
    assert {x.group_size for x in by[sha("")]} == {3} and {x.keep_id for x in by[sha("")]} == {2}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_filter_keeps_columns(spark):
    d = odd(spark)
    kept = exact_dedup.drop_exact_copies(d)
    assert kept.columns == d.columns
    assert sorted((x.doc_id, (x.text or "")[:3]) for x in kept.collect()) == [(2, ""), (4, "wor"), (5, "a b")]


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """Smallest id reachable over fingerprints at most 2 bits apart, by id."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    every = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ np.uint64(p)) <= 2):
            root[find(prints[i + 1 + int(j)])] = find(p)
    least = {}
    for i, p in pairs:
        least[find(p)] = min(least.get(find(p), i), i)
    return {i: least[find(p)] for i, p in pairs}


def test_fingerprints(spark):
    r = random.Random(1)
    texts = [None, "", " \t\x0b\x0c ", "A", "a B", "a b c", "É x y z", "a b c d"] + [" ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.choice([3, 40, 900]))) for _ in range(40)]
    assert simhash.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
        a, b = (set(zip(*(v.tolist() for v in simhash.golay_keys(z)), strict=True)) for z in (x, y))
        assert {r for r, _ in a & b} == set(range(3000))


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_of_crowded_and_sparse_fingerprints(spark, bucket):
    r = random.Random(bucket)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(120):  # a crowd around one point, a chain, and strangers
        prints.add(centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    chain = r.getrandbits(64)
    for _ in range(30):
        chain ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        prints.add(chain)
    prints |= {r.getrandbits(64) for _ in range(100)} | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    pairs = [(i, p) for i, p in enumerate(sorted(prints, key=lambda p: p * 7919 % 10007))]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.components(simhash.links(spark.createDataFrame([(signed(p),) for _, p in pairs], "fp long"), bucket))
    root = {x.node: x.root for x in found.collect()}
    want = brute_components(pairs)
    groups, got = defaultdict(set), defaultdict(set)
    for i, p in pairs:
        groups[want[i]].add(i)
        got[root.get(signed(p), signed(p))].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def test_near_duplicates(spark):
    r = random.Random(9)
    base = [" ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(300)) for _ in range(8)]
    rows = [(10 * k + j + 1, " ".join(w if r.random() > 0.004 else "zz" for w in t.split())) for k, t in enumerate(base) for j in range(6)] + [(900, None), (901, ""), (902, " "), (903, base[0].upper())]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    pairs = [(i, brute_print(t)) for i, t in rows]
    assert {x.doc_id: x.fp % (1 << 64) for x in found} == dict(pairs)
    assert {x.doc_id: x.component_id for x in found} == brute_components(pairs)
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_components(pairs).values()))


def test_near_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark)).collect()
    assert len(found) == 8 and {x.component_id for x in found if x.doc_id in (3, 4)} == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(odd(spark)).columns == odd(spark).columns


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if common.get(key(x), i) == i]
        out[i] = (len(split), len(split) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fan):
    r = random.Random(batches)
    pool = ["Short", "", "  a line of some length  ", "A LINE of some length", "ÉTÉ a line of some length", "été a line of some length", "\ta line of some length\r"] + [f"a line that counts {k}" for k in range(12)]
    rows = [(i * 3 - 20, r.choice([None, "", "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))])) for i in range(60)]
    found = line_dedup.line_dedup(docs(spark, rows), min_chars=12, min_docs=5, batches=batches, fan=fan).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in found} == brute_lines(rows, 12, 5)
    assert any(x.n_dropped for x in found)


def test_lines_odd_rows(spark):
    found = line_dedup.line_dedup(odd(spark), min_docs=2).collect()
    assert len(found) == 8 and {(x.doc_id, x.n_dropped) for x in found if x.n_lines and x.doc_id in (3, 4)} == {(3, 1), (4, 0)}
    assert line_dedup.line_dedup(empty(spark)).count() == 0


WORDS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute_hits(text, items, window):
    words = lambda t: re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n and item is not None else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination(spark, seed):
    r = random.Random(seed)
    text = lambda n, k: r.choice([" ", ", ", "\n"]).join(r.choice("abcdeé"[:k]) + r.choice(["", "", "X"]) for _ in range(n))
    items = [(i, text(r.randrange(0, 9), 5)) for i in range(12)] + [(20, None), (None, "a b c d e"), (3, "b b c a"), (7, "é")]
    rows = [(i, text(r.randrange(0, 60), 6)) for i in range(60)] + [(100, None), (101, ""), (102, "--")]
    found = decontamination.decontaminate(docs(spark, rows), docs(spark, items, "item_id long, text string"), window=4).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in found} == {i: brute_hits(t, items, 4) for i, t in rows}
    for x, (_, t) in zip(sorted(found, key=lambda x: x.doc_id), sorted(rows), strict=True):
        assert (x.text is None) == (t is None)
        if t is not None:
            assert len(decontamination.words(x.text)) == x.n_words - x.n_hit
            assert x.dropped == (x.n_words > 0 and x.n_hit > 0.8 * x.n_words)


def test_decontamination_in_passes(spark):
    r = random.Random(11)
    text = lambda n, k: " ".join(r.choice("abcdeé"[:k]) for _ in range(n))
    items = [(i, text(r.randrange(0, 40), 5)) for i in range(25)] + [(3, text(9, 4)), (None, "a b"), (50, text(300, 3))]
    rows = [(i, text(r.randrange(0, 60), 6)) for i in range(50)] + [(1, text(30, 4)), (None, text(40, 5)), (7, None), (8, "")]
    df = docs(spark, rows).withColumn("_0", F.lit("kept"))
    tables = [decontamination.decontaminate(df, docs(spark, items, "item_id long, text string"), window=5, keep=("_0",), pass_words=n).collect() for n in (20, 1_000_000)]
    few, one = (sorted(map(str, t)) for t in tables)
    assert few == one and {x._0 for x in tables[0]} == {"kept"}
    want = sorted(str((i, *brute_hits(t, items, 5))) for i, t in rows)
    assert sorted(str((x.doc_id, x.n_words, x.n_hit, list(x["items"]))) for x in tables[0]) == want
    assert len(list(decontamination.passes(docs(spark, items, "item_id long, text string"), window=5, limit=20))) > 10


def test_decontamination_odd_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.decontaminate(odd(spark), none, keep=("digest", "run")).collect()
    assert len(found) == 8 and not any(x.n_hit for x in found)
    assert decontamination.decontaminate(empty(spark), none).count() == 0
    items = docs(spark, [(1, "word " * 12)], "item_id long, text string")
    hits = {x.doc_id: x.n_hit for x in decontamination.decontaminate(odd(spark).filter(F.col("doc_id").isNotNull()), items).collect()}
    assert hits[3] == 50_000 and hits[5] == 0


def test_cut_leaves_the_rest_as_it_is():
    assert decontamination._cut("Keep É, DROP-this; end.", [(2, 4)]) == "Keep É, ; end."


def test_names_and_ids_of_any_kind(spark):
    rows = [("x", "same text here", 1, 2, 3, 4), ("y", "same text here", 5, 6, 7, 8), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, `te.xt` string, __key int, __again int, __id int, `a.b` int")
    for drop, left in ((exact_dedup.drop_exact_copies, "y"), (simhash.drop_near_duplicates, "x")):
        kept = drop(df, "key", "te.xt")
        assert kept.columns == df.columns
        assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] in (left, None)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, "key", "`te.xt`").collect()} == {"x": "x", "y": "x", None: None}
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(df, "key", "`te.xt`", 4, 2).collect()} == {("x", 1), ("y", 0), (None, 0)}


def test_lines_of_rows_that_repeat_ids(spark):
    line = "a line that is long enough to count, of forty or more"
    rows = [(1, line), (1, line + "\nx"), (2, line), (2, "y"), (2, line)]
    two = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert len(two) == 5 and not any(x.n_dropped for x in two)
    more = [*rows, (3, line), (4, line), (5, line), (5, "z\n" + line)]
    found = sorted((x.doc_id, x.n_dropped, x.kept_text) for x in line_dedup.line_dedup(docs(spark, more)).collect())
    want = [(1, 1, ""), (1, 1, "x"), (2, 0, "y"), (2, 1, ""), (2, 1, ""), (3, 1, ""), (4, 1, ""), (5, 0, line), (5, 0, "z\n" + line)]
    assert found == want
    null = [(None, line), (None, line + "\nw"), *((k, line) for k in range(4))]
    assert sorted(x.n_dropped for x in line_dedup.line_dedup(docs(spark, null)).collect()) == [0, 1, 1, 1, 1, 1]


def test_lines_of_long_documents(spark):
    shared = [f"line {k:06d} that all of five documents hold, in order" for k in range(30_000)]
    rows = [(i, "\n".join([f"own {i}", *shared, "end"])) for i in range(5)]
    began = time.time()
    found = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert found == {i: (30_002, 0 if i == 4 else 30_000, rows[4][1] if i == 4 else f"own {i}\nend") for i in range(5)}
    assert time.time() - began < 60


def test_lines_with_salted_keys(spark):
    r = random.Random(8)
    rows = [(i, "\n".join([f"a very common line {k}" for k in range(3) if r.random() < 0.7] + [f"line number {r.randrange(400)} of some"])) for i in range(400)]
    found = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.line_dedup(docs(spark, rows), min_chars=12, min_docs=2, share=16).collect()}
    assert found == brute_lines(rows, 12, 2)


def test_links_of_keys_that_are_crowded_by_two_segments(spark):
    """Fingerprints of equal first and second segments: only the third tells them apart."""
    r = random.Random(12)
    head = r.getrandbits(43) << 21
    prints = {head | r.getrandbits(21) for _ in range(150)}
    prints |= {p ^ (1 << r.randrange(21)) ^ (1 << r.randrange(64)) for p in list(prints)[:60]}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    pairs = [(i, p) for i, p in enumerate(sorted(prints))]
    found = simhash.components(simhash.links(spark.createDataFrame([(signed(p),) for _, p in pairs], "fp long"), 8))
    root = {x.node: x.root for x in found.collect()}
    want = brute_components(pairs)
    groups, got = defaultdict(set), defaultdict(set)
    for i, p in pairs:
        groups[want[i]].add(i)
        got[root.get(signed(p), signed(p))].add(i)
    assert len(groups) < len(pairs)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}
