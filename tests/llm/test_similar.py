"""The pipeline's near-dedup stage and its search by similarity, against all pairs."""

import random

import pytest

from weftgraph.llm import similar
from weftgraph.llm.common import table

from .test_dedup import docs, empty, odd

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def least_similar(rows):
    """The smallest id of each row's group linked by a similarity of 0.8 of five-word shingles."""
    sets = {i: set(similar.shingles(t).tolist()) for i, t in rows}
    ids, least = sorted(sets), {i: i for i in sets}
    for i in ids:
        for j in ids:
            if i < j and least[i] != least[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    return least


def crowd():
    """Groups of copies with a few changes, chains of copies of copies, and strays with a passage that a third of all have."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(6):
        words = [word() for _ in range(r.choice([12, 60, 300]))] + (passage if k % 2 else [])
        for j in range(25):
            copy = list(words)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append((100 * k + j, " ".join(copy)))
            if j % 3 == 0:
                words = copy
    rows += [(1000 + j, " ".join([*passage, *(word() for _ in range(r.randrange(1, 30)))])) for j in range(60)]
    r.shuffle(rows)
    return rows


def test_similar_groups_are_exact(spark):
    rows = crowd()
    least = least_similar(rows)
    sizes = [list(least.values()).count(c) for c in set(least.values())]
    assert sizes.count(1) > 20 and max(sizes) > 10
    found = {x.doc_id: x.component_id for x in similar.similar_groups(docs(spark, rows)).collect()}
    assert {i: found.get(i, i) for i in least} == least
    assert {x.doc_id for x in similar.drop_similar(docs(spark, rows)).collect()} == set(least.values())


def test_similar_odd_rows(spark):
    assert {x.doc_id: x.component_id for x in similar.similar_groups(odd(spark)).collect()} == {3: 3, 4: 3}
    assert similar.similar_groups(empty(spark)).count() == 0
    kept = similar.drop_similar(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 6
    assert len(similar.shingles("a b c d e f f")) == 3 and len(similar.shingles("A b")) == 1 and not len(similar.shingles(" "))


def test_stage_drops_similar_documents(spark):
    sf = "/root/testdata/sf0.001"
    given = table(spark, sf, "documents").dropDuplicates(["text"]).filter("text rlike '[a-z]'")
    rows = [(d.doc_id, d.text) for d in given.collect()]
    least = least_similar(rows)
    kept = {d.doc_id for d in corpus_pipeline.near_dedup(spark, spark.createDataFrame(given.collect(), given.schema), sf).collect()}
    assert len(set(least.values())) < len(rows) and kept <= set(least) and not any(i in kept and least[i] in kept for i in least if least[i] != i)


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    """A passage of 40 texts in 1000 is known by a share of all texts; 20 texts hold hardly one of them."""
    monkeypatch.setattr(similar, "SAMPLE", 20)
    monkeypatch.setattr(similar, "EACH", 5, raising=False)
    rows = [(i, " ".join([*(["one two three four five six"] if i % 25 == 0 else []), *(f"w{i}x{k}" for k in range(9))])) for i in range(1000)]
    assert len(similar._common(spark.createDataFrame(rows, "id long, text string"), 5)) == 2
