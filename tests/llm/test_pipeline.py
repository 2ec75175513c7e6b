"""The pipeline's stages on a small corpus, against a plain version of what each decides."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402


from weftgraph.llm import bpe, language_id, subwords  # noqa: E402
from weftgraph.llm.common import table  # noqa: E402

from .test_dedup import brute_components, brute_hits, brute_print  # noqa: E402
from .test_similar import least_similar  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", "s", 10, "x"), (2, None, None, None, None, None), (3, "42", "en", "s", 2, "y")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert (out.columns, [t for _, t in out.dtypes]) == (d.columns, [t for _, t in d.dtypes]), name
            out.collect()


def test_stages_with_clashing_names(spark):
    """Columns named like what stages and operators add."""
    extra = ["score", "lang_pred", "ambiguous", "dropped", "n_hit", "items", "__key", "__again", "__id", "__text", "_0", "_c0", "key", "again", "n_words", "a.b", "row"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    texts = [(1, "the and of the with"), (2, "the and of the with"), (3, "on the other hand"), (4, None)]
    rows = [(i, t, "en", "s", 5, *(f"{c}-{i}" for c in extra)) for i, t in texts]
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert (out.columns, [t for _, t in out.dtypes]) == (docs.columns, [t for _, t in docs.dtypes]), name
        for r in out.collect():
            assert tuple(r)[5:] == tuple(f"{c}-{r.doc_id}" for c in extra), name
    assert {r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect()} == {2, 3, 4}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and last.count() == 4


def test_language_stage(spark):
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([("the and of with that", "en"), ("der die das und nicht", "de")] * 30)]
    rows += [(100, "the and of", None, "s", 10), (101, "123 !!", "en", "s", 6), (102, None, "en", "s", 0), (103, "der die das", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert found[100] == "en" and found[103] == "de" and not {101, 102} & set(found)
    model = language_id.fit_languages(docs)
    names, _, vague = model.predict(subwords.WordTable(language_id.split, model.rows), [r[1] for r in rows])
    assert found == {r[0]: n for r, n, v in zip(rows, names, vague, strict=True) if n != "und" and not v}


def test_run_equals_a_plain_version(spark):
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    model = language_id.fit_languages(table(spark, SF, "documents"))
    names, _, vague = model.predict(subwords.WordTable(language_id.split, model.rows), [d["text"] for d in docs])
    docs = [d for d, n, v in zip(docs, names, vague, strict=True) if n != "und" and not v]
    last: dict[str, int] = {}
    for d in docs:
        last[d["text"]] = max(last.get(d["text"], -1), d["doc_id"])
    docs = [d for d in docs if last[d["text"]] == d["doc_id"]]
    least = brute_components([(d["doc_id"], brute_print(d["text"])) for d in docs])
    docs = [d for d in docs if least[d["doc_id"]] == d["doc_id"]]
    # then those that resemble one of a smaller id in their group, by five-word shingles
    least = least_similar([(d["doc_id"], d["text"]) for d in docs])
    assert any(i != j for i, j in least.items())
    docs = [d for d in docs if least[d["doc_id"]] == d["doc_id"]]
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        tokens = bpe.read_ranks(f.read())
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    cut = 0
    for d in docs:
        n, hit, _ = brute_hits(d["text"], items, 10)
        assert (d["doc_id"] in found) == (hit <= 0.8 * n)
        if d["doc_id"] in found and not hit:
            assert found[d["doc_id"]].n_tokens == len(public.encode_ordinary(d["text"]))
            assert found[d["doc_id"]].decoded_sha256 == hashlib.sha256(d["text"].encode()).hexdigest()
        cut += hit > 0
    assert set(found) <= {d["doc_id"] for d in docs} and cut
