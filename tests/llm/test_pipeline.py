"""The pipeline: each stage against a plain version of it on the stage's own input."""

import pytest
from helpers import components, contamination, documents, hard_rows, repeated, spaced

import corpus_pipeline
from quotelab.llm import quality
from quotelab.llm.common import table, written

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_spans", "decontamination", "packing"]


@pytest.mark.parametrize("hard", [False, True])
def test_every_stage(spark, hard):
    docs = documents(spark, hard_rows()) if hard else table(spark, SMALL, "documents")
    columns = docs.columns
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        texts = [(r["doc_id"], r["text"]) for r in given]
        docs = written(stage(spark, docs, SMALL), f"test-{name}")
        if name == "packing":
            total = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
            assert set(total) == {i for i, _ in texts}
            break
        assert docs.columns == columns
        if name == "quality":
            out = quality.quality_scores(spark.createDataFrame(given, docs.schema), table(spark, SMALL, "labels"))
            bad = {r["doc_id"] for r in out.where("predicted = 0").collect()}
            want = [r for r in given if r["doc_id"] not in bad]
        elif name == "near_duplicates":
            best = components(texts)
            want = [r for r in given if best[r["doc_id"]][1] == r["doc_id"]]
        elif name == "repeated_spans":
            units = {i: spaced(t) for i, t in texts}
            gone = repeated(units, 50)
            kept = {i: " ".join(w for w, g in zip(u, gone[i], strict=True) if not g) for i, u in units.items()}
            want = []
            for r in given:
                r = r.asDict()
                if gone[r["doc_id"]].any():
                    r["text"] = kept[r["doc_id"]]
                    r["n_chars"] = len(r["text"])
                want.append(tuple(r[c] for c in columns))
        else:
            hit = contamination(texts, items)
            want = [r for r in given if not (hit[r["doc_id"]][1] and 20 * hit[r["doc_id"]][1] >= hit[r["doc_id"]][0])]
        assert rows_of(docs) == sorted(map(tuple, want), key=repr), name


def test_rows_without_an_id_stay(spark):
    docs = documents(spark, [(None, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, None)])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SMALL)
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [1, None, None], name


def test_repeated_rows_become_one(spark):
    docs = documents(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "x"), (3, "x"), (4, None), (5, "")])
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "one two three four five six"), (3, "x"), (4, None), (5, "")]
    assert out.columns == docs.columns


def test_run_reads_documents_and_returns_pieces(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
