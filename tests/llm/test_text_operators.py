"""Operators on texts against brute force, over the small tables and the hard cases."""

import hashlib

import pytest
from helpers import components, contamination, documents, hard_rows, repeated, runs, sorted_rows, spaced

from quotelab.llm import debruijn, decontaminate, jaccard, suffixes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def hexed(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_contaminated_documents(spark):
    rows = hard_rows()
    texts = dict(rows)
    long = texts[7].split()
    items = [
        (1, " ".join(long[20:50])), (10, " ".join(long[45:60])), (2, "ONE"), (3, ""), (4, None), (5, "!!!"), (6, "same " * 13),
        (1, " ".join(long[20:50])), (9, texts[12]), (None, "x" * 5000),
    ]
    benchmark = spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, n_hit string")
    expected = contamination(rows, [i for i in items if i[0] is not None])
    given = documents(spark, rows)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(
        ((i, n, h, len(f), hexed(",".join(f)), h > 0 and 20 * h >= n) for i, _ in rows for n, h, f in [expected[i]]), key=repr
    )
    assert sorted_rows(decontaminate.decontaminate(given, benchmark), *columns) == want
    # A benchmark in several shards gives the same.
    assert sorted_rows(decontaminate.decontaminate(given, benchmark, shard_rows=7), *columns) == want
    kept = decontaminate.clean_documents(given.drop("n_words"), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want if not r[5])


def test_contamination_of_the_small_tables(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    expected = contamination(small, items)
    got = sorted_rows(decontaminate.op1_winnowing_decontamination(spark, SMALL), "doc_id", "n_words", "n_hit", "items_sha256")
    assert got == sorted(((i, n, h, hexed(",".join(f))) for i, (n, h, f) in expected.items()), key=repr)


def test_links_of_near_duplicates(spark):
    rows = hard_rows()
    expected = components(rows)
    got = sorted_rows(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, *expected[i]) for i, _ in rows), key=repr)
    kept = jaccard.one_of_each(documents(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}


def test_chain_of_near_duplicates_is_one_group(spark):
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(12):  # neighbours differ by little, ends by much
        rows.append((100 - i, " ".join(words)))
        words = [*words[8:], *[f"n{i}x{j}" for j in range(8)]]
    expected = components(rows)
    got = sorted_rows(jaccard.jaccard_components(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, *expected[i]) for i, _ in rows), key=repr)
    assert len({c for _, _, c in got}) == 1


def test_links_of_the_small_table(spark, small):
    expected = components(small)
    got = sorted_rows(jaccard.op3_ngram_jaccard_join(spark, SMALL), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, *x) for i, x in expected.items()), key=repr)


def removed_words(rows):
    units = {i: spaced(t) for i, t in rows}
    gone = repeated(units, 50)
    return {i: (len(u), int(gone[i].sum()), " ".join(w for w, g in zip(u, gone[i], strict=True) if not g)) for i, u in units.items()}


def test_repeated_words(spark):
    rows = hard_rows()
    expected = removed_words(rows)
    out = debruijn.substring_dedup(documents(spark, rows))
    got = sorted_rows(out, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((i, n, g, hexed(k)) for i, _ in rows for n, g, k in [expected[i]]), key=repr)
    for row in out.collect():
        _, gone, kept = expected[row["doc_id"]]
        assert row["text"] == (kept if gone else dict(rows)[row["doc_id"]])
        assert (row["part"], row["size"], row["hash"]) == (1, "s", "h")


def test_repeated_words_of_the_small_table(spark, small):
    expected = removed_words(small)
    got = sorted_rows(debruijn.op4_debruijn_substring_dedup(spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((i, n, g, hexed(k)) for i, (n, g, k) in expected.items()), key=repr)


def removed_bytes(rows):
    units = {i: (t or "").encode() for i, t in rows}
    gone = repeated(units, 50)
    return {
        i: (len(u), int(gone[i].sum()), runs(gone[i]), hashlib.sha256(bytes(b for b, g in zip(u, gone[i], strict=True) if not g)).hexdigest())
        for i, u in units.items()
    }


def test_repeated_bytes(spark):
    rows = hard_rows()
    expected = removed_bytes(rows)
    got = sorted_rows(suffixes.suffix_dedup(documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *expected[i]) for i, _ in rows), key=repr)


def test_repeated_bytes_of_the_small_table(spark, small):
    expected = removed_bytes(small)
    got = sorted_rows(suffixes.op8_difference_cover_dedup(spark, SMALL), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *x) for i, x in expected.items()), key=repr)


@pytest.mark.parametrize("text", [b"banana", b"aaaaaaaaaa", b"a", b"ab", b"mississippi" * 3, bytes(range(60)) * 2])
@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7, 50])
def test_difference_cover_ranks(text, depth):
    import numpy as np

    rank = suffixes.difference_cover(np.frombuffer(text, np.uint8).astype(np.int64) + 1, depth)
    for i in range(len(text)):
        for j in range(len(text)):
            a, b = text[i : i + depth], text[j : j + depth]
            if a < b:
                assert rank[i] < rank[j]
            elif text[i:] == text[j:]:
                assert rank[i] == rank[j]


def test_rows_without_an_id(spark):
    text = " ".join(f"n{i}" for i in range(80))
    rows = [(None, text), (1, text), (2, text), (None, None)]
    given = documents(spark, rows)
    assert sorted_rows(jaccard.jaccard_components(given), "doc_id", "component_id") == sorted([(None, None), (None, None), (1, 1), (2, 1)], key=repr)
    assert sorted_rows(debruijn.substring_dedup(given), "doc_id", "n_removed") == sorted([(None, 0), (None, 0), (1, 0), (2, 80)], key=repr)
    assert sorted_rows(suffixes.suffix_dedup(given), "doc_id", "n_removed") == sorted([(None, 0), (None, 0), (1, 0), (2, len(text))], key=repr)


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b c"), (2, None)])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, benchmark).count() == 0
    assert sorted_rows(decontaminate.decontaminate(some, benchmark), "doc_id", "n_hit", "contaminated") == [(1, 0, False), (2, 0, False)]
    for of in (jaccard.jaccard_components, debruijn.substring_dedup, suffixes.suffix_dedup):
        assert of(none).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """Each is cut by its own text; equal rows are cut alike."""
    shared, other, third = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(1, shared), (2, shared), (2, other), (2, shared), (2, f"{third} {shared}"), (2, None), (3, other), (3, third), (4, "x")]
    given = documents(spark, rows)
    n = len(shared)
    words_ = [(1, 80, 0), (2, 80, 80), (2, 80, 0), (2, 80, 80), (2, 160, 80), (2, 0, 0), (3, 80, 80), (3, 80, 80), (4, 1, 0)]
    assert sorted_rows(debruijn.substring_dedup(given), "doc_id", "n_words", "n_removed") == sorted(words_, key=repr)
    out = suffixes.suffix_dedup(given)
    assert sorted_rows(out, "doc_id", "n_removed") == sorted([(1, 0), (2, n), (2, 0), (2, n), (2, n), (2, 0), (3, n), (3, n), (4, 0)], key=repr)


def test_columns_that_are_named_like_inner_ones(spark):
    names = ["_text", "spans", "_hit", "given", "base", "hit", "items", "mark", "N_WORDS", "Contaminated"]
    text = " ".join(f"n{i}" for i in range(80))
    given = spark.createDataFrame([(i, text, *(f"{c}{i}" for c in names)) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    items = spark.createDataFrame([(7, "n1 n2 n3")], "item_id long, text string")
    cut = debruijn.substring_dedup(given)
    hit = decontaminate.decontaminate(given, items, shard_rows=1)
    for out, kept in ((cut, [c for c in names if c != "N_WORDS"]), (hit, names[:-2])):
        assert sorted_rows(out, "doc_id", *kept) == [(i, *(f"{c}{i}" for c in kept)) for i in (1, 2)]
    assert sorted_rows(cut, "doc_id", "n_words", "n_removed") == [(1, 80, 0), (2, 80, 80)]
    assert sorted_rows(hit, "doc_id", "n_hit", "n_items") == [(1, 3, 1), (2, 3, 1)]
    left = debruijn.without_repeats(given).collect()
    assert sorted((r["doc_id"], r["text"], r["N_WORDS"]) for r in left) == [(1, text, "N_WORDS1"), (2, "", "N_WORDS2")]
    assert decontaminate.clean_documents(given, items).columns == given.columns
