"""What joins make and exchanges hold must not grow with the square of a group, nor with what can't match."""

import numpy as np
import pytest
from helpers import components, documents, words

from quotelab.llm import common, first_copy, jaccard, suffixes


def counted(monkeypatch, module):
    seen = {}
    write = common.written

    def of(df, name):
        out = write(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "written", of)
    return seen


@pytest.mark.parametrize("block", [8])
def test_rows_that_share_a_passage_make_no_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    seen = counted(monkeypatch, jaccard)
    passage, near = words(80, 1), words(200, 2)
    rows = [(i, " ".join(words(60 + i % 3, 100 + i, 5000) + passage)) for i in range(50)]
    random = np.random.default_rng(3)
    for i in range(50, 90):  # near copies, some linked only through others
        some = list(near)
        for at in random.integers(0, 200, 3):
            some[at] = f"x{i}"
        rows.append((i, " ".join(some)))
    out = jaccard.jaccard_components(documents(spark, rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == components(rows)
    assert max(seen["alike"] + seen.get("likeliest", [0])) <= 2 * len(rows)
    assert max(seen["cross-pairs"]) < 40 * 39 / 2


def test_only_texts_that_may_match_travel(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(1000)] + [(None, "n")])
    some, rest = common.parted(docs, docs.where("doc_id < 10"))
    assert set(range(10)) <= {r["doc_id"] for r in some.collect()} and rest.count() >= 950
    found = docs.where("doc_id < 10").selectExpr("doc_id", "text AS spans")
    out = {r["doc_id"]: r["spans"] for r in common.with_found(docs, found, "spans").collect()}
    assert out == {i: f"t{i}" if i < 10 else None for i in range(1000)} | {None: None}


def test_a_short_string_in_common_sends_no_bytes(spark):
    """35 bytes in common hold an anchor of 25, but no anchor with 13 bytes more on one side of it."""
    random = np.random.default_rng(1)
    letters = lambda n: "".join(chr(97 + x) for x in random.integers(0, 26, n))
    short, long = letters(35), letters(60)
    rows = [(i, letters(200) + short + letters(200)) for i in range(5)] + [(i, letters(200) + long + letters(200)) for i in (5, 6)]
    docs = documents(spark, rows).select("doc_id", "text")
    found = first_copy.shared_anchors(docs, suffixes.byte_units, 50, sides=True)
    assert {r["doc_id"] for r in found.collect()} == {5, 6}


def test_packed_rows_come_back():
    kind = np.dtype([("hash", "<u8"), ("at", "<i4"), ("doc", "<i8")])
    rows = np.zeros(1000, kind)
    random = np.random.default_rng(1)
    rows["hash"], rows["at"], rows["doc"] = random.integers(0, 2**64, 1000, np.uint64), random.integers(-9, 9, 1000), random.integers(-(2**62), 2**62, 1000)

    class Payload:
        def __init__(self, raw):
            self.raw = raw

        def as_buffer(self):
            import pyarrow as pa

            return pa.py_buffer(self.raw)

    for n in (0, 1, 1000):
        assert (common.unpacked(Payload(common.packed(rows[:n])), kind) == rows[:n]).all()


def test_what_tasks_send_does_not_grow_with_ranges_or_documents(spark, monkeypatch):
    """One row for each pair of tasks at most, however many documents share however many passages."""
    random = np.random.default_rng(5)
    letters = lambda n: "".join(chr(97 + x) for x in random.integers(0, 26, n))
    common_ = [letters(120) for _ in range(30)]
    rows = [(i, letters(60).join([letters(60), *common_[i % 3 :]])) for i in range(300)]
    docs = documents(spark, rows).select("doc_id", "text").repartition(4).localCheckpoint()
    made, of = {}, type(docs).mapInArrow

    def seen(self, function, *given):
        made.setdefault(function.__name__, []).append(out := of(self, function, *given))
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    out = {r["doc_id"]: r["n_removed"] for r in suffixes.suffix_dedup(docs).collect()}
    assert out[0] == 0 and all(out[i] >= 27 * 120 for i in range(3, 300))
    parts = common.parts_of(spark)
    tasks = 4 * parts
    for asked in made["ask"]:
        assert 0 < asked.count() <= asked.rdd.getNumPartitions() * (tasks + parts)
    for answered in made["answer"]:
        assert answered.count() <= tasks * parts


@pytest.mark.parametrize("width", [7, 8, 50])
def test_equal_windows_have_their_least_gram_at_the_same_place(width):
    random = np.random.default_rng(width)
    passage = random.integers(97, 100, 150).astype(np.uint8)
    texts = [random.integers(97, 100, n).astype(np.uint8) for n in (0, 3, width, 90)]
    texts = [*texts, np.concatenate((texts[3], passage)), np.zeros(0, np.uint8), np.concatenate((passage, texts[3])), np.full(120, 97, np.uint8)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.concatenate(texts)
    runs = first_copy.runs_of(suffixes.byte_units(data, offsets), width)
    found, halves = {}, {}
    for k in range(len(runs.at)):
        for s in range(runs.at[k], runs.stop[k]):
            window = data[s : s + width].tobytes()
            before = s < runs.cut[k]
            here = (runs.anchor[k] - s, runs.least[k], before, (runs.before if before else runs.behind)[k])
            assert halves.setdefault(window, here) == here and 0 <= here[0] <= width - width // 2
            found[s] = runs.doc[k]
    assert found == {s: d for d in range(len(texts)) for s in range(offsets[d], offsets[d + 1] - width + 1)}
