"""Packing, search, archives and models: exact round trips, brute force and held-out accuracy."""

import base64
import gzip
import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, documents, hard_rows, sorted_rows, spaced

from quotelab.llm import isotonic, language, maxent, packing, quality, topk, warc

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


# Packing


@pytest.mark.parametrize(("length", "open_windows"), [(2048, packing.OPEN_WINDOWS), (64, 3)])
def test_packing_is_a_round_trip(spark, length, open_windows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = hard_rows()
    out = packing.pack(documents(spark, rows).repartition(3), packing.tokenizer_path(), length, open_windows, least_cut=8).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in rows}
    copies = Counter(i for i, _ in rows)
    covered = {i: np.zeros(len(x), int) for i, x in ids.items()}
    sequences = {}
    for r in out:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        covered[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((c == copies[i]).all() for i, c in covered.items())
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at and size > 0
            at += size
        assert at <= length
    total = sum(len(x) * copies[i] for i, x in ids.items())
    assert len(sequences) <= math.ceil(total / length) + 3 * open_windows


def test_special_strings_have_the_tokenizers_own_ids():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, chunks = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    texts = [
        "plain", "<|endoftext|>", "a<|endoftext|>b", "", "x <|startoftext|><|endoftext|> é\u0301 y", "<|ENDOFTEXT|> <|endoftext|",
        "don<|endoftext|>'t", "<|endoftext|>" * 3, "tail<|startoftext|>", "e<|endoftext|>\u0301", "<|endof", "text|> after",
    ]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, at = chunks.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, []), packing.tokenizer_path()).count() == 0


# Top-k search


def brute_top_k(vectors, queries, k, scale=64):
    good = {}
    for i, v in vectors:
        if v and i is not None and all(x is not None and math.isfinite(x) for x in v):
            w = tuple(math.floor(scale * x) for x in v)
            good[i] = min(good.get(i, w), w)
    out = []
    for q in queries & good.keys():
        scores = sorted((-sum(a * b for a, b in zip(good[q], w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(good[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_search_with_ties_repeats_and_unusable_vectors(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.normal(size=8).round(1)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 400)]  # ties
    rows += [(400, None), (420, []), (440, [1.0] * 7 + [None]), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(20, rows[20][1]), (500, [0.0] * 8), (520, [-3.0] * 8), (540, [2.0, 1.0]), (541, [1.0, 1.0])]
    given = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<double>, weights string, block int")
    expected = brute_top_k(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    for blocks in ({}, {"query_block": 5, "index_block": 90}):
        out = topk.top_k(given, given.where("id % 20 = 0"), 20, **blocks)
        assert sorted_rows(out, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)
    assert topk.top_k(given.limit(0), given.limit(0)).count() == 0


def test_search_of_large_weights(spark):
    """Scores are exact far beyond what doubles tell apart; beyond a long they are held at its ends and tie."""
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(size=8)]) for i in range(120)]
    rows += [(i, [float(x) for x in np.round(random.normal(size=8) * 3e7)]) for i in range(120, 300)]
    rows += [(300, [1e8, *[0.0] * 7]), (301, [1e8 + 1, *[0.0] * 7]), (320, [1e8, 1.0, *[0.0] * 6]), (340, [0.0] * 8)]
    rows += [(i, [1e200 * (i - 380.5), *[1.0] * 7]) for i in range(360, 400)]
    rows += [(400, [1e307] * 8), (420, [1e308] * 8)]
    given = spark.createDataFrame(rows, "id long, vector array<double>")
    weights = {i: [math.floor(64 * x) for x in v] for i, v in rows if math.isfinite(64 * max(v))}
    expected = []
    for q in (i for i in weights if i % 20 == 0):
        scores = {i: sum(a * b for a, b in zip(weights[q], w, strict=True)) for i, w in weights.items() if i != q}
        held = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for i, s in scores.items())
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(held[:20], 1)]
    for blocks in ({}, {"query_block": 7, "index_block": 60}):
        out = topk.top_k(given, given.where("id % 20 = 0"), 20, **blocks)
        assert sorted_rows(out, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


def test_search_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = sorted_rows(topk.op6_impact_top_k(spark, SMALL), "query_id", "rank", "vec_id", "score")
    assert out == sorted(brute_top_k(rows, {i for i, _ in rows if i % 20 == 0}, 20), key=repr)


# WARC


def archived(spark, rows, folder, **options):
    pages = spark.createDataFrame([(*r, "gone", 7) for r in rows], "page_id long, url string, html string, kind string, first int")
    os.makedirs(folder, exist_ok=True)
    return warc.archive(pages, str(folder), **options)


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 40_000
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>{i % 9}</p>") for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "u", long), (63, "u", long), (5, "u", "<p>5</p>"), (64, "u", "a\r\n\r\nb"), (None, "u", "<p>1</p>")]
    manifest = archived(spark, rows, tmp_path / "a", roll_bytes=2000)
    got = sorted_rows(warc.read_archives(manifest, str(tmp_path / "a")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = i is not None and i > first[html or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected.append((i, len(raw), sha, "revisit" if again else "response", first[html or ""] if again else None))
    assert got == sorted(expected, key=repr)
    listed = manifest.collect()
    assert len(listed) > 1 and sorted(r["file"] for r in listed) == sorted(os.listdir(tmp_path / "a"))
    for r in listed:
        raw = (tmp_path / "a" / r["file"]).read_bytes()
        assert (hashlib.sha256(raw).hexdigest(), len(raw)) == (r["sha256"], r["bytes"])
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    again = archived(spark, rows, tmp_path / "again", roll_bytes=2000)  # a second run writes the same bytes
    assert sorted_rows(again, "file", "sha256") == sorted_rows(manifest, "file", "sha256")


def test_archives_of_few_bytes_are_responses_and_empty_tables_work(spark, tmp_path):
    manifest = archived(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], tmp_path / "b", least_revisit=4)
    got = sorted_rows(warc.read_archives(manifest, str(tmp_path / "b")), "page_id", "refers_to")
    assert got == [(1, None), (2, None), (3, None), (4, 3)]
    empty = archived(spark, [], tmp_path / "c")
    assert empty.count() == 0 and warc.read_archives(empty, str(tmp_path / "c")).count() == 0


# Quality


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = quality.op5_fourier_quality(spark, MIDDLE).collect()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    checked = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in checked)
    assert right / len(checked) > 0.9


def test_quality_of_hard_rows(spark):
    rows = hard_rows()
    labels = spark.createDataFrame([(i, i % 2, None) for i, _ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    bare = quality.quality_scores(documents(spark, rows), labels.limit(0)).collect()
    assert {r["score"] for r in bare} == {0.5}
    assert quality.quality_scores(documents(spark, []), labels).count() == 0
    kept = quality.good_documents(documents(spark, rows), labels)
    assert kept.columns == documents(spark, []).columns
    assert kept.count() == sum(r["predicted"] for r in out)


def test_isotonic_map_rises(spark):
    points = spark.createDataFrame([(x / 10, float(x in (3, 5, 6, 8, 9))) for x in range(10)], "v double, y double")
    fitted = isotonic.fit(points, "v", "y", 0.0, 1.0)
    values = fitted(np.linspace(-1, 2, 50))
    assert (np.diff(values) >= -1e-12).all() and values.min() >= 0 and values.max() <= 1


# Language


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op9_kneser_ney_language(spark, MIDDLE).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (held(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    checked = [r for r in rows if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in checked) / len(checked) > 0.9


def test_language_of_hard_rows(spark):
    rows = hard_rows()
    out = language.identify(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r["doc_id"]]
        letters = any(map(str.isalpha, text or ""))
        assert (r["lang_pred"] == "en") if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
    from pyspark.sql import functions as F

    untaught = language.identify(documents(spark, rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
    assert language.identify(documents(spark, [])).count() == 0


# Language-model scores


def unigram(rows):
    tokens = {i: [*spaced((t or "").translate(LOWER)), None] for i, t in rows}
    counts = Counter(w for i, t in rows if i is not None and held(i, 5) != 1 for w in [*spaced((t or "").translate(LOWER)), None])
    total, kinds = sum(counts.values()), len(counts)
    base = {
        i: sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t) for i, t in tokens.items()
    }
    return {i: (len(t), sum(counts[w] > 0 for w in t), total, base[i]) for i, t in tokens.items()}


def checked_scores(out, rows):
    expected = unigram(rows)
    assert len(out) == len(rows)
    for r in out:
        n, known, total, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-6)
        assert r["held_out"] == (held(r["doc_id"], 5) == 1) and math.isfinite(r["score"]) and r["score"] <= 1e-9


def test_scores_of_hard_rows(spark):
    rows = hard_rows()
    checked_scores(maxent.language_model_scores(documents(spark, rows)).collect(), rows)
    assert maxent.language_model_scores(documents(spark, [])).count() == 0


def test_scores_beat_the_base_on_held_out_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    out = maxent.op10_maxent_scores(spark, MIDDLE).collect()
    checked_scores(out, rows)
    apart = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)
