"""Benchmark decontamination by winnowing.

Every window of ``window`` words of a benchmark item is known by its winnowing fingerprint, the
smallest hash of the k-grams in it.  A document is joined with those fingerprints; a match is extended
to the whole window and compared on the window's own hash.  A shared span of ``window`` words or more
therefore always has a fingerprint on both sides: none is missed.

The benchmark is the smaller, stated set.  It is cut into shards of at most ``shard_rows`` windows;
each shard is broadcast and applied in one map over the documents, so that documents are never
shuffled and a benchmark of any size is handled the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.llm.common import not_named, numbers, prepared, set_aside, table, texts, written
from quotelab.llm.tokens import (
    alphanumeric_bytes,
    documents_of,
    pieces,
    sliding_minimum,
    whole_windows,
    window_hashes,
    words_of,
)

WINDOW = 13
GRAM = 7
SHARD_ROWS = 1_000_000
RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct ``(item_id, length, print, window_hash)`` of all items.

    An item of fewer words than ``window`` (and not none) is one window of its own length.  Items
    without a text, a word or an id have no window.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = numbers(batch, "item_id")
            for start, _, data, offsets in pieces(texts(batch)):
                words = words_of(data, offsets, alphanumeric_bytes(), lower=True)
                total, counts, owner = len(words.hashes), np.diff(words.first), documents_of(words.first)
                for length in sorted({min(window, int(n)) for n in counts if n}):
                    whole = window_hashes(words.hashes, length)
                    good = whole_windows(words.first, length, total)
                    good &= np.minimum(counts, window)[owner[: len(good)]] == length
                    low = _prints(words.hashes, length, gram)
                    at = np.flatnonzero(good)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[start + owner[at]]), pa.array(np.full(len(at), length, np.int32)),
                         pa.array(low[at].view(np.int64)), pa.array(whole[at].view(np.int64))],
                        names=["item_id", "length", "print", "window_hash"],
                    )

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL")
    return rows.mapInArrow(of, "item_id long, length int, print long, window_hash long").distinct()


def _prints(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Winnowing fingerprint of each ``length``-word window (the window's own hash when it is short)."""
    gram = min(gram, length)
    return sliding_minimum(window_hashes(hashes, gram), length - gram + 1)


class Shard:
    """Sorted arrays of one part of the benchmark: fingerprints, and windows with their items."""

    def __init__(self, rows) -> None:
        self.lengths = {}
        for length, some in rows.groupby("length"):
            hashes = some["window_hash"].to_numpy().view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            keys, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
            prints = np.unique(some["print"].to_numpy().view(np.uint64))
            self.lengths[int(length)] = prints, keys, first, count, some["item_id"].to_numpy()[order]


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


def hits(words, shard: Shard, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words covered by an item's window; documents and items of those windows (distinct pairs)."""
    total = len(words.hashes)
    owner, cover = documents_of(words.first), np.zeros(total + 1, np.int64)
    owners, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, (prints, keys, first, count, ids) in shard.lengths.items():
        good = whole_windows(words.first, length, total)
        if not len(good):
            continue
        low = _prints(words.hashes, length, gram)
        runs = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        among, _ = _found(prints, low[runs])
        at = np.flatnonzero(np.repeat(among, np.diff(np.append(runs, len(low)))) & good)
        same, key = _found(keys, window_hashes(words.hashes, length)[at])
        at, key = at[same], key[same]
        cover[at] += 1
        cover[at + length] -= 1
        pairs = np.unique(np.stack([owner[at], key]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        n = count[pairs[1]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners.append(np.repeat(pairs[0], n))
        items.append(ids[np.repeat(first[pairs[1]], n) + inner])
    pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(items)]), axis=1)
    return np.cumsum(cover[:-1]) > 0, pairs[0], pairs[1]


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    least_share: int = 20,
    shard_rows: int = SHARD_ROWS,
    keep_text: bool = True,
) -> DataFrame:
    """``documents`` with what each shares with ``benchmark``.

    Added: ``n_words``, ``n_hit`` (words inside an occurring window), ``n_items``, ``items_sha256``
    (occurring item ids, sorted as strings, comma-joined) and ``contaminated`` (``n_hit > 0`` and
    ``least_share * n_hit >= n_words``).  Columns of the same names, in any case, are replaced; all others
    stay, whatever their names.  Ids take no part, so that null ones are like others.
    Null and empty texts have no words and are clean; repeated rows are judged row by row; with an
    empty benchmark everything is clean.
    """
    spark = prepared(documents.sparkSession)
    windows = written(item_windows(benchmark, window, gram), "item-windows")
    shards = max(1, -(-windows.count() // shard_rows))
    names = [c for c in not_named(documents.columns, RESULT) if keep_text or c != "text"]
    schema = T.StructType([documents.schema[c] for c in names])
    between = T.StructType([T.StructField("text", T.StringType()), T.StructField("given", schema), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])
    final = T.StructType([*schema, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in RESULT.items())])
    documents = documents.select(F.col("text").cast("string"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("given"))
    for s in range(shards):
        some = windows.where(F.pmod(F.xxhash64("window_hash", "item_id"), F.lit(shards)) == s)
        shard = spark.sparkContext.broadcast(Shard(some.toPandas()))
        last = s == shards - 1
        documents = documents.mapInArrow(_apply(shard, gram, names, last, least_share), final if last else between)
    return documents


def _apply(shard, gram: int, names: list[str], last: bool, least_share: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            fields = batch.schema.names
            for start, stop, data, offsets in pieces(texts(batch)):
                words = words_of(data, offsets, alphanumeric_bytes(), lower=True)
                covered, owners, items = hits(words, shard.value, gram)
                docs = np.arange(stop - start)
                found = {}
                bounds = np.searchsorted(owners, np.append(docs, stop - start))
                for d in np.unique(owners):
                    found[int(d)] = items[bounds[d] : bounds[d + 1]]
                part = batch.slice(start, stop - start)
                if "hit" in fields:  # what earlier shards found
                    for d, (bits, more) in enumerate(zip(part.column("hit"), part.column("items"), strict=True)):
                        a, b = words.first[d], words.first[d + 1]
                        old = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=b - a)
                        covered[a:b] |= old.astype(bool)
                        if len(more):
                            found[d] = np.union1d(found.get(d, np.zeros(0, np.int64)), more.as_py())
                if not last:
                    bits = [np.packbits(covered[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                    lists = pa.array([found.get(d, []) for d in range(stop - start)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), lists], names=["text", "given", "hit", "items"])
                    continue
                sums = np.concatenate(([0], np.cumsum(covered)))
                n_words, n_hit = np.diff(words.first), np.diff(sums[words.first])
                n_items, digests = np.zeros(stop - start, np.int64), [empty] * (stop - start)
                for d, ids in found.items():
                    n_items[d] = len(ids)
                    digests[d] = hashlib.sha256(",".join(sorted(map(str, ids.tolist()))).encode()).hexdigest()
                results = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string())]
                results.append(pa.array((n_hit > 0) & (least_share * n_hit >= n_words)))
                yield pa.RecordBatch.from_arrays([*part.column(1).flatten(), *results], names=[*names, *RESULT])

    return of


def op1_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate(documents, table(spark, folder, "benchmark"), keep_text=False)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns that came in."""
    moved, back = set_aside(documents, RESULT)
    clean = decontaminate(moved, benchmark).where("NOT contaminated")
    return clean.drop(*RESULT).withColumnsRenamed(back).select(*(f"`{c}`" for c in documents.columns))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, p FROM dw JOIN iw USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
