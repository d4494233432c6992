"""Substring removal by a compacted de Bruijn graph of token k-mers.

Each ``window``-word k-mer is an edge between its two (k-1)-mers.  Only edges that occur in more than
one document can matter; they are found in two packed exchanges (``first_copy``).  Each repeated edge is
joined with its source, its first occurrence in the document of smallest id.  Edges of a document that
follow each other without branching, that is whose sources also follow each other, compact into one
path; a path is kept only as far as its source coordinates run along with it.  The words of all paths go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.llm.common import not_named, numbers, prepared, set_aside, table, texts, with_found
from quotelab.llm.first_copy import SPANS, Words, all_spans, with_bases
from quotelab.llm.tokens import nonspace_bytes, pieces, words_of

WINDOW = 50
RESULT = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}


def space_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return words_of(data, offsets, nonspace_bytes())


def marked(spans: pa.Array, first: np.ndarray, start: int, bases: np.ndarray, kind: np.dtype = SPANS) -> np.ndarray:
    """Which units of consecutive texts lie in a span; ``first``: where each text's units begin, ``bases``:
    where its coordinates do."""
    cover = np.zeros(first[-1] + 1, np.int64)
    for d in range(len(first) - 1):
        if spans[start + d].is_valid:
            rows = np.frombuffer(spans[start + d].as_buffer(), kind)
            begin = first[d] - int(bases[start + d]) + rows["at"].astype(np.int64)
            np.add.at(cover, np.clip(begin, first[d], first[d + 1]), 1)
            np.add.at(cover, np.clip(begin + rows["length"], first[d], first[d + 1]), -1)
    return np.cumsum(cover[:-1]) > 0


def kept_words(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, joined by one space, and where each document's bytes begin."""
    kept = ~removed
    counts = np.concatenate(([0], np.cumsum(kept)))
    data = words.data.copy()
    take = np.zeros(len(data) + 1, np.int64)
    take[words.starts[kept]] += 1
    take[words.ends[kept]] -= 1
    take = np.cumsum(take[:-1]) > 0
    where = np.flatnonzero(kept)
    after = counts[words.first[1:]]  # kept words up to each document's end
    joined = np.ones(len(where), bool)
    joined[after[after > 0] - 1] = False  # no space behind a document's last kept word
    at = words.ends[where[joined]]
    take[at], data[at] = True, 0x20
    out = np.concatenate(([0], np.cumsum(take)))
    bounds = np.append(words.starts, len(data))[words.first]
    bounds[-1] = len(data)
    return data[take], out[bounds]


def substring_dedup(documents: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``documents`` without words covered by a window that also starts in a document of smaller id.

    Added: ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space) and, with
    ``keep_text``, ``text`` as it remains: unchanged when nothing is removed, else the kept words joined
    by one space.  Null texts have no words and stay null.  Rows without ``doc_id`` are judged against
    nothing.  Rows that repeat an id belong to one document, and each is cut by its own text.  Columns
    named like a result, in any case, are replaced; others may have any name.
    """
    prepared(documents.sparkSession)
    names = [c for c in not_named(documents.columns, RESULT) if keep_text or c != "text"]
    given = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("given")
    rows = with_bases(documents.select("doc_id", F.col("text").cast("string"), given), "words")
    own = rows.where("doc_id IS NOT NULL").select("doc_id", "text", "base")
    spans = all_spans(own, space_words, window, "words")
    schema = T.StructType(
        [*(T.StructField(c, T.StringType()) if c == "text" else documents.schema[c] for c in names),
         *(T.StructField(k, T._parse_datatype_string(v)) for k, v in RESULT.items())]
    )
    return with_found(rows, spans, "spans").select("text", "base", "given", "spans").mapInArrow(_removed(names), schema)


def _removed(names: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, bases, spans = batch.column(0), numbers(batch, "base"), batch.column(3)
            for start, stop, data, offsets in pieces(texts(batch)):
                words = space_words(data, offsets)
                removed = marked(spans, words.first, start, bases)
                kept, bounds = kept_words(words, removed)
                gone = np.diff(np.concatenate(([0], np.cumsum(removed)))[words.first])
                raw = memoryview(kept)
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = iter(batch.column(2).slice(start, stop - start).flatten())
                if "text" in names:
                    new = [kept[a:b].tobytes().decode() if n else None for a, b, n in zip(bounds[:-1], bounds[1:], gone, strict=True)]
                    text = pa.array([y if n else x for x, y, n in zip(old.slice(start, stop - start).to_pylist(), new, gone, strict=True)], pa.string())
                held = [text if c == "text" else next(columns) for c in names]
                results = [pa.array(np.diff(words.first)), pa.array(gone), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*held, *results], names=[*names, *RESULT])

    return of


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the columns that came in, their texts without the words that ``substring_dedup``
    removes; ``n_chars``, if there, is brought up to date where words went."""
    moved, back = set_aside(documents, RESULT)
    cut = substring_dedup(moved)
    if "n_chars" in documents.columns:
        size = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars")))
    return cut.drop(*RESULT).withColumnsRenamed(back).select(*(f"`{c}`" for c in documents.columns))


def op4_debruijn_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM k) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM r),
l AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, w, gone
  FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM d),
y AS (
  SELECT x.doc_id, string_agg(t, ' ' ORDER BY x.q) AS kept
  FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT f.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM f LEFT JOIN y USING (doc_id)
"""
