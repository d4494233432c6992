"""Suffix-array removal of byte strings that an earlier document holds too, by difference cover.

Equal strings of ``width`` bytes have the same least gram, at the same place, so suffixes are dealt by it:
runs of windows whose least gram is the same one travel as one piece of text, and only where another document
has that gram too, with the same bytes before it or behind it.  Equal pieces count once, and a piece that is
alone with its gram needs no sorting.  Each range of grams sorts the suffixes of the others by difference cover: triples
at two of three positions are sorted and named, the string of names is sorted recursively, remaining suffixes are merged
in, and neighbours in the order are compared over ``width`` bytes.  Names stop growing once they cover
``width`` bytes, since no later byte matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.llm.common import dealt, grouped, numbers, packed, parted, parts_of, prepared, spans_of, table, texts, unpacked, unpacked_at, with_found, written
from quotelab.llm.debruijn import marked
from quotelab.llm.first_copy import BYTE_PIECES, PACKED, among, marks, part_of, runs_of, shared_anchors, shared_marks, with_bases
from quotelab.llm.tokens import BYTE_VALUE, Words, mixed, pieces

U64 = np.uint64
WIDTH = 50
#: Tasks that sort for each shuffle partition of the session, and the ranges that each sorts one after another.
TASKS, RANGES = 2, 32
FLUSH_BYTES = 16 << 20
RUN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("length", "<i4")])
#: ``gram``: where in the piece its least gram is; ``range``: of those that its task sorts.
PIECE = np.dtype([*RUN.descr, ("gram", "<u2"), ("range", "u1")])
SPAN = np.dtype([("at", "<i4"), ("length", "<i4")])
RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Words:
    at = np.arange(len(data))
    return Words(BYTE_VALUE[data], at, at + 1, offsets, data)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows, equal rows alike, from 1; compared column by column."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        if key.max(initial=0) >= (1 << 62) // (int(column.max(initial=0)) + 2):
            key = np.unique(key, return_inverse=True)[1]
        key = key * (int(column.max(initial=0)) + 1) + column
    key = key - key.min(initial=0)
    most = int(key.max(initial=0))
    if most < 8 * len(key):  # counting is less work than sorting
        seen = np.zeros(most + 1, bool)
        seen[key] = True
        return np.cumsum(seen)[key]
    return np.unique(key, return_inverse=True)[1] + 1


def difference_cover(x: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``x`` (symbols from 1) by at least its first ``depth`` symbols, ties alike."""
    n = len(x)
    if depth <= 1 or n < 3:
        return _names(x) if depth <= 1 or n < 2 else _names(x, np.append(x[1:], 0))
    y = np.concatenate((x, np.zeros(3, x.dtype)))
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    names = _names(y[sampled], y[sampled + 1], y[sampled + 2])
    if int(names.max()) < len(names) and depth > 3:
        # Names in the order of positions 1, 4, 7, ... then 2, 5, 8, ..., parted by the smallest symbol.
        string = np.concatenate((names[: len(one)] + 1, [1], names[len(one) :] + 1))
        ranks = difference_cover(string, -(-depth // 3))
        names = np.concatenate((ranks[: len(one)], ranks[len(one) + 1 :]))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names
    # Merge: a suffix at a third position is one symbol before a sampled one, and so is one at 1 mod 3;
    # against one at 2 mod 3 two symbols go before.
    zero = np.arange(0, n, 3)
    by_one = _names(np.concatenate((y[zero], y[one])), np.concatenate((rank[zero + 1], rank[one + 1])))
    by_two = _names(
        np.concatenate((y[zero], y[two])), np.concatenate((y[zero + 1], y[two + 1])), np.concatenate((rank[zero + 2], rank[two + 2]))
    )
    order_one, order_two = np.argsort(rank[one], kind="stable"), np.argsort(rank[two], kind="stable")
    all_ranks = np.sort(names)
    own_one, own_two = by_one[len(zero) :][order_one], by_two[len(zero) :][order_two]
    before = np.searchsorted(own_one, by_one[: len(zero)]) + np.searchsorted(own_two, by_two[: len(zero)])
    # Twice the number of sampled suffixes before it, plus one if it lies strictly between two of them.
    out = np.zeros(n, np.int64)
    out[sampled] = 2 * np.searchsorted(all_ranks, names)
    same_one = own_one[np.minimum(np.searchsorted(own_one, by_one[: len(zero)]), len(own_one) - 1)] == by_one[: len(zero)]
    same = same_one
    if len(two):
        same = same | (own_two[np.minimum(np.searchsorted(own_two, by_two[: len(zero)]), len(two) - 1)] == by_two[: len(zero)])
    out[zero] = 2 * before - np.where(same, 0, 1)
    return _names(out, np.zeros(n, np.int64)) if not len(zero) else _names(out, _among(out, zero, by_one[: len(zero)], n))


def _among(out: np.ndarray, zero: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Second key: suffixes that lie between the same sampled ones are ordered by their own key."""
    second = np.zeros(n, np.int64)
    between = out[zero] % 2 != 0
    second[zero[between]] = own[between]
    return second


def first_copies(text: np.ndarray, docs: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether each of the suffixes at ``starts`` begins with ``width`` bytes that start in a smaller document."""
    rank = difference_cover(text.astype(np.int64) + 1, width)[starts]
    order = np.lexsort((docs, rank))
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 17):  # compare neighbours over the whole width
        i, j = order[a - 1 : a - 1 + (1 << 17)], order[a : a + (1 << 17)]
        i = i[: len(j)]
        same[a : a + len(j)] = (text[starts[i][:, None] + np.arange(width)] == text[starts[j][:, None] + np.arange(width)]).all(axis=1)
    group = np.cumsum(~same) - 1
    at = grouped(group)
    lowest = np.minimum.reduceat(docs[order], at) if len(at) else docs[:0]
    out = np.zeros(len(order), bool)
    out[order] = docs[order] > lowest[group]
    return out


def _pack(rows: np.ndarray, text: np.ndarray) -> bytes:
    return np.int64(len(rows)).tobytes() + packed(rows) + text.tobytes()


def _unpack(payload) -> tuple[np.ndarray, np.ndarray]:
    raw = payload.as_buffer()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8 + n * PIECE.itemsize
    return unpacked_at(raw, PIECE, n, 8), np.frombuffer(raw, np.uint8, raw.size - at, at)


def gather(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return text[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def copied_runs(documents: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """``doc_id, spans``: packed spans of bytes to remove."""
    parts = parts_of(documents.sparkSession)
    tasks = TASKS * parts
    gram = width // 2

    def batch_of(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        part, known, payload = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(known, pa.bool_()), pa.array(payload, pa.binary())], names=["part", "shared", "payload"])

    def sent(held: list[tuple]) -> pa.RecordBatch:
        rows, least, text = (np.concatenate(x) for x in zip(*held, strict=True))
        begin = np.cumsum(rows["length"].astype(np.int64)) - rows["length"]
        raw = memoryview(text)
        digest = np.fromiter((hash(raw[a : a + n].tobytes()) for a, n in zip(begin.tolist(), rows["length"].tolist(), strict=True)), np.int64, len(rows))
        order = np.lexsort((rows["doc"], digest))
        at = grouped(digest[order])
        lowest = np.empty(len(rows), np.int64)
        lowest[order] = np.repeat(rows["doc"][order][at], np.diff(np.append(at, len(order)))[: len(at)])
        copy = rows["doc"] > lowest  # the whole piece is in an earlier document of this task
        out = [(p, True, b) for p, b in dealt(rows["doc"][copy] % parts, rows[copy][list(RUN.names)].astype(RUN))]
        mine = np.flatnonzero(~copy)
        part = part_of(mixed(least[mine]), tasks * RANGES)
        rows["range"][mine] = part % RANGES
        order = np.lexsort((rows["doc"][mine], part))
        mine, part = mine[order], part[order] // RANGES
        for a, b in spans_of(grouped(part), len(part)):
            some = mine[a:b]
            out.append((int(part[a]), False, _pack(rows[some], gather(text, begin[some], rows["length"][some].astype(np.int64)))))
        return batch_of(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, bases = numbers(batch, "doc_id"), numbers(batch, "base")
            lists = batch.column(batch.schema.get_field_index("anchors"))
            for start, stop, data, offsets in pieces(texts(batch), BYTE_PIECES):
                runs = runs_of(byte_units(data, offsets), width)
                shared = shared_marks(lists, start, stop)
                before, behind = (has & among(marks(hashes, runs.doc), shared) for hashes, has in runs.halves())
                some = before | behind
                at = np.where(before, runs.at, runs.cut)[some]
                ends = np.where(behind, runs.stop, runs.cut)[some]
                owner, anchor = runs.doc[some], runs.anchor[some]
                rows = np.zeros(len(at), PIECE)
                rows["doc"], rows["at"] = ids[start + owner], at - offsets[owner] + bases[start + owner]
                rows["length"], rows["gram"] = ends - at + width - 1, anchor - at
                text = gather(data, at, rows["length"].astype(np.int64))
                held.append((rows, runs.least[some], text))
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def flagged(rows: np.ndarray, text: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Spans of the pieces at ``begin``, of one range, that lie in an earlier document too."""
        lengths = rows["length"].astype(np.int64)
        # Equal pieces are sorted once: that of the smallest document, whose spans its repeats share.
        raw, known = memoryview(text), {}
        group = np.fromiter((known.setdefault(raw[a : a + n].tobytes(), len(known)) for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)), np.int64, len(rows))
        order = np.lexsort((rows["doc"], group))
        chosen = order[grouped(group[order])]
        later = rows["doc"] > rows["doc"][chosen][group]
        # Equal windows have the same least gram: a piece that is alone with its own needs no sorting.
        known = {}
        same = np.fromiter((known.setdefault(raw[a : a + gram].tobytes(), len(known)) for a in (begin + rows["gram"])[chosen].tolist()), np.int64, len(chosen))
        sorted_ = np.flatnonzero(np.bincount(same)[same] > 1)
        del known
        if not len(sorted_):
            return rows[later][list(RUN.names)].astype(RUN)
        some = chosen[sorted_]
        windows = lengths[some] - width + 1
        start = np.cumsum(lengths[some]) - lengths[some]
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        piece = np.repeat(np.arange(len(some)), windows)
        copies = first_copies(gather(text, begin[some], lengths[some]), rows["doc"][some][piece], start[piece] + inner, width)
        new = copies.copy()
        new[1:] &= ~copies[:-1] | (piece[1:] != piece[:-1])
        last = copies.copy()
        last[:-1] &= ~copies[1:] | (piece[1:] != piece[:-1])
        at, end = np.flatnonzero(new), np.flatnonzero(last)
        count = np.bincount(sorted_[piece[at]], minlength=len(chosen))
        same = np.flatnonzero(~later)
        each = count[group[same]]
        span = np.repeat((np.cumsum(count) - count)[group[same]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        own = np.repeat(same, each)
        out = np.empty(len(own), RUN)
        out["doc"], out["at"] = rows["doc"][own], rows["at"][own] + inner[at[span]]
        out["length"] = (end - at)[span] + width
        return np.concatenate((rows[later][list(RUN.names)].astype(RUN), out))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        found, size = [], 0  # of several ranges, so that rows sent don't multiply with ranges

        def back() -> pa.RecordBatch:
            rows = np.concatenate(found)
            return batch_of([(p, True, b) for p, b in dealt(rows["doc"] % parts, rows)])

        for batch in batches:
            for known, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if known:
                    found.append(unpacked(payload, RUN))
                    size += found[-1].nbytes
                    if size >= FLUSH_BYTES:
                        yield back()
                        found, size = [], 0
                else:
                    held.append(_unpack(payload))
        if held:
            rows, text = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            begin = np.cumsum(rows["length"].astype(np.int64)) - rows["length"]
            order = np.argsort(rows["range"], kind="stable")
            for a, b in spans_of(grouped(rows["range"][order]), len(order)):
                found.append(flagged(rows[order[a:b]], text, begin[order[a:b]]))
                size += found[-1].nbytes
                if size >= FLUSH_BYTES:
                    yield back()
                    found, size = [], 0
        if size:
            yield back()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(x, RUN) for batch in batches for x in batch.column(2)]
        rows = np.concatenate(got) if got else np.zeros(0, RUN)
        rows = rows[np.lexsort((rows["at"], rows["doc"]))]
        spans = np.empty(len(rows), SPAN)
        spans["at"], spans["length"] = rows["at"], rows["length"]
        first = grouped(rows["doc"])
        lists = [spans[a:b].tobytes() for a, b in spans_of(first, len(rows))]
        for i in range(0, len(first), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][first[i : i + 20_000]]), pa.array(lists[i : i + 20_000], pa.binary())], names=["doc_id", "spans"])

    some, _ = parted(documents, anchors)
    pieces_ = some.join(anchors, "doc_id").select("doc_id", "text", "base", "anchors").mapInArrow(ask, PACKED)
    found = pieces_.repartitionById(TASKS * parts, "part").mapInArrow(answer, PACKED)
    return found.repartitionById(parts, "part").mapInArrow(collect, "doc_id long, spans binary")


def suffix_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes) of every row.

    Removed is each byte covered by a ``width``-byte string that also starts in a document of smaller
    id; strings are judged on the input and never cross documents.  Null texts are empty.  Rows without
    an id are judged against nothing; rows that repeat an id belong to one document, and each is cut by
    its own text.
    """
    prepared(documents.sparkSession)
    given = with_bases(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "bytes")
    own = given.where("doc_id IS NOT NULL")
    anchors = written(shared_anchors(own, byte_units, width, TASKS, sides=True), "byte-anchors")
    spans = written(copied_runs(own, anchors, width), "byte-spans")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in RESULT.items()), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, spans_ = numbers(batch, "base"), batch.column(3)
            for start, stop, data, offsets in pieces(texts(batch)):
                removed = marked(spans_, offsets, start, bases, SPAN)
                heads = removed.copy()
                heads[1:] &= ~removed[:-1]
                inner = offsets[:-1][offsets[:-1] < offsets[1:]]
                heads[inner] = removed[inner]
                gone = np.concatenate(([0], np.cumsum(removed)))[offsets]
                runs = np.concatenate(([0], np.cumsum(heads)))[offsets]
                kept = data[~removed]
                raw, bounds = memoryview(kept), offsets - gone
                left = [raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(np.diff(offsets)), pa.array(np.diff(gone)), pa.array(np.diff(runs)),
                     pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array(left, pa.binary())],
                    names=schema.names,
                )

    return with_found(given, spans, "spans").select("doc_id", "text", "base", "spans").mapInArrow(cut, schema)


def op8_difference_cover_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(table(spark, folder, "documents")).drop("kept")
