"""Exact search for windows that start in an earlier document, in two packed exchanges.

A *window* is a run of ``window`` units (words or bytes) of one document.  Both users (substring
removal by words and by bytes) first ask which winnowing anchors occur in more than one document:
every window holds at least one anchor, so windows without a shared anchor are unique and never travel.

Records travel packed, many to a row, by a range of their hash.  Each task first merges what it holds
itself, so that a hash that a third of all documents share is sent at most twice by each task: no key
range grows with the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelab.llm.common import dealt, grouped, numbers, packed, parted, parts_of, prepared, spans_of, texts, unpacked, written
from quotelab.llm.tokens import PIECE_BYTES, Words, documents_of, mixed, pieces, sliding_minimum, whole_windows, window_hashes, winnowed

U64 = np.uint64
#: ``hash``: the upper 44 bits of a hash of the anchor; equal ones by chance only send a text in vain.
ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8")])
MARK = np.dtype([("doc", "<i8"), ("mark", "<u4")])
#: Bits of a sorted hash that number the document among those a task has gathered.
UNSENT_BITS = U64(20)
#: Bits of a gram's hash that give way to its place, and a factor that tells a gram's sides apart.
PLACE = U64(2**32 - 1)
SIDE_BASE = U64(0x9FB21C651E98DF25)
PACKED = "part int, shared boolean, payload binary"
#: Text that a task gathers before it merges and sends.
FLUSH_BYTES = 32 << 20
#: Text whose units are bytes is worked on in pieces whose arrays stay in the cache.
BYTE_PIECES = 256 << 10

Units = Callable[[np.ndarray, np.ndarray], Words]


def _batch(part: list, shared: list, payload: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(shared, pa.bool_()), pa.array(payload, pa.binary())],
        names=["part", "shared", "payload"],
    )


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Key range of a hash, from its upper half."""
    return ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def anchors_of(units: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a batch's anchors: winnowed grams of half a window.

    Gram and sliding width add up to ``window + 1`` units, so each whole window holds an anchor.
    """
    gram = window // 2
    total = len(units.hashes)
    grams = window_hashes(units.hashes, gram)
    good = whole_windows(units.first, gram, total)
    grams[~good] = U64(2**64 - 1)
    at = np.flatnonzero(winnowed(grams, window - gram + 1) & good)
    return at, grams[at]


@dataclass
class Runs:
    """Windows one after another whose least gram is the same one, at ``anchor``: those from ``at`` to ``cut``
    reach far enough before it, those from ``cut`` to ``stop`` far enough behind it."""

    doc: np.ndarray
    at: np.ndarray
    cut: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    before: np.ndarray
    behind: np.ndarray

    def halves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of what all windows of a half have in common, and which runs have that half."""
        yield self.before, self.at < self.cut
        yield self.behind, self.cut < self.stop


def runs_of(units: Words, window: int) -> Runs:
    """The windows of consecutive texts by the first of their least grams of half a window.

    Of what a window holds besides that gram, at least half, rounded up, lies on one side of it: windows that
    are equal agree in the gram with what is on this side, and far fewer texts share these than share the
    gram alone.  The two are known by two grams that overlap.
    """
    gram, total = window // 2, len(units.hashes)
    grams = window_hashes(units.hashes, gram)
    n = max(0, total - window + 1)
    least = sliding_minimum((grams & ~PLACE) | np.arange(len(grams), dtype=U64), window - gram + 1) & PLACE
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    first = units.first
    for x in (first[:-1], np.maximum(first[:-1], first[1:] - window + 1)):
        new[x[x < n]] = True
    at = np.flatnonzero(new)
    stop = np.append(at[1:], n)[: len(at)]
    doc = np.searchsorted(first, at, "right") - 1
    whole = at + window <= first[doc + 1]
    at, stop, doc = at[whole], stop[whole], doc[whole]
    anchor = least[at].astype(np.int64)
    side = -(-(window - gram) // 2)
    cut = np.clip(anchor - side + 1, at, stop)
    # Where a run lacks a half, its hash is of other units and not used.
    own = grams[anchor] * SIDE_BASE
    before = mixed(own + grams[np.maximum(anchor - side, 0)])
    behind = mixed((own ^ SIDE_BASE) + grams[np.minimum(anchor + side, max(len(grams) - 1, 0))])
    return Runs(doc, at, cut, stop, anchor, grams[anchor], before, behind)


def marks(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The 32 bits that tell a document's anchors apart, behind the number of the document in its batch."""
    return (docs.astype(U64) << U64(32)) | (mixed(hashes) >> U64(32))


def shared_marks(lists: pa.Array, start: int, stop: int) -> np.ndarray:
    """Ascending ``marks`` of the shared anchors of a slice's documents."""
    values = [np.frombuffer(lists[d].as_buffer(), np.uint32) for d in range(start, stop)]
    docs = np.repeat(np.arange(len(values), dtype=U64), [len(x) for x in values])
    return np.sort((docs << U64(32)) | np.concatenate(values).astype(U64)) if values else np.zeros(0, U64)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to send of distinct ``rows`` in order of hash and document, and those already known to be shared.

    A hash held by one document is sent once.  Of one that more hold, the two outer documents are
    sent, which tells the receiver that it is shared, and all holders are known here.
    """
    if not len(rows):  # no text as long as a window
        return rows, rows
    at = grouped(rows["hash"])
    size = np.diff(np.append(at, len(rows)))
    outer = np.zeros(len(rows), bool)
    outer[at] = outer[at + size - 1] = True
    return rows[outer], rows[np.repeat(size > 1, size) & ~outer]


def with_bases(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` (with ``doc_id`` and ``text``) and ``base``: where the row's coordinates begin.

    An id is one document.  When its rows hold different texts, these lie one behind the other, with a
    gap, on one line of coordinates, so that spans of one text never mark another; equal texts share
    theirs.  ``base`` is 0 wherever an id has one text.  An id whose texts exceed 2^31 bytes in all fails.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keys = documents.where("doc_id IS NOT NULL").select("doc_id", mark.alias("mark"), size.alias("size"))
    several = keys.groupBy("doc_id").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("doc_id")
    several = written(several, f"{name}-several-texts")
    if several.isEmpty():
        return documents.withColumn("base", F.lit(0))
    lines = keys.join(several, "doc_id").groupBy("doc_id", "mark").agg(F.max("size").alias("size"))
    end = F.sum("size").over(Window.partitionBy("doc_id").orderBy("mark")).cast("int")
    lines = written(lines.select("doc_id", "mark", (end - F.col("size")).cast("int").alias("base")), f"{name}-bases")
    placed = documents.withColumn("mark", mark).join(lines, ["doc_id", "mark"], "left")
    return placed.select(*documents.columns, F.coalesce("base", F.lit(0)).alias("base"))


def shared_anchors(documents: DataFrame, units: Units, window: int, tasks: int = 1, sides: bool = False) -> DataFrame:
    """``doc_id, anchors``: packed marks of the document's anchors that other documents hold too.

    Hashes are compared in ``tasks`` tasks for each shuffle partition of the session.  With ``sides`` it is
    the least grams of windows with what is before or behind them (``runs_of``) that are compared.
    """
    owners = parts_of(documents.sparkSession)
    parts = tasks * owners

    def sent(hashes: list[np.ndarray], docs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        names, number = np.unique(np.concatenate(ids), return_inverse=True)
        # One number for hash and document, sorted; hashes in order are also in order of their parts.
        mask = U64((1 << int(UNSENT_BITS)) - 1)
        keys = np.concatenate(hashes)
        hashes.clear()
        keys &= ~mask
        keys |= number.astype(U64)[np.concatenate(docs)]
        docs.clear()
        keys.sort()
        keys = keys[grouped(keys)]
        rows = np.empty(len(keys), ANCHOR)
        rows["hash"], rows["doc"] = keys >> UNSENT_BITS, names[(keys & mask).astype(np.int64)]
        del keys
        send, known = _split(rows)
        part = part_of(send["hash"] << UNSENT_BITS, parts)
        at = grouped(part)
        out = [(int(part[a]), False, packed(send[a:b])) for a, b in spans_of(at, len(part))]
        out += [(p, True, b) for p, b in dealt(known["doc"] % parts, known)]
        return _batch(*map(list, zip(*out, strict=True))) if out else _batch([], [], [])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, ids, size, count = [], [], [], 0, 0
        for batch in batches:
            given = numbers(batch, "doc_id")
            for start, stop, data, offsets in pieces(texts(batch), BYTE_PIECES if sides else PIECE_BYTES):
                some = units(data, offsets)
                if sides:
                    runs = runs_of(some, window)
                    for values, has in runs.halves():
                        hashes.append(mixed(values[has]))
                        docs.append((runs.doc[has] + count).astype(np.int32))
                else:
                    at, values = anchors_of(some, window)
                    # Anchors are minima, so their hashes are small: they are spread by a hash of the hash.
                    hashes.append(mixed(values))
                    docs.append((documents_of(some.first)[at] + count).astype(np.int32))
                ids.append(given[start:stop])
                size, count = size + len(data), count + stop - start
                if size >= FLUSH_BYTES or count >= 1 << int(UNSENT_BITS) - 1:
                    yield sent(hashes, docs, ids)
                    hashes, docs, ids, size, count = [], [], [], 0, 0
        if ids:
            yield sent(hashes, docs, ids)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = [], []
        for batch in batches:
            for shared, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                (known if shared else asked).append(unpacked(payload, ANCHOR))
        if not asked:
            return
        rows = np.concatenate(asked)
        del asked
        rows = rows[np.argsort(rows["hash"])]
        at = grouped(rows["hash"])
        if len(rows):
            several = np.minimum.reduceat(rows["doc"], at) != np.maximum.reduceat(rows["doc"], at)
            known.append(rows[np.repeat(several, np.diff(np.append(at, len(rows))))])
        rows = np.concatenate(known) if known else rows
        found = np.empty(len(rows), MARK)
        found["doc"], found["mark"] = rows["doc"], rows["hash"] >> (U64(32) - UNSENT_BITS)
        del rows
        for p, b in dealt(found["doc"] % owners, found):
            yield _batch([p], [True], [b])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(x, MARK) for batch in batches for x in batch.column(2)]
        rows = np.concatenate(got) if got else np.zeros(0, MARK)
        del got
        rows = rows[np.argsort(rows["doc"])]
        at = grouped(rows["doc"])
        mark = np.ascontiguousarray(rows["mark"])
        lists = [mark[a:b].tobytes() for a, b in spans_of(at, len(rows))]
        for i in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"][at[i : i + 20_000]]), pa.array(lists[i : i + 20_000], pa.binary())],
                names=["doc_id", "anchors"],
            )

    asked = documents.select("doc_id", "text").mapInArrow(ask, PACKED)
    found = asked.repartitionById(parts, "part").mapInArrow(answer, PACKED)
    return found.repartitionById(owners, "part").mapInArrow(gather, "doc_id long, anchors binary")


#: ``check`` is a second hash: with it, equal windows agree on 96 bits.
WINDOW = np.dtype([("doc", "<i8"), ("at", "<i4"), ("hash", "<u8"), ("check", "<u4")])
COPY = np.dtype([("doc", "<i8"), ("at", "<i4"), ("from_doc", "<i8"), ("from_at", "<i4")])
SPANS = np.dtype([("at", "<i4"), ("length", "<i4"), ("from_doc", "<i8"), ("from_at", "<i4")])


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the smallest document that has their hash, and all others as copies of its first."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["check"], rows["hash"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    at = np.flatnonzero(new)
    source = rows[np.repeat(at, np.diff(np.append(at, len(rows)))[: len(at)])]
    later = rows["doc"] > source["doc"]
    copies = np.empty(int(later.sum()), COPY)
    for name, values in zip(COPY.names, (rows["doc"], rows["at"], source["doc"], source["at"]), strict=True):
        copies[name] = values[later]
    return rows[~later], copies


def copied_spans(documents: DataFrame, anchors: DataFrame, units: Units, window: int) -> DataFrame:
    """``doc_id, spans``: packed runs of windows that also start in a document of smaller id.

    Places count from the ``base`` of a text.
    A run is compacted while its source runs along with it: window ``i`` of a span lies ``i`` units
    behind the span's start both in the document and in the source.
    """
    parts = parts_of(documents.sparkSession)

    def sent(rows: list[np.ndarray]) -> pa.RecordBatch:
        send, copies = _first(np.concatenate(rows))
        out = [(p, False, b) for p, b in dealt(part_of(send["hash"], parts), send)]
        out += [(p, True, b) for p, b in dealt(copies["doc"] % parts, copies)]
        return _batch(*map(list, zip(*out, strict=True))) if out else _batch([], [], [])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = numbers(batch, "doc_id")
            bases = numbers(batch, "base")
            lists = batch.column(batch.schema.get_field_index("anchors"))
            for start, stop, data, offsets in pieces(texts(batch)):
                some = units(data, offsets)
                total = len(some.hashes)
                at, hashes = anchors_of(some, window)
                owner = documents_of(some.first)
                wanted = np.zeros(total + 1, np.int64)
                mine = at[among(marks(hashes, owner[at]), shared_marks(lists, start, stop))]
                np.add.at(wanted, np.maximum(mine - (window - window // 2), 0), 1)  # windows that hold it
                wanted[mine + 1] -= 1
                good = whole_windows(some.first, window, total)
                where = np.flatnonzero((np.cumsum(wanted)[: len(good)] > 0) & good)
                rows = np.empty(len(where), WINDOW)
                rows["hash"] = window_hashes(some.hashes, window)[where]
                rows["check"] = window_hashes(mixed(some.hashes), window)[where] >> U64(32)
                rows["doc"] = ids[start + owner[where]]
                rows["at"] = where - some.first[owner[where]] + bases[start + owner[where]]
                held.append(rows)
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            for part, shared, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                if shared.as_py():
                    yield _batch([part.as_py()], [True], [payload.as_py()])
                else:
                    asked.append(unpacked(payload, WINDOW))
        if asked:
            _, copies = _first(np.concatenate(asked))
            del asked
            for p, b in dealt(copies["doc"] % parts, copies):
                yield _batch([p], [True], [b])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(x, COPY) for batch in batches for x in batch.column(2)]
        rows = np.concatenate(got) if got else np.zeros(0, COPY)
        del got
        rows = rows[np.lexsort((rows["at"], rows["doc"]))]
        if not len(rows):
            return
        new = np.ones(len(rows), bool)
        new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["at"][1:] != rows["at"][:-1] + 1)
        new[1:] |= (rows["from_doc"][1:] != rows["from_doc"][:-1]) | (rows["from_at"][1:] != rows["from_at"][:-1] + 1)
        at = np.flatnonzero(new)
        spans = np.empty(len(at), SPANS)
        spans["at"], spans["from_doc"], spans["from_at"] = rows["at"][at], rows["from_doc"][at], rows["from_at"][at]
        spans["length"] = np.diff(np.append(at, len(rows))) + window - 1
        docs = rows["doc"][at]
        first = grouped(docs)
        lists = [spans[a:b].tobytes() for a, b in spans_of(first, len(docs))]
        for i in range(0, len(first), 20_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[first[i : i + 20_000]]), pa.array(lists[i : i + 20_000], pa.binary())],
                names=["doc_id", "spans"],
            )

    some, _ = parted(documents, anchors)
    asked = some.join(anchors, "doc_id").select("doc_id", "text", "base", "anchors").mapInArrow(ask, PACKED)
    found = asked.repartitionById(parts, "part").mapInArrow(answer, PACKED)
    return found.repartitionById(parts, "part").mapInArrow(gather, "doc_id long, spans binary")


def all_spans(documents: DataFrame, units: Units, window: int, name: str) -> DataFrame:
    """Written table ``doc_id, spans`` of ``documents`` (``doc_id, text, base``; ``doc_id`` not null)."""
    prepared(documents.sparkSession)
    anchors = written(shared_anchors(documents, units, window), f"{name}-anchors")
    return written(copied_spans(documents, anchors, units, window), f"{name}-spans")
