"""Token packing with bounded space.

Each task keeps at most ``open_windows`` unfinished sequences.  A document's piece goes to the fullest
of them that still holds it (best fit); when none does and all places are taken, the fullest is
emitted.  Sequences that a task leaves unfinished are merged afterwards in groups of tasks, by the same
rule.  Only placements travel, never token ids, so that memory and shuffles stay small.

Tokens come from a public tokenizer file.  It drops white space and splits texts before it
merges, so a text's ids are those of its units in order: each distinct unit is tokenized once by a
worker and the rest is lookup.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm.common import numbers, prepared, table, texts, written
from quotelab.llm.tokens import Words, nonspace_bytes, pieces, words_of

LENGTH = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: A gap of fewer tokens is padded rather than filled with the head of a cut document.
LEAST_CUT = 32
#: Unfinished sequences of so many tasks are merged by one task.
MERGE_TASKS = 64
#: Distinct units whose ids a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, finished boolean"


def token_units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Units that the tokenizer's own splitting never joins, so that each has its ids for itself.

    A blank-separated chunk is cut between letters, single digits and other signs.  Letters are those
    of ASCII and the two-byte Latin ones; a chunk with an apostrophe (the splitter binds endings like
    ``'s``) or with any other character stays whole.  The splitter ignores case, so units are lower-cased.
    """
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    kind = np.where(letter, 1, 3).astype(np.uint8)
    kind[0x30:0x3A] = 2
    kind[nonspace_bytes() == 0] = 0
    kinds = kind[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = 1
    odd = (data == 0x27) | ((data >= 0x80) & (kinds != 1))
    chunks = words_of(data, offsets, nonspace_bytes())
    strange = np.concatenate(([0], np.cumsum(odd)))
    whole = strange[chunks.ends] > strange[chunks.starts]
    for start, end in zip(chunks.starts[whole].tolist(), chunks.ends[whole].tolist(), strict=True):
        kinds[start:end] = 4
    cut = np.zeros(len(data), bool)
    cut[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    return words_of(data, offsets, nonspace_bytes(), lower=True, cut=cut)


class ChunkTokenizer:
    """Token ids of whole texts from ids of their units, each distinct unit tokenized once."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that are one id wherever they stand, and part the text around them.
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.found = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        got = []
        for i in range(0, len(units), 2000):
            got += [e.ids for e in self.tokenizer.encode_batch(units[i : i + 2000], add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, ids))
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate((self.first, first))[order]
        self.count = np.concatenate((self.count, count))[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and where each text's ids begin (one entry more than texts)."""
        raw = data.tobytes()
        if not self.found.search(raw):
            return self._encode(data, offsets)
        # Texts are parted at special strings; the parts are encoded like texts and joined by their ids.
        starts, stops, owner, special = [], [], [], []
        for text, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for hit in self.found.finditer(raw, start, stop):
                starts.append(start)
                stops.append(hit.start())
                owner.append(text)
                special.append(self.special[hit[0]])
                start = hit.end()
            starts.append(start)
            stops.append(stop)
            owner.append(text)
            special.append(-1)
        parts = b"".join(raw[a:b] for a, b in zip(starts, stops, strict=True))
        sizes = np.array(stops) - np.array(starts)
        ids, at = self._encode(np.frombuffer(parts, np.uint8), np.concatenate(([0], np.cumsum(sizes))).astype(offsets.dtype))
        ends = np.flatnonzero(np.array(special) >= 0)
        ids = np.insert(ids, at[ends + 1], np.array(special, np.int64)[ends].astype(np.uint32))
        per_text = np.bincount(owner, np.diff(at) + (np.array(special) >= 0), len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = token_units(data, offsets)
        distinct, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.remembered:
            self.clear()
        slot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[slot] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            raw = words.data.tobytes()
            spans = zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist(), strict=True)
            self._learn(distinct[new], [raw[a:b].decode() for a, b in spans])
        slot = np.searchsorted(self.keys, distinct)[inverse]
        count = self.count[slot]
        ends = np.cumsum(count)
        take = np.repeat(self.first[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[take], np.concatenate(([0], ends))[words.first]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker: what it has learnt serves later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


class Windows:
    """A bounded set of open sequences; placements of finished ones go to ``done``."""

    def __init__(self, length: int, most: int, least_cut: int) -> None:
        self.length, self.most, self.least_cut = length, most, least_cut
        self.open: list[tuple[int, int]] = []  # (free tokens, number), sorted
        self.held: dict[int, list[tuple]] = {}
        self.number = 0
        self.done: list[tuple[int, list[tuple]]] = []

    def _start(self) -> int:
        self.number += 1
        self.held[self.number] = []
        return self.number

    def _close(self, number: int) -> None:
        self.done.append((number, self.held.pop(number)))

    def _put(self, number: int, free: int, piece: tuple, size: int) -> None:
        self.held[number].append((piece, self.length - free))
        if size == free:
            self._close(number)
        else:
            insort(self.open, (free - size, number))

    def place(self, size: int, cut) -> None:
        """Place ``size`` tokens; ``cut(a, b)`` makes the piece of tokens ``a`` to ``b``."""
        at = 0
        while size - at >= self.length:
            self._put(self._start(), self.length, cut(at, at + self.length), self.length)
            at += self.length
        while at < size:
            rest = size - at
            fit = bisect_left(self.open, (rest, 0))
            if fit < len(self.open):
                free, number = self.open.pop(fit)
                self._put(number, free, cut(at, size), rest)
                return
            if len(self.open) < self.most:
                self._put(self._start(), self.length, cut(at, size), rest)
                return
            free, number = self.open.pop(0)  # none fits: the fullest leaves
            if free >= self.least_cut:
                self._put(number, free, cut(at, at + free), free)
                at += free
            else:
                self._close(number)


def _table_of(rows: list[tuple], task: int, base: int, finished: bool) -> pa.RecordBatch:
    """``rows``: (sequence number, [((doc_id, start, length, crc, doc_tokens), offset), ...])."""
    flat = [(*piece, base + number, offset, task, finished) for number, held in rows for piece, offset in held]
    columns = list(zip(*flat, strict=True)) if flat else [[]] * 9
    kinds = [pa.int64()] * 8 + [pa.bool_()]
    names = [c.split()[0] for c in PLACED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(
    documents: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    least_cut: int = LEAST_CUT,
) -> DataFrame:
    """One row per piece: its document, place in the document, sequence and offset in it.

    Every id of every document, with ``end_id`` behind each, lies in one piece; a null or empty text is
    the end id alone.  Rows are packed one by one, so repeated rows are packed repeatedly; other
    columns take no part.  ``sequence_id`` is unique, offsets in a sequence have no gaps.
    """
    from pyspark import TaskContext

    prepared(documents.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunks = TaskContext.get().partitionId(), tokenizer_of(tokenizer)
        windows = Windows(length, open_windows, least_cut)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for start, stop, data, offsets in pieces(texts(batch)):
                ids, begins = chunks.encode(data, offsets)
                for d in range(stop - start):
                    own = np.append(ids[begins[d] : begins[d + 1]], np.uint32(end_id)).astype("<u4")
                    windows.place(len(own), lambda a, b, own=own, d=d: (column[start + d], a, b - a, zlib.crc32(own[a:b].tobytes()), len(own)))
                yield _table_of(windows.done, task, task << 32, True)
                windows.done = []
        left = sorted(windows.held.items())
        yield _table_of(left, task, task << 32, False)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = written(rows.mapInArrow(first, PLACED), "placed")

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(length, open_windows, length + 1)  # no cuts: checksums stay as they are
        out = []
        sizes = left.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        runs = {k: v.sort_values("offset") for k, v in left.groupby("sequence_id")}
        for sequence, size in sizes.items():  # an unfinished sequence moves as a whole
            windows.place(int(size), lambda a, b, sequence=sequence: sequence)
        for number, held in [*windows.done, *sorted(windows.held.items())]:
            for sequence, offset in held:
                run = runs[sequence]
                out.append(run.assign(sequence_id=(1 << 62) + (int(key[0]) << 32) + number, offset=run["offset"] + offset, finished=True))
        return pd.concat(out) if out else left

    groups = placed.where("NOT finished").withColumn("_group", F.expr(f"task div {MERGE_TASKS}"))
    merged = groups.groupBy("_group").applyInPandas(lambda key, left: merge(key, left.drop(columns="_group")), PLACED)
    return placed.where("finished").unionByName(merged).drop("task", "finished")


def op2_bounded_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
