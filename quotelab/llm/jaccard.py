"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents of equal shingle sets are one row of the matrix.  Two rows whose Jaccard similarity reaches
the threshold share a column among the first ``size - ceil(t * size) + 1`` of each, in any fixed order
of the columns; the order puts rare ones first (by a fixed-size table of counts over all documents), so
the product of those parts has few entries per column.  It is computed by blocks of columns; overlap
counts are accumulated per pair, and pairs whose sizes or column positions already rule the threshold
out are dropped.

Before any set travels, candidate pairs meet by parity sketches, one bit for each column of a set: two
sets differ in at least as many columns as their sketches do in bits, so whoever differs in too many is
out.  What is left goes through the product block by block; after each block a pair whose count and what
the sizes still allow stay below the bound is discarded, and the last block makes the count exact.

Components need no pair twice: first each row is compared with the smallest row it shares a column with,
keeping the partner of largest overlap; then only pairs that still lie in different components follow,
all of them, so no link is lost and a group of copies never expands into all its pairs.  Where many rows
share a column, their sketches are compared inside tasks, block against block, and only pairs that may link
become rows; of these each row's likeliest go first, and what that joins is not compared any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm.common import dealt, distinct, grouped, parted, parts_of, prepared, table, texts, unpacked, written
from quotelab.llm.components import components
from quotelab.llm.first_copy import part_of
from quotelab.llm.tokens import documents_of, mixed, nonspace_bytes, pieces, whole_windows, window_hashes, words_of

U64 = np.uint64
SHINGLE = 5
PERCENT = 80
#: Columns are ordered by counts in a table of 2**18 cells; its size does not depend on the data.
CELL_BITS = 18
SLICES = 16
FLUSH_BYTES = 32 << 20
#: Column blocks of the product.
BLOCKS = 4
#: A row that very many pairs name is dealt to this many tasks, each with its own copy of the row's set.
SALTS = 64

#: Rows that share a column are compared pair by pair in a join up to this number, beyond it block by block inside tasks.
FEW, BLOCK_ROWS = 16, 1024

POSTING = np.dtype([("node", "<u8"), ("at", "<i4"), ("hash", "<u8"), ("size", "<i4")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin.

    A text of fewer than ``k`` words (and not none) has its whole word sequence as its one shingle.
    """
    words = words_of(data, offsets, nonspace_bytes(), lower=True)
    total, owner = len(words.hashes), documents_of(words.first)
    good = whole_windows(words.first, k, total)
    hashes, docs = window_hashes(words.hashes, k)[good], owner[: len(good)][good]
    count = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            hashes = np.concatenate((hashes, mixed(window_hashes(words.hashes, n)[words.first[short]] + U64(n))))
            docs = np.concatenate((docs, short))
    order = np.argsort(hashes)
    order = order[np.argsort(docs[order], kind="stable")]
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], np.searchsorted(docs[new], np.arange(len(offsets)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values modulo 2**64."""
    return np.diff(np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))[first])


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - CELL_BITS)).astype(np.int64)


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set the parity of its columns in as many bits as it has columns, to the next power of two."""
    sizes = np.diff(first)
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(width)))
    owner = documents_of(first)
    bit = begin[owner] + (mixed(hashes) & (width - 1).astype(U64)[owner]).astype(np.int64)
    raw = np.packbits((np.bincount(bit, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def differing_bits(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """In how many bits each two sketches differ, once the wider is folded to the width of the other."""
    out = np.zeros(len(one), np.int64)
    shapes = np.array([(len(x), len(y)) for x, y in zip(one, other, strict=True)]).reshape(-1, 2)
    for wide, narrow in np.unique(shapes, axis=0):
        at = np.flatnonzero((shapes == (wide, narrow)).all(axis=1))
        least = int(min(wide, narrow))
        folded = [
            np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1, least), axis=1)
            for side in (one, other)
        ]
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1)
    return out


def described(documents: DataFrame, k: int) -> DataFrame:
    """One row per document (``cell`` null: id, set size, set digests, sketch), and slices of the count table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "doc_id", "size", "low", "high", "sketch", "counts"]
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for start, stop, data, offsets in pieces(texts(batch)):
                hashes, first = shingle_sets(data, offsets, k)
                counts += np.bincount(cells(hashes), minlength=len(counts))
                n = stop - start
                digests = [sums(mixed(hashes + U64(salt)), first).view(np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int32()), ids.slice(start, n), pa.array(np.diff(first)), *map(pa.array, digests),
                     pa.array(sketches(hashes, first), pa.binary()), pa.nulls(n, pa.binary())],
                    names=names,
                )
        if counts.any():
            slices = [x.tobytes() for x in np.split(counts, SLICES)]
            empty = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), empty, empty, empty, empty, pa.nulls(SLICES, pa.binary()), pa.array(slices, pa.binary())], names=names)

    return documents.select("doc_id", "text").mapInArrow(of, "cell int, doc_id long, size long, low long, high long, sketch binary, counts binary")


def count_table(rows: DataFrame) -> np.ndarray:
    """The summed count table (2 MB at any size of the input)."""

    def add(key: tuple, some: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << CELL_BITS) // SLICES, np.int64)
        for frame in some:
            for x in frame["counts"]:
                total += np.frombuffer(x, np.int64)
        yield pd.DataFrame({"cell": [key[0]], "counts": [total.tobytes()]})

    slices = rows.where("cell IS NOT NULL").select("cell", "counts").groupBy("cell").applyInPandas(add, "cell int, counts binary")
    total = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.int64)
    for cell, counts in slices.collect():
        total[cell] = np.frombuffer(counts, np.int64)
    return total.ravel()


def postings(documents: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """``hash, node, size, at`` of the columns in question that more than one distinct set has."""
    parts = parts_of(documents.sparkSession)
    table_of_counts = documents.sparkSession.sparkContext.broadcast(counts)

    def sent(rows: list[np.ndarray]) -> pa.RecordBatch:
        send = distinct(np.concatenate(rows), "hash", "node")  # equal sets send their columns once
        out = list(dealt(part_of(send["hash"], parts), send))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "payload"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in pieces(texts(batch)):
                hashes, first = shingle_sets(data, offsets, k)
                owner, sizes = documents_of(first), np.diff(first)
                order = np.lexsort((hashes, table_of_counts.value[cells(hashes)], owner))
                node = sums(mixed(hashes + U64(1)), first)
                at = np.arange(len(hashes)) - first[owner]
                some = at <= (sizes - (percent * sizes + 99) // 100)[owner]
                rows = np.empty(int(some.sum()), POSTING)
                rows["hash"], rows["node"] = hashes[order][some], node[owner[some]]
                rows["size"], rows["at"] = sizes[owner[some]], at[some]
                held.append(distinct(rows, "hash", "node"))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(x, POSTING) for batch in batches for x in batch.column(1)]
        if not got:
            return
        rows = np.concatenate(got)
        del got
        rows = rows[np.lexsort((rows["node"], rows["hash"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = rows[new]
        at = grouped(rows["hash"])
        many = np.repeat(np.diff(np.append(at, len(rows))), np.diff(np.append(at, len(rows)))) > 1
        rows = rows[many]
        for i in range(0, len(rows), 50_000):
            x = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(x[c]).view(np.int64) if x[c].dtype == U64 else np.ascontiguousarray(x[c])) for c in ("hash", "node", "size", "at")],
                names=["hash", "node", "size", "at"],
            )

    packed = documents.select("doc_id", "text").mapInArrow(send, "part int, payload binary")
    return packed.repartitionById(parts, "part").mapInArrow(match, "hash long, node long, size int, at int")


def packed_sets(documents: DataFrame, k: int) -> DataFrame:
    """``node, size`` and the set as ``BLOCKS`` packed ranges of its hashes, each ascending."""
    edges = (np.arange(1, BLOCKS, dtype=U64) << U64(32)) // U64(BLOCKS) << U64(32)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(texts(batch)):
                hashes, first = shingle_sets(data, offsets, k)
                columns: list[list[bytes]] = [[] for _ in range(BLOCKS)]
                for a, b in zip(first[:-1], first[1:], strict=True):
                    for column, part in zip(columns, np.split(hashes[a:b], np.searchsorted(hashes[a:b], edges)), strict=True):
                        column.append(part.tobytes())
                node = sums(mixed(hashes + U64(1)), first)
                packed = [pa.array(c, pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(np.diff(first)), *packed],
                    names=["node", "size", *(f"block{i}" for i in range(BLOCKS))],
                )

    return documents.select("text").mapInArrow(of, "node long, size long, " + ", ".join(f"block{i} binary" for i in range(BLOCKS)))


def joined(pairs: DataFrame, rows: DataFrame, x: str, y: str) -> DataFrame:
    """``pairs`` (``a, b``) with the column ``x`` of both nodes, as ``x`` and ``y``.

    ``rows`` has one row per ``node``.  A node that very many pairs name is copied for each of ``SALTS``
    parts of its pairs that there are, so that they spread over as many tasks.
    """
    for side, other, name in (("a", "b", x), ("b", "a", y)):
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
        wanted = salted.select(side, "salt").distinct().join(rows.select(F.col("node").alias(side), F.col(x).alias(name)), side)
        pairs = salted.join(wanted, [side, "salt"]).drop("salt")
    return pairs


def reach(overlap: F.Column, rest: F.Column, sizes: F.Column, percent: int) -> F.Column:
    """Whether ``overlap`` columns in common, and at most ``rest`` more, can make up the threshold."""
    return (overlap + rest) * (100 + percent) >= sizes * percent


ALIKE = "a long, b long, p long, q long, bits long"


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, p, q, bits`` (the sizes, and in how many bits the sketches differ) of pairs that their
    sketches do not rule out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            bits = differing_bits(x, y)
            keep = bits * (100 + percent) <= sizes * (100 - percent)
            columns = [*(batch.column(i).filter(pa.array(keep)) for i in range(4)), pa.array(bits[keep])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "p", "q", "bits"])

    some = joined(pairs.select("a", "b"), classes.select(F.col("low").alias("node"), F.struct("size", "sketch").alias("x")), "x", "y")
    some = some.select("a", "b", F.col("x.size").alias("p"), F.col("y.size").alias("q"), F.col("x.sketch").alias("x"), F.col("y.sketch").alias("y"))
    return some.mapInArrow(of, ALIKE)


def blocks_alike(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """What ``alike`` finds among the pairs of ``rows`` (``hash, node, size, at, component, n``) that share a
    ``hash``, are of different components and of possible sizes and places.

    The ``n`` rows of a hash are cut in blocks.  Each two blocks meet in one task, which compares the sketches
    of all their rows at once; only pairs that may link come out.
    """

    def of(found: pa.Table) -> pa.Table:
        found = found.sort_by("node")
        node, size, at, component, mine, low, high = (found[c].to_numpy() for c in ("node", "size", "at", "component", "mine", "low_block", "high_block"))
        sketch = found["sketch"].to_pylist()
        width = np.array([len(x) for x in sketch])
        out = []
        groups = [(w, b) for w in np.unique(width).tolist() for b in sorted({low[0], high[0]})]
        where = {(w, b): np.flatnonzero((width == w) & (mine == b)) for w, b in groups}
        bits = {key: np.frombuffer(b"".join(sketch[i] for i in rows), np.uint64).reshape(len(rows), -1) for key, rows in where.items()}
        for one in groups:
            for other in groups:
                # No size within the threshold has a sketch so much wider; blocks are compared with the other one.
                if one[0] > other[0] or one[0] * 200 <= other[0] * percent or (low[0] == high[0]) != (one[1] == other[1]):
                    continue
                x, y = where[one], where[other]
                folded = np.bitwise_xor.reduce(bits[other].reshape(len(y), -1, one[0] // 8), axis=1)
                for i, row in zip(x.tolist(), bits[one], strict=True):
                    p, q = int(size[i]), size[y].astype(np.int64)
                    near = (np.minimum(p, q) * 100 >= np.maximum(p, q) * percent) & (component[y] != component[i])
                    near &= np.minimum(p - int(at[i]), q - at[y]) * (100 + percent) >= (p + q) * percent
                    if one[0] == other[0]:
                        near &= node[y] < node[i] if one[1] == other[1] else np.full(len(y), one[1] < other[1])
                    some = np.flatnonzero(near)
                    if len(some):
                        differ = np.bitwise_count(folded[some] ^ row).sum(axis=1).astype(np.int64)
                        good = differ * (100 + percent) <= (p + q[some]) * (100 - percent)
                        j = y[some[good]]
                        a, b = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                        p_, q_ = np.where(node[j] < node[i], p, size[j]), np.where(node[j] < node[i], size[j], p)
                        out.append(np.stack((a, b, p_, q_, differ[good]), axis=1))
        all_ = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pa.table({name: all_[:, c] for c, name in enumerate(("a", "b", "p", "q", "bits"))})

    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    cut = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumns({"low_block": F.least("mine", "other"), "high_block": F.greatest("mine", "other")})
    cut = cut.join(classes.select(F.col("low").alias("node"), "sketch"), "node")
    cut = cut.select("hash", "node", "size", "at", "component", "sketch", "mine", "low_block", "high_block")
    return cut.groupBy("hash", "low_block", "high_block").applyInArrow(of, ALIKE).distinct()


def overlaps(x: pa.Array, y: pa.Array) -> np.ndarray:
    """How many columns each row of two lists of packed, ascending hashes has in common: one sparse
    product of the two blocks, of which only the diagonal, the pairs asked for, is formed."""
    row, column = [], []
    for side in (x, y):
        offsets = np.frombuffer(side.buffers()[1], np.int32)[side.offset : side.offset + len(side) + 1].astype(np.int64)
        raw = side.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        row.append(np.repeat(np.arange(len(side)), np.diff(offsets) // 8))
        column.append(np.frombuffer(data.tobytes(), U64))
    row, column = np.concatenate(row), np.concatenate(column)
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    both = (row[1:] == row[:-1]) & (column[1:] == column[:-1])
    return np.bincount(row[1:][both], minlength=len(x))


def verified(left: DataFrame, documents: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``left`` (written, from ``alike``) whose whole sets reach the threshold.

    Overlaps are added up block of columns by block; a pair is discarded as soon as its count and what
    the rest of its sets allows stay below the bound.  Each block is a job of its own, so that only its
    part of the sets is in exchange files.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            seen = [pa.array(np.diff(np.frombuffer(z.buffers()[1], np.int32)[z.offset : z.offset + len(z) + 1]) // 8, pa.int64()) for z in (x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlaps(x, y), pa.int64()), *seen], names=["a", "b", "more", "seen_p", "seen_q"])

    asked = left.select(F.col("a").alias("low")).union(left.select("b")).distinct()
    asked = written(asked, "asked")
    ids = written(classes.join(asked, "low", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "asked-ids")
    sets = packed_sets(parted(documents, ids)[0], k)
    # Rows that repeat an id have its sets repeatedly, one is enough; sets of no pair are left out.
    sets = sets.join(asked.withColumnRenamed("low", "node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets, "sets")
    left = left.select("a", "b", F.col("p").alias("rest_p"), F.col("q").alias("rest_q"), (F.col("p") + F.col("q")).alias("sizes"), F.lit(0).cast("long").alias("overlap"))
    for i in range(BLOCKS):
        both = joined(left.select("a", "b"), sets.select("node", F.col(f"block{i}").alias("x")), "x", "y")
        counted = both.select("a", "b", "x", "y").mapInArrow(of, "a long, b long, more long, seen_p long, seen_q long")
        left = left.join(counted, ["a", "b"]).select(
            "a", "b", (F.col("rest_p") - F.col("seen_p")).alias("rest_p"), (F.col("rest_q") - F.col("seen_q")).alias("rest_q"),
            "sizes", (F.col("overlap") + F.col("more")).alias("overlap"),
        )
        left = written(left.where(reach(F.col("overlap"), F.least("rest_p", "rest_q"), F.col("sizes"), percent)), f"overlaps-{i}")
    return left.select("a", "b")


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of each row's pairs the one whose sketches differ least for their sizes."""
    entry = F.struct((F.col("bits") / (F.col("p") + F.col("q"))).alias("share"), "a", "b", "p", "q", "bits")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end"), entry.alias("entry"))
    return ends.groupBy("end").agg(F.min("entry").alias("entry")).select("entry.*").drop("share").distinct()


def still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose rows have not come into one component."""
    for side in ("a", "b"):
        name = labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        pairs = pairs.join(name, side, "left").withColumn(f"{side}_in", F.coalesce(f"{side}_in", side))
    return pairs.where("a_in <> b_in").drop("a_in", "b_in")


def possible(one: str, other: str, percent: int) -> F.Column:
    """Whether sizes and the positions of a shared column leave the threshold within reach."""
    x, y = F.col(f"{one}.size").cast("long"), F.col(f"{other}.size").cast("long")
    rest = F.least(x - F.col(f"{one}.at"), y - F.col(f"{other}.at"))
    # A shared column at these places, where it is the first one, leaves at most ``rest`` in common.
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & reach(F.lit(0), rest, x + y, percent)


def jaccard_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents``.

    Two documents link when ``100 * intersection >= percent * union`` of their distinct ``k``-word
    shingles (lower-cased words); ``component_id`` is the smallest ``doc_id`` reachable by links.  Null,
    empty and blank texts have no shingles and stay alone.  Rows without ``doc_id`` come back unlinked;
    repeated rows come back repeatedly.  Other columns take no part.
    """
    prepared(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(described(documents, k), "described")
    sizes = rows.where("cell IS NULL").drop("cell", "counts")
    named = sizes.where("doc_id IS NOT NULL")
    classes = named.where("size > 0").groupBy("low", "high", "size").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    found = postings(documents.where("doc_id IS NOT NULL"), count_table(rows), k, percent)
    lists = found.join(classes.select(F.col("low").alias("node"), "doc"), "node")
    lists = written(lists, "postings")

    # Copies mostly follow what they were made from: the smallest document is the likeliest partner.
    heads = lists.groupBy("hash").agg(F.min(F.struct("doc", "node", "size", "at")).alias("h"))
    heads = heads.select("hash", "h.*")
    met = lists.alias("p").join(heads.alias("q"), "hash").where(F.struct("p.doc", "p.node") > F.struct("q.doc", "q.node"))
    met = met.where(possible("p", "q", percent)).groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count("*").alias("n"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("n", F.negative("b"))).alias("b"))
    best = written(best, "first-pairs")
    links = verified(written(alike(best, classes, percent), "alike"), documents, classes, k, percent)

    labels = components(links)
    placed = lists.drop("doc").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_up = placed.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y")
    # Sizes that can link lie in the same step of this scale or in neighbouring ones.
    scale = F.floor(F.log(F.col("size").cast("double")) / np.log(101 / percent))
    placed = written(placed.join(mixed_up.select("hash", "n"), "hash").withColumn("step", scale), "placed")
    few = placed.where(F.col("n") <= FEW)
    near = few.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    cross = few.alias("p").join(near.alias("q"), ["hash", "step"]).where("p.node > q.node AND p.component <> q.component")
    cross = cross.where(possible("p", "q", percent)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    cross = alike(cross.join(best, ["a", "b"], "left_anti"), classes, percent)
    many = blocks_alike(placed.where(F.col("n") > FEW), classes, percent).join(best, ["a", "b"], "left_anti")
    cross = written(cross.unionByName(many).distinct(), "cross-pairs")
    for step in range(3):
        if cross.isEmpty():
            break
        # The likeliest partner of each row first: what this joins need not be compared any more.
        some = written(likeliest(cross), "likeliest")
        rest = step < 2 and cross.count() > 2 * some.count()
        links = links.unionByName(verified(some if rest else cross, documents, classes, k, percent))
        labels = components(links)
        if not rest:
            break
        cross = written(still_apart(cross.join(some.select("a", "b"), ["a", "b"], "left_anti"), labels), "cross-pairs")

    known = classes.join(labels.withColumnRenamed("node", "low"), "low", "left")
    known = known.select("low", "high", "size", "doc", F.coalesce("component", "low").alias("group"))
    known = known.join(known.groupBy("group").agg(F.min("doc").alias("component")), "group").select("low", "high", "size", "component")
    out = sizes.drop("sketch").join(known, ["low", "high", "size"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_of_each(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows whose ``doc_id`` is the smallest of its group of near duplicates; all columns stay.

    Of rows that repeat an id and its text one stays, the first by a hash of all columns.  Rows without an
    id can't be compared by it and all stay.
    """
    groups = written(jaccard_components(documents, k, percent), "groups").where("doc_id IS NOT NULL")
    judged = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows"))
    judged = written(judged, "judged")
    some, rest = parted(documents.where("doc_id IS NOT NULL"), judged.where("NOT stays"))
    named = some.join(judged.where("NOT stays").select("doc_id"), "doc_id", "left_anti").select(*documents.columns).unionByName(rest)
    twice = judged.where("rows > 1").select("doc_id")
    if not twice.isEmpty():
        row, of_all = F.struct(*documents.columns), F.hash(*documents.columns)
        same = named.join(twice, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("mark"), row.alias("row"), of_all.alias("order"))
        one = same.groupBy("doc_id", "mark").agg(F.min_by("row", "order").alias("row")).select("row.*")
        named = named.join(twice, "doc_id", "left_anti").select(*documents.columns).unionByName(one)
    return named.unionByName(documents.where("doc_id is null"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(m)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
