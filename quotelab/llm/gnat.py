"""Hard negatives through a multiway hyperplane tree with distance ranges.

The tree is fitted on a bounded sample: a node holds split points, and a vector belongs to the child of
its nearest one.  All vectors are then placed in it, and for each split point and sibling subtree the range
of distances is taken over all of them.  A search for scores in a window is a search in an annulus of
distances around the anchor: a subtree is left out when its range from some split point and what the
annulus allows from there don't meet.  The leaves that stay are compared exactly, in integers.

A leaf is kept as packed blocks of bounded size.  Anchors travel to blocks, and stream past a block held
by a task; neither all blocks nor all anchors of a leaf are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelab.llm.common import parts_of, prepared, table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's: from, to.
LEAST, MOST = 50, 95
#: Rows on which the tree is fitted, children of a node, sampled rows below which a node is a leaf.
SAMPLE, FANOUT, LEAF = 2048, 8, 32
#: Rows of a packed block, anchors compared with it at once.
BLOCK, ASKED = 1024, 256
#: Largest component, and score (its negative is a long, too).
LIMIT, HIGHEST = 2**62, 2**63 - 1


# --- vectors -------------------------------------------------------------------------------------------------


def packed_weights(weights: np.ndarray) -> tuple[int, bytes]:
    """Width and the shortest integers that hold the weights."""
    top = int(np.abs(weights).max()) if weights.size else 0
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    return len(weights), weights.astype(kind).tobytes()


def matrix_of(widths: list[int], payloads: list[bytes]) -> np.ndarray:
    """One row for each vector, short ones filled with zeros."""
    out = np.zeros((len(widths), max(widths, default=0)), np.int64)
    shape = np.array([(w, len(p)) for w, p in zip(widths, payloads, strict=True)], np.int64).reshape(-1, 2)
    for width, size in np.unique(shape, axis=0):
        if width:
            at = np.flatnonzero((shape == (width, size)).all(axis=1))
            raw = np.frombuffer(b"".join(payloads[i] for i in at), f"<i{size // width}")
            out[at, :width] = raw.reshape(len(at), width)
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; object integers where 64 bits may not hold them."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if top < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -HIGHEST, HIGHEST).astype(np.int64)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean, in floating point; bounds from them are taken with some slack."""
    width = min(rows.shape[1], points.shape[1])
    a, b = rows.astype(float), points.astype(float)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a[:, :width] @ b[:, :width].T)
    return np.sqrt(np.maximum(square, 0))


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``id, label, width, weights`` of usable ``(id, label, vector)`` rows, once for each id.

    Null labels or vectors, null or non-finite components make a row unusable.  Of rows that repeat an id
    the one of least label, then least packed weights counts.  Components beyond 2**62 stop there.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[Any]] = [[], [], [], []]
            for i, label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if i is None or label is None or not x.is_valid or x.values.null_count:
                    continue
                values = x.values.to_numpy().astype(float)
                if np.isfinite(values).all():
                    with np.errstate(over="ignore"):
                        weights = np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int64)
                    for column, value in zip(out, (i, label, *packed_weights(weights)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "label", "width", "weights"])

    usable = rows.select("id", F.col("label").cast("long"), "vector").mapInArrow(of, "id long, label long, width int, weights binary")
    return usable.groupBy("id").agg(F.min(F.struct("label", "width", "weights")).alias("x")).select("id", "x.*")


# --- the tree ------------------------------------------------------------------------------------------------


class Node:
    """Split points and, for each, a child node or the number of a leaf; ranges and norms come later."""

    def __init__(self, number: int, points: np.ndarray) -> None:
        self.number, self.points = number, points
        self.children: list[Node | int] = []
        n = len(points)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)  # from point i to subtree j
        self.norm_low, self.norm_high = np.full(n, np.inf), np.full(n, -np.inf)  # of subtree j


class Tree:
    """Fitted on a sample; ``leaves`` counts leaves, ``nodes`` holds the inner nodes by number."""

    def __init__(self, sample: np.ndarray, fanout: int, leaf: int) -> None:
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grown(sample, fanout, leaf)

    def _grown(self, rows: np.ndarray, fanout: int, leaf: int) -> Node | int:
        if len(rows) > leaf:
            points = self._split_points(rows, fanout)
            if len(points) > 1:
                node = Node(len(self.nodes), points)
                self.nodes.append(node)
                near = distances(rows, points).argmin(axis=1)
                node.children = [self._grown(rows[near == j], fanout, leaf) for j in range(len(points))]
                return node
        self.leaves += 1
        return self.leaves - 1

    @staticmethod
    def _split_points(rows: np.ndarray, fanout: int) -> np.ndarray:
        """Far from one another: each next point is that farthest from the chosen ones."""
        chosen = [0]
        away = distances(rows, rows[:1])[:, 0]
        while len(chosen) < fanout and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(rows, rows[chosen[-1:]])[:, 0])
        return rows[chosen]

    def visit(self, rows: np.ndarray, see: Callable[[Node, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """Leaf of each row; ``see`` gets each node with its rows, their distances and children."""
        out = np.zeros(len(rows), np.int64)
        stack: list[tuple[Node | int, np.ndarray]] = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                away = distances(rows[at], node.points)
                near = away.argmin(axis=1)
                if see:
                    see(node, at, away, near)
                stack += [(child, at[near == j]) for j, child in enumerate(node.children)]
        return out

    def survivors(self, anchor: np.ndarray, low: float, high: float) -> list[int]:
        """Leaves that may hold a vector whose score lies in ``[low, high]``."""
        square = float((anchor.astype(float) ** 2).sum())
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
                continue
            some = node.norm_high >= 0  # subtrees with rows
            norm_low, norm_high = np.where(some, node.norm_low, 0), np.where(some, node.norm_high, 0)
            away = distances(anchor[None], node.points)[0][:, None]
            slack = 1e-6 * (np.sqrt(square) + np.sqrt(norm_high) + away + 1)
            farthest = square + norm_high - 2 * low  # squares of the annulus
            outer = np.sqrt(np.maximum(farthest, 0)) + slack
            inside = np.sqrt(np.maximum(square + norm_low - 2 * high, 0)) - slack
            meets = (np.maximum(away - outer, inside - away) <= node.high + slack) & (away + outer >= node.low - slack)
            keep = some & meets.all(axis=0) & (farthest + 1e-6 * (square + norm_high + abs(low)) >= 0)
            stack += [node.children[j] for j in np.flatnonzero(keep)]
        return out


def fitted(rows: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF) -> Tree:
    """From the ``sample`` rows whose ids hash lowest."""
    some = rows.select("width", "weights", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()
    return Tree(matrix_of([r["width"] for r in some], [bytes(r["weights"]) for r in some]), fanout, leaf)


def _batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return matrix_of(batch.column("width").to_pylist(), batch.column("weights").to_pylist())


def with_ranges(tree: Tree, rows: DataFrame) -> Tree:
    """The least and largest distance from each split point to each sibling subtree, and of norms, over all rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[float, float]] = {}

        def widen(key: tuple[int, int, int], low: float, high: float) -> None:
            before = held.get(key, (np.inf, -np.inf))
            held[key] = (min(before[0], low), max(before[1], high))

        for batch in batches:
            weights = _batch_matrix(batch)
            norms = (weights.astype(float) ** 2).sum(axis=1)

            def see(node: Node, at: np.ndarray, away: np.ndarray, near: np.ndarray, norms: np.ndarray = norms) -> None:
                for j in np.unique(near):
                    mine = near == j
                    widen((node.number, -1, int(j)), norms[at[mine]].min(), norms[at[mine]].max())
                    for i, (low, high) in enumerate(zip(away[mine].min(axis=0), away[mine].max(axis=0), strict=True)):
                        widen((node.number, i, int(j)), low, high)

            tree.visit(weights, see)
        keys = np.array(list(held), np.int32).reshape(-1, 3)
        ends = np.array(list(held.values()), float).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T), *map(pa.array, ends.T)], names=["node", "i", "j", "low", "high"])

    if tree.nodes:
        found = rows.select("width", "weights").mapInArrow(of, "node int, i int, j int, low double, high double")
        for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            node = tree.nodes[r["node"]]
            if r["i"] < 0:
                node.norm_low[r["j"]], node.norm_high[r["j"]] = r["low"], r["high"]
            else:
                node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = r["low"], r["high"]
    return tree


class Index:
    """Packed blocks of all rows by leaf, the tree with its ranges, blocks of each leaf."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF, block: int = BLOCK) -> None:
        self.tree = with_ranges(fitted(rows, sample, fanout, leaf), rows)
        tree = self.tree

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("leaf", pa.array(tree.visit(_batch_matrix(batch)), pa.int64()))

        placed = written(rows.mapInArrow(place, "id long, label long, width int, weights binary, leaf long"), "placed")
        size = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
        self.blocks = {k: max(1, -(-n // block)) for k, n in size.items()}
        if size:
            number = F.element_at(F.create_map(*(F.lit(x) for pair in self.blocks.items() for x in pair)), F.col("leaf"))
        else:
            number = F.lit(1)
        self.rows = placed.withColumn("block", F.pmod(F.xxhash64("id"), number).cast("int"))

        def pack(key: tuple, held: pa.Table) -> pa.Table:
            held = held.sort_by("id")
            weights = matrix_of(held["width"].to_pylist(), held["weights"].to_pylist())
            width, payload = packed_weights(weights.ravel())
            ids, labels = (held[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
            columns = [key[0].as_py(), key[1].as_py(), ids, labels, width, payload]
            return pa.table([pa.array([x], t) for x, t in zip(columns, PACKED_TYPES, strict=True)], names=PACKED_NAMES)

        self.packed = written(self.rows.groupBy("leaf", "block").applyInArrow(pack, PACKED), "blocks")


PACKED = "leaf long, block int, ids binary, labels binary, width int, weights binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
PACKED_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
#: An anchor on its way: where to, its vector, and the windows of scores that it looks for.
ASK = "leaf long, block int, id long, label long, width int, weights binary, positives array<long>, lows array<long>, highs array<long>"
ASK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
ASK_NAMES = [c.split()[0] for c in ASK.split(", ")]
FOUND = "anchor_id long, positive_id long, id long, score long"


class Block:
    def __init__(self, ids: bytes, labels: bytes, width: int, weights: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        raw = matrix_of([width], [weights])
        self.weights = raw.reshape(len(self.ids), -1) if width else np.zeros((len(self.ids), 0), np.int64)

    def search(self, asks: list[tuple], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """For each window of each anchor its ``k`` first rows of the same label, or of other ones."""
        scores = inner(matrix_of([a[2] for a in asks], [a[3] for a in asks]), self.weights)
        for (anchor, label, _, _, positives, lows, highs), score in zip(asks, scores, strict=True):
            mine = (self.labels == label) & (self.ids != anchor) if same else self.labels != label
            at = np.flatnonzero(mine & (score >= min(lows)) & (score <= max(highs)))
            at = at[np.argsort(-score[at], kind="stable")]
            found = score[at]
            for positive, low, high in zip(positives, lows, highs, strict=True):
                start = int(np.searchsorted(-found, -high))
                for x in range(start, min(start + k, len(at))):
                    if found[x] < low:
                        break
                    yield anchor, positive, int(self.ids[at[x]]), int(found[x])


def visited(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """``FOUND`` rows of anchors that stream past the blocks they ask; at most ``k`` a window and block."""
    blocks = index.packed.select(*PACKED_NAMES, F.lit(False).alias("ask"))
    both = blocks.unionByName(asks.withColumn("ask", F.lit(True)), allowMissingColumns=True)
    names = ["leaf", "block", "ask", "ids", "labels", "width", "weights", "id", "label", "positives", "lows", "highs"]
    spread = both.select(names).repartition(parts_of(asks.sparkSession), "leaf", "block").sortWithinPartitions("leaf", "block", "ask")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            rows = list(block.search(held, k, same)) if held and block else []
            held.clear()
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "id", "score"])

        for batch in batches:
            for _, _, ask, ids, labels, width, weights, *row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                if not ask:
                    yield found()
                    block = Block(ids, labels, width, weights)
                    continue
                held.append((row[0], row[1], width, weights, *row[2:]))
                if len(held) == ASKED:
                    yield found()
        yield found()

    return spread.mapInArrow(stream, FOUND)


def _asks(index: Index, anchors: DataFrame, own: bool) -> DataFrame:
    """Anchors to their own block, or to the others that may hold rows of their windows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for leaf, block, i, label, width, weights, positives, lows, highs in zip(*(batch.column(c).to_pylist() for c in ASK_NAMES), strict=True):
                if own:
                    targets = [(leaf, block)]
                elif not lows:
                    targets = []
                else:
                    vector = matrix_of([width], [weights])[0]
                    targets = [t for t in routes(float(min(lows)), float(max(highs)), vector) if t != (leaf, block)]
                rows += [(*t, i, label, width, weights, positives, lows, highs) for t in targets]
                if len(rows) > 4096:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    tree, blocks = index.tree, index.blocks

    def routes(low: float, high: float, vector: np.ndarray) -> list[tuple[int, int]]:
        return [(leaf, b) for leaf in tree.survivors(vector, low, high) for b in range(blocks.get(leaf, 0))]

    return anchors.select(ASK_NAMES).mapInArrow(of, ASK)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ASK_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ASK_TYPES, strict=True)], names=ASK_NAMES)


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    scale: int = SCALE, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are ``(id, label, vector)``; ``anchors`` says of a row, by ``id``, whether it asks.  A row's
    score is the inner product of floor(scale * x); higher comes first, equal scores by smaller id.  An
    anchor's positives are its first rows of the same label; a positive's negatives are the first rows
    of another label whose score lies between ``least`` and ``most`` hundredths of the positive's.

    Unusable rows and repeated ids: see ``quantised``.  Vectors of unequal width meet as if the shorter one
    ended in zeros.  Scores that no long holds stop at its ends.  No rows, no anchors or a single label
    give no rows.  The tree's ``sample`` rows are the only bounded choice; it decides speed, not results.
    """
    prepared(rows.sparkSession)
    usable = written(quantised(rows, scale), "vectors")
    index = Index(usable, sample, fanout, leaf, block)
    nothing = F.array().cast("array<long>")
    asking = written(index.rows.where(anchors).select(*ASK_NAMES[:6], nothing.alias("positives"), nothing.alias("lows"), nothing.alias("highs")), "anchors")

    def wide(low: Column) -> dict[str, Column]:
        return {"positives": F.array(F.lit(0).cast("long")), "lows": F.array(low), "highs": F.array(F.lit(HIGHEST))}

    # Positives: in the own block first; the k-th score there bounds what other blocks must hold.
    first = written(visited(index, _asks(index, asking.withColumns(wide(F.lit(-HIGHEST))), own=True), positives, True), "own-positives")
    reached = first.groupBy("anchor_id").agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor")).withColumnRenamed("anchor_id", "id")
    bounded = asking.join(reached, "id", "left").withColumns(wide(F.coalesce("floor", F.lit(-HIGHEST))))
    rest = visited(index, _asks(index, bounded, own=False), positives, True)
    best = written(_best(first.unionByName(rest), positives, "anchor_id").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: windows of scores, narrowed from below by what the own block holds.
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = best.withColumn("low", F.ceil(score * least / 100).cast("long")).withColumn("high", F.floor(score * most / 100).cast("long")).where("low <= high")
    asked = _windows(asking, windows)
    near = written(visited(index, _asks(index, asked, own=True), negatives, False), "own-negatives")
    narrowed = near.groupBy("anchor_id", "positive_id").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("floor"))
    tighter = windows.join(narrowed, ["anchor_id", "positive_id"], "left").withColumn("low", F.coalesce("floor", "low"))
    far = visited(index, _asks(index, _windows(asking, tighter), own=False), negatives, False)
    chosen = _best(near.unionByName(far), negatives, "anchor_id", "positive_id")
    out = chosen.join(best, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _windows(asking: DataFrame, windows: DataFrame) -> DataFrame:
    held = windows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "low", "high")).alias("w"))
    parts = {"positives": F.col("w.positive_id"), "lows": F.col("w.low"), "highs": F.col("w.high")}
    return asking.drop(*parts).join(held, "id").withColumns(parts).select(ASK_NAMES)


def op13_gnat_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
