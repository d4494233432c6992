"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors become integer weights.  A block of the index quantises each weight's impact to its power of two
and keeps, for each level of impacts, the posting segments of its dimensions.  The segments are processed
level by level, highest impact first, adding up scores for a group of queries at once.  After each level
what a vector can still gain is bounded by the norm of its postings that were not processed; a vector
whose bound lies below a score that ``k`` vectors surely reach can't enter.  A query stops as soon as at
most ``rescore`` vectors are left, or no level is, and those are rescored exactly.

The first block of the index, a sample dealt by hash, meets all stated queries first; the k-th score that
each query finds there is proof against vectors of the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelab.llm.common import prepared, table, written

SCALE = 64
K = 20
QUERY_BLOCK = 4096
INDEX_BLOCK = 8192
#: Weights that a block or a group holds at most on average, whatever the width of its vectors.
BLOCK_VALUES = 1 << 21
#: A level ends at the power of two below which at most this share of the block's squared weights is left.
LEVELS = (0.25, 0.05, 0.005)
RESCORE = 256
#: Scores that one task holds at once.
SCORES = 1 << 21
LONGEST, SMALLEST = 2**63 - 1, -(2**63)
#: Rounding of a sum of products against the product of the norms, and underflow.
ROUNDING, UNDERFLOW = 2.0**-50, 1e-290

VECTOR = "id long, weights array<double>"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``id, weights``: floor(scale * x) of each component, whole numbers held as doubles.

    Vectors that are null, empty, or hold components that are null or not finite, before or after they
    are scaled, are left out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = x.values
                if not x.is_valid or i is None or not len(values) or values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    values = np.floor(scale * values.to_numpy().astype(float))
                if np.isfinite(values).all():
                    ids.append(i)
                    out.append(values)
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["id", "weights"])

    return vectors.mapInArrow(of, VECTOR)


def scaled_down(weights: np.ndarray) -> tuple[np.ndarray, int]:
    """``weights`` divided by a power of two, so that none exceeds 1, and its exponent."""
    exponent = int(np.frexp(np.abs(weights).max(initial=0.0))[1])
    return np.ldexp(weights, -exponent), exponent


class Block:
    """Posting segments of some vectors of one width, by descending quantised impact."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray) -> None:
        self.ids, self.weights = ids, weights
        self.most = float(np.abs(weights).max(initial=0.0))
        small, self.exponent = scaled_down(weights)
        impact = np.frexp(small)[1]  # the quantised impact: a power of two
        energy = np.square(small)
        lowest, highest = int(impact[small != 0].min(initial=0)), int(impact[small != 0].max(initial=0))
        cuts, total = [], energy.sum()
        if lowest > highest - 64:  # impacts further apart than doubles tell are one level
            below = [energy[impact <= e].sum() for e in range(lowest, highest + 1)]
            cuts = sorted({lowest + int(np.searchsorted(below, share * total, "right")) - 1 for share in LEVELS}, reverse=True)
        rounding = weights.shape[1] * ROUNDING * np.sqrt(energy.sum(axis=1))
        self.levels = []  # dimensions, their postings of the level, and the norm of a vector's postings below it
        done = np.zeros(small.shape, bool)
        for cut in [*(c for c in cuts if lowest <= c < highest), None]:
            now = ~done if cut is None else (impact > cut) & ~done
            done |= now
            dims = np.flatnonzero((now & (small != 0)).any(axis=0))
            rest = np.sqrt(np.where(done, 0.0, energy).sum(axis=1)) * (1 + 2.0**-40) + rounding
            self.levels.append((dims, np.where(now, small, 0.0)[:, dims], rest))

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows as longs; what doesn't fit is held at the ends of a long."""
        weights = self.weights[rows]
        if len(query) * self.most * float(np.abs(query).max(initial=0.0)) < 2**53:
            return (weights @ query).astype(np.int64)
        whole = [int(x) for x in query]
        sums = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in weights)
        return np.fromiter((min(max(s, SMALLEST), LONGEST) for s in sums), np.int64, len(rows))

    def search(self, queries: np.ndarray, owns: np.ndarray, floors: list, k: int, rescore: int = RESCORE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, ids and exact scores of the at most ``k`` vectors here that can be among
        its ``k`` best.  A query's own id is no candidate; its floor is a score that ``k`` vectors of another
        block reach, or None."""
        n = len(self.ids)
        small, exponent = scaled_down(queries)
        down = -(exponent + self.exponent)
        norm = np.sqrt(np.square(small).sum(axis=1))
        floor = np.array([-np.inf if f is None or f == SMALLEST else np.ldexp(float(f), down) for f in floors])
        top, bottom = np.ldexp(float(LONGEST), down), np.ldexp(float(SMALLEST), down)
        score = np.zeros((len(queries), n))
        at = np.minimum(np.searchsorted(self.ids, owns), n - 1)
        mine = np.flatnonzero(self.ids[at] == owns)
        score[mine, at[mine]] = -np.inf
        open_ = np.arange(len(queries))
        for step, (dims, postings, rest) in enumerate(self.levels):
            score += small[open_][:, dims] @ postings.T
            gain = norm[open_, None] * rest + UNDERFLOW
            if n >= k:
                found = np.partition(score - gain, n - k, axis=1)[:, n - k]
                found = np.minimum(found, top)  # beyond a long all scores tie
                floor[open_] = np.maximum(floor[open_], np.where(found <= bottom, -np.inf, found))
            least = floor[open_] - np.abs(floor[open_]) * ROUNDING
            alive = score + gain >= np.where(np.isneginf(least) | np.isnan(least), -np.inf, least)[:, None]
            closed = (alive.sum(axis=1) <= max(rescore, k)) | (step == len(self.levels) - 1)
            for j in np.flatnonzero(closed).tolist():
                q = int(open_[j])
                rows = np.flatnonzero(alive[j])
                rows = rows[self.ids[rows] != owns[q]]
                exact = self.exact(queries[q], rows)
                best = np.lexsort((self.ids[rows], ~exact))[:k]  # ~x falls as x rises, for every long
                yield q, self.ids[rows[best]], exact[best]
            score, open_ = score[~closed], open_[~closed]
            if not len(open_):
                return


def _search(k: int):
    def of(key: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(frames)).combine_chunks()
        out: list[list] = [[], [], []]
        widths = np.array([len(x) for x in held.column("weights")])
        for width in np.unique(widths):
            some = held.filter(pa.array(widths == width))
            ids, is_query = some.column("id").to_numpy(), some.column("query").to_numpy()
            if is_query.all() or not is_query.any():
                continue
            weights = some.column("weights").combine_chunks().flatten().to_numpy().reshape(len(ids), int(width))
            order = np.flatnonzero(~is_query)[np.argsort(ids[~is_query])]
            block = Block(ids[order], weights[order])
            asked = np.flatnonzero(is_query)
            floors = some.column("floor").to_pylist()
            step = max(1, SCORES // len(block.ids))
            for a in range(0, len(asked), step):
                rows = asked[a : a + step]
                for q, found, score in block.search(weights[rows], ids[rows], [floors[r] for r in rows], k):
                    out[0] += [int(ids[rows[q]])] * len(found)
                    out[1] += found.tolist()
                    out[2] += score.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` the ``k`` best of ``vectors``.

    Both are ``(id, vector)`` frames; a query's own id is no candidate.  Ties go to the smaller id.
    Rows that repeat an id are one vector (the smallest, component by component); vectors of another
    width than the query's are no candidates.  Unusable vectors take no part, neither as queries; other
    columns neither.  Scores are exact whatever the size of the weights; one that no long can hold is the
    nearest long, and such scores tie.
    """
    prepared(vectors.sparkSession)

    def once(df: DataFrame) -> DataFrame:
        return quantised(df.select("id", "vector"), scale).groupBy("id").agg(F.min("weights").alias("weights"))

    def dealt(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
        n, values = df.agg(F.count("*"), F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()
        places = max(1, -(-n // rows), -(-values // BLOCK_VALUES))
        return df.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(places)).cast("int")), places

    index, blocks = dealt(written(once(vectors), "vectors"), index_block)
    asked, groups = dealt(written(once(queries), "queries"), query_block)

    def met(from_: int, to: int, asked: DataFrame) -> DataFrame:
        """Blocks ``from_`` to ``to`` of the index meet each group of the stated queries once."""
        some = index.where(F.col("place").between(from_, to))
        all_groups, all_blocks = (F.explode(F.sequence(F.lit(a), F.lit(b))) for a, b in ((0, groups - 1), (from_, to)))
        left = some.select(F.col("place").alias("block"), all_groups.alias("group"), F.lit(False).alias("query"), "id", "weights", F.lit(None).cast("long").alias("floor"))
        right = asked.select(all_blocks.alias("block"), F.col("place").alias("group"), F.lit(True).alias("query"), "id", "weights", "floor")
        return left.unionByName(right).groupBy("block", "group").applyInArrow(_search(k), "query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = met(0, 0, asked.withColumn("floor", F.lit(None).cast("long")))
    if blocks > 1:
        found = written(ranked(found), "first-block")
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        found = found.drop("rank").unionByName(met(1, blocks - 1, asked.join(floors, "id", "left")))
    return ranked(found)


def op6_impact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where("id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
