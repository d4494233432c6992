"""Quality classifier: ridge regression on random Fourier features of document statistics.

Cosines of random projections approximate a Gaussian kernel over standardised statistics of the whole
text.  Each task sums its part of the normal equations, the sums are added in groups, and the driver
solves one small system.  An isotonic map, fitted on training rows that the ridge fit did not see, turns
raw values into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelab.llm import isotonic
from quotelab.llm.common import prepared, table, texts, written
from quotelab.llm.tokens import documents_of, nonspace_bytes, pieces, window_hashes, words_of

FOURIER = 256
SEED = 7
RIDGE = 1e-3
#: Kernel width in standard deviations, times the root of the number of statistics.
WIDTH = 1.0
THRESHOLD = 0.3
SUM_GROUPS = 16

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "spread_word", "log_longest", "upper", "digit", "outside_ascii", "newline",
    "exclamation", "stop_or_comma", "symbol", "other_sign", "distinct_words", "distinct_lines", "distinct_pairs",
    "long_words", "one_byte_words", "sign_words", "log_lines", "capital_words", "mean_line",
]


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=float)))[first])


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each document."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    n = len(offsets) - 1
    words = words_of(data, offsets, nonspace_bytes())
    lines_byte = np.ones(256, bool)
    lines_byte[10] = False
    lines = words_of(data, offsets, lines_byte)
    size, count, n_lines = np.diff(offsets).astype(float), np.diff(words.first).astype(float), np.diff(lines.first).astype(float)
    owner = documents_of(words.first)
    length = (words.ends - words.starts).astype(float)
    kind = np.zeros(256, np.uint8)
    for value, members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", "!", ".,", "#$%&*@", "?;:\"'()[]{}<>/\\|=+-_~^`"), 1):
        kind[list(members.encode())] = value
    kind[128:] = 8
    kinds = kind[data]
    shares = {k: _per(kinds == k, offsets) / np.maximum(size, 1) for k in range(1, 9)}
    many, lined = np.maximum(count, 1), np.maximum(n_lines, 1)
    mean = _per(length, words.first) / many
    spread = np.sqrt(np.maximum(_per(length**2, words.first) / many - mean**2, 0))
    longest = np.zeros(n)
    full = np.flatnonzero(count)
    if len(full):
        longest[full] = np.maximum.reduceat(length, words.first[full])
    pairs = window_hashes(words.hashes, 2)
    inside = owner[1:] == owner[:-1]
    first_kind = kinds[words.starts]
    sign = np.isin(first_kind, (4, 5, 6, 7))
    columns = [
        np.log1p(size), np.log1p(count), mean, spread, np.log1p(longest), shares[1], shares[2], shares[8], shares[3],
        shares[4], shares[5], shares[6], shares[7], _distinct(words.hashes, owner, n) / many,
        _distinct(lines.hashes, documents_of(lines.first), n) / lined,
        _distinct(pairs[inside], owner[1:][inside], n) / np.maximum(count - 1, 1),
        _per(length > 12, words.first) / many, _per(length == 1, words.first) / many, _per(sign, words.first) / many,
        np.log1p(n_lines), _per(first_kind == 1, words.first) / many, np.log1p(size / lined),
    ]
    return np.stack(columns, axis=1)


def described(documents: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row (null texts count as empty)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in pieces(texts(batch)):
                x = statistics(data, offsets)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), values], names=["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, x array<double>")


class Fourier:
    """Standardisation and random cosine features, with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.w = random.normal(size=(len(mean), n)) / (WIDTH * np.sqrt(len(mean)))
        self.b = random.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack((z, np.ones((len(x), 1))))


class Model:
    def __init__(self, features: Fourier, weights: np.ndarray, calibrated: isotonic.Isotonic) -> None:
        self.features, self.weights, self.calibrated = features, weights, calibrated

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of ``z z'``, ``z y`` and rows over ``x, y``: by task, then by group, then here (a few MB)."""
    shared = rows.sparkSession.sparkContext.broadcast(features)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            z, y = shared.value(_matrix(batch.column(0))), batch.column(1).to_numpy()
            part = np.concatenate(((z.T @ z).ravel(), z.T @ y, [len(y)]))
            total = part if total is None else total + part
        if total is not None:
            group = TaskContext.get().partitionId() % SUM_GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(x) for frame in frames for x in frame["sums"])
        yield pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    sums = rows.select("x", "y").mapInArrow(of, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary")
    n = FOURIER + 1
    total = sum((np.frombuffer(x) for _, x in sorted(map(tuple, sums.collect()))), np.zeros(n * n + n + 1))
    return total[: n * n].reshape(n, n), total[n * n : -1], float(total[-1])


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def train(described_rows: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """Fit on labelled rows outside the held-out fifth; of these, one fold of four only calibrates."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = described_rows.join(marked, "doc_id").where(remainder(5) != 0).withColumn("fold", remainder(5))
    rows = written(rows, "labelled")
    fitted = rows.where("fold <> 1")
    moments = fitted.select([F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(STATISTICS))] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(STATISTICS))]).first()
    values = np.array([0.0 if v is None else v for v in moments])
    features = Fourier(values[: len(STATISTICS)], values[len(STATISTICS) :], FOURIER, seed)
    a, b, n = normal_equations(fitted, features)
    weights = np.linalg.solve(a + RIDGE * max(n, 1) / FOURIER * np.eye(len(b)), b)
    model = Model(features, weights, isotonic.Isotonic(np.zeros(0), np.zeros(0), -0.5, 1.5))
    model.calibrated = isotonic.fit(scored(rows.where("fold = 1"), model, "y").select("raw", "y"), "raw", "y", -0.5, 1.5)
    return model


def scored(rows: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``raw`` and calibrated ``score`` of each row's statistics, beside its ``key``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), pa.array(shared.value.calibrated(raw))], names=[key, "raw", "score"])

    return rows.select(key, "x").mapInArrow(of, T.StructType([rows.schema[key], *T._parse_datatype_string("raw double, score double")]))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    Learnt from labelled rows whose crc32 of ``doc_id`` (as text) leaves a remainder by 5; repeated
    labels count repeatedly, null ones not at all.  Without any labels every score is 0.5.  Null texts
    are scored as empty ones.  Only the text enters a score.  Rows without an id are not held out, and
    are not learnt from either.
    """
    prepared(documents.sparkSession)
    rows = written(described(documents), "statistics")
    out = scored(rows, train(rows, labels))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text is predicted to be of quality 1; all columns stay, whatever their names.

    Each row is judged by its own text in the same map that passes it on: no document is shuffled, and
    null or repeated ids are nothing special.
    """
    prepared(documents.sparkSession)
    model = train(written(described(documents), "statistics"), labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            good = [shared.value.calibrated(shared.value.raw(statistics(data, offsets))) >= threshold for _, _, data, offsets in pieces(column.fill_null(""))]
            yield batch.filter(pa.array(np.concatenate([*good, np.zeros(0, bool)])))

    at = [c.lower() for c in documents.columns].index("text")
    return documents.mapInArrow(of, documents.schema)


def op5_fourier_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
