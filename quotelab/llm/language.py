"""Language identification by interpolated Kneser-Ney character language models.

For each language, character n-grams up to five of blank-padded words are counted in Spark.  Discounted
counts of the longest n-grams are interpolated with continuation counts of the shorter ones; each order
is kept as a sorted array of hashes with one column of log-probabilities for each language.  A text gets
the language of lowest cross-entropy per character.  Scores are the calibrated share of right answers at
the text's margin over the second language.

Each distinct word of a batch is scored once; a text adds up its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm import isotonic
from quotelab.llm.common import prepared, table, texts
from quotelab.llm.tokens import WORD_BASE, alphanumeric_bytes, documents_of, mixed, pieces, powers, words_of

ORDER = 5
DISCOUNT = 0.75
#: Documents of each language that the counts take, about, chosen by a hash of the id: the documented
#: bound on labelled training rows.
SAMPLE = 10_000
#: Below this share of right answers a prediction counts as rejected.
REJECT_BELOW = 0.5
MAX_MARGIN = 4.0
UNDETERMINED = "und"
U64 = np.uint64


def letter_runs() -> np.ndarray:
    table_ = alphanumeric_bytes()
    table_[0x30:0x3A] = False
    return table_


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each behind ``ORDER - 1`` blanks and before one; word of each n-gram end."""
    joined = (" " * (ORDER - 1)).join(["", *(w + " " for w in words)])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(U64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return points, sizes


def grams(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each scored character, the hashes of the n-grams of orders 1 to ``ORDER`` that end with it."""
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scale = powers(WORD_BASE, ORDER + 1)
    values, out = mixed(points + U64(1)), np.zeros((len(at), ORDER), U64)
    total = np.zeros(len(at), U64)
    for n in range(ORDER):
        total = total + values[at - n] * scale[n]
        out[:, n] = mixed(total + U64(n + 1))
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    words = words_of(data, offsets, letter_runs(), lower=True)
    distinct, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    spans = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
    return words, [raw[a:b].decode(errors="replace").lower() for a, b in spans], inverse


def counted(documents: DataFrame) -> DataFrame:
    """``lang, gram, n``: counts of the longest n-grams (as text) of ``doc_id, text, lang``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, stop, data, offsets in pieces(texts(batch)):
                words, names, inverse = distinct_words(data, offsets)
                codes, values = pd.factorize(np.array(langs[start:stop], object))
                if not len(names):
                    continue
                uses = pd.Series(1, index=pd.MultiIndex.from_arrays([codes[documents_of(words.first)], inverse])).groupby(level=[0, 1]).sum()
                points, sizes = characters(names)
                begin = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
                text = points.astype(np.uint32).tobytes().decode("utf-32-le")
                for code, some in uses.groupby(level=0):
                    found: dict[str, int] = {}
                    for (_, w), n in some.items():
                        a = begin[w]
                        for i in range(a, a + sizes[w]):
                            g = text[i : i + ORDER]
                            found[g] = found.get(g, 0) + n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([values[code]] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    return documents.select("text", "lang").mapInArrow(of, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """Sorted hash arrays: for each order n-grams with log-probabilities, contexts with back-off weights."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.langs = sorted(counts["lang"].unique())
        self.alphabet = max(len(set().union(*counts["gram"])), 1) + 1
        each = [self._kneser_ney(counts[counts["lang"] == lang]) for lang in self.langs]
        self.tables = []
        for n in range(ORDER, 0, -1):
            grams_ = sorted(set().union(*(e[n][0] for e in each)))
            contexts = sorted({g[:-1] for g in grams_})
            weights = np.zeros((len(contexts), len(each)), np.float64)
            for j, e in enumerate(each):
                weights[:, j] = [np.log(e[n][1].get(c, 1.0)) for c in contexts]
            probabilities = np.zeros((len(grams_), len(each)), np.float64)
            for j, e in enumerate(each):
                probabilities[:, j] = [np.log(self._p(e, g)) for g in grams_]
            self.tables.append((n, *_sorted(grams_, n, probabilities), *_sorted(contexts, n - 1, weights)))
        self.calibrated = isotonic.Isotonic(np.zeros(0), np.zeros(0), 0.0, MAX_MARGIN)

    def _kneser_ney(self, counts: pd.DataFrame) -> dict:
        """By order: discounted shares of n-grams, and the weight that each context leaves to the next order."""
        out = {}
        current = dict(zip(counts["gram"], counts["n"], strict=True))
        for n in range(ORDER, 0, -1):
            total: dict[str, float] = {}
            kinds: dict[str, int] = {}
            for g, c in current.items():
                total[g[:-1]] = total.get(g[:-1], 0) + c
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            shares = {g: max(c - DISCOUNT, 0) / total[g[:-1]] for g, c in current.items()}
            out[n] = shares, {c: DISCOUNT * kinds[c] / total[c] for c in total}
            lower: dict[str, int] = {}
            for g in current:  # continuation counts: in how many n-grams a shorter one ends
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            current = lower
        return out

    def _p(self, e: dict, gram: str) -> float:
        p = 1 / self.alphabet
        for n in range(1, len(gram) + 1):
            g = gram[len(gram) - n :]
            p = e[n][0].get(g, 0.0) + e[n][1].get(g[:-1], 1.0) * p
        return p

    def scores(self, hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Log-probability of each character in each language."""
        out = np.zeros((len(hashes), len(self.langs)))
        left = np.arange(len(hashes))
        for n, keys, values, context_keys, weights in self.tables:
            slot = np.minimum(np.searchsorted(keys, hashes[left, n - 1]), len(keys) - 1)
            found = keys[slot] == hashes[left, n - 1]
            out[left[found]] += values[slot[found]]
            left = left[~found]
            if not len(left):
                return out
            slot = np.minimum(np.searchsorted(context_keys, contexts[left, n - 1]), len(context_keys) - 1)
            known = context_keys[slot] == contexts[left, n - 1]
            out[left[known]] += weights[slot[known]]
        out[left] -= np.log(self.alphabet)
        return out


def _sorted(names: list[str], n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash array of equal-length strings in ascending order, with their rows."""
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(U64).reshape(len(names), n)
    scale, total = powers(WORD_BASE, ORDER + 1), np.zeros(len(names), U64)
    for i in range(n):
        total = total + mixed(points[:, n - 1 - i] + U64(1)) * scale[i]
    keys = mixed(total + U64(n)) if n else np.zeros(len(names), U64)
    order = np.argsort(keys)
    return keys[order], values[order]


def compared(documents: DataFrame, models) -> DataFrame:
    """``doc_id, lang_pred, margin, cross_entropy`` of ``doc_id, text`` (und: no letter or no text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models.value
        langs = np.array([*m.langs, UNDETERMINED], object)
        for batch in batches:
            for start, stop, data, offsets in pieces(texts(batch)):
                n = stop - start
                words, names, inverse = distinct_words(data, offsets)
                entropy = np.zeros((n, len(m.langs)))
                letters = np.zeros(n)
                if len(names):
                    points, sizes = characters(names)
                    hashes = grams(points, sizes)
                    # The context of an n-gram is the (n - 1)-gram that ends one character earlier.
                    before = _contexts(points, sizes)
                    first = np.cumsum(sizes) - sizes
                    each = np.add.reduceat(m.scores(hashes, before), first) if m.langs else np.zeros((len(names), 0))
                    lettered = np.fromiter((any(map(str.isalpha, w)) for w in names), bool, len(names))
                    owner = documents_of(words.first)
                    chars = np.bincount(owner, sizes[inverse], n)
                    letters = np.bincount(owner, lettered[inverse], n)
                    for j in range(len(m.langs)):
                        entropy[:, j] = -np.bincount(owner, each[inverse, j], n) / np.maximum(chars, 1)
                known = (letters > 0) & bool(m.langs)
                best = np.argmin(entropy, axis=1) if m.langs else np.zeros(n, np.int64)
                two = np.sort(entropy, axis=1)
                margin = two[:, 1] - two[:, 0] if len(m.langs) > 1 else np.full(n, MAX_MARGIN)
                margin = np.where(known, margin, 0.0)
                score = np.where(known, m.calibrated(margin), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(langs[np.where(known, best, len(m.langs))], pa.string()), pa.array(margin),
                     pa.array(two[:, 0] if m.langs else np.zeros(n)), pa.array(score)],
                    names=["doc_id", "lang_pred", "margin", "cross_entropy", "score"],
                )

    return documents.select("doc_id", "text").mapInArrow(of, "doc_id long, lang_pred string, margin double, cross_entropy double, score double")


def _contexts(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each scored character and order n, the hash of the n - 1 characters before it."""
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scale, values = powers(WORD_BASE, ORDER + 1), mixed(points + U64(1))
    out, total = np.zeros((len(at), ORDER), U64), np.zeros(len(at), U64)
    for n in range(1, ORDER):
        total = total + values[at - n] * scale[n - 1]
        out[:, n] = mixed(total + U64(n))
    return out


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def train(documents: DataFrame, sample: int = SAMPLE):
    """Models of the sampled training documents; training rows outside the sample calibrate the score."""
    spark = documents.sparkSession
    marked = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(remainder() != 2)
    # A quarter of a language's sample or more is left for calibration, even where all rows are few.
    share = marked.groupBy("lang").agg(F.least(F.lit(0.75), F.lit(float(sample)) / F.count("*")).alias("share"))
    share = {r["lang"]: r["share"] for r in share.collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    inside, near = F.lit(False), F.lit(False)
    for lang, s in share.items():
        inside |= (F.col("lang") == lang) & (place < s)
        near |= (F.col("lang") == lang) & (place >= s) & (place < s + min(s, 0.25))
    models = Models(counted(marked.where(inside)).toPandas())
    checked = compared(marked.where(near), spark.sparkContext.broadcast(models))
    truth = marked.where(near).select("doc_id", "lang")
    right = checked.join(truth, "doc_id").select("margin", (F.col("lang") == F.col("lang_pred")).cast("double").alias("y"))
    models.calibrated = isotonic.fit(right, "margin", "y", 0.0, MAX_MARGIN)
    return models


def identify(documents: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, cross_entropy`` for every row.

    Learnt from ``text`` and non-null ``lang`` of rows whose crc32 of ``doc_id`` leaves no remainder of 2
    by 4.  ``und`` with score 0 where the text is null or has no letter, or nothing could be learnt.
    Repeated rows are answered repeatedly; other columns take no part.
    """
    spark = prepared(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    out = compared(documents, spark.sparkContext.broadcast(train(documents)))
    rejected = (F.col("score") < reject_below).alias("rejected")
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score", rejected, "cross_entropy")


def op9_kneser_ney_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
