"""Language-model scoring by a hashed maximum-entropy model.

A word's probability is that of its class given the two words before it, times that of its slot in the
class, times its share of the slot.  Both softmaxes are log-linear in three hashed features: the word
before, the one before that (a skip), and both together; their constant terms are the corpus shares.  The
most frequent words have slots of their own, all others share hashed ones.  Weights are trained by
distributed gradient updates: in each round every task sums the gradient over its share of the training
texts under the same weights.

Word counts cover all training texts.  They travel packed by ranges of the word's hash and stay there;
only a bounded list of frequent words is broadcast.  A text's other words are sent to their counts, and
sums per text come back, so that the vocabulary may grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm.common import dealt, grouped, parts_of, prepared, table, texts, unpacked, written
from quotelab.llm.first_copy import part_of
from quotelab.llm.tokens import mixed, nonspace_bytes, pieces, words_of

U64 = np.uint64
END = U64(0x5BD1E995A5A5A5A5)
CLASSES = SLOTS = 16
OWN = 128
#: Rows of each weight table; each row has one weight for each class or slot.
ROWS = 1 << 14
FEATURES = 3
ROUNDS = 3
FREQUENT = 65_536
FLUSH_BYTES = 32 << 20

COUNT = np.dtype([("hash", "<u8"), ("n", "<i8")])
USE = np.dtype([("row", "<i8"), ("n", "<i4"), ("hash", "<u8")])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end behind each text's words, and where each text's tokens begin."""
    words = words_of(data, offsets, nonspace_bytes(), lower=True)
    return np.insert(words.hashes, words.first[1:], END), words.first + np.arange(len(words.first))


def _tally(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(hashes, kind="stable")
    hashes, n = hashes[order], n[order]
    at = grouped(hashes)
    out = np.empty(len(at), COUNT)
    out["hash"], out["n"] = hashes[at], np.add.reduceat(n, at) if len(at) else 0
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """Packed counts of all words of training texts (``part, payload``), with each part's frequent ones."""
    parts = parts_of(documents.sparkSession)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = _tally(rows["hash"], rows["n"])
        out = list(dealt(part_of(rows["hash"], parts), rows))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "payload"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in pieces(texts(batch)):
                hashes, _ = tokens(data, offsets)
                held.append(_tally(hashes, np.ones(len(hashes), np.int64)))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_part.setdefault(part, []).append(unpacked(payload, COUNT))
        most = 4 * FREQUENT // parts + 64
        for part, held in by_part.items():
            rows = np.concatenate(held)
            rows = _tally(rows["hash"], rows["n"])
            top = rows[np.lexsort((rows["hash"], -rows["n"]))[:most]]
            columns = [pa.array([part], pa.int32()), pa.array([next(dealt(np.zeros(len(rows), int), rows))[1]], pa.binary())]
            columns += [pa.array([len(rows)]), pa.array([int(rows["n"].sum())])]
            columns += [pa.array([np.ascontiguousarray(top[c]).view(np.int64).tolist()], pa.list_(pa.int64())) for c in ("hash", "n")]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "payload", "kinds", "total", "top", "uses"])

    packed = documents.where("train").select("text").mapInArrow(send, "part int, payload binary").repartition(parts, "part")
    return packed.mapInArrow(add, "part int, payload binary, kinds long, total long, top array<long>, uses array<long>")


class Vocabulary:
    """Frequent words with their counts, the slot of any word, and the size of each slot."""

    def __init__(self, top: pd.DataFrame) -> None:
        top = top.sort_values(["uses", "top"], ascending=[False, True], kind="stable")
        own = top["top"].to_numpy()[:OWN].view(U64)
        self.own_keys, self.own_slots = np.sort(own), np.argsort(own)
        keys = top["top"].to_numpy().view(U64)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], top["uses"].to_numpy()[order]
        self.kinds = self.total = 0
        self.slot_kinds = np.zeros(CLASSES * SLOTS)
        self.slot_total = np.zeros(CLASSES * SLOTS)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out = (OWN + (hashes >> U64(20)) % U64(CLASSES * SLOTS - OWN)).astype(np.int64)
        if len(self.own_keys):
            at = np.minimum(np.searchsorted(self.own_keys, hashes), len(self.own_keys) - 1)
            mine = self.own_keys[at] == hashes
            out[mine] = self.own_slots[at[mine]]
        return out

    def frequent(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, self.counts[at]

    def log_slot_size(self) -> np.ndarray:
        return np.log10(self.slot_total + 0.5 * (self.slot_kinds + 1))

    def log_size(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.kinds + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From at most ``4 * FREQUENT`` frequent words and 256 sums."""
    spark = counts.sparkSession
    top = counts.select(F.explode(F.arrays_zip("top", "uses")).alias("x")).select("x.*").orderBy(F.desc("uses"), "top").limit(FREQUENT)
    words = Vocabulary(top.toPandas())
    shared = spark.sparkContext.broadcast(words)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = np.zeros(CLASSES * SLOTS, np.int64), np.zeros(CLASSES * SLOTS, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                rows = unpacked(payload, COUNT)
                slot = shared.value.slots(rows["hash"])
                kinds += np.bincount(slot, minlength=len(kinds))
                total += np.bincount(slot, rows["n"], len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kinds))), pa.array(kinds), pa.array(total)], names=["slot", "kinds", "total"])

    for slot, kinds, total in counts.select("payload").mapInArrow(sizes, "slot long, kinds long, total long").groupBy("slot").agg(F.sum("kinds"), F.sum("total")).collect():
        words.slot_kinds[slot], words.slot_total[slot] = kinds, total
    words.kinds, words.total = int(words.slot_kinds.sum()), int(words.slot_total.sum())
    return words


class MaxEnt:
    """Weights of the class softmax and of the slot softmax, with the corpus shares as constants."""

    def __init__(self, words: Vocabulary) -> None:
        share = (words.slot_total + 0.5 * (words.slot_kinds + 1)).reshape(CLASSES, SLOTS)
        share = share / share.sum()
        self.base = [np.log(share.sum(axis=1)).astype(np.float32), np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)]
        self.weights = np.zeros((2, ROWS, CLASSES), np.float32)
        self.words = words

    def features(self, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of the features of each token; what lies before a text counts as 0."""
        one, two = np.zeros(len(hashes), U64), np.zeros(len(hashes), U64)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        one[first[:-1]] = two[first[:-1]] = 0
        second = first[:-1] + 1
        two[second[second < first[1:]]] = 0
        return [mixed(one + U64(1)), mixed(two + U64(2)), mixed(one * U64(0x9E3779B97F4A7C15) + two + U64(3))]

    def log_probabilities(self, which: int, rows: list[np.ndarray], base: np.ndarray) -> np.ndarray:
        logits = base + self.weights[which][rows[0]]
        for r in rows[1:]:
            logits += self.weights[which][r]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def steps(self, hashes: np.ndarray, first: np.ndarray):
        """For both softmaxes: which one, feature rows, log-probabilities and the outcome, of blocks of tokens."""
        features, slots = self.features(hashes, first), self.words.slots(hashes)
        for a in range(0, len(hashes), 65_536):
            block = slice(a, a + 65_536)
            classes = slots[block] // SLOTS
            rows = [(f[block] % U64(ROWS)).astype(np.uint16) for f in features]
            yield block, 0, rows, self.log_probabilities(0, rows, self.base[0]), classes
            inner = [(mixed(f[block] + classes.astype(U64)) % U64(ROWS)).astype(np.uint16) for f in features]
            yield block, 1, inner, self.log_probabilities(1, inner, self.base[1][classes]), slots[block] % SLOTS

    def gradient(self, hashes: np.ndarray, first: np.ndarray, gradient: np.ndarray, uses: np.ndarray) -> None:
        for _, which, rows, log_p, outcome in self.steps(hashes, first):
            residual = -np.exp(log_p)
            residual[np.arange(len(outcome)), outcome] += 1
            for r in rows:
                order = np.argsort(r, kind="stable")
                at = grouped(r[order])
                gradient[which][r[order][at]] += np.add.reduceat(residual[order], at, axis=0)
                uses[which] += np.bincount(r, minlength=ROWS)

    def score(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's slot probability."""
        out = np.zeros(len(hashes))
        for block, _, _, log_p, outcome in self.steps(hashes, first):
            out[block] += log_p[np.arange(len(outcome)), outcome]
        return out / np.log(10)


def train(documents: DataFrame, model: MaxEnt, rounds: int = ROUNDS) -> MaxEnt:
    """One pass over all training texts in ``rounds`` parts, with one update behind each."""
    spark = documents.sparkSession
    half = np.dtype("<f4")

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(np.frombuffer(x, half).astype(float) for frame in frames for x in frame["sums"])
        yield pd.DataFrame({"slice": [key[0]], "sums": [total.tobytes()]})

    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            gradient, uses, any_ = np.zeros((2, ROWS, CLASSES), np.float32), np.zeros((2, ROWS)), False
            for batch in batches:
                for _, _, data, offsets in pieces(texts(batch)):
                    any_ = True
                    shared.value.gradient(*tokens(data, offsets), gradient, uses)
            if any_:
                both = np.concatenate((gradient, uses[:, :, None].astype(np.float32)), axis=2).reshape(16, -1)
                yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in both], pa.binary())], names=["slice", "sums"])

        some = documents.where("train").where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        sums = some.mapInArrow(of, "slice int, sums binary").groupBy("slice").applyInPandas(add, "slice int, sums binary")
        total = np.zeros((16, 2 * ROWS * (CLASSES + 1) // 16))
        for i, x in sums.collect():
            total[i] = np.frombuffer(x)
        total = total.reshape(2, ROWS, CLASSES + 1)
        # A diagonal second-order step: FEATURES rows act on each token, curvature is at most a quarter each.
        model.weights = model.weights + (total[:, :, :CLASSES] / (FEATURES * (0.25 * total[:, :, CLASSES:] + 25))).astype(np.float32)
    return model


#: What a text's words that are not frequent add to its sums.
SUM = np.dtype([("row", "<i8"), ("n_known", "<i8"), ("base", "<f8")])
SENT = "part int, payload binary, known boolean, row long, doc_id long, n_tokens long, n_known long, base double, context double"
SCORED = "doc_id long, n_tokens long, n_known long, base double, context double"


def scored(documents: DataFrame, counts: DataFrame, model: MaxEnt) -> DataFrame:
    spark = documents.sparkSession
    parts, shared = parts_of(spark), spark.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SENT.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.float64()]

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, row = shared.value, TaskContext.get().partitionId() << 32
        sizes, held, size = m.words.log_slot_size(), [], 0
        for batch in batches:
            for start, stop, data, offsets in pieces(texts(batch)):
                n = stop - start
                hashes, first = tokens(data, offsets)
                owner = np.repeat(np.arange(n), np.diff(first))
                frequent, uses = m.words.frequent(hashes)
                context = np.bincount(owner, m.score(hashes, first) - sizes[m.words.slots(hashes)], n)
                base = np.bincount(owner, np.where(frequent, np.log10(uses + 0.5), 0.0), n)
                known = np.bincount(owner, frequent, n).astype(np.int64)
                ids = row + np.arange(n)
                yield rows_of(n, part=(ids % parts), row=ids, doc_id=batch.column(0).slice(start, n), n_tokens=np.diff(first), n_known=known, base=base, context=context)
                left = ~frequent
                order = np.lexsort((hashes[left], owner[left]))
                h, o = hashes[left][order], owner[left][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                at = np.flatnonzero(new)
                use = np.empty(len(at), USE)
                use["hash"], use["row"], use["n"] = h[at], ids[o[at]], np.diff(np.append(at, len(h)))[: len(at)]
                held.append(use)
                row, size = row + n, size + len(data)
                if size >= FLUSH_BYTES:
                    yield from asked(held)
                    held, size = [], 0
        if held:
            yield from asked(held)

    def asked(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        use = np.concatenate(held)
        out = list(dealt(part_of(use["hash"], parts), use))
        yield rows_of(len(out), part=[p for p, _ in out], payload=[b for _, b in out], known=[False] * len(out))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, counted = [], []
        for batch in batches:
            own = batch.filter(batch.column(1).is_null())
            if own.num_rows:
                yield own
            for payload, known in zip(batch.column(1), batch.column(2), strict=True):
                if payload.is_valid:
                    (counted if known.as_py() else uses).append(unpacked(payload, COUNT if known.as_py() else USE))
        if not uses:
            return
        use = np.concatenate(uses)
        del uses
        use = use[np.argsort(use["row"], kind="stable")]
        counts_ = np.concatenate(counted) if counted else np.zeros(0, COUNT)
        counts_ = counts_[np.argsort(counts_["hash"])]
        n = np.zeros(len(use), np.int64)
        if len(counts_):
            at = np.minimum(np.searchsorted(counts_["hash"], use["hash"]), len(counts_) - 1)
            n = np.where(counts_["hash"][at] == use["hash"], counts_["n"][at], 0)
        first = grouped(use["row"])
        if len(first):
            base = np.add.reduceat(use["n"] * np.log10(n + 0.5), first)
            known = np.add.reduceat(np.where(n > 0, use["n"], 0).astype(np.int64), first)
            sums = np.empty(len(first), SUM)
            sums["row"], sums["n_known"], sums["base"] = use["row"][first], known, base
            out = list(dealt(sums["row"] % parts, sums))
            yield rows_of(len(out), part=[p for p, _ in out], payload=[b for _, b in out])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = [], []
        for batch in batches:
            own.append(batch.filter(batch.column(1).is_null()).select(names[3:]))
            sums += [unpacked(x, SUM) for x in batch.column(1) if x.is_valid]
        rows = pa.Table.from_batches(own).sort_by("row").combine_chunks() if own else None
        if rows is None or not rows.num_rows:
            return
        at, base, known = rows.column("row").to_numpy(), rows.column("base").to_numpy().copy(), rows.column("n_known").to_numpy().copy()
        if sums:
            all_ = np.concatenate(sums)
            where = np.searchsorted(at, all_["row"])
            base += np.bincount(where, all_["base"], len(at))
            known += np.bincount(where, all_["n_known"], len(at)).astype(np.int64)
        out = rows.select(["doc_id", "n_tokens"]).append_column("n_known", pa.array(known)).append_column("base", pa.array(base))
        yield from out.append_column("context", rows.column("context")).to_batches(50_000)

    packed = documents.select("doc_id", "text").mapInArrow(send, SENT)
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SENT.split(", ")[3:]]
    known = counts.select("part", "payload", F.lit(True).alias("known"), *empty)
    back = packed.unionByName(known).repartition(parts, "part").mapInArrow(answer, SENT)
    return back.repartition(parts, "part").mapInArrow(add, SCORED)


def language_model_scores(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row of ``documents`` under models of the rows outside the held-out fold.

    Null texts are the end token alone; repeated rows count and are scored repeatedly; rows without an
    id are scored but not learnt from.  With no training text every word is unknown.  Other columns take
    no part.  ``score`` is log10 of the text's probability, ``base_score`` that of the unigram model.
    """
    prepared(documents.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    documents = documents.withColumn("train", F.coalesce(fold != 1, F.lit(False)))
    counts = written(word_counts(documents), "word-counts")
    words = vocabulary(counts)
    model = train(documents, MaxEnt(words), rounds)
    out = scored(documents, counts.select("part", "payload"), model)
    base = F.col("base") - F.col("n_tokens") * F.lit(words.log_size())
    return out.select(
        "doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("base") + F.col("context")).alias("score"),
    )


def op10_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model_scores(table(spark, folder, "documents"))
