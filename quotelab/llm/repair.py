"""Cheapest repair of conversations: grammar-compressed dynamic programming over roles and faults.

A row of a conversation is one symbol of its *shape*: its role's initial and its fault.  A symbol is a
min-plus transfer matrix between the states of the automaton of ``(s?(ua)+)?``; an entry is the least cost
and a rope of the edits that reach it.  Shapes of all conversations share one Re-Pair grammar; the matrix
of a rule is the product of its two symbols' matrices, computed bottom-up once a worker, and its ropes
are joints of theirs.  A shape is the product of the few symbols that the grammar leaves of it.

Rows are range-sorted by conversation and turn, so that one conversation may span many tasks, and packed
into chunks.  A conversation inside one chunk is finished there.  Matrices of the chunks of a longer one
are multiplied within each range, then over the ranges, and the chosen edits go back to the chunks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm.common import parts_of, prepared, table, written
from quotelab.llm.grammar import Rules, encoded, grammar

#: Rows and characters of text after which a chunk is full (one text is never split).
CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the automaton: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ENDS = (START, A)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


class Rope:
    """Edits as a joint of two shared ropes, written out when first compared or read."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | None, right: Rope | None, text: str | None = None) -> None:
        self.left, self.right, self._text = left, right, text

    def __str__(self) -> str:
        if self._text is None:
            self._text = str(self.left) + str(self.right)
            self.left = self.right = None
        return self._text


Matrix = list[dict[int, tuple[int, Rope]]]  # by entry state: exit state, cost, edits


def row_times(row: dict[int, tuple[int, Rope]], matrix: Matrix) -> dict[int, tuple[int, Rope]]:
    out: dict[int, tuple[int, Rope]] = {}
    for k, (cost, rope) in row.items():
        for j, (more, tail) in matrix[k].items():
            total, held = cost + more, out.get(j)
            if held is None or total < held[0]:
                out[j] = (total, Rope(rope, tail))
            elif total == held[0]:  # the least text; no candidate can be the other's beginning
                both = Rope(rope, tail)
                if str(both) < str(held[1]):
                    out[j] = (total, both)
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [row_times(row, b) for row in a]


def _text(text: str) -> Rope:
    return Rope(None, None, text)


def _inserts() -> Matrix:
    """Any inserts between two rows; more than two in a row only return to a state at a cost."""
    out: Matrix = [{i: (0, _text(""))} for i in range(4)]
    for i in (START, S):
        out[i][U], out[i][A] = (INSERT, _text("I")), (2 * INSERT, _text("II"))
    out[U][A], out[A][U] = (INSERT, _text("I")), (INSERT, _text("I"))
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then what may be done with one row: ``b`` and ``d`` can only be deleted, capitals are truncated."""
    out: Matrix = [{i: (DELETE, _text("D"))} for i in range(4)]
    if symbol not in "bd":
        fault = TRUNCATED if symbol.isupper() else 0
        for (i, letter), j in STEP.items():
            if letter == symbol.lower():
                out[i][j] = (KEEP + fault, _text("K"))
            elif letter in NAMES:
                out[i][j] = (REROLE + fault, _text("R"))
    return product(INSERTS, out)


class Evaluator:
    """Matrices of symbols and rules, and through them of shapes."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.of = {c: symbol_matrix(c) for c in "suaxSUAXb"}
        for pair, symbol in rules:  # bottom-up: a rule's symbols come before it
            self.of[symbol] = product(self.of[pair[0]], self.of[pair[1]])
        self.whole = lru_cache(1 << 15)(self._whole)

    def symbols(self, shape: str) -> str:
        return encoded(shape.replace("d", "b"), self.rules)

    def matrix(self, shape: str) -> Matrix:
        out: Matrix = [{i: (0, _text(""))} for i in range(4)]
        for symbol in self.symbols(shape):
            out = product(out, self.of[symbol])
        return out

    def _whole(self, shape: str) -> tuple[int, str]:
        row = {START: (0, _text(""))}
        for symbol in self.symbols(shape):
            row = row_times(row, self.of[symbol])
        return best_end(row_times(row, INSERTS))


@lru_cache(2)
def _evaluator(rules: tuple[tuple[str, str], ...]) -> Evaluator:
    return Evaluator(list(rules))


def best_end(row: dict[int, tuple[int, Rope]]) -> tuple[int, str]:
    return min((row[j][0], str(row[j][1])) for j in ENDS if j in row)


def messages(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """What the edits make of the rows, as ``role:text``, and the state after them."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        letter = roles[at][:1] if edit == "K" else "a" if state == U else "u"
        if edit == "I":
            out.append(f"{NAMES[letter]}:")
        else:
            out.append(f"{roles[at] if edit == 'K' else NAMES[letter]}:{texts[at]}")
            at += 1
        state = STEP[state, letter]
    return out, state


def shape_of(roles: list[str], texts: list[str]) -> str:
    """A symbol for each row: role initial (x: no legal one), capital if truncated; b blank, d duplicate."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(SPACE)
        if not end:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            out.append(letter if end[-1] in ".!?" else letter.upper())
    return "".join(out)


def counts(shape: str) -> tuple[int, int, int]:
    return shape.count("b"), shape.count("d"), sum(map(shape.count, "SUAX"))


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


CHUNK = "place long, part int, open boolean, shape string, roles array<string>, texts array<string>, turns array<long>, digests binary"
CHUNK_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]


def _chunks(conv_type: pa.DataType, chunk_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["conv_id", *(c.split()[0] for c in CHUNK.split(", "))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, nothing = TaskContext.get().partitionId(), 0, object()
        conv, edge, turns, roles, texts, chars = nothing, True, [], [], [], 0
        out: list[tuple] = []
        held = 0

        def cut(is_open: bool) -> None:
            nonlocal seq, held, turns, roles, texts, chars
            digests = b"".join(hashlib.md5(f"{conv!r}\n{len(r)}\n{r}\n{t}".encode()).digest() for r, t in zip(roles, texts, strict=True)) if is_open else None
            known = [t for t in turns if t is not None]
            span = [known[0], known[-1], len(set(known))] if known else []
            out.append((conv, part << 32 | seq, part, is_open, shape_of(roles, texts), roles, texts, span, digests))
            held, seq = held + chars, seq + 1
            turns, roles, texts, chars = [], [], [], 0

        for batch in batches:
            for c, turn, present, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv or conv is nothing:
                    if conv is not nothing:
                        cut(edge)
                    edge, conv = conv is nothing, c
                    if len(out) >= 2048 or held > CHUNK_CHARS:
                        yield _rows(names, [conv_type, *CHUNK_TYPES], out)
                        out, held = [], 0
                elif len(roles) >= chunk_rows or chars >= CHUNK_CHARS:
                    edge = True
                    cut(True)
                    if held > CHUNK_CHARS:
                        yield _rows(names, [conv_type, *CHUNK_TYPES], out)
                        out, held = [], 0
                if present:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(text)
        if conv is not nothing:
            cut(True)
        yield _rows(names, [conv_type, *CHUNK_TYPES], out)

    return of


def _marked(chunks: DataFrame) -> DataFrame:
    """Open chunks without their texts; rows that an earlier chunk of the conversation holds become ``d``."""
    opened = chunks.where("open")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, shape, digests in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(digests[16 * i : 16 * i + 16], place, i) for i, c in enumerate(shape) if c not in "bd"]
            yield _rows(["digest", "place", "at"], [pa.binary(), pa.int64(), pa.int32()], rows)

    rows = opened.select("place", "shape", "digests").mapInArrow(each, "digest binary, place long, at int")
    first = rows.groupBy("digest").agg(F.min("place").alias("first"))
    later = rows.join(first, "digest").where("place > first").groupBy("place").agg(F.collect_list("at").alias("again"))
    skinny = opened.select("conv_id", "place", "part", "shape", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"))
    letters = F.split("shape", "")
    marked = F.array_join(F.transform(letters, lambda c, i: F.when(F.array_contains("again", i.cast("int")), "d").otherwise(c)), "")
    return skinny.join(later, "place", "left").withColumn("shape", F.when(F.col("again").isNull(), F.col("shape")).otherwise(marked)).drop("again")


class Segment:
    """Neighbouring chunks of one conversation: matrix, counts, edge initials, turns."""

    __slots__ = ("matrix", "rows", "counts", "illegal", "edges", "span")

    def __init__(self, matrix: list[dict[int, tuple[int, str]]], rows: int, counted: tuple[int, int, int], illegal: int, edges: tuple[str, str] | None, span: list[int]) -> None:
        self.matrix, self.rows, self.counts, self.illegal, self.edges, self.span = matrix, rows, counted, illegal, edges, span

    def ropes(self) -> Matrix:
        return [{j: (cost, _text(text)) for j, (cost, text) in row.items()} for row in self.matrix]

    def then(self, other: Segment) -> Segment:
        matrix = [{j: (c, str(r)) for j, (c, r) in row.items()} for row in product(self.ropes(), other.ropes())]
        illegal, edges, span = self.illegal + other.illegal, self.edges or other.edges, self.span or other.span
        if self.edges and other.edges:
            illegal += self.edges[1] + other.edges[0] not in LEGAL
            edges = (self.edges[0], other.edges[1])
        if self.span and other.span:
            span = [self.span[0], other.span[1], self.span[2] + other.span[2] - (self.span[1] == other.span[0])]
        counted = tuple(x + y for x, y in zip(self.counts, other.counts, strict=True))
        return Segment(matrix, self.rows + other.rows, counted, illegal, edges, span)


def _pickled(segment: Segment) -> bytes:
    return pickle.dumps([getattr(segment, x) for x in Segment.__slots__])


def _joined(payloads: list[bytes]) -> Segment:
    """Balanced, so that each edit is copied once a level."""
    parts = [Segment(*pickle.loads(p)) for p in payloads]
    while len(parts) > 1:
        parts = [parts[i].then(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SUMMARY_NAMES = [c.split()[0] for c in SUMMARY.split(", ")]
SUMMARY_TYPES = [*[pa.int64()] * 6, pa.string()]


def _gaps(span: list[int]) -> int:
    return span[1] - span[0] + 1 - span[2] if span else 0


def repair(rows: DataFrame, present: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of each conversation, whatever its length.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored.  Rows where ``present`` is not true
    count as lost: their conversation is reported, they are not.  Returns one row for each piece of a
    repaired conversation: ``conv_id, piece, whole, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired``.  ``whole`` pieces are entire conversations; of others, the piece with the least number
    holds the figures (the rest has nulls), and their texts in order of ``piece``, joined by newlines, are
    the conversation (a null ``repaired`` adds nothing).

    Null conversation ids are one conversation.  A null role or text reads as one space.  Rows are taken
    by turn, nulls first; equal turns by role, then by a hash of the text; equal rows are duplicates.
    A role whose first character is not s, u or a, an empty one too, fits nowhere.  Very long texts are
    rows like others.  An empty table gives no rows, a conversation of lost rows only zeros, no edits
    and no text.  Rows equal by md5 over conversation, role and text count as equal across chunks.
    """
    spark = prepared(rows.sparkSession)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    keyed = plain.withColumn("tie", F.xxhash64("text")).withColumn("line", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "tie", "line"]
    placed = keyed.repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order).drop("tie", "line")
    arrow = _arrow_type(rows, "conv_id")
    chunks = written(placed.mapInArrow(_chunks(arrow, chunk_rows), f"conv_id {conv_type}, {CHUNK}"), "chunks")
    marked = written(_marked(chunks), "open-chunks")
    closed = chunks.where("not open")
    shapes = closed.select("shape").unionByName(marked.select("shape")).select(F.translate("shape", "d", "b").alias("shape"))
    rules = tuple(grammar(written(shapes.groupBy("shape").agg(F.count("*").alias("n")), "shapes")))
    return _closed(closed, arrow, conv_type, rules).unionByName(_opened(chunks, marked, arrow, conv_type, rules))


def _arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def _closed(closed: DataFrame, arrow: pa.DataType, conv_type: str, rules: tuple) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator = _evaluator(rules)
        for batch in batches:
            out = []
            for conv, shape, roles, texts, span in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                cost, audit = evaluator.whole(shape)
                made, _ = messages(audit, START, roles, texts)
                out.append((conv, _gaps(span), *counts(shape), illegal_pairs(roles), cost, audit, "\n".join(made) if made else None))
            yield _rows(["conv_id", *SUMMARY_NAMES, "repaired"], [arrow, *SUMMARY_TYPES, pa.string()], out)

    done = closed.select("conv_id", "shape", "roles", "texts", "turns").mapInArrow(finish, f"conv_id {conv_type}, {SUMMARY}, repaired string")
    return done.withColumns({"piece": F.lit(0).cast("long"), "whole": F.lit(True)})


def _opened(chunks: DataFrame, marked: DataFrame, arrow: pa.DataType, conv_type: str, rules: tuple) -> DataFrame:
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator = _evaluator(rules)
        for batch in batches:
            out = []
            for conv, place, part, shape, initials, span in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                matrix = [{j: (c, str(r)) for j, (c, r) in row.items()} for row in evaluator.matrix(shape)]
                edges = (initials[0], initials[-1]) if initials else None
                out.append((conv, place, part, _pickled(Segment(matrix, len(shape), counts(shape), illegal_pairs(initials), edges, span))))
            yield _rows(["conv_id", "place", "part", "segment"], [arrow, pa.int64(), pa.int32(), pa.binary()], out)

    def within(key: tuple, frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("place")
        return pa.table([pa.array([key[0].as_py()], arrow), pa.array([key[1].as_py()], pa.int32()), pa.array([_pickled(_joined(frame["segment"].to_pylist()))], pa.binary())], names=["conv_id", "part", "segment"])

    pieces = ["conv_id", "part", "entry", "edits", *SUMMARY_NAMES]
    piece_types = [arrow, pa.int32(), pa.int32(), pa.string(), *SUMMARY_TYPES]

    def over(key: tuple, frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("part")
        parts, payloads, conv = frame["part"].to_pylist(), frame["segment"].to_pylist(), key[0].as_py()
        total = _joined(payloads)
        row = row_times(total.ropes()[START], INSERTS)
        cost, audit = best_end(row)
        out, state, at = [], START, 0
        for n, (part, payload) in enumerate(zip(parts, payloads, strict=True)):
            segment = Segment(*pickle.loads(payload))
            stop = _after(audit, at, segment.rows) if n + 1 < len(parts) else len(audit)
            # The edits of this part that the conversation's audit holds tell its exit state.
            edits = audit[at:stop]
            figures = (_gaps(total.span), *total.counts, total.illegal, cost, audit) if n == 0 else (None,) * 7
            out.append((conv, part, state, edits, *figures))
            state = next((j for j, (_, text) in segment.matrix[state].items() if text == edits), state)
            at = stop
        return pa.Table.from_batches([_rows(pieces, piece_types, out)])

    seg = marked.select("conv_id", "place", "part", "shape", "initials", "turns").mapInArrow(segments, f"conv_id {conv_type}, place long, part int, segment binary")
    joined = seg.groupBy("conv_id", "part").applyInArrow(within, f"conv_id {conv_type}, part int, segment binary")
    decided = written(joined.groupBy("conv_id").applyInArrow(over, f"conv_id {conv_type}, part int, entry int, edits string, {SUMMARY}"), "decided")

    def deal(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The edits of a part dealt to its chunks, in order."""
        left = left.sort_by("place")
        edits, state, at, out = right["edits"][0].as_py(), right["entry"][0].as_py(), 0, []
        places = left["place"].to_pylist()
        for n, (place, shape, initials) in enumerate(zip(places, left["shape"].to_pylist(), left["initials"].to_pylist(), strict=True)):
            stop = _after(edits, at, len(shape)) if n + 1 < len(places) else len(edits)
            out.append((place, state, edits[at:stop], *((right[c][0].as_py() for c in SUMMARY_NAMES) if n == 0 else (None,) * 7)))
            _, state = messages(edits[at:stop], state, initials, initials)
            at = stop
        return pa.Table.from_batches([_rows(["place", "entry", "edits", *SUMMARY_NAMES], [pa.int64(), pa.int32(), pa.string(), *SUMMARY_TYPES], out)])

    left = marked.select("conv_id", "part", "place", "shape", "initials").groupBy("conv_id", "part")
    dealt = left.cogroup(decided.groupBy("conv_id", "part")).applyInArrow(deal, f"place long, entry int, edits string, {SUMMARY}")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = batch_names
        for batch in batches:
            out = []
            for conv, place, entry, edits, roles, texts, *figures in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                made, _ = messages(edits, entry, roles, texts)
                out.append((conv, place, *figures, "\n".join(made) if made else None))
            yield _rows(names, [arrow, pa.int64(), *SUMMARY_TYPES, pa.string()], out)

    batch_names = ["conv_id", "piece", *SUMMARY_NAMES, "repaired"]
    both = chunks.where("open").select("conv_id", "place", "roles", "texts").join(dealt, "place")
    done = both.select("conv_id", "place", "entry", "edits", "roles", "texts", *SUMMARY_NAMES).mapInArrow(render, f"conv_id {conv_type}, piece long, {SUMMARY}, repaired string")
    return done.withColumn("whole", F.lit(False))


def _after(edits: str, at: int, rows: int) -> int:
    """Where the edits of that many rows end, from ``at``."""
    while rows:
        rows -= edits[at] != "I"
        at += 1
    return at


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of conversations in several pieces, hashed piece by piece in order."""
    spark = repaired.sparkSession
    conv_type, arrow = repaired.schema["conv_id"].dataType.simpleString(), _arrow_type(repaired, "conv_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, digest, first, out = nothing, hashlib.sha256(), True, []
        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if conv is nothing or c != conv:
                    if conv is not nothing:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, first = c, hashlib.sha256(), True
                if text.is_valid:
                    digest.update(b"" if first else b"\n")
                    digest.update(text.as_buffer())
                    first = False
        if conv is not nothing:
            out.append((conv, digest.hexdigest()))
        yield _rows(["conv_id", "repaired_sha256"], [arrow, pa.string()], out)

    ordered = repaired.select("conv_id", "repaired", "piece").repartition(parts_of(spark), "conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "repaired").mapInArrow(stream, f"conv_id {conv_type}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows with the faults that their conversation and turn draw."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("draw"))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") != 0).alias("present"), F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations"))
    fixed = repair(rows, F.col("present"))
    whole = fixed.where("whole").withColumn("repaired_sha256", F.sha2(F.coalesce("repaired", F.lit("")), 256))
    pieces = written(fixed.where("not whole"), "pieces")
    sums = digests(pieces).withColumnRenamed("conv_id", "_id")
    several = pieces.where("audit is not null").join(sums, F.col("conv_id").eqNullSafe(F.col("_id")))
    columns = ["conv_id", *SUMMARY_NAMES, "repaired_sha256"]
    return whole.select(columns).unionByName(several.select(columns))


#: One recursion step a row; a state is (cost, edits, text), least by cost, then by edits.
SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
      lambda r, i: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 20 AS draw FROM keyed),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(CASE WHEN draw = 3 THEN [0, 1] WHEN draw = 0 THEN []::INTEGER[] ELSE [0] END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_),
faults AS (
  SELECT conv_id, turn, n, role, text, role[1] AS l, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS e,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
marked AS (
  SELECT *, CASE WHEN e = '' THEN 'b' WHEN again THEN 'd' WHEN e[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM faults),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (n > 1 AND before || l NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows FROM marked GROUP BY conv_id),
-- s0, s1, s2, s3: nothing yet, after s, after u, after a, with any inserts made
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 'r': ''} AS s0, {'c': 99999, 'a': '', 'r': ''} AS s1,
    {'c': 3, 'a': 'I', 'r': E'\\nuser:'} AS s2, {'c': 6, 'a': 'II', 'r': E'\\nuser:\\nassistant:'} AS s3 FROM totals
  UNION ALL
  SELECT conv_id, n, s0, s1,
    list_min([t2, {'c': s0.c + 3, 'a': s0.a || 'I', 'r': s0.r || E'\\nuser:'}, {'c': s1.c + 3, 'a': s1.a || 'I', 'r': s1.r || E'\\nuser:'},
      {'c': t3.c + 3, 'a': t3.a || 'I', 'r': t3.r || E'\\nuser:'}]),
    list_min([t3, {'c': t2.c + 3, 'a': t2.a || 'I', 'r': t2.r || E'\\nassistant:'},
      {'c': s0.c + 6, 'a': s0.a || 'II', 'r': s0.r || E'\\nuser:\\nassistant:'}, {'c': s1.c + 6, 'a': s1.a || 'II', 'r': s1.r || E'\\nuser:\\nassistant:'}])
  FROM (
    SELECT conv_id, n, {'c': w0.c + 4, 'a': w0.a || 'D', 'r': w0.r} AS s0,
      list_min([{'c': w1.c + 4, 'a': w1.a || 'D', 'r': w1.r},
        {'c': w0.c + more + CASE WHEN l = 's' THEN 0 ELSE 99999 END, 'a': w0.a || 'K', 'r': w0.r || kept}]) AS s1,
      list_min([{'c': w2.c + 4, 'a': w2.a || 'D', 'r': w2.r},
        {'c': w0.c + more + u, 'a': w0.a || ku, 'r': w0.r || ru}, {'c': w1.c + more + u, 'a': w1.a || ku, 'r': w1.r || ru},
        {'c': w3.c + more + u, 'a': w3.a || ku, 'r': w3.r || ru}]) AS t2,
      list_min([{'c': w3.c + 4, 'a': w3.a || 'D', 'r': w3.r}, {'c': w2.c + more + a, 'a': w2.a || ka, 'r': w2.r || ra}]) AS t3
    FROM (
      SELECT w.conv_id, m.n, w.s0 AS w0, w.s1 AS w1, w.s2 AS w2, w.s3 AS w3, m.l,
        CASE WHEN m.fault IN ('b', 'd') THEN 99999 WHEN m.fault = 't' THEN 3 ELSE 0 END AS more,
        CASE WHEN m.l = 'u' THEN 0 ELSE 3 END AS u, CASE WHEN m.l = 'u' THEN 'K' ELSE 'R' END AS ku,
        CASE WHEN m.l = 'a' THEN 0 ELSE 3 END AS a, CASE WHEN m.l = 'a' THEN 'K' ELSE 'R' END AS ka,
        E'\\n' || m.role || ':' || m.text AS kept,
        E'\\n' || CASE WHEN m.l = 'u' THEN m.role ELSE 'user' END || ':' || m.text AS ru,
        E'\\n' || CASE WHEN m.l = 'a' THEN m.role ELSE 'assistant' END || ':' || m.text AS ra
      FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1))),
ended AS (
  SELECT t.*, list_min([w.s0, w.s3]) AS s FROM totals t JOIN walk w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.n = t.rows)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit,
  sha256(coalesce(s.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
