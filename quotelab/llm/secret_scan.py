"""Secrets in texts: fixed patterns, and values in credential contexts that are too costly to guess.

A value that follows the name of a credential is cut into words, dates, repeats, keyboard walks and
brute-force spans so that the whole is guessed in as few tries as possible; a forward dynamic program over
its positions finds the least cost.  Words and their ranks are counted over all texts of the corpus.  A value
is a secret when even the cheapest way costs ``MIN_GUESSES`` or more; ``changeme2024`` is none.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quotelab.llm.common import prepared, table, texts, written

# The base patterns in their order, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of AKIA[A-Z0-9]+ that have 20 characters
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ that have 24
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "guess")
#: What an assignment holds in lower case; texts without any need no search.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Names of credentials, and what may stand between a name and its value.
CONTEXT = re.compile(
    r"""(?<![a-z])(?:[a-z0-9]{1,20}[_-])?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|signing|encryption)[_-]?key)["']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:bearer[ \t]+|basic[ \t]+)?["']?([!#-&*-+\--:=?-Z^-z|~]{6,})""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key")

# Rows of keys whose neighbours make a walk, and digits read as letters.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "azertyuiop", "qsdfghjklm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@430157$", "aaeoists")

#: log10 of the tries from which a value is a secret; words of the dictionary.
MIN_GUESSES = 10.0
WORDS = 20_000
#: log10 costs: one more span, a shift or replaced letter, a date, its separators, the first key of a walk, a turn of it.
SPAN, VARIANT, DATE, SEPARATED, FIRST_KEY, TURN = 0.3, 0.3, math.log10(365 * 200), 0.6, math.log10(47), 0.5
LONGEST_WORD, LONGEST_UNIT, SHORTEST_WALK = 20, 8, 3
WORD = re.compile(r"[a-z]{3,20}")
DATES = (re.compile(r"(\d{4})(\d{2})(\d{2})"), re.compile(r"(\d{2})(\d{2})(\d{4})"), re.compile(r"(\d{4})([-/._])(\d{1,2})\2(\d{1,2})"), re.compile(r"(\d{1,2})([-/._])(\d{1,2})\2(\d{4})"))
YEAR = re.compile(r"(?:19|20)\d\d")

NEIGHBOURS = {(a, b) for row in WALKS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}


def alphabet(value: str) -> int:
    """Size of the classes of characters that a value draws from."""
    sizes = {"digit": 10, "lower": 26, "upper": 26, "other": 33}
    return sum(sizes[k] for k in {"digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other" for c in value})


def _is_date(numbers: list[int]) -> bool:
    year = next((n for n in numbers if n > 999), 0)
    rest = [n for n in numbers if n != year]
    return 1900 <= year < 2100 and len(rest) == 2 and all(1 <= n <= 31 for n in rest) and min(rest) <= 12


def spans_from(value: str, at: int, ranks: Mapping[str, int], per_char: float) -> Iterator[tuple[int, float]]:
    """End and log10 cost of each span but brute force that starts at ``at``."""
    low = value[at : at + LONGEST_WORD].lower()
    plain = low.translate(LEET)
    for n in range(3, len(low) + 1):
        part = value[at : at + n]
        shifts = 0.0 if part.islower() or not any(map(str.isupper, part)) else VARIANT if part.isupper() or part[1:].islower() else VARIANT * sum(map(str.isupper, part))
        if low[:n] in ranks:
            yield at + n, math.log10(ranks[low[:n]] + 1) + shifts
        elif plain[:n] in ranks:
            changed = sum(a != b for a, b in zip(low[:n], plain[:n], strict=True))
            yield at + n, math.log10(ranks[plain[:n]] + 1) + shifts + VARIANT * changed
    if "0" <= value[at] <= "9":
        if YEAR.match(value, at):
            yield at + 4, math.log10(200)
        for pattern in DATES:
            if (m := pattern.match(value, at)) and _is_date([int(g) for g in m.groups() if g.isdigit()]):
                yield m.end(), DATE + (SEPARATED if len(m.groups()) == 4 else 0)
    for unit in range(1, LONGEST_UNIT + 1):  # as far as the repeat goes
        word = value[at : at + unit]
        times = len(re.compile(f"(?:{re.escape(word)})+").match(value, at)[0]) // unit if len(word) == unit else 0
        if times >= (3 if unit == 1 else 2):
            base = per_char * unit if unit == 1 else guess_cost(word, ranks, math.inf, per_char)
            yield at + times * unit, base + math.log10(times)
    end, turns, step = at + 1, 0, 0
    small = value[at : at + 1].lower()
    while end < len(value):  # as far as the walk goes
        key = value[end].lower()
        if (small, key) not in NEIGHBOURS:
            break
        turns, step = turns + (step != 0 and (key > small) != (step > 0)), 1 if key > small else -1
        small, end = key, end + 1
        if turns * TURN > 40:  # dearer than any threshold in use
            break
    if end - at >= SHORTEST_WALK:
        yield end, FIRST_KEY + turns * TURN + math.log10(end - at)


def guess_cost(value: str, ranks: Mapping[str, int], limit: float = math.inf, per_char: float | None = None) -> float:
    """log10 of the tries of the cheapest way to guess a value, or ``limit`` if that is less.

    The state is a position and whether a brute-force span is open there; positions are taken in order
    and costs of ``limit`` or more dropped, so a long value that can't be guessed ends early.
    """
    if per_char is None:
        per_char = math.log10(max(2, alphabet(value)))
    best: dict[int, list[float]] = {0: [0.0, math.inf]}  # cost without, with an open brute-force span
    waiting, total = [0], len(value)

    def reach(at: int, brute: int, cost: float) -> None:
        if cost < limit:
            if at not in best:
                best[at] = [math.inf, math.inf]
                heapq.heappush(waiting, at)
            best[at][brute] = min(best[at][brute], cost)

    while waiting:
        at = heapq.heappop(waiting)
        closed, opened = best.pop(at)
        here = min(closed, opened)
        if at == total:
            return here
        more = SPAN if at else 0.0
        for end, cost in spans_from(value, at, ranks, per_char):
            reach(end, 0, here + more + cost)
        reach(at + 1, 1, min(opened, closed + more) + per_char)
    return limit


def dictionary(docs: DataFrame, words: int = WORDS) -> dict[str, int]:
    """Rank of each of the commonest words of all texts, 1 for the commonest; equal counts by the word.

    Counts are added up within tasks, then over tasks; only the ``words`` best come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in texts(batch).to_pylist():
                held.update(WORD.findall(text.lower()))
                if len(held) > 200_000:
                    yield out()
        yield out()

    counted = written(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Words by the eighth of a power of two of their count, to leave rare ones out before tasks report their best.
    eighth = F.floor(F.log2("n") * 8)
    enough, least = 0, 0
    for r in counted.groupBy(eighth.alias("eighth")).count().orderBy(F.desc("eighth")).collect():
        least, enough = r["eighth"], enough + r["count"]
        if enough >= words:
            break
    best = counted.where(eighth >= least).orderBy(F.desc("n"), "word").limit(words).collect()
    return {r["word"]: rank for rank, r in enumerate(best, 1)}


def spans(text: str, ranks: Mapping[str, int], limit: float = MIN_GUESSES) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all secrets, in code points, sorted."""
    low = text.lower()
    found: list[tuple[int, int, int]] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:?!")
            if guess_cost(value, ranks, limit) >= limit:
                found.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def secret_spans(docs: DataFrame, ranks: Mapping[str, int], limit: float = MIN_GUESSES) -> DataFrame:
    """``doc_id, secrets``: of each row the ``(kind, start, stop)`` spans by start, then kind, in code points.

    Other columns are ignored.  Null and empty texts have no spans; null and repeated ids are rows like
    others; texts are searched whole, however long.  Spans of different kinds may overlap.
    """
    prepared(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(id_type)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans(t.as_py(), ranks, limit)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), pa.array(found, span)], names=["doc_id", "secrets"])

    made = docs.select("doc_id", "text").mapInArrow(of, f"doc_id {id_type.simpleString()}, secrets array<struct<kind:string,start:bigint,stop:bigint>>")
    return made


def op12_guess_cost_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_spans(docs, dictionary(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")

    def text(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
