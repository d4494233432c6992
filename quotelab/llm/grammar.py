"""Re-Pair over many short strings: the commonest neighbours become a symbol of their own, round after round.

The strings stay where they are; each round counts neighbours in Spark and brings only the commonest
few to the driver.  A symbol is one character, so that rewriting a string is ``str.replace``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds, symbols added in a round, and the character of the first symbol.
ROUNDS = 8
PER_ROUND = 32
FIRST = 0x100

Rules = list[tuple[str, str]]  # (pair of symbols, its symbol) in the order in which they are applied


def encoded(text: str, rules: Rules) -> str:
    for pair, symbol in rules:
        if pair in text:
            text = text.replace(pair, symbol)
    return text


def grammar(strings: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Rules:
    """Rules of the strings in column ``shape``, each weighing ``n``; at most ``rounds * per_round``.

    A round takes the commonest pairs of neighbours that share no symbol, as rewriting one pair changes
    the count of another that holds one of its symbols.  It ends when no pair occurs twice.  No strings,
    or empty ones, give no rules.  Equal counts go to the smaller pair.
    """
    rules: Rules = []
    for _ in range(rounds):

        def pairs(batches: Iterator[pa.RecordBatch], rules: Rules = rules) -> Iterator[pa.RecordBatch]:
            count: Counter[str] = Counter()
            for batch in batches:
                for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = encoded(text, rules)
                    for pair in {text[i : i + 2] for i in range(len(text) - 1)}:
                        count[pair] += n * text.count(pair)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["pair", "n"])

        counted = strings.select("shape", "n").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * per_round).collect()
        used: set[str] = set()
        added: Rules = []
        for row in best:
            if len(added) < per_round and not used & set(row["pair"]):
                used |= set(row["pair"])
                added.append((row["pair"], chr(FIRST + len(rules) + len(added))))
        if not added:
            break
        rules = [*rules, *added]
    return rules
