"""Text normalization, stated capacities, similarity and page reading.

Normalization and capacities are column expressions.  Python sees rows in two places, in batches: the
sequence ratio of two texts, and the markup of pages.
"""

from __future__ import annotations

import difflib
import html
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions with the job instead of expecting the package on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a stated capacity looks like in normalized text, and the words around it.
CAPACITY_PATTERNS = [
    r"(?:capacite|accueillir|jusqu.?a|maximum|max)[^0-9]{0,35}([1-9][0-9]{1,3})\s*(?:personnes|convives|places)",
    r"([1-9][0-9]{1,3})\s*(?:personnes|convives|places)[^.!?]{0,30}(?:assis|assises|cocktail|reception)",
]
CAPACITY_STARTS = ["capacite|accueillir|jusqu|max", "[1-9][0-9]"]
SEATED_WORDS = ["assis", "banquet", "repas"]
CAPACITY_RANGE = (20, 3000)
CONTEXT = 50
#: Markup that is read before its rows leave.
PAGE_CHARACTERS = 1 << 20


@cache
def _letters() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition without marks makes of each character beyond ASCII.

    Returned are characters that become one letter or digit, what they become, characters that vanish,
    and those that become several.  All others, and signs, only part words.
    """
    one, into, none, several = [], [], [], {}
    for code in (c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000):
        character = chr(code)
        parts = unicodedata.normalize("NFKD", character)
        if parts == character and not unicodedata.combining(character):
            continue
        left = "".join(" " if not (p.isascii() and p.isalnum()) else p.lower() for p in parts if not unicodedata.combining(p))
        if not left:
            none.append(character)
        elif len(left) == 1 and left != " ":
            one.append(character)
            into.append(left)
        elif left.strip():
            several[character] = left
    return "".join(one), "".join(into), "".join(none), several


def normalize_text(text: str | Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space; NULL gives an empty text."""
    one, into, none, several = _letters()
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # Few texts hold a character that becomes several; only those are taken apart.
    without = F.translate(text, "".join(several), "")
    beyond = text.rlike(r"[^\x00-\xbb\xbf-\xff]")
    spelled = F.when(beyond & (F.char_length(without) < F.char_length(text)), spelled).otherwise(text)
    plain = F.lower(F.translate(spelled, one + none, into))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def stated_sizes(words: Column) -> Column:
    """Sizes that a normalized text states: array of (size, seated).

    A size is a seated one when seats are mentioned within ``CONTEXT`` characters of where it is stated.
    """
    low, high = CAPACITY_RANGE
    found = []
    for start, pattern in zip(CAPACITY_STARTS, CAPACITY_PATTERNS, strict=True):
        # Where a hit may start, the longest stretch of up to CONTEXT characters before it, and the hit with
        # as many after it, seen without being used up.
        before = rf"(?={start})(?<=(^.{{0,{CONTEXT - 1}}}|.{{{CONTEXT}}}))"
        whole = F.lit(f"{before}(?=({pattern}.{{0,{CONTEXT}}})){pattern}")
        pieces = F.arrays_zip(
            F.regexp_extract_all(words, whole, F.lit(1)).alias("before"), F.regexp_extract_all(words, whole, F.lit(2)).alias("on")
        )
        found.append(F.transform(pieces, _size_by(pattern)))
    return F.filter(F.concat(*found), lambda h: h["size"].between(low, high))


def _size_by(pattern: str) -> Callable[[Column], Column]:
    return lambda p: F.struct(
        F.regexp_extract(p["on"], pattern, 1).cast("int").alias("size"),
        F.concat(p["before"], p["on"]).rlike("|".join(SEATED_WORDS)).alias("seated"),
    )


def largest_size(sizes: Column, seated: bool) -> Column:
    return F.array_max(F.transform(F.filter(sizes, lambda h: h["seated"] == seated), lambda h: h["size"]))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalized texts."""
    pairs = zip(left, right, strict=True)
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs], dtype=float)


# Raw content of scripts and styles, what is no content, tags, and texts between them.
TOKENS = re.compile(
    r"<(?P<raw>script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?P<code>.*?)(?:</(?P=raw)\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<link>a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
TARGET = re.compile(r"""\shref\s*=\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\s"'>]+))""", re.IGNORECASE)


def page_parts(markup: str | None) -> tuple[str, list[str]]:
    """Text of a page, scripts included, with single spaces; targets of its links in order."""
    said, targets = [], []
    for token in TOKENS.finditer(markup or ""):
        if token["link"]:
            said.append(" ")
            if target := TARGET.search(token["link"]):
                targets.append(html.unescape(target["double"] or target["single"] or target["bare"] or ""))
        elif token["text"] or token["code"]:
            said.append(html.unescape(token["text"] or "") or token["code"])
        else:
            said.append(" ")
    return " ".join("".join(said).split()), [t for t in targets if t]


def resolved(base: str, target: str) -> dict | None:
    """Absolute address of a link, its host and path; None when unreadable."""
    try:
        address = urljoin(base, target)
        parts = urlparse(address)
    except ValueError:
        return None
    return {"url": address, "host": parts.netloc, "path": parts.path}


def host_of(url: str) -> str:
    try:
        return urlparse(url).netloc
    except ValueError:
        return ""


def read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body: one row per page with its text and links.

    Links are many small objects: rows leave as soon as they come from ``PAGE_CHARACTERS`` of markup.
    """
    names = ["url", "host", "text", "links"]
    for batch in batches:
        rows, size = [], 0
        for url, markup in zip(batch["url"], batch["html"], strict=True):
            text, targets = page_parts(markup)
            rows.append((url, host_of(url), text, [link for t in targets if (link := resolved(url, t))]))
            size += len(markup or "")
            if size >= PAGE_CHARACTERS:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


PAGE_SCHEMA = "url string, host string, text string, links array<struct<url:string,host:string,path:string>>"
