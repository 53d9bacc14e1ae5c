"""All phrases of a rule pack found in one scan of each text.

The phrases become one automaton a task, so a scan costs the same for ten phrases and for a
rule file of a hundred thousand; only what is found costs more.  A text comes back with the
phrases that it holds: number, non-overlapping occurrences, line of the first one.  Rules then
count entries of a short array.  Distinct characters are counted in the same pass.

Defined cases: phrases match as they are written, across anything but nothing else; ASCII
phrases under four characters that are marked `word` match between non-letters, ignoring
case; the same phrase under two categories has two entries; an empty text holds none; an empty
phrase is left out.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textassay.functions.packs import Pack

try:
    import ahocorasick
except ImportError:  # then phrase by phrase: the same result, slower
    ahocorasick = None

HIT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("line", T.LongType())])
FOUND = [T.StructField("found", T.ArrayType(HIT)), T.StructField("kinds", T.IntegerType()), T.StructField("bare_n", T.IntegerType())]


@dataclasses.dataclass(frozen=True)
class Entry:
    category: str
    phrase: str
    word: bool


def entries(pack: Pack) -> list[Entry]:
    """Every phrase of a pack under its category; the place in this list is its number."""
    literal = [("scam", pack.scam), ("promo", pack.promo), ("credibility", sum(pack.credibility, ()))]
    literal += [(f"combo_{k}", c[1]) for k, c in enumerate(pack.combos)] + [(f"platform_{k}", p[1]) for k, p in enumerate(pack.platforms)]
    found = [Entry(c, w, w.isascii() and len(w) < 4) for c, words in literal for w in words]
    exact = [("hedging", pack.hedging), ("citing", pack.citing), *((f"custom_{k}", r.keywords) for k, r in enumerate(pack.custom))]
    return found + [Entry(c, w, False) for c, words in exact for w in words]


def numbers(pack: Pack) -> dict[str, tuple[int, int]]:
    """First number and the one after the last of each category."""
    out: dict[str, tuple[int, int]] = {}
    for k, e in enumerate(entries(pack)):
        first = out.get(e.category, (k, k))[0]
        out[e.category] = (first, k + 1)
    return out


class Scanner:
    """found(text): (number, phrase, occurrences, line of the first) of the phrases in a text, by number."""

    def __init__(self, listed: list[Entry]):
        self.by_phrase: dict[str, list[int]] = {}
        self.words: list[tuple[int, str, re.Pattern]] = []
        for k, e in enumerate(listed):
            if e.word and e.phrase:
                self.words.append((k, e.phrase, re.compile(f"(?<![A-Za-z]){re.escape(e.phrase)}(?![A-Za-z])", re.IGNORECASE | re.ASCII)))
            elif e.phrase:
                self.by_phrase.setdefault(e.phrase, []).append(k)
        self.automaton = None
        if ahocorasick is not None and self.by_phrase:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.by_phrase:
                self.automaton.add_word(phrase, phrase)
            self.automaton.make_automaton()

    def _matches(self, text: str):
        """(start, phrase), by end, or by start for a single phrase."""
        if self.automaton is not None:
            for end, phrase in self.automaton.iter(text):
                yield end + 1 - len(phrase), phrase
        else:
            for phrase in self.by_phrase:
                at = text.find(phrase)
                while at >= 0:
                    yield at, phrase
                    at = text.find(phrase, at + 1)

    def found(self, text: str) -> list[tuple[int, str, int, int]]:
        seen: dict[str, list[int]] = {}  # occurrences, start of the first, end of the last counted
        for start, phrase in self._matches(text):
            own = seen.get(phrase)
            if own is None:
                seen[phrase] = [1, start, start + len(phrase)]
            elif start >= own[2]:
                own[0] += 1
                own[2] = start + len(phrase)
        hits = [(k, phrase, n, text.count("\n", 0, first) + 1) for phrase, (n, first, _) in seen.items() for k in self.by_phrase[phrase]]
        for k, phrase, pattern in self.words:
            places = [m.start() for m in pattern.finditer(text)]
            if places:
                hits.append((k, phrase, len(places), text.count("\n", 0, places[0]) + 1))
        return sorted(hits)


def characters(text: str, ignored: np.ndarray) -> tuple[int, int]:
    """Distinct and all characters of a text but those ignored (code points), from one count of its code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return 0, 0
    if points.max() < 1 << 16:
        counts = np.bincount(points, minlength=1 << 8)
        out = counts[ignored[ignored < len(counts)]]
        return int(np.count_nonzero(counts) - np.count_nonzero(out)), int(len(points) - out.sum())
    kinds, counts = np.unique(points, return_counts=True)
    own = ~np.isin(kinds, ignored)
    return int(own.sum()), int(counts[own].sum())


def mark(docs: DataFrame, pack: Pack, ignored: str) -> DataFrame:
    """docs (needs column t, not null) with found, kinds and bare_n: its phrases, and the distinct and all characters but those ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(entries(pack))  # a rule file has a bounded size
    at, schema = docs.columns.index("t"), T.StructType([*docs.schema.fields, *FOUND])
    kind = pa.list_(pa.struct([("id", pa.int32()), ("phrase", pa.string()), ("n", pa.int32()), ("line", pa.int64())]))
    apart = np.array(sorted(set(map(ord, ignored))), np.uint32)

    def scan(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            found, kinds, bare = [], [], []
            for text in batch.column(at).to_pylist():
                found.append([{"id": k, "phrase": p, "n": n, "line": line} for k, p, n, line in scanner.found(text)])
                for column, n in zip((kinds, bare), characters(text, apart), strict=True):
                    column.append(n)
            new = [pa.array(found, kind), pa.array(kinds, pa.int32()), pa.array(bare, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(scan, schema)
