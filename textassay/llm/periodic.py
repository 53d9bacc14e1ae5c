"""Periodic runs of words, found with an enhanced suffix array and the branching-tandem test.

A task takes its documents in batches of words.  Words are numbered per document, so that
suffixes of different documents never share a prefix, and the suffix array of a batch is
built by prefix doubling: round k ranks the suffixes by their first 2**k words, and only
groups that are still tied are sorted again.  A run of at least MIN_LENGTH words and three
periods holds two suffixes that share 16 words, so documents without such a tie after
round 4 go no further.  The ranks of all rounds are kept: they give the LCP array and the
extension of a square to the left by binary descent, exactly.

Each boundary of an LCP interval of depth d parts it in two; the suffixes of the smaller
part look up ISA[i + d] and ISA[i - d], and where one falls into the other part a square
with period d ends a run there (the next word differs).  Its rotations to the left merge
into the run.  No tree nodes are built; the work is O(n log n) in numpy.

Defined cases: a null or blank text has no words and no runs, its collapsed text is "";
rows are told by place, so equal ids, null ids and repeated rows each get their own result;
of runs with the same words the smallest period counts; among runs of equal exponent the
smallest start is `best`, then the smallest period; an empty table gives an empty result;
a very long text is a batch of its own, in memory proportional to it; a further column with
the name of a new one stays, and the new one gets a trailing underscore.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textassay.llm.io import bounded, free

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words of the documents that share a suffix array.
BATCH_WORDS = 200_000
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _refine(ids: np.ndarray, first: np.ndarray | None, shared: int):
    """Suffix array, its inverse and the ranks of each doubling round.

    ids are dense; `first` (where each document begins) lets documents without a tie drop out
    at the last round of at most `shared` words: then (kept documents, None, None) is returned.
    """
    n = len(ids)
    sizes = np.bincount(ids)
    starts = np.cumsum(sizes) - sizes
    sa = np.argsort(ids, kind="stable").astype(np.int64)
    rank = starts[ids]
    levels = [rank.astype(np.int32)]
    tied = np.flatnonzero(sizes[ids[sa]] > 1)  # places in the suffix array
    h = 1
    while len(tied):
        at = sa[tied]
        after = at + h
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[tied] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        rank[at] = np.repeat(tied[head], np.diff(np.append(head, len(key))))
        levels.append(rank.astype(np.int32))
        h *= 2
        alone = np.diff(np.append(head, len(key))) == 1
        tied = tied[~np.repeat(alone, np.diff(np.append(head, len(key))))]
        if first is not None and h <= shared < 2 * h:
            own = np.unique(np.searchsorted(first, sa[tied], side="right") - 1)
            if len(own) < len(first):
                return own, None, None
            first = None
    return sa, rank, levels


def _equal(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Longest equal stretch from i and j on (step 1), or that ends before them (step -1), i < j."""
    n, length = len(levels[0]), np.zeros(len(i), np.int64)
    i, j = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        a, b = (i, j) if step > 0 else (i - width, j - width)
        inside = (b < n) & (a < n) & (a >= 0)
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        length += width * same
        i += step * width * same
        j += step * width * same
    return length


def _nearest(lcp: np.ndarray, step: int) -> np.ndarray:
    """Nearest boundary before each with LCP not above its own (step -1), or after it with a smaller one (step 1).

    By pointer jumping; lcp has sentinels of -1 at both ends.
    """
    near = np.arange(len(lcp)) + step
    near[0] = 0
    near[-1] = len(lcp) - 1
    open_ = np.arange(1, len(lcp) - 1)
    while len(open_):
        p = near[open_]
        over = lcp[p] > lcp[open_] if step < 0 else lcp[p] >= lcp[open_]
        open_ = open_[over]
        near[open_] = near[p[over]]
    return near


def _squares(ids: np.ndarray, sa: np.ndarray, isa: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each branching tandem repeat."""
    n = len(ids)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = 0
    tied = np.flatnonzero(ids[sa[1:]] == ids[sa[:-1]]) + 1
    lcp[tied] = _equal(levels, sa[tied - 1], sa[tied], 1)
    low, high = _nearest(lcp, -1), _nearest(lcp, 1)
    at = np.flatnonzero(lcp > 0)
    left, right = at - low[at], high[at] - at
    small = np.where(left <= right, low[at], at)
    size = np.minimum(left, right)
    other = np.where(left <= right, at, low[at])
    other_end = np.where(left <= right, high[at], at)
    starts, periods = [], []
    ends = np.cumsum(size)
    cut = 0
    while cut < len(at):  # a bounded number of suffixes at a time
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + (1 << 20), side="right")))
        own, times = np.s_[cut:stop], size[cut:stop]
        place = np.repeat(small[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        depth, lo, hi = (np.repeat(x[own], times) for x in (lcp[at], other, other_end))
        i = sa[place]
        for shift in (1, -1):
            j = i + shift * depth
            inside = (j >= 0) & (j < n)
            there = isa[np.where(inside, j, 0)]
            hit = inside & (there >= lo) & (there < hi)
            starts.append(np.minimum(i, j)[hit])
            periods.append(depth[hit])
        cut = stop
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *periods])


def find(documents: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start and period; a document is an array of word numbers from 0, dense."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    # a run and its shift by one period share at least this many words
    shared = min(-(-min_length * (min_exponent - 1) // min_exponent), min_length)
    kept = [k for k, ids in enumerate(documents) if len(ids) >= min_length]
    for again in (False, True):
        if not kept:
            return found
        lengths = np.array([len(documents[k]) for k in kept])
        first = np.cumsum(lengths) - lengths
        kinds = np.array([documents[k].max() + 1 for k in kept], np.int64)
        ids = np.concatenate([documents[k] for k in kept]) + np.repeat(np.cumsum(kinds) - kinds, lengths)
        sa, isa, levels = _refine(ids, None if again else first, shared)
        if levels is not None:
            break
        kept = [kept[k] for k in sa]
    start, period = _squares(ids, sa, isa, levels)
    back = _equal(levels, start, start + period, -1)
    end, start = start + 2 * period, start - back
    long = end - start >= np.maximum(min_length, min_exponent * period)
    best: dict[tuple[int, int], int] = {}
    for s, e, q in zip(start[long].tolist(), end[long].tolist(), period[long].tolist(), strict=True):
        best[s, e] = min(q, best.get((s, e), q))
    for (s, e), q in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(first, s, side="right")) - 1
        found[kept[k]].append((s - int(first[k]), e - s, q))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Every row of `docs` (needs column text) with runs, best (a run or null) and collapsed, the text without repetitions."""
    bounded(docs.sparkSession)
    named = [free(n, docs.columns) for n in ("runs", "best", "collapsed")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(named, (T.ArrayType(RUN), RUN, T.StringType()), strict=True))])
    at = docs.columns.index("text")
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def record(r):
        return None if r is None else dict(zip(("start", "length", "period"), r, strict=True))

    def scan(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            first = 0
            while first < batch.num_rows:
                words, n, last = [], 0, first
                while last < batch.num_rows and (last == first or n < BATCH_WORDS):
                    words.append((texts[last].as_py() or b"").split())  # bytes split at exactly the six ASCII blanks
                    n += len(words[-1])
                    last += 1
                found = find([_numbered(w) for w in words], min_length, min_exponent)
                short = pa.array([collapse(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
                new = [pa.array([[record(x) for x in r] for r in found], pa.list_(run)), pa.array([record(strongest(r)) for r in found], run), short]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *new], [*batch.schema.names, *named])
                first = last

    return docs.mapInArrow(scan, schema)
