"""Substring dedup by collinear chaining: fuzzy passages that documents share.

Seeds are K-word shingles whose smallest word hash stands first or last: a choice by content
alone, so equal shingles are chosen in every text, and any SURE equal words hold one.  The
places of a seed form nested classes by how many of the words that follow agree.
In a class of at most FEW texts every text is linked with every other, at their places that
agree furthest.  A place of a class with more is linked with the leader (smallest text hash)
of the finest class that more texts share, and, for its partners that share a shorter piece of
their own, every two such seeds of a text within JOINT words make a seed of their own, whose
classes are linked alike; so texts that only share pieces that many others have too, one here
and one there, meet.

A place of a larger class that no passage of its text covers then is open, and is held against every place of its
seed: two of them are linked if the AROUND words on each side may hold a passage.  That asks for ALIKE pairs of neighbours
in common and, on both sides, for a span over the place with as many words of the other as MIN_WORDS and MIN_IDENTITY
demand, or as three in five of what is seen where it goes on beyond.  This is looked up in tiles of a class inside a task,
so places that are not alike never are a row, and no task holds a class.  A covered place is not held against more texts.
Links inside a long equal stretch are thinned to every fourth seed but at its end.

Per pair of texts the matches are chained in order with a cost per word of gap, the best
predecessor coming from Fenwick trees of prefix maxima.  The trees belong to cells of
GAP_MOST words by GAP_MOST words, and a match looks into its own and the neighbouring
cells, so what lies further behind hides nothing that is near.  Chains are aligned on the
words around them, extended at both ends until unlike words outweigh, or, where that leaves fewer
than MIN_WORDS, as widely as MIN_IDENTITY allows, parted at their worst gap while too few words
are equal, and kept from MIN_WORDS words and MIN_IDENTITY of equal words.  A chain whose extension reaches the end of those words is aligned again
on the whole texts.

The seeds are dealt out in PASSES passes by their hash, so a fraction of them lies in
shuffle files at a time.  Equal texts are one node; its rows get their ids back at the end.

Defined cases: null, empty and short texts share nothing; exact repeats of a row are one
document, different texts under one id are several, and a missing id is an id of its own;
repeats inside one text are not reported; every stretch of a document that is shared
stands in a row of its own, with one other document (the smallest id on ties); very long
texts are read whole, in slices; further columns of docs are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from itertools import chain as joined

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.io import drop, shared_dir, stored
from textassay.llm.textops import _BASE, SPACE_WORDS, as_signed, mix64, slices

K = 5
#: So many equal words in a row hold a seed.
SURE = 2 * K - 2
#: Words after a seed that order its places: (first, words, bits) of each piece of the key; the words are powers of two.
KEY = ((5, 4, 16), (9, 8, 12), (17, 16, 12), (33, 8, 8), (41, 8, 8), (49, 8, 8))
#: Bits of the key that agree inside a class of each level.
LEVELS = [sum(bits for *_, bits in KEY[:n]) for n in range(len(KEY) + 1)]
#: From this level on links are thinned.
LONG = 2
#: From this level on MIN_WORDS words agree, so that a leader has all the passage that begins there.
WHOLE = 4
PAD = 64
PASSES = 1
GAP_COST = 0.1
#: Words between matches beyond which a passage ends (matches of neighbouring cells may lie up to twice as far apart).
GAP_MOST = 100
MIN_WORDS, MIN_IDENTITY = 40, 0.8
#: Evidence that a chain needs: a match counts 1, 2 if the next 4 words agree and 3 if the next 12 do.
MIN_EVIDENCE = 3
#: Words around a chain that it is aligned on at first.
REACH = 128
BLOCK = 128
#: Chains that are extended at once.
LINES = 1 << 11
#: Words that an extension may run on past differing words.
DROP = 4
#: Places back that a repeat is looked for.
PERIOD = 8
#: Rows of a record batch that a task hands out at once.
ROWS = 1 << 16
#: Texts of a class that all meet each other; beyond, they meet its leader, those that share a second seed, and, where nothing covers them, all.
FEW = 8
#: Words between the first words of two seeds that are taken together.
JOINT = 16
#: Words on each side of an open place that are held against those of another one.
AROUND = 60
#: Neighbouring words that two of them need in common: a passage of MIN_WORDS has so many equal words, less one for each stretch of them.
ALIKE = round(MIN_IDENTITY * MIN_WORDS) - (2 * (MIN_WORDS - round(MIN_IDENTITY * MIN_WORDS)) + 1)
#: Values of the hashes by which words and neighbours are told in a tile; NOTHING stands for what is beyond a text's ends.
BUCKETS, NOTHING = 1 << 13, (1 << 16) - 1
#: Pairs of places whose spans are looked at together.
SPANS = 1 << 14
#: Places of a class in a tile at most, about; larger classes are cut into blocks of half as many by text, of which every two make a tile.
TILE = 1 << 13
#: Places of one seed that are looked at together; beyond, the leaders found so far are carried on.
HOLD = 1 << 17
#: Hashes of texts a task remembers, so that copies in one task give their seeds once.
REMEMBER = 1 << 16
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PLACES = "seed bigint, key bigint, node bigint, pos int"
LINKS = "node bigint, other bigint, pos int, other_pos int, evidence int"
LINK_NAMES = ["node", "other", "pos", "other_pos", "evidence", "seed", "key"]
FOUND = "node bigint, other bigint, first_word bigint, last_word bigint, other_first bigint, other_last bigint, identity double, cut boolean"


def seeds(texts: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """PLACES of the seeds of texts(node, text) whose hash falls to `part`; key orders by the words that follow."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("node").to_numpy()
            for piece in slices(batch.column("text")):
                words = piece.words(SPACE_WORDS, lower=True)
                times = np.where(words.count >= MIN_WORDS, words.count - K + 1, 0)
                for r in np.flatnonzero(times):
                    node = int(ids[piece.first + r])
                    if node in seen:
                        times[r] = 0
                    elif len(seen) < REMEMBER:
                        seen.add(node)
                if not times.sum():
                    continue
                # rows stand apart, so that no window runs on into the next row's words
                apart = np.arange(piece.n) * PAD
                flat = np.zeros(len(words.hash) + piece.n * PAD + PAD, np.uint64)
                flat[np.arange(len(words.hash)) + np.repeat(apart, words.count)] = words.hash
                pos = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(np.arange(piece.n), times)
                at = words.rows[:-1][row] + apart[row] + pos
                inner = flat[at + 1]
                for k in range(2, K - 1):
                    inner = np.minimum(inner, flat[at + k])
                own = np.minimum(flat[at], flat[at + K - 1]) <= inner
                at, pos, row = at[own], pos[own], row[own]
                spans, n = {1: flat}, 1
                while n < 16:
                    wide = spans[n] * np.uint64(pow(_BASE, n, 1 << 64))
                    wide[:-n] += spans[n][n:]
                    n *= 2
                    spans[n] = wide
                seed = mix64(spans[4][at] * np.uint64(_BASE) + flat[at + 4])
                mine = np.flatnonzero((seed >> np.uint64(32)) % np.uint64(parts) == part)
                at, seed, pos, row = at[mine], seed[mine], pos[mine], row[mine]
                key = np.zeros(len(at), np.uint64)
                for first, n, bits in KEY:
                    key = key << np.uint64(bits) | mix64(spans[n][at + first]) >> np.uint64(64 - bits)
                # of a place that comes again every few words, with all that follows, the first stays
                again = np.zeros(len(at), bool)
                for k in range(1, PERIOD + 1):
                    again[k:] |= (seed[k:] == seed[:-k]) & (key[k:] == key[:-k]) & (row[k:] == row[:-k])
                fresh = np.flatnonzero(~again)
                node = ids[piece.first + row]
                for i in range(0, len(fresh), ROWS):
                    o = fresh[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(as_signed(seed[o])), pa.array(as_signed(key[o])), pa.array(node[o]), pa.array(pos[o].astype(np.int32))], ["seed", "key", "node", "pos"])

    return texts.select("node", "text").mapInArrow(run, PLACES)


def _levels(differing: np.ndarray) -> np.ndarray:
    """The finest level at which keys agree, from the bits in which they differ."""
    return sum((differing >> np.uint64(64 - bits) == 0).astype(np.int64) for bits in LEVELS[1:])


def _classes(seed, key):
    """For each level, whether a place begins a class, of places sorted by seed and key."""
    for bits in LEVELS:
        prefix = key >> np.uint64(64 - bits) if bits else np.zeros(len(seed), np.uint64)
        yield np.concatenate([[True], (seed[1:] != seed[:-1]) | (prefix[1:] != prefix[:-1])])


def _sized(seed, key, node, few, before, after):
    """(group, rank, more, level): the coarsest class of at most `few` texts that a place is in, -1 for none; its text's rank
    there; whether a text stands there twice; and the finest level at which more texts share its class, -1 for none.

    A class that the places before or after these belong to as well has more texts.
    """
    n = len(seed)
    group, rank, more, level = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, -1)
    left, given = np.arange(n), 0
    for k, begins in enumerate(_classes(seed, key)):
        own = np.cumsum(begins[left]) - 1
        if not len(left):
            break
        order = np.lexsort((node[left], own))
        o, v = own[order], node[left][order]
        fresh = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
        first = np.concatenate([[True], o[1:] != o[:-1]])
        texts, number = np.bincount(o[fresh]), np.cumsum(fresh) - 1
        small = texts <= few
        if before is not None and left[0] == 0 and _carries(before, seed, key, k):
            small[0] = False
        if after and left[-1] == n - 1:
            small[-1] = False
        to = small[own]
        ranks = np.zeros(len(left), np.int64)
        ranks[order] = number - number[first][o]
        group[left[to]], rank[left[to]], more[left[to]] = own[to] + given, ranks[to], (np.bincount(own) > texts)[own[to]]
        level[left[~to]] = k
        left, given = left[~to], given + len(texts)
    return group, rank, more, level


def _carries(carried, seed, key, k) -> bool:
    """Whether the first place is in the class of level k that the places before ended with."""
    bits = LEVELS[k]
    return carried[0] == seed[0] and (not bits or carried[1] >> np.uint64(64 - bits) == key[0] >> np.uint64(64 - bits))


def _met(key, group, rank, more, few):
    """(rows, partners, level): each place of a group with every other text's place that agrees furthest; once for a pair where no text stands there twice."""
    out = [(np.zeros(0, np.int64),) * 3]
    inside = np.flatnonzero(group >= 0)
    for r in range(few):
        own = inside[rank[inside] == r]
        rest = inside[(rank[inside] > r) | (more[inside] & (rank[inside] < r))]
        if not len(own) or not len(rest):
            break
        at = np.searchsorted(own, rest)
        pair, far = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.uint64)
        any_ = np.zeros(len(rest), bool)
        for near, there in ((own[np.minimum(at, len(own) - 1)], at < len(own)), (own[np.maximum(at - 1, 0)], at > 0)):
            differing = key[near] ^ key[rest]
            better = there & (group[near] == group[rest]) & (~any_ | (differing < far))
            pair[better], far[better] = near[better], differing[better]
            any_ |= better
        out.append((rest[any_], pair[any_], _levels(far[any_])))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _led(seed, key, node, pos, carried, shared):
    """(rows, leader's node, leader's pos, level) of the places that have a leader, and the leaders of the last classes.

    carried: (seed, key, [(node, pos) a level]) of the classes that the rows before ended with.
    shared: the finest level at which a place looks for one.
    """
    n = len(seed)
    lead, where, level = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    ended = []
    for k, begins in enumerate(_classes(seed, key)):
        starts, own = np.flatnonzero(begins), np.cumsum(begins) - 1
        best = np.minimum.reduceat(node, starts)
        bearer = np.flatnonzero(node == best[own])
        first = np.zeros(len(starts), np.int64)
        first[own[bearer][::-1]] = bearer[::-1]
        place = pos[first].astype(np.int64)
        if carried and _carries(carried, seed, key, k):
            best[0], place[0] = carried[2][k]
        led = (node != best[own]) & (shared >= k)
        lead[led], where[led], level[led] = best[own][led], place[own][led], k
        ended.append((best[-1], place[-1]))
    rows = np.flatnonzero(level >= 0)
    return rows, lead[rows], where[rows], level[rows], (seed[-1], key[-1], ended)


def leaders(batches, few=1, worth=1, rest=False):
    """LINKS of places sorted by seed, key and node: all pairs of the texts in classes of at most `few`, else with the leaders of the classes.

    A match is worth `worth` and what agrees after it.  With rest the places whose seed more texts share follow as rows without other,
    but for those whose next MIN_WORDS words more texts share: the leader stands for them.
    """
    names = ["seed", "key", "node", "pos"]
    held, carried = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)], None
    for batch in joined(batches, [None]):
        if batch is not None:
            held = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, names, strict=True)]
        n = cut = len(held[0])
        if batch is not None and n:
            # the last seed's places wait for the rest of them, unless there are very many
            begin = int(np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))[-1])
            cut = n if n - begin >= HOLD else begin
        if not cut:
            continue
        seed, key, node, pos = (h[:cut] for h in held)
        held = [h[cut:] for h in held]
        if carried is None:  # most seeds have one place
            edge = np.concatenate([[True], seed[1:] != seed[:-1], [True]])
            many = ~(edge[1:] & edge[:-1])
            seed, key, node, pos = seed[many], key[many], node[many], pos[many]
            if not len(seed):
                continue
        key = key.view(np.uint64)
        goes_on = cut == n and batch is not None  # a seed that is cut has many places
        group, rank, more, shared = _sized(seed, key, node, few, carried, goes_on)
        met, partner, agreed = _met(key, group, rank, more, few)
        rows, lead, where, level, ended = _led(seed, key, node, pos, carried, shared)
        carried = ended if goes_on else None
        unmet = shared >= 0
        unmet[rows[level >= WHOLE]] = False
        rows, level = np.concatenate([met, rows]), np.concatenate([agreed, level])
        lead, where = np.concatenate([node[partner], lead]), np.concatenate([pos[partner], where])
        keep = (level < LONG) | (mix64(seed[rows].view(np.uint64)) & np.uint64(3) == 0)
        rows, lead, where, level = rows[keep], lead[keep], where[keep], level[keep]
        # a pair stands once, under the larger node
        turn = lead > node[rows]
        columns = [np.where(turn, lead, node[rows]), np.where(turn, node[rows], lead), np.where(turn, where, pos[rows]), np.where(turn, pos[rows], where), np.minimum(worth + level, 3)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        last = [pa.nulls(len(rows), pa.int64())] * 2 if rest else []
        for i in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + ROWS], k) for c, k in zip(columns, kinds, strict=True)), *(c[i : i + ROWS] for c in last)], LINK_NAMES[: 5 + len(last)])
        hot = np.flatnonzero(unmet) if rest else []
        for i in range(0, len(hot), ROWS):
            o = hot[i : i + ROWS]
            none = [pa.nulls(len(o), k) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(node[o]), none[1], pa.array(pos[o], pa.int32()), *none[3:], pa.array(seed[o]), pa.array(key[o].view(np.int64))], LINK_NAMES)


def joint(batches):
    """PLACES of every two seeds of a text of places(node, pos, seed, key), sorted by node and pos, that a passage of MIN_WORDS words may hold; they stand where the first does."""
    held = [np.zeros(0, np.int64)] * 4
    for batch in joined(batches, [None]):
        if batch is not None:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("node", "pos", "seed", "key"), strict=True)]
        node, pos, seed, key = held
        if not len(node):
            continue
        # a place waits until all that its passage may hold is there
        whole = len(node) if batch is None else int(np.flatnonzero((node != node[-1]) | (pos[-1] - pos > JOINT))[-1:].sum() + 1)
        if batch is not None and node[0] == node[-1] and pos[-1] - pos[0] <= JOINT:
            continue
        held = [h[whole:] for h in held]
        for d in range(1, JOINT + 1):
            i = np.arange(max(0, min(whole, len(node) - d)))
            i = i[(node[i] == node[i + d]) & (pos[i + d] - pos[i] <= JOINT)]
            if not len(i):
                break
            both = mix64(seed[i].view(np.uint64) * np.uint64(_BASE) + mix64(seed[i + d].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(both)), pa.array(key[i]), pa.array(node[i]), pa.array(pos[i].astype(np.int32))], ["seed", "key", "node", "pos"])


class Fenwick:
    """Prefix maxima of (value, index) over GAP_MOST places."""

    def __init__(self):
        self.best: list[tuple[float, int] | None] = [None] * (GAP_MOST + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i <= GAP_MOST:
            if self.best[i] is None or self.best[i] < value:
                self.best[i] = value
            i += i & -i

    def top(self, n: int) -> tuple[float, int] | None:
        """The largest value at places 0..n-1."""
        top = None
        while n:
            if self.best[n] is not None and (top is None or top < self.best[n]):
                top = self.best[n]
            n -= n & -n
        return top


def _in_line(matches: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """_among_all of matches that all rise: the one in front is the best predecessor, as each is worth more than the gap to those further back."""
    score, came = [], []
    for k, (x, y) in enumerate(matches):
        own, back = float(K), -1
        if k:
            a, b = matches[k - 1]
            if x // GAP_MOST - a // GAP_MOST <= 1 and y // GAP_MOST - b // GAP_MOST <= 1 and (gain := K + score[-1] - GAP_COST * (x + y - a - b)) > own:
                own, back = gain, k - 1
        score.append(own)
        came.append(back)
    return score, came


def _among_all(matches: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """The best score of a chain that ends with each of the sorted matches, and its predecessor there (-1 for none)."""
    trees: dict[tuple[int, int], Fenwick] = {}
    score: list[float] = []
    came: list[int] = []
    i = 0
    while i < len(matches):
        j = i
        while j < len(matches) and matches[j][0] == matches[i][0]:  # equal positions do not follow each other
            x, y = matches[j]
            cx, cy, best = x // GAP_MOST, y // GAP_MOST, None
            for a in (cx, cx - 1):
                for b, reach in ((cy, y % GAP_MOST), (cy - 1, GAP_MOST)):
                    if (a, b) in trees and (top := trees[a, b].top(reach)) is not None and (best is None or best < top):
                        best = top
            own, back = float(K), -1
            if best is not None and (gain := K + best[0] - GAP_COST * (x + y)) > own:
                own, back = gain, best[1]
            score.append(own)
            came.append(back)
            j += 1
        for k in range(i, j):
            x, y = matches[k]
            trees.setdefault((x // GAP_MOST, y // GAP_MOST), Fenwick()).put(y % GAP_MOST, (score[k] + GAP_COST * (x + y), k))
        i = j
    return score, came


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of (pos, other pos) matches, both rising from one cell to itself or a neighbour, by score less gap costs; best first."""
    matches = sorted(set(matches))
    rising = all(a[0] < b[0] and a[1] < b[1] for a, b in zip(matches, matches[1:]))
    score, came = _in_line(matches) if rising else _among_all(matches)
    if rising and score[-1] > max(score[:-1], default=0) and -1 not in came[1:]:
        return [matches]
    used, out = [False] * len(matches), []
    for k in sorted(range(len(matches)), key=lambda k: (-score[k], k)):
        own = []
        while k >= 0 and not used[k]:
            used[k] = True
            own.append(matches[k])
            k = came[k]
        if own:
            out.append(own[::-1])
    return out


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words in the best alignment of two short stretches (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    ends = 0
    for _ in range(2):  # what is equal at the front, then at the back
        n = min(len(a), len(b))
        same = int(np.argmin(np.append(a[:n] == b[:n], False)))
        a, b, ends = a[same:][::-1], b[same:][::-1], ends + same
    if not len(a) or not len(b):
        return ends
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        diagonal = row[:-1] + (b == w)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], diagonal))
    return ends + int(row[-1])


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """Which words are equal as two stretches go on together until differing words outweigh, how many of them to take, and whether they end first."""
    n = min(len(a), len(b))
    if not n:
        return np.zeros(0, bool), 0, True
    equal = a[:n] == b[:n]
    gain = np.cumsum(np.where(equal, 1, -2))
    over = np.maximum.accumulate(np.maximum(gain, 0)) - gain > 2 * DROP
    stop = int(np.argmax(over)) if over.any() else n
    if not stop or gain[:stop].max() <= 0:
        return equal[:stop], 0, stop == n
    return equal[:stop], int(np.argmax(gain[:stop])) + 1, stop == n


def _widest(words: int, same: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """The most words to take to the left and right of `words` with `same` equal ones so that MIN_IDENTITY of all are equal.

    Each end is an equal word.  Of equally wide spans the one that takes most on the right.
    """

    def over(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.flatnonzero(equal) + 1])
        return at, np.concatenate([[0], np.cumsum(equal)[equal]]) - MIN_IDENTITY * at

    (take, gain), (other, more) = over(left), over(right)
    ahead = np.maximum.accumulate(more[::-1])[::-1]  # the best that this many words or more give
    need = -(same - MIN_IDENTITY * words) - gain - 1e-9
    far = np.searchsorted(-ahead, -need, side="right") - 1
    if far.max() < 0:
        return None
    total = np.where(far >= 0, take + other[far], -1)
    k = int(np.argmax(total))
    return int(take[k]), int(other[far[k]])


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float, bool, bool]]:
    """The passages (first, last, other first, other last, identity) of a chain on the word hashes of both texts.

    A chain with too few equal words is parted at its worst gap until the parts have enough.
    The flags tell whether a's words ended before the extension did, at each end.
    """
    steps, equal, unlike = [], [], []  # (x, y, words) of the matches without what overlaps; equal and unlike words in front of each
    x, y = chain[0]
    for x2, y2 in chain:
        skip = max(0, x - x2, y - y2)
        if skip < K:
            gap = _gap(a[x : x2 + skip], b[y : y2 + skip])
            equal.append(gap)
            unlike.append(max(x2 + skip - x, y2 + skip - y) - gap)
            x, y = x2 + K, y2 + K
            steps.append((x2 + skip, y2 + skip, K - skip))
    out, parts = [], [(0, len(steps))]
    while parts:
        low, high = parts.pop()
        x, y, _ = steps[low]
        to_left, left, before = _reach(a[:x][::-1], b[max(0, y - x) : y][::-1])
        before &= x <= y  # else b ends first
        core, first, other = sum(n for *_, n in steps[low:high]) + sum(equal[low + 1 : high]), x, y
        x, y, n = steps[high - 1]
        x, y = x + n, y + n
        to_right, right, after = _reach(a[x:], b[y : y + len(a) - x])
        after &= len(a) - x <= len(b) - y
        words = max(x - first, y - other)
        if words + left + right < MIN_WORDS <= words + len(to_left) + len(to_right):
            # too short as trimmed: the widest span that is still alike enough
            wide = _widest(words, core, to_left, to_right)
            if wide is not None and words + sum(wide) >= MIN_WORDS:
                left, right = wide
        same, more = core + int(to_left[:left].sum()), int(to_right[:right].sum())
        first, other, x, y = first - left, other - left, x + right, y + right
        identity = (same + more) / max(x - first, y - other)
        if identity >= MIN_IDENTITY or (low + 1 == high and (before or after)):
            out.append((first, x - 1, other, y - 1, identity, before, after))
        elif low + 1 < high:
            at = max(range(low + 1, high), key=lambda k: (unlike[k], -k))
            parts += [(at, high), (low, at)]
    return out


def _links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of all seeds, pass by pass, and of every two seeds that many texts share; and (node, pos, seed) of the places that more than FEW texts share."""
    spark, path = texts.sparkSession, f"{shared_dir(texts.sparkSession)}/links-{uuid.uuid4().hex}"
    linked = lambda places, worth, rest: places.repartition("seed").sortWithinPartitions("seed", "key", "node", "pos").mapInArrow(lambda batches: leaders(batches, FEW, worth, rest), LINKS + (", seed bigint, key bigint" if rest else ""))
    for part in range(PASSES):
        linked(seeds(texts, part, PASSES), 1, True).write.mode("append").parquet(path)
    found = spark.read.schema(LINKS + ", seed bigint, key bigint").parquet(path)
    many = found.where("other IS NULL").select("node", F.col("pos").cast("bigint").alias("pos"), "seed", "key")
    two = many.repartition("node").sortWithinPartitions("node", "pos").mapInArrow(joint, PLACES)
    linked(two, 2, False).write.parquet(f"{path}-two")
    return found.where("other IS NOT NULL").drop("seed", "key").unionByName(spark.read.schema(LINKS).parquet(f"{path}-two")), many.drop("key")


def uncovered(pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which seeds at pos lie in none of the stretches first..last."""
    order = np.argsort(first, kind="stable")
    ahead = np.concatenate([[-1], np.maximum.accumulate(last[order])]) if len(order) else np.full(1, -1)
    return ahead[np.searchsorted(first[order], pos, side="right")] < pos + K - 1


def _open(many: DataFrame, found: DataFrame) -> DataFrame:
    """node, pos, seed, open, blocks of the places of many(node, pos, seed) whose seed has an open one, that no passage of found covers; large classes in blocks."""
    # the places and passages of a text are bounded by its own words
    places = many.groupBy("node").agg(F.collect_list(F.struct("pos", "seed")).alias("places"))
    covers = found.groupBy("node").agg(F.collect_set(F.struct("first_word", "last_word")).alias("covers"))

    def run(batches):
        for batch in batches:
            places, covers = batch.column("places"), batch.column("covers").fill_null([])
            sizes, of = pc.list_value_length(places).to_numpy(), np.cumsum([0, *pc.list_value_length(covers).to_pylist()])
            (pos, seed), (first, last) = ([a.flatten().field(k).to_numpy() for k in range(2)] for a in (places, covers))
            ends = np.cumsum([0, *sizes])
            free = [uncovered(pos[a:z], first[b:y], last[b:y]) for a, z, b, y in zip(ends, ends[1:], of, of[1:])]
            node = np.repeat(batch.column("node").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(pos), pa.array(seed), pa.array(np.concatenate([*free, np.zeros(0, bool)]))], ["node", "pos", "seed", "open"])

    flagged = stored(places.join(covers.hint("merge"), "node", "left").mapInArrow(run, "node bigint, pos bigint, seed bigint, open boolean"), "flagged")
    sizes = flagged.groupBy("seed").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any")
    blocks = F.when(F.col("n") > TILE, F.ceil(F.col("n") * 2 / TILE)).otherwise(1).cast("int")
    return flagged.join(sizes.select("seed", blocks.alias("blocks")).hint("merge"), "seed").select("node", "pos", "seed", "open", "blocks")


def _surroundings(places: DataFrame, texts: DataFrame) -> DataFrame:
    """seed, tile, node, pos, open, side, words: each of places(node, pos, seed, open, blocks) of texts(node, text), with the hashes of the words around it, in every tile of its block."""
    asked = places.groupBy("node").agg(F.collect_list(F.struct("pos", "seed", "open", "blocks")).alias("places"))
    asked = asked.join(texts.select("node", "text").hint("merge"), "node")
    reach = np.arange(-AROUND, AROUND)

    def run(batches):
        for batch in batches:
            places = batch.column("places")
            ends = np.cumsum([0, *pc.list_value_length(places).to_pylist()])
            pos, seed, open_, blocks = (places.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
            nodes = batch.column("node").to_numpy()
            for part in slices(batch.column("text")):
                words = part.words(SPACE_WORDS, lower=True)
                own = np.append(np.minimum(words.hash >> np.uint64(48), np.uint64(NOTHING - 1)), np.uint64(NOTHING)).astype(np.uint16)
                sizes = np.diff(ends[part.first : part.first + part.n + 1])
                row = np.repeat(np.arange(part.n), sizes)
                mine = np.arange(ends[part.first], ends[part.first + part.n])
                for i in range(0, len(mine), 1 << 12):
                    m, r = mine[i : i + (1 << 12)], row[i : i + (1 << 12)]
                    at = (words.rows[:-1][r] + pos[m])[:, None] + reach
                    inside = (at >= words.rows[:-1][r][:, None]) & (at < words.rows[1:][r][:, None])
                    around = own[np.where(inside, at, len(own) - 1)]
                    node = nodes[part.first + r]
                    side = (mix64(node.view(np.uint64)) % blocks[m].astype(np.uint64)).astype(np.int64)
                    times = blocks[m].astype(np.int64)
                    each = np.repeat(np.arange(len(m)), times)
                    other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                    tile = np.minimum(side[each], other) * times[each] + np.maximum(side[each], other)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AROUND), len(m), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                    for k in range(0, len(each), 1 << 12):
                        e = each[k : k + (1 << 12)]
                        columns = [pa.array(seed[m][e]), pa.array(tile[k : k + (1 << 12)]), pa.array(node[e]), pa.array(pos[m][e]), pa.array(open_[m][e].astype(bool)), pa.array(side[e]), raw.take(pa.array(e))]
                        yield pa.RecordBatch.from_arrays(columns, ["seed", "tile", "node", "pos", "open", "side", "words"])

    return asked.mapInArrow(run, "seed bigint, tile bigint, node bigint, pos bigint, open boolean, side bigint, words binary")


def _numbered(values: np.ndarray) -> np.ndarray:
    """Buckets of the values around places, each told by its side, and by how many equal ones stand between it and the place; NOTHING is BUCKETS.

    What a passage over two places has in common lies on the same side of both, so it has no more of a value than either.
    """
    out = np.empty(values.shape, np.int64)
    for k, half in enumerate((slice(AROUND - 1, None, -1), slice(AROUND, None))):
        own = values[:, half]
        order = np.argsort(own, axis=1, kind="stable")
        own, place = np.take_along_axis(own, order, axis=1), np.arange(own.shape[1])
        fresh = np.concatenate([np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)
        times = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        told = mix64(own.astype(np.uint64) * np.uint64(4 * AROUND) + (2 * times + k).astype(np.uint64)) >> np.uint64(51)
        np.put_along_axis(out[:, half], order, np.where(own == NOTHING, BUCKETS, told.astype(np.int64)), axis=1)
    return out


def _holding(buckets: np.ndarray) -> np.ndarray:
    """(bucket, place) whether it is among the buckets of a place; the last one never is."""
    holds = np.zeros((BUCKETS + 1, len(buckets)), np.uint8)
    holds[buckets.T, np.arange(len(buckets))] = 1
    holds[BUCKETS] = 0
    return holds


def _near(node, free, side, both):
    """(i, j) of the places of one tile, one of them open, of two texts (and sides, if there are two) with ALIKE neighbours of both in common; of a text's places the one with most."""
    n = len(node)
    holds = _holding(both)
    two, once, place = side.min() != side.max(), len(np.unique(node)) == n, np.arange(n)
    asked = np.flatnonzero(free)
    for i in np.split(asked, range(step := max(1, (1 << 20) // (n * both.shape[1])), len(asked), step)):
        common = np.add.reduce(holds[both[i]], axis=1, dtype=np.uint8)
        fits = (common >= ALIKE) & (node != node[i, None]) & (~free | (place > i[:, None]))
        if two:
            fits &= side != side[i, None]
        k, j = np.nonzero(fits)
        if not once and len(j):
            order = np.lexsort((-common[k, j].astype(np.int64), node[j], k))
            k, j = k[order], j[order]
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (node[j][1:] != node[j][:-1])])
            k, j = k[fresh], j[fresh]
        if len(j):
            yield i[k], j


def spanned(hits: np.ndarray) -> np.ndarray:
    """Of rows of words around a place, those where the ones that hit may be in a passage over the place, whose first and last words are among them."""
    least = int(MIN_IDENTITY * MIN_WORDS - 1e-9) + 1
    count = [np.pad(np.cumsum(h, axis=1, dtype=np.int16), ((0, 0), (1, 0))) for h in (hits[:, :AROUND][:, ::-1], hits[:, AROUND:])]
    gain = [(c - MIN_IDENTITY * np.arange(AROUND + 1)).astype(np.float32) for c in count]
    for g, h in zip(gain, (hits[:, :AROUND][:, ::-1], hits[:, AROUND:]), strict=True):
        g[:, 1:AROUND][h[:, :-1] == 0] = -np.inf
        g[:, AROUND] += (MIN_IDENTITY - 0.6) * AROUND  # goes on beyond what is seen
    # the best that a right side of so many words or more gives, and the words in which so many hit
    ahead = np.pad(np.maximum.accumulate(gain[1][:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)), constant_values=-np.inf)
    first = np.full((len(hits), AROUND + 1), AROUND + 1)
    first[:, 0] = 0
    row, at = np.nonzero(hits[:, AROUND:])
    first[row, count[1][row, at + 1]] = at + 1
    need = np.clip(least - count[0], 0, AROUND)
    far = np.maximum(np.take_along_axis(first, need.astype(np.int64), axis=1), np.maximum(MIN_WORDS - np.arange(AROUND + 1), 0))
    right = np.take_along_axis(ahead, far, axis=1)
    return (gain[0] + right >= -1e-3).any(axis=1)


def alike(batches):
    """LINKS of places(seed, tile, node, pos, open, side, words), sorted by seed and tile."""
    held, out, size = None, [], 0

    def links():
        node, other, pos, other_pos, mine, its = map(np.concatenate, zip(*out, strict=True))
        least = int(MIN_IDENTITY * MIN_WORDS - 1e-9) + 1
        keep = np.flatnonzero((np.add.reduce(mine, axis=1, dtype=np.uint8) >= least) & (np.add.reduce(its, axis=1, dtype=np.uint8) >= least))
        keep = keep[spanned(mine[keep])]
        keep = keep[spanned(its[keep])]
        node, other, pos, other_pos = node[keep], other[keep], pos[keep], other_pos[keep]
        turn = other > node
        columns = [np.where(turn, other, node), np.where(turn, node, other), np.where(turn, other_pos, pos), np.where(turn, pos, other_pos), np.full(len(node), MIN_EVIDENCE)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], LINK_NAMES[:5])

    for batch in joined(batches, [None]):
        if batch is not None:
            held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        seed, tile = held.column("seed").to_numpy(), held.column("tile").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (tile[1:] != tile[:-1])]))
        whole = held.num_rows if batch is None else int(starts[-1])
        node, pos, side = (held.column(c).to_numpy() for c in ("node", "pos", "side"))
        free = held.column("open").to_numpy(zero_copy_only=False).astype(bool)
        if whole:
            around = np.frombuffer(b"".join(held.column("words").slice(0, whole).to_pylist()), np.uint16).reshape(whole, -1).astype(np.uint32)
            none = (around[:, :-1] == NOTHING) | (around[:, 1:] == NOTHING)
            words, both = _numbered(around), _numbered(np.pad(np.where(none, NOTHING, around[:, :-1] << np.uint32(16) | around[:, 1:]), ((0, 0), (0, 1)), constant_values=NOTHING))
        for a, z in zip(starts, [*starts[1:], held.num_rows]):
            if z > whole or z - a < 2 or not free[a:z].any():
                continue
            holds = _holding(words[a:z])
            for i, j in _near(node[a:z], free[a:z], side[a:z], both[a:z]):
                out.append((node[a + i], node[a + j], pos[a + i], pos[a + j], holds[words[a + i], j[:, None]], holds[words[a + j], i[:, None]]))
                size += len(i)
                if size >= SPANS:
                    yield links()
                    out, size = [], 0
        held = held.slice(whole)
    if out:
        yield links()


def _rest(many: DataFrame, found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LINKS of the open places of many(node, pos, seed), and the texts(node, text) that they are of."""
    places = stored(_open(many, found), "open")
    held = texts.join(places.select("node").distinct().hint("merge"), "node").groupBy("node").agg(F.first("text").alias("text"))
    held = stored(held, "texts")
    dealt = _surroundings(places, held).repartition("seed", "tile").sortWithinPartitions("seed", "tile", "node", "pos")
    return stored(dealt.mapInArrow(alike, LINKS), "rest"), held


def _ends(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray, step: int):
    """_reach of many stretches of up to REACH of n words, a[at], a[at + step], .. beside b[bt], b[bt + step], ..

    (which are equal, words until differing ones outweigh, words to take, equal ones among these, equal ones in all); without an end within REACH of more words the second is REACH.
    """
    k = np.arange(REACH)
    inside = k < n[:, None]
    equal = (a[np.where(inside, at[:, None] + step * k, 0)] == b[np.where(inside, bt[:, None] + step * k, 0)]) & inside
    gain = np.cumsum(np.where(equal, 1, -2), axis=1, dtype=np.int16)
    over = (np.maximum.accumulate(np.maximum(gain, 0), axis=1) - gain > 2 * DROP) | ~inside
    stop = np.where(over.any(axis=1), over.argmax(axis=1), REACH)
    own = np.where(k < stop[:, None], gain, -1)
    best = own.argmax(axis=1)
    most = own[np.arange(len(n)), best].astype(np.int64)
    take = np.where(most > 0, best + 1, 0)
    ahead = np.where(stop > 0, gain[np.arange(len(n)), stop - 1], 0)
    # a gain is the equal words less twice the others
    return equal, stop, take, np.where(take > 0, most + 2 * take, 0) // 3, (ahead + 2 * stop) // 3


def straight(a, a_from, a_to, b, b_from, b_to, x, y, words):
    """align of many chains of equal places: the words [x, x + words) of texts a[a_from:a_to] are all equal to those at y of b[b_from:b_to].

    (whether known here, first, last, other first, other last, identity, before, after), rows without a passage having last < first.
    A chain whose extension runs on beyond REACH words, or that is too little alike, is for align.
    """
    z, w = x + words, y + words
    n, m = np.minimum(x, y), np.minimum(a_to - a_from - z, b_to - b_from - w)
    to_left, stop, left, same, ahead = _ends(a, a_from + x - 1, b, b_from + y - 1, n, -1)
    to_right, halt, right, more, beyond = _ends(a, a_from + z, b, b_from + w, m, 1)
    known = ((stop < REACH) | (n <= REACH)) & ((halt < REACH) | (m <= REACH))
    before, after = (stop == n) & (x <= y), (halt == m) & (a_to - a_from - z <= b_to - b_from - w)
    short = (words + left + right < MIN_WORDS) & (words + stop + halt >= MIN_WORDS) & (words + ahead + beyond >= MIN_IDENTITY * MIN_WORDS - 1e-6)
    for i in np.flatnonzero(known & short):
        wide = _widest(int(words[i]), int(words[i]), to_left[i, : stop[i]], to_right[i, : halt[i]])
        if wide is not None and words[i] + sum(wide) >= MIN_WORDS:
            left[i], right[i] = wide
            same[i], more[i] = to_left[i, : wide[0]].sum(), to_right[i, : wide[1]].sum()
    identity = (words + same + more) / (words + left + right)
    return known, x - left, z + right - 1, y - left, w + right - 1, identity, before, after


def _chained(pairs: DataFrame, texts: DataFrame, reach: int | None) -> DataFrame:
    """other, block, node, chain, low, whole, words: each chain of pairs(node, other, block, matches), texts(node, first, second, text) being marked by the side they stand on, with the words of node around it (all without reach), as 32 bits of their hashes."""
    # the pairs of a text are bounded by its own seeds
    own = pairs.groupBy("node").agg(F.collect_list(F.struct("other", "block", "matches")).alias("pairs"))
    own = own.join(texts.where("first").select("node", "text").hint("merge"), "node")

    def run(batches):
        for batch in batches:
            pairs = batch.column("pairs")
            ends, pairs = np.cumsum([0, *pc.list_value_length(pairs).to_pylist()]), pairs.flatten()
            others, blocks, matches = (pairs.field(k) for k in range(3))
            others, blocks = others.to_pylist(), blocks.to_pylist()
            number = np.repeat(np.arange(len(others)), pc.list_value_length(matches).to_numpy())
            x, y, worth = (matches.flatten().field(k).to_numpy() for k in range(3))
            order = np.lexsort((worth, y, x, number))
            number, x, y, worth = number[order], x[order], y[order], worth[order]
            # a match that two kinds of seeds give counts as the better one
            top = np.append((number[1:] != number[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True)
            edges = np.searchsorted(number[top], np.arange(len(others) + 1))
            x, y, worth = x[top].tolist(), y[top].tolist(), worth[top].tolist()
            nodes = batch.column("node").to_pylist()
            out: list[tuple] = []
            held = 0
            for part in slices(batch.column("text")):
                words = part.words(SPACE_WORDS, lower=True)
                hashes = (words.hash >> np.uint64(32)).astype(np.uint32)
                for r in range(part.n):
                    text = hashes[words.rows[r] : words.rows[r + 1]]
                    for k in range(ends[part.first + r], ends[part.first + r + 1]):
                        own = slice(edges[k], edges[k + 1])
                        evidence = dict(zip(zip(x[own], y[own]), worth[own]))
                        for chain in chains(list(evidence)):
                            if sum(evidence[m] for m in chain) < MIN_EVIDENCE:
                                continue
                            low = max(0, chain[0][0] - reach) if reach else 0
                            high = chain[-1][0] + K + reach if reach else len(text)
                            around = text[low:high].tobytes()
                            out.append((others[k], blocks[k], nodes[part.first + r], chain, low, high >= len(text), around))
                            held += len(around) + 32 * len(chain)
                            if held > 1 << 22:
                                yield _chain_batch(out)
                                out, held = [], 0
            yield _chain_batch(out)

    return own.mapInArrow(run, "other bigint, block int, node bigint, chain array<struct<pos: int, other_pos: int>>, low int, whole boolean, words binary")


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    others, blocks, nodes, chained, lows, whole, words = list(zip(*rows, strict=True)) or [()] * 7
    places = np.array(list(joined.from_iterable(chained)), np.int32).reshape(-1, 2)
    chained = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, chained)]), pa.int32()), pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], ["pos", "other_pos"]))
    columns = [pa.array(others, pa.int64()), pa.array(blocks, pa.int32()), pa.array(nodes, pa.int64()), chained, pa.array(lows, pa.int32()), pa.array(whole, pa.bool_()), pa.array(words, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["other", "block", "node", "chain", "low", "whole", "words"])


def _aligned(pairs: DataFrame, texts: DataFrame, reach: int | None) -> DataFrame:
    """FOUND of the chains of pairs(node, other, matches), dealt by the other text in blocks of about BLOCK pairs, so that a leader of many is spread."""
    sizes = pairs.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    probes = _chained(pairs.join(sizes.hint("merge"), "other").withColumn("block", block), texts, reach).withColumn("text", F.lit(None).cast("string"))
    bases = sizes.join(texts.where("second").select(F.col("node").alias("other"), "text").hint("merge"), "other")
    none = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ("node", "chain", "low", "whole", "words")]
    bases = bases.select("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *none, "text")
    dealt = bases.unionByName(probes).repartition("other", "block").sortWithinPartitions("other", "block", F.col("node").asc_nulls_first(), F.size("chain").desc(), "low")

    def run(batches):
        base = np.zeros(0, np.uint32)
        pair, taken = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # the words of all texts of the batch, behind those of the last one before; null has none
            texts = [part.words(SPACE_WORDS, lower=True) for part in slices(batch.column("text"))]
            b = np.concatenate([base, *((t.hash >> np.uint64(32)).astype(np.uint32) for t in texts)])
            edges = len(base) + np.cumsum([0, *joined.from_iterable(t.count.tolist() for t in texts)])
            is_text = batch.column("node").is_null().to_numpy(zero_copy_only=False)
            of = np.maximum.accumulate(np.where(is_text, np.arange(n), -1))
            b_from, b_to = np.where(of < 0, 0, edges[of]), np.where(of < 0, len(base), edges[of + 1])
            base = b[b_from[-1] : b_to[-1]].copy()

            rows = np.flatnonzero(~is_text)
            if not len(rows):
                continue
            b_from, b_to = b_from[rows], b_to[rows]
            batch = batch.take(pa.array(rows))
            others, nodes, low, whole = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("other", "node", "low", "whole"))
            a_edges = np.cumsum([0, *pc.binary_length(batch.column("words")).to_pylist()]) // 4
            a = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint32)
            chained = batch.column("chain")
            c_edges = np.cumsum([0, *pc.list_value_length(chained).to_pylist()])
            xs, ys = (chained.flatten().field(k).to_numpy() for k in range(2))
            xs = xs - np.repeat(low, np.diff(c_edges))
            x, y, words = xs[c_edges[:-1]].astype(np.int64), ys[c_edges[:-1]].astype(np.int64), (xs[c_edges[1:] - 1] - xs[c_edges[:-1]]).astype(np.int64) + K
            bent = np.add.reduceat((xs - ys != np.repeat(x - y, np.diff(c_edges))).astype(np.int64), c_edges[:-1])
            own = np.flatnonzero(bent == 0)
            # of those in one line, the ones whose words are all equal
            line = np.cumsum(words[own]) - words[own]
            k = np.arange(words[own].sum()) - np.repeat(line, words[own])
            unlike = a[np.repeat(a_edges[own] + x[own], words[own]) + k] != b[np.repeat(b_from[own] + y[own], words[own]) + k]
            own = own[np.add.reduceat(unlike.astype(np.int64), line) == 0] if len(own) else own
            parts = [straight(a, a_edges[o], a_edges[o + 1], b, b_from[o], b_to[o], x[o], y[o], words[o]) for o in (own[i : i + LINES] for i in range(0, max(1, len(own)), LINES))]
            known, first, last, other, end, identity, before, after = map(np.concatenate, zip(*parts, strict=True))
            known = known & ((identity >= MIN_IDENTITY) | (c_edges[own + 1] - c_edges[own] == 1))
            cut = (before & (low[own] > 0)) | (after & ~whole[own])
            good = cut & ((identity >= MIN_IDENTITY) | before | after) | ((np.minimum(last - first, end - other) + 1 >= MIN_WORDS) & (identity >= MIN_IDENTITY))
            place = np.full(len(rows), -1)
            place[own[known]] = np.flatnonzero(known)
            found = []
            for i in np.flatnonzero((place < 0) | np.isin(np.arange(len(rows)), own[known & good])).tolist():
                if pair != (others[i], nodes[i]):
                    pair, taken = (others[i], nodes[i]), []
                at = slice(c_edges[i], c_edges[i + 1])
                head, tail, above, below = x[i] + low[i], xs[at][-1] + low[i] + K - 1, y[i], ys[at][-1] + K - 1
                if any(f <= head and tail <= z and g <= above and below <= w for f, z, g, w in taken):
                    continue
                if (j := place[i]) >= 0:
                    spans = [(first[j], last[j], other[j], end[j], identity[j], before[j], after[j])]
                else:
                    spans = align(a[a_edges[i] : a_edges[i + 1]], b[b_from[i] : b_to[i]], list(zip(xs[at].tolist(), ys[at].tolist(), strict=True)))
                for p, q, g, w, alike, f_cut, l_cut in spans:
                    p, q = p + low[i], q + low[i]
                    open_ = bool((f_cut and low[i] > 0) or (l_cut and not whole[i]))
                    if open_ or (min(q - p, w - g) + 1 >= MIN_WORDS and alike >= MIN_IDENTITY):
                        taken.append((p, q, g, w))
                        found.append((nodes[i], others[i], p, q, g, w, alike, open_))
            columns = list(zip(*found, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64()), pa.array(columns[7], pa.bool_())], ["node", "other", "first_word", "last_word", "other_first", "other_last", "identity", "cut"])

    return dealt.mapInArrow(run, FOUND)


def _sizes(texts: DataFrame) -> DataFrame:
    """doc_id, node and n, its words, of each row of texts(doc_id, text, node)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("node"), pa.array(part.words(SPACE_WORDS, hashed=False).count.astype(np.int64))], ["doc_id", "node", "n"])

    return texts.select("doc_id", "node", "text").mapInArrow(run, f"doc_id {kind}, node bigint, n bigint")


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, other_id, first_word, last_word, other_first, other_last, n_words, identity of each shared passage of docs(doc_id, text)."""
    spark = docs.sparkSession
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")  # a pass leaves no shuffle files
    try:
        return _passages(docs)
    finally:
        spark.conf.set(CLEAN, before)


def _pairs(links: DataFrame) -> DataFrame:
    """node, other, matches of the pairs of texts with enough evidence."""
    matches = F.collect_set(F.struct("pos", "other_pos", "evidence")).alias("matches")
    pairs = links.groupBy("node", "other").agg(F.sum("evidence").alias("evidence"), matches).where(F.col("evidence") >= MIN_EVIDENCE)
    return stored(pairs.select("node", "other", "matches"), "pairs")


def _found(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of pairs(node, other, matches) of texts(node, text) in both directions."""
    # equal texts are one node; one text of each that is looked at
    sides = pairs.select("node", F.lit(True).alias("first"), F.lit(False).alias("second")).union(pairs.select("other", F.lit(False), F.lit(True)))
    wanted = sides.groupBy("node").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    held = texts.select("node", "text").join(wanted.hint("merge"), "node").groupBy("node", "first", "second").agg(F.first("text").alias("text"))
    held = stored(held, "texts")
    found = stored(_aligned(pairs, held, REACH), "passages")
    # an extension that used up its words decides on the whole texts
    again = stored(found.where("cut").select("node", "other").distinct(), "again")
    if not again.isEmpty():
        more = _aligned(stored(pairs.join(again.hint("merge"), ["node", "other"], "left_semi"), "pairs"), held, None)
        found = found.join(again.hint("merge"), ["node", "other"], "left_anti").select(found.columns).unionByName(more)
    # each passage in both directions, from one look at it
    ways = (("node", "other", "first_word", "last_word", "other_first", "other_last"), ("other", "node", "other_first", "other_last", "first_word", "last_word"))
    ways = F.array(*(F.struct(*(F.col(c).alias(name) for c, name in zip(way, ways[0], strict=True)), "identity") for way in ways))
    found = stored(found.select(F.explode(ways).alias("p")).select("p.*"), "passages")
    drop(held)
    return found


def _passages(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("node"))
    links, many = _links(texts.select("node", "text"))
    found = _found(_pairs(links), texts)
    # what no passage covers is held against all that share its seed
    more, held = _rest(many, found, texts.select("node", "text"))
    if not more.isEmpty():
        asked = more.select("node", "other").distinct()
        both = more.unionByName(links.join(asked.hint("merge"), ["node", "other"], "left_semi").select(more.columns))
        found = found.unionByName(_found(_pairs(both), held))
    drop(links)

    # texts get their documents back
    rows = stored(_sizes(texts).distinct(), "rows")
    firsts = rows.where(F.col("n") >= MIN_WORDS).groupBy("node").agg(F.min("doc_id").alias("least"))
    # copies: the least id is every other row's partner; its own is the next one
    others = rows.join(firsts.hint("merge"), "node").where(~F.col("doc_id").eqNullSafe(F.col("least")))
    next_ = others.groupBy("node", "n", "least").agg(F.min("doc_id").alias("next"))
    alike = others.select("doc_id", F.col("least").alias("other_id"), "n").unionByName(next_.select(F.col("least").alias("doc_id"), F.col("next").alias("other_id"), "n"))
    end = F.col("n") - 1
    zero = F.lit(0).cast("bigint")
    alike = alike.select("doc_id", "other_id", zero.alias("first_word"), end.alias("last_word"), zero.alias("other_first"), end.alias("other_last"), F.lit(1.0).alias("identity"))
    named = found.join(firsts.withColumnRenamed("node", "other").hint("merge"), "other").withColumnRenamed("least", "other_id")
    best = named.groupBy("node", "first_word", "last_word").agg(F.min(F.struct(F.col("other_id").isNull().alias("none"), "other_id", "other_first", "other_last", "identity")).alias("o"))
    shared = rows.join(best.hint("merge"), "node").select("doc_id", "o.other_id", "first_word", "last_word", "o.other_first", "o.other_last", "o.identity")
    return shared.unionByName(alike).withColumn("n_words", F.col("last_word") - F.col("first_word") + 1)
