"""Quality rules: base counts, and a calibrated logistic regression over hashed n-grams.

Features of a text are its word 1- and 2-grams and its 3- and 5-grams of code points,
hashed into 2**18 buckets and divided by their number in each family, so a score is a
bias plus the mean weight over each family: two gathers and a running sum per character,
whole texts only.  The classifier is fitted on at most ``sample_rows`` labelled documents,
chosen by a hash of their id in equal shares of both classes; Platt scaling on a held-out
fifth, re-weighted to the class shares of *all* labels, turns scores into
probabilities, which fixed thresholds judge.

Defined cases: a null text has no words and fails the base rules; an empty table gives
an empty result; without labels of both classes the probability is the share of good
labels (1.0 without any), so only the base rules reject; repeated rows are scored each,
and of several labels of an id the mean decides, a tie being good; of several texts under
a labelled id the smallest is learned from; very long texts are read whole, each as one
slice (a learned text has at most one entry a bucket); a further column of docs with the
name of a new one stays as it is, and the new one gets a trailing underscore.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textassay.llm.io import bounded, free
from textassay.llm.textops import SPACE_WORDS, Slice, mix64, segment_sums, slices

BUCKET_BITS = 18
#: Documented bound of the classifier's sample: rows, half of each class.
SAMPLE_ROWS = 4000
#: Entries of the fitting matrix that are multiplied at once.
BLOCK_ENTRIES = 1 << 20
KEEP_FROM = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SHIFT = np.uint64(64 - BUCKET_BITS)
_SHIFT32 = np.uint32(32 - BUCKET_BITS)
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@dataclasses.dataclass(frozen=True)
class Model:
    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -500, 500)))


def _families(part: Slice, words):
    """Yields (buckets, row bounds) of each n-gram family; n-grams do not cross rows."""
    salt = lambda k: np.uint64(mix64(np.array([k], np.uint64))[0])
    yield (words.hash >> _SHIFT).astype(np.int64), words.rows[:-1], words.rows[1:]
    if len(words.hash):
        pairs = mix64(words.hash[:-1] * np.uint64(3) + words.hash[1:] + salt(1))
        yield (pairs >> _SHIFT).astype(np.int64), words.rows[:-1], np.maximum(words.rows[:-1], words.rows[1:] - 1)
    data, bounds = _characters(part)
    for width in (3, 5):
        n = len(data) - width + 1
        if n <= 0:
            continue
        gram = np.full(n, width * 0x2545F491 & 0xFFFFFFFF, np.uint32)
        for k in range(width):
            gram = (gram ^ (data[k : k + n] * _MULTIPLIERS[k])) * np.uint32(0x01000193)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x2C1B3C6D)
        first = np.minimum(bounds[:-1], n)
        yield (gram >> _SHIFT32).astype(np.int64), first, np.maximum(first, np.minimum(bounds[1:] - width + 1, n))


def _characters(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice (their UTF-8 bytes as one number), and where each row begins and ends."""
    data = part.data.astype(np.uint32)
    more = (part.data & 0xC0) == 0x80
    if not more.any():
        return data, part.bounds
    at = np.flatnonzero(~more)
    codes, open_ = data[at], np.ones(len(at), bool)
    for k in range(1, 4):
        open_ &= at + k < len(data)
        open_[open_] = more[at[open_] + k]
        codes[open_] = codes[open_] << np.uint32(8) | data[at[open_] + k]
    return codes, np.searchsorted(at, part.bounds)


def raw_scores(part: Slice, words, model: Model) -> np.ndarray:
    score = np.full(part.n, model.bias)
    if model.weights is None:
        return score
    for buckets, first, last in _families(part, words):
        total = np.zeros(len(buckets) + 1)
        np.cumsum(model.weights[buckets], out=total[1:])
        score += (total[last] - total[first]) / np.maximum(last - first, 1)
    return score


def base_counts(part: Slice, words) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of each row."""
    data, bounds = part.data, part.bounds
    leads = (data & 0xC0) != 0x80
    inside = SPACE_WORDS[data]
    # lines end at each \n and at each row's end
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.searchsorted(bounds, breaks, side="right") - 1, np.arange(part.n)])
    ends = np.concatenate([breaks, bounds[1:]])
    order = np.lexsort((ends, row))
    row, ends = row[order], ends[order]
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = np.where(row[1:] == row[:-1], ends[:-1] + 1, bounds[row[1:]])
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=letters[1:])
    full = letters[ends] > letters[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    key = part.span_hash(starts, ends) ^ mix64(row.astype(np.uint64))
    repeated = np.zeros(part.n, np.int64)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
    np.add.at(repeated, row[order][again], 1)
    # words in 8-word windows that occur twice or more
    window, fits = words.windows(8)
    at = np.flatnonzero(fits)
    covered = np.zeros(len(words.start) + 8, np.int32)
    if len(at):
        key = window[at] ^ mix64(words.row_of()[at].astype(np.uint64) + np.uint64(7))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + 8, 1)
    covered = np.cumsum(covered)[: len(words.start)] > 0
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": segment_sums(leads & inside, bounds),
        "n_symbols": segment_sums(_IS_SYMBOL[data], bounds),
        "n_dup_lines": repeated,
        "n_repeat_words": segment_sums(covered, words.rows),
    }


def _featurise(batches):
    """(good, buckets, values) of each row; a bucket's value is summed over the families."""
    for batch in batches:
        good = batch.column(1)
        for part in slices(batch.column(2)):
            found = list(_families(part, part.words(SPACE_WORDS)))
            for i in range(part.n):
                own = [buckets[first[i] : last[i]] for buckets, first, last in found]
                share = [np.full(len(b), 1 / max(1, len(b)), np.float32) for b in own]
                got, at = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]), return_inverse=True)
                yield good[part.first + i].as_py(), got.astype(np.int32), np.bincount(at, np.concatenate([*share, np.zeros(0, np.float32)]), len(got)).astype(np.float32)


class _Sparse:
    """Rows of (bucket, value), kept once; products go by blocks of rows, so their working memory is bounded."""

    def __init__(self, rows):
        good, sizes, index, value = [], [0], np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.float32)
        for y, buckets, values in rows:
            n = sizes[-1] + len(buckets)
            while n > len(index):
                index.resize(2 * len(index), refcheck=False)
                value.resize(2 * len(value), refcheck=False)
            index[sizes[-1] : n], value[sizes[-1] : n] = buckets, values
            good.append(y)
            sizes.append(n)
        self.good, self.ends = np.array(good, np.float64), np.array(sizes)
        self.index, self.value = index[: sizes[-1]], value[: sizes[-1]]
        self.blocks, first = [], 0
        while first < len(good):
            last = max(first + 1, int(np.searchsorted(self.ends, self.ends[first] + BLOCK_ENTRIES, side="right")) - 1)
            self.blocks.append((first, min(last, len(good))))
            first = self.blocks[-1][1]

    def times(self, w: np.ndarray) -> np.ndarray:
        """One sum of value * w[bucket] a row."""
        out = np.zeros(len(self.good))
        for a, z in self.blocks:
            o = np.s_[self.ends[a] : self.ends[z]]
            out[a:z] = segment_sums(self.value[o] * w[self.index[o]], self.ends[a : z + 1] - self.ends[a])
        return out

    def spread(self, error: np.ndarray, n: int) -> np.ndarray:
        """One sum of value * error[row] a bucket."""
        out = np.zeros(n)
        for a, z in self.blocks:
            o = np.s_[self.ends[a] : self.ends[z]]
            out += np.bincount(self.index[o], self.value[o] * np.repeat(error[a:z], np.diff(self.ends[a : z + 1])), n)
        return out


def _fit(rows, share_good: float) -> Model | None:
    """Full-batch Adam on the sparse rows, then Platt scaling on the held-out fifth; None without both classes."""
    x = _Sparse(rows)
    y = x.good
    if len(set(y)) != 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    train = ~held
    class_weight = np.where(y > 0, 0.5 / max(1, (y[train] > 0).sum()), 0.5 / max(1, (y[train] == 0).sum()))
    w, b = np.zeros(1 << BUCKET_BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 61):
        z = x.times(w) + b
        error = np.where(train, (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * class_weight, 0)
        g = x.spread(error, len(w)) + 1e-7 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        b -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-7)
    z = x.times(w) + b
    use = held if len(set(y[held])) == 2 else train
    zs, ys = z[use], y[use]
    sample_weight = np.where(ys > 0, share_good / max(1, (ys > 0).sum()), (1 - share_good) / max(1, (ys == 0).sum()))
    target = np.where(ys > 0, ((ys > 0).sum() + 1) / ((ys > 0).sum() + 2), 1 / ((ys == 0).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * zs + offset, -30, 30)))
        r, h = sample_weight * (p - target), sample_weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * zs * zs).sum() + 1e-4, (h * zs).sum()], [(h * zs).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(r * zs).sum() + 1e-4 * (slope - 1), r.sum()])
        step = np.clip(step, -1, 1)
        slope, offset = slope - step[0], offset - step[1]
    return Model(w.astype(np.float32), b, float(max(slope, 1e-3)), float(offset))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents (columns doc_id, text; doc_id, quality).

    A document with several labels counts as good if their mean is at least 0.5.
    """
    per_doc = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    counts = {r["good"]: r["count"] for r in per_doc.groupBy("good").count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    share = good / (good + bad) if good + bad else 1.0
    constant = Model(None, 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not good or not bad:
        return constant
    ranked = per_doc.withColumn("_order", F.xxhash64("doc_id", F.lit(3)))
    picked = None
    for kind in (0, 1):
        part = ranked.where(F.col("good") == kind).orderBy("_order", "doc_id").limit(sample_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    # at most sample_rows ids, so the hint is bounded
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked.select("doc_id", "good")), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text")).select("doc_id", "good", "text").coalesce(1)
    sample = sample.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")

    def fit(batches):
        model = _fit(_featurise(batches), share)
        if model is not None:
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset]})

    # the fitted model is one row of 1 MB whatever the input
    found = sample.mapInArrow(fit, "weights binary, bias double, slope double, offset double").collect()
    if not found:
        return constant
    r = found[0]
    return Model(np.frombuffer(bytes(r["weights"]), np.float32), r["bias"], r["slope"], r["offset"])


def score(docs: DataFrame, model: Model, threshold: float = KEEP_FROM, prefix: str = "") -> DataFrame:
    """Every row of `docs` (needs column text) with the base counts, quality probability and verdict.

    The new columns are named with `prefix`, and a trailing underscore where docs has such a name.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    named = {n: free(prefix + n, docs.columns) for n in [*names, "base_failed", "kept", "p_good"]}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.BooleanType() if k in ("base_failed", "kept") else T.DoubleType() if k == "p_good" else T.LongType()) for k, n in named.items())])
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch.column(at)):
                words = part.words(SPACE_WORDS)
                counts = base_counts(part, words)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                p = model.probability(raw_scores(part, words, model))
                rows = batch.slice(part.first, part.n)
                columns = [*rows.columns, *(pa.array(counts[n]) for n in names), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *named.values()])

    return docs.mapInArrow(run, schema)
