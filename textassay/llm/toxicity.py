"""Toxicity of texts whose words may be disguised: a noisy channel restores them, a learned lexicon scores them.

Channel: a disguised span is a lattice of characters.  Digits and symbols may stand for
letters (LEET), runs of one letter for one or two, separators and blanks between single
characters for nothing, look-alike letters for Latin ones; each choice has a cost.  A Viterbi
search, exact over the last ORDER - 1 characters, finds the cheapest reading under a
character language model.  Its n-gram counts come from every text that is handed in for
learning, summed per task into 2**TABLE_BITS buckets, so the model has a fixed size.

Lexicon: features of a text are its restored words and their prefixes of PREFIXES letters.
They are counted by class over a bounded sample of labelled texts (SAMPLE_TOXIC and
SAMPLE_CLEAN rows, chosen by a hash of their id; the documented bound of the classifier),
near copies of a class once, by a min-hash of their three-word sequences;
those that lean to toxic by MIN_ODDS and a likelihood ratio of MIN_RATIO make up the lexicon,
at most LEXICON of them.  A logistic regression over the strongest and the joint evidence of
a text, fitted on a quarter of the sample that the lexicon it sees was not counted on and
weighted to the class shares of all labels, gives the score.

A text is read once per distinct token: readings of tokens are kept per worker, at most
MEMO of them.  A single split of a word in two ("stu pid") is not undone.

Defined cases: a null, empty or blank text has no words and gets the score of a text without
evidence; a null id is never learned from and counts as not held out; of several labels of
an id the mean decides, a tie being toxic; of several texts under a labelled id the smallest
is learned from; repeated rows are scored each; without labels of both classes every score is the
share of toxic labels (0 without labels); an empty table gives an empty result; very long
texts are read whole, spans in time linear in their length; a further column of docs with the
name of a new one stays, and the new one gets a trailing underscore.
"""

from __future__ import annotations

import collections
import dataclasses
import math
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textassay.llm.io import bounded, drop, free, stored

ORDER, TABLE_BITS, SLICES, FAN_IN = 4, 18, 8, 256
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 12000
PREFIXES, MIN_WORD = (4, 5, 6, 7), 3
MIN_ROWS, MIN_RATIO, MIN_ODDS, LEXICON = 3, 20.0, 1.5, 20_000
MEMO, PENDING = 200_000, 200_000
#: Distinct tokens whose n-grams are counted in one go.
COUNTED_AT_ONCE = 1 << 18
TOXIC_FROM = 0.3
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
LOOKALIKE = dict(zip("аеорсхуіѕјαοερι", "aeopcxyisjaoepi", strict=True))
SEPARATORS = "._-~/'·"
#: Costs in nats.
SUBSTITUTE, MASK, BREAK, SKIP, JOIN, ONCE, TWICE, SINGLE, ALIKE = 1.0, 2.0, 2.0, 2.0, 0.5, 1.0, 1.5, 3.0, 0.3
EDGES = ".,;:?\"'()[]{}<>«»…“”„‘’-–—_~/#&%="
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD])
_HIDDEN = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")
_LETTERS = [chr(c) for c in range(97, 0x250) if chr(c).islower()]
_CODE = {" ": 0} | {c: k + 1 for k, c in enumerate(_LETTERS)}
_TABLE = np.zeros(0x251, np.uint8)
_TABLE[[ord(c) for c in _LETTERS]] = [_CODE[c] for c in _LETTERS]
_OTHER = 255
_ODD = 0x9E3779B1
_SUSPECT = re.compile(r"[0-9@$!|+*€]|[^\W\d_][._\-~/'·]+[^\W\d_]|([^\W\d_])\1\1|[а-яіѕјα-ω]")
_STRETCHED = re.compile(r"(.)\1\1|[а-яіѕјα-ω]")
_LATIN = re.compile(r"[a-zß-ɏ]")
_WORDS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,2}\S){2,}(?!\S)")
_TAIL = re.compile(r"[!?]+$|([*$@+|])\1\1+$|^([*$@!+|])\2\2+")


def _buckets(key: np.ndarray, width: int) -> np.ndarray:
    """Buckets of n-grams of `width` characters, each packed into 32 bits."""
    key = key ^ np.uint32(width * 0x85EBCA6B & 0xFFFFFFFF)
    key ^= key >> np.uint32(15)
    return (key * np.uint32(_ODD) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def count_grams(words: collections.Counter, table: np.ndarray) -> None:
    """Add the n-grams of words, with a boundary on both sides, as often as each word stands; what is no letter is a boundary."""
    text = f" {' '.join(words)} "
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _TABLE[np.minimum(raw, 0x250)].astype(np.uint32)
    times = np.zeros(len(raw), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)  # of each word with the blank before it
    times[: ends[-1]] = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes + 1)
    key, fine = codes, np.ones(len(codes), bool)
    for width in range(1, ORDER + 1):
        if width > 1:
            n = len(codes) - width + 1
            key = key[:n] << np.uint32(8) | codes[width - 1 :]
            if width > 2:
                fine = fine[:n] & (codes[width - 2 : width - 2 + n] > 0)
            else:
                fine = (codes[:-1] > 0) | (codes[1:] > 0)
        own = fine[: len(key)] & ((key > 0) | (width == 1))
        table += np.bincount(_buckets(key[own], width), times[: len(key)][own], len(table)).astype(np.int64)


def clean(text: str) -> str:
    """Lower-cased compatibility form without invisible characters."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = text.translate(_INVISIBLE)
    return text.lower()


@dataclasses.dataclass(frozen=True)
class Model:
    """Character counts, lexicon {feature: (log odds, likelihood ratio)} and the logistic weights of evidence."""

    counts: np.ndarray
    total: int
    lexicon: dict[str, tuple[float, float]]
    weights: tuple[float, ...]

    def probability(self, evidence: list[tuple[float, float]]) -> float:
        z = sum(w * x for w, x in zip(self.weights, _summary(evidence), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class Channel:
    """Restores spans under the character model; keeps what it has looked up, within bounds."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total = counts, total
        self._cost: dict[str, float] = {}

    def _count(self, gram: str) -> int:
        key = 0
        for c in gram:
            key = key << 8 | _CODE.get(c, _OTHER)
        key ^= len(gram) * 0x85EBCA6B & 0xFFFFFFFF
        key ^= key >> 15
        return int(self.counts[(key * _ODD & 0xFFFFFFFF) >> (32 - TABLE_BITS)])

    def cost(self, context: str, c: str) -> float:
        """-log p(c | context), each order leaning on the next shorter one."""
        found = self._cost.get(context + c)
        if found is None:
            p = 1 / 64
            for m in range(len(context) + 1):
                own = context[len(context) - m :]
                seen = self._count(own) if m else self.total
                p = (min(self._count(own + c), seen) + 5 * p) / (seen + 5)
            found = -math.log(p)
            if len(self._cost) >= MEMO:
                self._cost.clear()
            self._cost[context + c] = found
        return found

    def restore(self, span: str) -> str:
        """The cheapest reading of a span: words with single blanks between them."""
        states: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
        for options in [*lattice(span), [(" ", 0.0)]]:
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (cost, path) in states.items():
                for text, price in options:
                    own, total = context, cost + price
                    for c in text:
                        if c == " ":
                            total += self.cost(own, c) if own != " " else 0.0
                            own = " "
                        else:
                            total += self.cost(own, c)
                            own = (own + c)[1 - ORDER :]
                    if own not in after or total < after[own][0]:
                        after[own] = (total, (path, text))
            states = after
        parts, path = [], min(states.values(), key=lambda s: s[0])[1]
        while path is not None:
            path, text = path
            parts.append(text)
        return " ".join("".join(reversed(parts)).split())


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Readings and costs of each run of one character."""
    nodes, at = [], 0
    while at < len(span):
        c, end = span[at], at + 1
        while end < len(span) and span[end] == c:
            end += 1
        times, at = end - at, end
        c = c if c in _CODE else LOOKALIKE.get(c, c)
        price = ALIKE if c != span[at - 1] else 0.0
        if c.isspace():
            node = [("", JOIN), (" ", 0.0)]
        elif c.isalpha():
            node = [(c, price)] if times == 1 else [(c * 2, price + (TWICE if times > 2 else 0)), (c, price + (ONCE if times > 2 else SINGLE))]
        elif c in LEET:
            step = MASK if c == "*" else SUBSTITUTE
            node = [(x * k, step * (k + 1) / 2) for x in LEET[c] for k in range(1, min(times, 2) + 1)]
            node += [(" ", BREAK if times < 3 and c != "*" else 0.5), *([("", SKIP)] if not c.isdigit() else [])]
        elif c in SEPARATORS:
            node = [("", SKIP), (" ", 0.0)]
        else:
            node = [(" ", 0.0)]
        nodes.append(node)
    return nodes


def reading(token: str, channel: Channel) -> tuple[str | None, list[str]]:
    """What a lower-cased token may say, None where nothing about it is suspect, and its words."""
    core = token if token.isalpha() else token.strip(EDGES)
    if core.isalpha():
        if not _STRETCHED.search(core) or not _LATIN.search(core):
            return None, [core]
    else:
        core = _TAIL.sub("", core).strip(EDGES)
        if not _SUSPECT.search(core) or not _LATIN.search(core):
            return None, _WORDS.findall(token)
    said = channel.restore(core)
    return said, said.split()


def features(words: list[str]):
    for w in words:
        if len(w) >= MIN_WORD:
            yield w + " "
            for n in PREFIXES:
                if len(w) > n:
                    yield w[:n]


def tokens_of(text: str | None) -> tuple[set[str], list[str]]:
    """(distinct tokens, spans of blank-separated single characters) of the cleaned text."""
    low = clean(text or "")
    tokens = low.split()
    single = b"\1\1\1" in bytes(map((1).__eq__, map(len, tokens)))  # else no span can match
    return set(tokens), [m.group() for m in _SPACED.finditer(low)] if single else []


class Reader(dict):
    """What `keep(token, reading, words)` makes of a token; equal tokens are read once."""

    def __init__(self, channel: Channel, keep):
        super().__init__()
        self.channel, self.keep = channel, keep

    def __missing__(self, token: str):
        found = self.keep(token, *reading(token, self.channel))
        if len(self) >= MEMO:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def all(self, text: str | None) -> list:
        """Of the distinct tokens and of the spans of a text, what is not None."""
        tokens, spans = tokens_of(text)
        found = {x for x in map(self.__getitem__, tokens) if x is not None}
        for span in spans:
            said = self.channel.restore(span)
            found.add(self.keep(span, said, said.split()))
        found.discard(None)
        return sorted(found)


def _summary(evidence: list[tuple[float, float]]) -> tuple[float, ...]:
    """1, greatest log odds, greatest and joint likelihood ratio, number of words with evidence, damped."""
    if not evidence:
        return (1.0, 0.0, 0.0, 0.0, 0.0)
    odds, ratios = zip(*evidence, strict=True)
    return (1.0, max(odds), math.log1p(max(ratios)), math.log1p(sum(ratios)), math.log1p(len(evidence)))


def evidence_in(lexicon: dict[str, tuple[float, float]]):
    """keep() for a Reader: (token, reading, strongest feature) of a token with evidence, else None."""
    heads = {f[:4] for f in lexicon}  # most words end here

    def keep(token, said, words):
        near = [w for w in words if f"{w} "[:4] in heads]
        found = max((lexicon[f] for f in features(near) if f in lexicon), key=lambda x: (x[1], x[0]), default=None) if near else None
        return None if found is None else (token, said or "", found)

    return keep


def character_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """n-gram counts of all texts of docs (column text), as a table of fixed size."""
    bounded(docs.sparkSession)
    size = 1 << TABLE_BITS
    part = size // SLICES

    def emit(table, task):
        press = zstandard.ZstdCompressor()
        rows = [press.compress(table[k * part : (k + 1) * part].astype("<i8").tobytes()) for k in range(SLICES)]
        return pa.RecordBatch.from_arrays([pa.array([task] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], ["task", "slice", "counts"])

    def count(batches):
        from pyspark import TaskContext

        table, words = np.zeros(size, np.int64), collections.Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    words.update(clean(text.as_py()).split())
                if len(words) >= COUNTED_AT_ONCE:
                    count_grams(words, table)
                    words.clear()
        if words:
            count_grams(words, table)
        if table.any():
            yield emit(table, TaskContext.get().partitionId())

    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for task, k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<i8")
                held[task, k] = held[task, k] + own if (task, k) in held else own
        press = zstandard.ZstdCompressor()
        for (task, k), total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([press.compress(total.tobytes())], pa.binary())], ["task", "slice", "counts"])

    schema = "task int, slice int, counts binary"
    tasks = docs.select("text").rdd.getNumPartitions()
    sums = docs.select("text").mapInArrow(count, schema)
    while True:  # tables meet FAN_IN at a time, slice by slice
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("task", (F.col("task") / FAN_IN).cast("int")).repartition(SLICES * tasks, "task", "slice").mapInArrow(add, schema)
        if tasks == 1:
            break
    table = np.zeros(size, np.int64)
    for r in sums.collect():  # SLICES rows, 2**TABLE_BITS numbers in all
        table[r["slice"] * part : (r["slice"] + 1) * part] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), "<i8")
    # characters in all: the unigrams
    total = sum(int(table[b]) for b in np.unique(_buckets(np.arange(1, len(_CODE), dtype=np.uint32), 1)))
    return table, total


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Damped Newton steps with a ridge on all but the constant; evidence never speaks against toxic, so weights below 0 are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        own, w = x[:, used], np.zeros(used.sum())
        ridge = np.full(len(w), penalty)
        ridge[0] = 1e-4

        def loss(w, own=own, ridge=ridge):
            z = own @ w
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -500, 500)))
            gradient = own.T @ (weight * (p - y)) + ridge * w
            step = np.linalg.solve((own * (weight * p * (1 - p))[:, None]).T @ own + np.diag(ridge), gradient)
            now, scale = loss(w), 1.0
            while scale > 1e-6 and loss(w - scale * step) > now:
                scale /= 2
            w = w - scale * step
            if np.abs(scale * step).max() < 1e-10 or scale <= 1e-6:
                break
        out = np.zeros(x.shape[1])
        out[used] = w
        wrong = out < 0
        wrong[0] = False
        if not wrong.any():
            return out
        used &= ~wrong


#: Likelihood ratio (G squared) of a feature in a of na toxic and b of nb clean texts, and its smoothed log odds.
_RATIO = "2 * ({a} * ln(greatest({a}, 1) * ({na} + {nb}) / ({na} * ({a} + {b}))) + {b} * ln(greatest({b}, 1) * ({na} + {nb}) / ({nb} * ({a} + {b}))) + ({na} - {a}) * ln(greatest({na} - {a}, 1) * ({na} + {nb}) / ({na} * greatest({na} + {nb} - {a} - {b}, 1))) + ({nb} - {b}) * ln(greatest({nb} - {b}, 1) * ({na} + {nb}) / ({nb} * greatest({na} + {nb} - {a} - {b}, 1))))"


def _ratio(a: int, b: int, na: int, nb: int) -> float:
    def part(k, n, of):
        return k * math.log(k * (na + nb) / (n * of)) if k else 0.0

    return 2 * (part(a, na, a + b) + part(b, nb, a + b) + part(na - a, na, na + nb - a - b) + part(nb - b, nb, na + nb - a - b))


def _lexicon(rows, na: int, nb: int) -> dict[str, tuple[float, float]]:
    found = {}
    for feature, a, b in rows:
        if a >= MIN_ROWS and na and nb:
            odds, ratio = math.log((a + 0.5) / (na + 1)) - math.log((b + 0.5) / (nb + 1)), _ratio(a, b, na, nb)
            if odds >= MIN_ODDS and ratio >= MIN_RATIO:
                found[feature] = (odds, ratio)
    return found


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); hand in only rows that may be learned from.

    The character model takes every text; the lexicon a sample of at most SAMPLE_TOXIC and SAMPLE_CLEAN rows.
    """
    spark = docs.sparkSession
    counts, total = character_counts(docs)
    known = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().hint("merge")
    per_doc = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    per_doc = stored(per_doc.join(known, "doc_id", "left_semi"), "judged")
    size = {r["toxic"]: r["count"] for r in per_doc.groupBy("toxic").count().collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    if len(size) < 2:
        drop(per_doc)
        edge = math.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return Model(counts, total, {}, (edge, 0.0, 0.0, 0.0, 0.0))
    ranked = per_doc.withColumn("_order", F.xxhash64("doc_id", F.lit(13)))
    picked = [ranked.where(F.col("toxic") == k).orderBy("_order", "doc_id").limit(most) for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).withColumn("kept_out", F.pmod("_order", F.lit(4)) == 0).drop("_order"))  # at most SAMPLE_* ids
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("kept_out").alias("kept_out"), F.min("text").alias("text"))
    bounded(spark)
    one = sample.withColumn("sketch", F.lit(0)).schema

    def sketch(batches):
        for batch in batches:
            found = [_sketch(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "sketch"])

    # near copies say the same thing once
    sample = sample.mapInArrow(sketch, one).groupBy("toxic", "sketch").agg(F.min_by(F.struct("kept_out", "text"), "doc_id").alias("r")).select("toxic", "r.*")
    sample = stored(sample, "sample")
    channel = spark.sparkContext.broadcast((counts, total))
    names = ["a0", "b0", "a1", "b1"]  # toxic and clean texts, of the part for the lexicon and of the part kept out

    def count(batches):
        reader = Reader(Channel(*channel.value), lambda token, said, words: tuple(features(words)) or None)
        seen: dict[str, list[int]] = collections.defaultdict(lambda: [0, 0, 0, 0])

        def rows():
            own = list(seen.values())
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in own], pa.int64()) for k in range(4))], ["feature", *names])

        for batch in batches:
            for toxic, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for f in set().union(*reader.all(text.as_py())):
                    seen[f][2 * out + 1 - toxic] += 1
                if len(seen) >= PENDING:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    rows = sample.select("toxic", "kept_out", "text")
    n = {(r["toxic"], r["kept_out"]): r["count"] for r in sample.groupBy("toxic", "kept_out").count().collect()}
    a0, b0, a1, b1 = (n.get((t, k), 0) for k in (False, True) for t in (1, 0))
    na, nb = a0 + a1, b0 + b1
    found = rows.mapInArrow(count, "feature string, a0 long, b0 long, a1 long, b1 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))
    found = found.where(f"a0 + a1 >= {MIN_ROWS} AND (a0 + a1) * {nb} > (b0 + b1) * {na}")
    ratio = F.expr(_RATIO.format(a="(a0 + a1)", b="(b0 + b1)", na=f"{na}D", nb=f"{nb}D"))
    best = found.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "feature").limit(LEXICON).collect()
    whole = _lexicon([(r["feature"], r["a0"] + r["a1"], r["b0"] + r["b1"]) for r in best], na, nb)
    half = _lexicon([(r["feature"], r["a0"], r["b0"]) for r in best], a0, b0)
    honest = min(a1, b1) >= 20
    seen_by = half if honest else whole

    def summarise(batches):
        reader = Reader(Channel(*channel.value), evidence_in(seen_by))
        for batch in batches:
            got = [_summary([e for _, _, e in reader.all(text.as_py())]) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(g) for g in got], pa.list_(pa.float64()))], ["toxic", "x"])

    used = rows.where("kept_out") if honest else rows
    fitted = used.select("toxic", "text").mapInArrow(summarise, "toxic int, x array<double>").collect()  # at most SAMPLE_* rows of five numbers
    order = sorted((tuple(r["x"]), r["toxic"]) for r in fitted)
    x, y = np.array([o[0] for o in order]), np.array([o[1] for o in order], float)
    ones, zeros = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    weight = np.where(y > 0, share / ones, (1 - share) / zeros) * len(y)
    weights = _logistic(x, y, weight)
    drop(per_doc)
    drop(sample)
    return Model(counts, total, whole, tuple(weights.tolist()))


def _sketch(text: str | None) -> int:
    """Smallest hash of the three-word sequences of a text, which near copies mostly share."""
    w = clean(text or "").split()
    return min((zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))), default=0) - (1 << 31)


def score(docs: DataFrame, model: Model, threshold: float = TOXIC_FROM) -> DataFrame:
    """Every row of docs (needs column text) with score, predicted, and restored: suspect spans that hold evidence, as read."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = [free(n, docs.columns) for n in ("score", "predicted", "restored")]
    pair = T.StructType([T.StructField("span", T.StringType()), T.StructField("said", T.StringType())])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(named, (T.DoubleType(), T.IntegerType(), T.ArrayType(pair)), strict=True))])
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("span", pa.string()), ("said", pa.string())]))

    def run(batches):
        model = shared.value
        reader = Reader(Channel(model.counts, model.total), evidence_in(model.lexicon))
        for batch in batches:
            scores, restored = [], []
            for text in batch.column(at):
                found = reader.all(text.as_py())
                scores.append(model.probability([e for _, _, e in found]))
                restored.append([{"span": token, "said": said} for token, said, _ in found if said])
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(restored, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *named])

    return docs.mapInArrow(run, schema)
