"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes with escape method C and full
symbol exclusion.  Because the symbols seen after a context are also seen after its
suffix, exclusion needs only two sums per context (how many of the suffix's symbols and
how much of its count the context has used up), so the code length of any byte comes
from a few table lookups and whole batches are scored with numpy.

Texts are dealt into chunks of about CHUNK_BYTES.  A chunk sends its distinct grams, packed
and with their training counts, to blocks by their two nearest context bytes; the counts of
a block merge to its part of the trie, the block answers each chunk's grams with their code
lengths, and a chunk's texts meet their answers.  So texts and model move by shuffles alone,
in proportion to the input; grams that many texts hold move once a chunk.  Busy blocks are
salted by chunk.  Only the counts of byte pairs (65536 at most) are broadcast, and words that
make up at least 1/FREQUENT of the training words (so fewer than FREQUENT) for the unigram
base, all other words go through a join.

Text is lower-cased (A-Z); a text ends with one end symbol, and begins after ends.

Defined cases: null reads as empty (one end token); without training text every byte
costs log10(256) and every token log10(1/1); repeated rows are scored each; a null
doc_id trains; a very long text is a chunk of its own; there are no ties to break; columns
beyond doc_id, text and held_out are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.io import bounded, stored
from textassay.llm.textops import SLICE_BYTES, SPACE_WORDS, Slice, as_signed, mix64, segment_sums, slices

ORDER = 5
SYMBOLS = 256
#: Bytes of text that look up their grams together.
CHUNK_BYTES = 8 << 20
#: Grams of a packed row.
PIECE_GRAMS = 4096
#: Chunks that one task of a block answers.
SALT_CHUNKS = 64
FREQUENT = 1 << 20
#: Distinct keys that a counting task holds before it passes them on.
HOLD = 1_500_000
CACHE_BITS = 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0] = 255  # 0 is the end symbol; 255 occurs in no UTF-8 text


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def grams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Gram of each byte and each end of a slice (symbol in the low byte, nearer context above it), and row bounds."""
    n, lead = part.n, ORDER + 1
    padded = np.zeros(len(part.data) + lead * n, np.uint8)
    shift = np.repeat(np.arange(n) * lead + ORDER, np.diff(part.bounds))
    padded[np.arange(len(part.data)) + shift] = _LOWER[part.data]
    out = padded.astype(np.uint64)
    for k in range(1, ORDER + 1):
        out[k:] |= padded[:-k].astype(np.uint64) << np.uint64(8 * k)
    valid = np.ones(len(padded), bool)
    starts = part.bounds[:-1] + np.arange(n) * lead
    for k in range(ORDER):
        valid[starts + k] = False
    return out[valid], part.bounds + np.arange(n + 1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Counter:
    """Keys with counts, merged as they grow; rows() passes them on."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.add_counted(*np.unique(values, return_counts=True))

    def add_counted(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.size += len(key)
        if self.size > 2 * HOLD:
            self.keys, self.counts = ([x] for x in _merged(self.keys, self.counts))
            self.size = len(self.keys[0])

    def rows(self, last: bool):
        if not self.keys or not (last or self.size > HOLD):
            return
        key, n = _merged(self.keys, self.counts)
        self.__init__()
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key[a : a + 100_000])), pa.array(n[a : a + 100_000].astype(np.int64))], ["key", "n"])


def training_words(texts: DataFrame) -> DataFrame:
    """key, n: how often each word hash occurs in the column text."""

    def run(batches):
        counter = _Counter()
        for batch in batches:
            for part in slices(batch.column(0)):
                counter.add(part.words(SPACE_WORDS, lower=True).hash)
                yield from counter.rows(False)
        yield from counter.rows(True)

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Trie:
    """Tables of a block of grams: per order the cells (context, symbol) and the contexts, both sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short_keys: np.ndarray, short_counts: np.ndarray):
        """keys: grams of ORDER context bytes; short_keys: all grams of one context byte."""
        self.cells: list[tuple[np.ndarray, np.ndarray]] = [None] * (ORDER + 1)
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [None] * (ORDER + 1)
        for k in range(ORDER, 1, -1):
            self.cells[k] = (keys, counts)
            keys, counts = _merged([keys & _mask(k)], [counts])
        self.cells[1] = (short_keys, short_counts)
        self.cells[0] = _merged([short_keys & _mask(1)], [short_counts])
        for k, (key, n) in enumerate(self.cells):
            own = key >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            used = add(self._count(k - 1, key & _mask(k))[0]) if k else np.zeros(len(first))
            self.contexts[k] = (own[first], add(n).astype(np.float64), np.diff(np.append(first, len(own))).astype(np.float64), used.astype(np.float64))
        self.cells = [(key, n.astype(np.float32)) for key, n in self.cells]

    def _count(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, n = self.cells[k]
        if not len(cells):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
        there = cells[at] == key
        return np.where(there, n[at], 0), there

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each distinct gram."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        used, distinct = np.zeros(len(gram)), np.zeros(len(gram))
        for k in range(ORDER, -1, -1):
            contexts, total, kinds, use = self.contexts[k]
            if not len(contexts) or not len(open_):
                continue
            own = (gram[open_] >> np.uint64(8)) & _mask(k)
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            seen = contexts[at] == own
            who, at = open_[seen], at[seen]
            n, found = self._count(k, gram[who] & _mask(k + 1))
            escape = kinds[at] - distinct[who]
            whole = total[at] - used[who] + escape
            with np.errstate(divide="ignore"):
                # a context all of whose symbols are excluded is passed for free
                step = np.where(found, np.log10(n), np.where(escape > 0, np.log10(escape), 0)) - np.where(found | (escape > 0), np.log10(whole), 0)
            out[who] += step
            used[who], distinct[who] = use[at], kinds[at]
            done = np.zeros(len(gram), bool)
            done[who[found]] = True
            open_ = open_[~done[open_]]
        out[open_] -= np.log10(SYMBOLS - distinct[open_])
        return out


class Answers:
    """Code lengths of a chunk's grams; frequent grams come from a direct-mapped cache."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.value = gram[order], value[order]
        self.known = np.full(1 << CACHE_BITS, np.uint64(1 << 63), np.uint64)
        self.known_value = np.zeros(1 << CACHE_BITS)

    def of(self, gram: np.ndarray) -> np.ndarray:
        slot = (mix64(gram) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.known_value[slot]
        miss = np.flatnonzero(self.known[slot] != gram)
        out[miss] = value = self.value[np.searchsorted(self.gram, gram[miss])]
        # of grams in one slot the last stays, in both tables
        kept = np.zeros(1 << CACHE_BITS, np.int64)
        kept[slot[miss]] = np.arange(len(miss))
        last = kept[slot[miss]]
        self.known[slot[miss]], self.known_value[slot[miss]] = gram[miss][last], value[last]
        return out


def block_of(gram: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a gram, by its two nearest context bytes."""
    return ((gram >> np.uint64(8)) & _mask(2)).astype(np.int64) * 40503 % 65536 % blocks


def _packed(values: np.ndarray) -> bytes:
    """An array of 8-byte values, byte place by byte place and compressed: sorted grams and lengths that recur shrink well."""
    raw = values.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind=np.uint64) -> np.ndarray:
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pieces(key: np.ndarray, n: np.ndarray):
    """Packed runs of PIECE_GRAMS grams and their counts."""
    for a in range(0, len(key), PIECE_GRAMS):
        yield _packed(key[a : a + PIECE_GRAMS]), _packed(n[a : a + PIECE_GRAMS].astype(np.int64))


def chunked(text: DataFrame, blocks: int) -> DataFrame:
    """Two kinds of rows: texts (chunk, _row, doc_id, held_out, text), and pieces (chunk, block, grams, counts)."""
    kind = text.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        chunk = row = TaskContext.get().partitionId() << 33
        trained, other, held = _Counter(), _Counter(), 0

        def sent(own):
            keys, n = _merged([*trained.keys, *other.keys], [*trained.counts, *(0 * x for x in other.counts)])
            place = block_of(keys, blocks)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(blocks + 1))
            for b in range(blocks):
                at = order[cuts[b] : cuts[b + 1]]
                found = list(_pieces(keys[at], n[at]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array([b] * len(found), pa.int32()), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], schema=schema)

        def whole(rows):
            """A batch of one kind with nulls for the columns of the other."""
            own = {name: rows.column(name) for name in rows.schema.names}
            return pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(rows.num_rows, f.type)) for f in full], schema=full)

        full = None
        for batch in batches:
            if full is None:
                full = pa.schema([*schema, ("_row", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("held_out", pa.bool_()), ("text", batch.schema.field("text").type)])
            for part in slices(batch.column("text"), min(SLICE_BYTES, CHUNK_BYTES)):
                if held and held + len(part.data) > CHUNK_BYTES:
                    for rows in sent(chunk):
                        yield whole(rows)
                    chunk += 1
                    trained, other, held = _Counter(), _Counter(), 0
                gram, bounds = grams(part)
                learn = np.repeat(batch.column("_train").slice(part.first, part.n).fill_null(False).to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                trained.add(gram[learn])
                other.add(gram[~learn])
                held += len(part.data)
                texts = batch.select(["doc_id", "held_out", "text"]).slice(part.first, part.n)
                yield whole(pa.RecordBatch.from_arrays([pa.array(np.full(part.n, chunk)), pa.array(np.arange(row, row + part.n)), *texts.columns], ["chunk", "_row", *texts.schema.names]))
                row += part.n
        if full is not None:
            for rows in sent(chunk):
                yield whole(rows)

    return text.select("doc_id", "held_out", "text", "_train").mapInArrow(run, f"chunk bigint, block int, grams binary, counts binary, _row bigint, doc_id {kind}, held_out boolean, text string")


def merged_counts(pieces: DataFrame, *keys: str) -> DataFrame:
    """block, salt, grams, counts: the counts of each key, a block or one with a salt, added up."""

    def run(batches):
        own, counter = None, _Counter()

        def sent():
            if own is None or not counter.keys:
                return
            found = list(_pieces(*_merged(counter.keys, counter.counts)))
            for a in range(0, len(found), 256):
                some = found[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array([own[0]] * len(some), pa.int32()), pa.array([own[1]] * len(some), pa.int64()), pa.array([x for x, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], ["block", "salt", "grams", "counts"])

        for batch in batches:
            for block, salt, key, n in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "grams", "counts")), strict=True):
                here = (block, salt if "salt" in keys else 0)
                if here != own:
                    yield from sent()
                    own, counter = here, _Counter()
                counter.add_counted(_unpacked(key), _unpacked(n, np.int64))
        yield from sent()

    rows = pieces.select("block", "salt", "grams", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "block int, salt bigint, grams binary, counts binary")


def _pairs(cells: DataFrame) -> DataFrame:
    """key, n of all grams of one context byte; 65536 keys at most."""

    def run(batches):
        counter = _Counter()
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, n = _unpacked(key), _unpacked(n, np.int64)
                counter.add_counted(key[n > 0] & _mask(2), n[n > 0])
        yield from counter.rows(True)

    return cells.select("grams", "counts").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def answered(pieces: DataFrame, cells: DataFrame, salts: int, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """chunk, grams, value: the code length of each gram of each chunk."""
    shared = pieces.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        own, keys, counts, trie = None, [], [], None
        for batch in batches:
            out = []
            for block, salt, chunk, key, n in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "chunk", "grams", "counts")), strict=True):
                if (block, salt) != own:
                    own, keys, counts, trie = (block, salt), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], None
                key = _unpacked(key)
                if chunk is None:
                    n = _unpacked(n, np.int64)
                    keys.append(key[n > 0])
                    counts.append(n[n > 0])
                    continue
                if trie is None:
                    trie = Trie(*_merged(keys, counts), *shared.value)
                out.append((chunk, _packed(key), _packed(trie.log10(key))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["chunk", "grams", "value"])

    every = cells.select("block", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"), F.lit(None).cast("bigint").alias("chunk"), "grams", "counts")
    rows = every.unionByName(pieces.select("block", "salt", "chunk", "grams", F.lit(None).cast("binary").alias("counts")))
    # a block's cells (without chunk) come before the pieces that ask
    return rows.repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("chunk").asc_nulls_first()).mapInArrow(run, "chunk bigint, grams binary, value binary")


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    key, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def score(docs: DataFrame, train: str = "NOT held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text, held_out).

    train: SQL condition of the rows to learn from.
    """
    spark = docs.sparkSession
    bounded(spark)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out", F.expr(train).alias("_train"))
    size, ends = text.agg(F.sum(F.octet_length("text")), F.count_if("_train")).first()
    words = stored(training_words(text.where("_train")), "lm-words")
    row = words.agg(F.count("*"), F.sum("n")).first()
    total = (row[1] or 0) + ends
    distinct = row[0] + (ends > 0)
    unseen = math.log10(total + distinct + 1)
    # each of these words makes up 1/FREQUENT of the training words or more
    frequent = spark.sparkContext.broadcast(_arrays(words.where(F.col("n") * FREQUENT >= total)))

    blocks = 32 * math.ceil(math.sqrt(1 + (size or 0) / (1 << 30)))
    salts = 1 + (size or 0) // (CHUNK_BYTES * SALT_CHUNKS)
    rows = stored(chunked(text, blocks), "lm-chunks")
    pieces = rows.where("block IS NOT NULL").withColumn("salt", F.pmod("chunk", F.lit(salts).cast("bigint")))
    cells = merged_counts(pieces, "block", "salt") if salts > 1 else pieces
    cells = stored(merged_counts(cells, "block"), "lm-cells")
    answers = answered(pieces, cells, salts, _arrays(_pairs(cells)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        common, times = frequent.value
        worth = np.log10(times + 1.0)
        own, gram, value, known = None, [], [], None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            texts = batch.column("_row").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (texts[1:] != texts[:-1])])) if len(chunks) else []
            for first, last in zip(cuts, [*cuts[1:], len(chunks)], strict=True):
                some = batch.slice(first, last - first)
                if chunks[first] != own:
                    own, gram, value, known = chunks[first], [], [], None
                if not texts[first]:
                    gram += [_unpacked(x) for x in some.column("grams").to_pylist()]
                    value += [_unpacked(x, np.float64) for x in some.column("value").to_pylist()]
                    continue
                if known is None:
                    known = Answers(np.concatenate(gram), np.concatenate(value))
                    gram, value = [], []
                for part in slices(some.column("text")):
                    found, bounds = grams(part)
                    words = part.words(SPACE_WORDS, lower=True)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, words.hash), len(common) - 1)
                        hit = common[at] == words.hash
                        gain = np.where(hit, worth[at], 0.0)
                    else:
                        hit, gain = np.zeros(len(words.hash), bool), np.zeros(len(words.hash))
                    rare = segment_sums(~hit, words.rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(as_signed(words.hash[~hit])))
                    head = [some.column(c).slice(part.first, part.n) for c in ("_row", "doc_id", "held_out")]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(segment_sums(known.of(found), bounds)), pa.array(words.count.astype(np.int64) + 1), pa.array(segment_sums(hit, words.rows)), pa.array(segment_sums(gain, words.rows)), lists], ["_row", "doc_id", "held_out", "score", "n_tokens", "n_known", "gain", "rare"])

    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    asked = rows.where("_row IS NOT NULL").select("chunk", *none(("grams", "binary"), ("value", "binary")), "_row", "doc_id", "held_out", "text")
    both = answers.select("chunk", "grams", "value", *none(("_row", "bigint"), ("doc_id", kind), ("held_out", "boolean"), ("text", "string"))).unionByName(asked)
    # the answers of a chunk (without row) come before its texts
    both = both.repartition("chunk").sortWithinPartitions("chunk", F.col("_row").asc_nulls_first())
    scored = stored(both.mapInArrow(run, f"_row bigint, doc_id {kind}, held_out boolean, score double, n_tokens bigint, n_known bigint, gain double, rare array<bigint>"), "lm-scored")
    rest = words.where(F.col("n") * FREQUENT < total).select("key", "n")
    rare = scored.select("_row", F.explode("rare").alias("key")).join(rest.hint("merge"), "key").groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("_gain"))
    out = scored.drop("rare").join(rare.hint("merge"), "_row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("_gain", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        "score",
    )


def adaptive_log10(text: str | None) -> float:
    """log10 probability of one text under a model that starts empty and learns each byte after coding it."""
    data = bytes([0] * ORDER) + bytes(_LOWER[np.frombuffer((text or "").encode(), np.uint8)]) + b"\0"
    seen: dict[bytes, dict[int, int]] = {}
    out = 0.0
    for i in range(ORDER, len(data)):
        symbol, excluded = data[i], set()
        for k in range(ORDER, -1, -1):
            own = {s: n for s, n in seen.get(data[i - k : i], {}).items() if s not in excluded}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if symbol in own:
                out += math.log10(own[symbol] / whole)
                break
            out += math.log10(len(own) / whole)
            excluded |= own.keys()
        else:
            out -= math.log10(SYMBOLS - len(excluded))
        for k in range(ORDER + 1):
            after = seen.setdefault(data[i - k : i], {})
            after[symbol] = after.get(symbol, 0) + 1
    return out


def adaptive_score(docs: DataFrame) -> DataFrame:
    """doc_id, score: adaptive code length of each row, one text at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([adaptive_log10(t) for t in rows.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
