"""Benchmark decontamination on a distributed positional inverted index.

The index is a table of segments, each a bounded run of documents: its terms (word
hashes, sorted) and, per term, the positions where the term stands.  A benchmark item
is cut into windows of words.  In each segment a window starts from the term that is
rarest there; its positions, moved back by the term's offset, are intersected with the
offset-adjusted positions of the next rarest terms until none or only exact phrases
are left.  With ``slack`` > 0 every term need only stand within that many words of its
place (proximity match).

Items are handled in blocks of bounded size, so what is sent to the tasks is bounded
whatever the benchmark's size.

Defined cases: null and empty texts have no words and are never hit; an item of fewer
words than the width is one window, an item without words none; repeated documents are
judged each, repeated item ids count once; an item without id hits words but is neither counted
nor listed; windows do not run across documents; empty
tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.llm.io import stored
from textassay.llm.textops import ALNUM_WORDS, slices

WIDTH = 10
SEGMENT_BYTES = 2 << 20
#: Bytes of item text that one pass over the index looks for.
ITEM_BLOCK_BYTES = 2 << 20


def build_index(docs: DataFrame) -> DataFrame:
    """One row a segment: docs (ids), rows (first word of each document), terms, offsets, positions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text"), SEGMENT_BYTES):
                words = part.words(ALNUM_WORDS, lower=True)
                order = np.argsort(words.hash, kind="stable")
                ranked = words.hash[order]
                new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
                columns = [words.rows.astype(np.int32), ranked[new], np.append(new, len(ranked)).astype(np.int32), order.astype(np.int32)]
                ids = batch.column("doc_id").slice(part.first, part.n)
                ids = pa.ListArray.from_arrays(pa.array([0, part.n], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["docs", "rows", "terms", "offsets", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, f"docs array<{kind}>, rows binary, terms binary, offsets binary, positions binary")


class Items:
    """Words of a block of items, and the windows over them: first word, width, item."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        part = next(slices(pa.array(texts, pa.string()), 1 << 62))
        words = part.words(ALNUM_WORDS, lower=True)
        self.vocabulary, self.word = np.unique(words.hash, return_inverse=True)
        first, size, item = [], [], []
        for i, (a, b) in enumerate(zip(words.rows[:-1], words.rows[1:], strict=True)):
            n = max(1, b - a - width + 1) if b > a else 0
            first.append(np.arange(a, a + n))
            size.append(np.full(n, min(width, b - a)))
            item.append(np.full(n, i))
        self.first, self.size, self.item = (np.concatenate(x).astype(np.int64) for x in (first, size, item))
        self.ids = ids


def _matches(items: Items, rows, terms, offsets, positions, slack: int):
    """(item, first word, words) of each place where a window's terms stand within slack of their places."""
    if not len(terms) or not len(items.vocabulary):
        return
    at = np.minimum(np.searchsorted(terms, items.vocabulary), len(terms) - 1)
    there = terms[at] == items.vocabulary
    begin = np.where(there, offsets[at], 0)
    count = np.where(there, offsets[at + 1] - offsets[at], 0)
    # windows all of whose terms occur in this segment
    missing = np.concatenate([[0], np.cumsum(count[items.word] == 0)])
    for w in np.flatnonzero(missing[items.first + items.size] == missing[items.first]):
        own = items.word[items.first[w] : items.first[w] + items.size[w]]
        order = np.argsort(count[own], kind="stable")
        found = None
        for k in order:
            t = own[k]
            listed = positions[begin[t] : begin[t] + count[t]].astype(np.int64)
            if found is None:
                found = listed - k
                found = found[(found >= 0) & (found + len(own) <= rows[-1])]
            else:
                low = np.searchsorted(listed, found + k - slack)
                high = np.searchsorted(listed, found + k + slack, side="right") if slack else low
                found = found[high > low] if slack else found[listed[np.minimum(low, len(listed) - 1)] == found + k]
            if not len(found):
                break
        if len(found):
            inside = np.searchsorted(rows, found, side="right") == np.searchsorted(rows, found + len(own) - 1, side="right")
            for start in found[inside]:
                yield int(items.item[w]), int(start), len(own)


def matches(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = 0) -> DataFrame:
    """segment, row, doc_id, n_words, spans, item_ids of every indexed document.

    spans: merged [first, last] word numbers covered by matches; items(item_id, text).
    """
    spark = index.sparkSession
    kind = index.schema["docs"].dataType.elementType.simpleString()
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BLOCK_BYTES) * 2 - 1)
    numbered = index.withColumn("segment", F.monotonically_increasing_id())
    found = None
    for b in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about ITEM_BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Items([r[0] for r in own], [r[1] for r in own], width) if own else None)

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    view = lambda name, t: np.frombuffer(batch.column(name)[i].as_buffer(), t)  # noqa: B023, E731
                    rows = view("rows", np.int32).astype(np.int64)
                    n = len(rows) - 1
                    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                    ids: list[set[str]] = [set() for _ in range(n)]
                    if block is not None:
                        got = sorted({(s, k, m) for m, s, k in _matches(block, rows, view("terms", np.uint64), view("offsets", np.int32), view("positions", np.int32), slack)})
                        for start, size, item in got:
                            d = int(np.searchsorted(rows, start, side="right")) - 1
                            if block.ids[item] is not None:
                                ids[d].add(block.ids[item])
                            first, last = start - int(rows[d]), start - int(rows[d]) + size - 1
                            if spans[d] and first <= spans[d][-1][1] + 1:
                                spans[d][-1] = (spans[d][-1][0], max(last, spans[d][-1][1]))
                            else:
                                spans[d].append((first, last))
                    docs = batch.column("docs")[i].values
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("segment")[i].as_py()] * n, pa.int64()),
                            pa.array(np.arange(n)),
                            docs,
                            pa.array(np.diff(rows)),
                            pa.array([[{"first": a, "last": z} for a, z in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                            pa.array([sorted(s) for s in ids], pa.list_(pa.string())),
                        ],
                        ["segment", "row", "doc_id", "n_words", "spans", "item_ids"],
                    )

        part = numbered.mapInArrow(run, f"segment bigint, row bigint, doc_id {kind}, n_words bigint, spans array<struct<first: bigint, last: bigint>>, item_ids array<string>")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
    return found


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs(doc_id, text)."""
    found = matches(stored(build_index(docs), "postings"), items, width)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))).cast("long")
    ids = F.array_sort(F.array_distinct("item_ids"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
