"""All pairs of 64-bit fingerprints within a Hamming distance, by an index of permuted tables.

The bits are cut into blocks.  Two fingerprints within distance d differ in at most d of m
blocks, so they agree in some m - d of them: for each choice of m - d blocks there is one
table whose key is those bits, and an equi-join on (mask, key) meets every pair.  m grows
with the number of fingerprints, so that a key is selective at any size: 4 tables of 16
bits for a thousand fingerprints at distance 3, 35 of 36 bits for a billion.

A bucket of more than HOT fingerprints is parted again: the bits that vary among its members
are cut into d + 1 parts, of which a pair within d shares one, so it becomes d + 1 smaller
buckets with longer keys, and so on until all are small or fewer than 2 (d + 1) bits vary, which
4**(d + 1) fingerprints can hold.  So candidates a fingerprint and mask are bounded on any data,
and nothing is dropped.

The members of a bucket are compared in blocks of xor and bit counts inside a task, so a candidate
never is a row.  A pair comes from the first table, and the first part of a parted bucket, in which
it agrees, so it comes once and pairs need no shuffle.  ``nearest_before`` gives a row a fingerprint
instead of its pairs, whose number grows with the square of a dense family.

Defined cases: fingerprints are distinct before they are indexed (a family of equal ones is one
row, its members are found by joining back); null fingerprints have no pairs.
"""

from __future__ import annotations

import itertools
import math
import uuid
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.sources.shared import folder

HOT = 1 << 15
#: Tables of an index at most; beyond them keys are left as they are and hot buckets are parted.
MOST_TABLES = 924
#: Key bits over log2 of the number of fingerprints.
SPARE_BITS = 2
#: Up to this size buckets are compared side by side, larger ones in blocks of ROWS by COLUMNS.
SMALL, ROWS, COLUMNS = 64, 512, 4096
FAR_APART = 99


def parts(mask: int, n: int) -> list[int]:
    """The set bits of a mask, cut into n masks of nearly equal size, neighbours together."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def masks(distance: int, n: int) -> list[int]:
    """Masks of which any two fingerprints within `distance` share one, with keys of log2(n) + SPARE_BITS bits or more if MOST_TABLES allows."""
    best = []
    for m in range(distance + 1, 65):
        chosen = m - distance
        if best and math.comb(m, chosen) > MOST_TABLES:
            break
        best = [sum(c) for c in itertools.combinations(parts((1 << 64) - 1, m), chosen)]
        if min(x.bit_count() for x in best) >= math.log2(max(n, 2)) + SPARE_BITS:
            break
    return best


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _written(df: DataFrame, base: str, name: str) -> DataFrame:
    df.write.parquet(f"{base}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")


def index(fingerprints: DataFrame, distance: int, hot: int = HOT) -> tuple[DataFrame, str]:
    """(root, path, sooner, mask, key, fingerprint, query) of the buckets, and the folder that holds what they are made of.

    `fingerprints` has columns fingerprint (distinct) and query (boolean), and doc_id if that is
    to be carried.  A bucket is a (path, key); root is the number of its first mask, and a pair
    that agrees on a mask of `sooner` is met in an earlier part too.
    """
    spark = fingerprints.sparkSession
    base = f"{folder(spark)}/hamming-{uuid.uuid4().hex}"
    own = ["fingerprint", "query", *(c for c in ("doc_id",) if c in fingerprints.columns)]
    rows = _written(fingerprints.where("fingerprint IS NOT NULL").select(*own), base, "fingerprints")
    n_rows = rows.count()
    tables = F.array(*(F.struct(F.lit(i).alias("root"), F.lit(signed(m)).cast("long").alias("mask")) for i, m in enumerate(masks(distance, n_rows))))
    level = rows.select(F.explode(tables).alias("t"), *own).select("t.root", F.col("t.root").cast("long").alias("path"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("sooner"), "t.mask", *own)
    done, n = None, 0
    while True:
        level = level.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        if n:
            level = _written(level, base, f"level-{n}")
        if n_rows <= hot:  # no bucket can hold more
            return level, base
        varying = F.bit_or("fingerprint").bitwiseAND(F.bitwise_not(F.bit_and("fingerprint")))
        full = level.groupBy("path", "mask", "key").agg(F.count("*").alias("size"), varying.alias("varying")).where((F.col("size") > hot) & (F.bit_count("varying") >= 2 * (distance + 1)))
        bits = "filter(sequence(0, 63), b -> getbit(varying, b) = 1)"
        part = f"aggregate(slice(bits, CAST(k * size(bits) DIV {distance + 1} AS INT) + 1, CAST((k + 1) * size(bits) DIV {distance + 1} - k * size(bits) DIV {distance + 1} AS INT)), mask, (m, b) -> m | shiftleft(1L, b))"
        full = full.selectExpr("path", "mask", "key", f"{bits} AS bits").selectExpr("path", "key", f"transform(sequence(0, {distance}), k -> {part}) AS finer")
        full = _written(full, base, f"hot-{n}")
        none = full.isEmpty()
        # of all rows of the index at most one in `hot` is a full bucket
        cool = level if none else level.join(F.broadcast(full), ["path", "key"], "left_anti").select(level.columns)
        done = cool if done is None else done.unionByName(cool)
        if none:
            return done, base
        level = level.join(F.broadcast(full), ["path", "key"]).select("*", F.posexplode("finer").alias("k", "part"))
        level = level.select("root", F.xxhash64("path", "key", "k").alias("path"), F.expr("concat(sooner, slice(finer, 1, k))").alias("sooner"), F.col("part").alias("mask"), *own)
        n += 1


def _whole(batches):
    """(batch, starts) of batches that end with a bucket, from batches in order of buckets."""
    held = None
    for batch in joined(batches, [None]):
        if batch is not None:
            held = batch if held is None or not held.num_rows else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        path, key = held.column("path").to_numpy(), held.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])]))
        cut = held.num_rows if batch is None else int(starts[-1])
        if cut:
            yield held.slice(0, cut), starts[starts < cut]
            held = held.slice(cut)


def _side_by_side(starts: np.ndarray, n: int):
    """(i, j) of all places i < j of each bucket of SMALL or fewer, one distance of places at a time."""
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for step in range(1, SMALL):
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield at, at + step


def _large(starts: np.ndarray, n: int):
    ends = np.append(starts[1:], n)
    return [(int(a), int(z)) for a, z in zip(starts, ends, strict=True) if z - a > SMALL]


def _close(x: np.ndarray, query: np.ndarray | None, starts: np.ndarray, distance: int):
    """(i, j) of the places of each bucket within distance: i < j, or i one of the queries and j one of the others."""
    for i, j in _side_by_side(starts, len(x)):
        if query is not None:
            mixed = query[i] != query[j]
            i, j = i[mixed], j[mixed]
            i, j = np.where(query[i], i, j), np.where(query[i], j, i)
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        yield i[near], j[near]
    for a, z in _large(starts, len(x)):
        places = np.arange(a, z)
        left, right = (places, places) if query is None else (places[query[a:z]], places[~query[a:z]])
        for k in range(0, len(left), ROWS):
            for m in range(k if query is None else 0, len(right), COLUMNS):
                i, j = np.nonzero(np.bitwise_count(x[left[k : k + ROWS], None] ^ x[None, right[m : m + COLUMNS]]) <= distance)
                i, j = left[k + i], right[m + j]
                if query is None:
                    i, j = i[i < j], j[i < j]
                yield i, j


def _first(batch: pa.RecordBatch, roots: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which differences v of pairs at places i agree on no earlier table and no earlier part."""
    root, sooner = batch.column("root").to_numpy()[i], batch.column("sooner")
    keep = np.ones(len(i), bool)
    for k in range(int(root.max(initial=0))):
        keep &= (root <= k) | (v & roots[k] != 0)
    offsets, values = sooner.offsets.to_numpy(), sooner.values.to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = (offsets[1:] - offsets[:-1])[i]
    for k in range(int(lengths.max(initial=0))):
        has = np.flatnonzero(lengths > k)
        keep[has] &= v[has] & values[offsets[i[has]] + k] != 0
    return keep


def _dealt(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition("path", "key").sortWithinPartitions("path", "key", order)


def near(fingerprints: DataFrame, distance: int, hot: int = HOT, unlike: bool = False) -> DataFrame:
    """a, b, distance of all pairs of different fingerprints within `distance`, and a_id, b_id if these have a doc_id.

    With `unlike`, only pairs of different doc_id.  With rows marked `query`, a is one of these and b one of the others; else a < b.
    `fingerprints` has columns fingerprint (distinct within each side) and query (boolean).
    """
    rows, _ = index(fingerprints, distance, hot)
    asked = not fingerprints.where("query").isEmpty()
    ids = "doc_id" in rows.columns
    roots = np.array(masks(distance, fingerprints.where("fingerprint IS NOT NULL").count()), np.uint64)

    def run(batches):
        for batch, starts in _whole(batches):
            x = batch.column("fingerprint").to_numpy().view(np.uint64)
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool) if asked else None
            for i, j in _close(x, query, starts, distance):
                v = x[i] ^ x[j]
                keep = np.flatnonzero((v != 0) & _first(batch, roots, i, v))
                if not len(keep):
                    continue
                i, j, v = i[keep], j[keep], v[keep]
                columns = [pa.array(x[i].view(np.int64)), pa.array(x[j].view(np.int64)), pa.array(np.bitwise_count(v).astype(np.int32))]
                if unlike:
                    label = batch.column("doc_id").to_numpy()
                    other = label[i] != label[j]
                    i, j, columns = i[other], j[other], [c.filter(pa.array(other)) for c in columns]
                if ids:
                    columns += [batch.column("doc_id").take(pa.array(k)) for k in (i, j)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["a", "b", "distance"] + ids * ["a_id", "b_id"]
    return _dealt(rows, "fingerprint").mapInArrow(run, "a bigint, b bigint, distance int" + ids * ", a_id bigint, b_id bigint")


def nearest_before(fingerprints: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """fingerprint, distance to the nearest other one with a smaller doc_id, of the rows marked `query` that have one within `distance`."""
    rows, _ = index(fingerprints.where("doc_id IS NOT NULL"), distance, hot)

    def run(batches):
        for batch, starts in _whole(batches):
            x = batch.column("fingerprint").to_numpy().view(np.uint64)
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            best = np.full(len(x), FAR_APART, np.uint8)
            for i, j in _side_by_side(starts, len(x)):
                i, j = i[query[j]], j[query[j]]
                best[j] = np.minimum(best[j], np.bitwise_count(x[i] ^ x[j]))
            for a, z in _large(starts, len(x)):
                asked = a + np.flatnonzero(query[a:z])
                for k in range(0, len(asked), ROWS):
                    j = asked[k : k + ROWS]
                    for m in range(a, int(j[-1]), COLUMNS):
                        i = np.arange(m, min(m + COLUMNS, int(j[-1])))
                        apart = np.bitwise_count(x[j, None] ^ x[None, i])
                        apart[i[None, :] >= j[:, None]] = FAR_APART
                        best[j] = np.minimum(best[j], apart.min(axis=1))
            found = np.flatnonzero(best <= distance)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(x[found].view(np.int64)), pa.array(best[found].astype(np.int32))], ["fingerprint", "distance"])

    found = _dealt(rows, "doc_id").mapInArrow(run, "fingerprint bigint, distance int")
    return found.groupBy("fingerprint").agg(F.min("distance").alias("distance"))
