"""Longest-processing-time sharding of groups that must stay together.

Equal texts are a group; groups are placed, largest first, on the least-loaded shard.
The schedule needs only how many groups there are of each weight, so weights are
counted by level (their 12 leading bits: exact below 4096 bytes, within 0.05 % above;
under 110 000 levels whatever the input), the heap runs over levels on the driver, and
a run of many equal groups is poured in at once.  Groups then find their place by
their rank in the level, documents theirs by a salted rank in the shard.

Defined cases: a null text counts as an empty one (size 16, crc32 0) and belongs to the
group of empty texts; repeated rows get a slot each; an empty table gives an empty
result; a group larger than a shard's share leaves the other shards as even as LPT can.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.io import stored

OVERHEAD = 16
LEVEL_BITS = 12
SALTS = 64
#: A group with more than this share of all rows joins by broadcast; there are fewer than 1000 such.
HOT_SHARE = 1000


def schedule(runs: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """LPT over runs (level, number of groups, mean weight), heaviest first.

    Gives per level the ranks at which a new shard begins, and those shards.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for level, n, weight in runs:
        starts, places, rank = [], [], 0
        if n <= 4 * shards:
            given: dict[int, int] = {}
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + weight, s))
                given[s] = given.get(s, 0) + 1
        else:
            given = _pour(heap, n, weight)
            heap = [(load + given.get(s, 0) * weight, s) for load, s in heap]
            heapq.heapify(heap)
        for s in sorted(given):
            starts.append(rank)
            places.append(s)
            rank += given[s]
        out.append((level, starts, places))
    return out


def _pour(heap: list[tuple[float, int]], n: int, weight: float) -> dict[int, int]:
    """How many of n equal groups each shard gets when they go one by one to the least loaded."""
    below = lambda top: sum(max(0, int((top - load) / weight)) for load, _ in heap)
    low, high = min(heap)[0], max(heap)[0] + weight * (n + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if below(mid) <= n:
            low = mid
        else:
            high = mid
    given = {s: max(0, int((low - load) / weight)) for load, s in heap}
    rest = n - sum(given.values())
    for _, s in heapq.nsmallest(rest, ((load + given[s] * weight, s) for load, s in heap)):
        given[s] += 1
        rest -= 1
    while rest:  # more ties than shards
        for _, s in sorted((load + given[s] * weight, s) for load, s in heap)[:rest]:
            given[s] += 1
            rest -= 1
    return given


def _rank(df: DataFrame, by: str, *order: str) -> DataFrame:
    """`rank`: 0.. within each value of `by`, without gathering a value's rows in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy(by, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most SALTS rows a value
    offsets = counts.select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(within) - 1)
    return ranked.join(offsets.hint("shuffle_hash"), [by, "_salt"]).withColumn("rank", F.col("_before") + F.col("_rn")).drop("_salt", "_rn", "_before")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stored(docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("_group")), "shard-base")
    groups = base.groupBy("_group").agg(F.count("*").alias("_rows"), F.sum("size").alias("_weight"))
    low_bits = f"greatest(0, length(bin(_weight)) - {LEVEL_BITS})"
    groups = stored(groups.withColumn("_level", F.expr(f"shiftleft(shiftright(_weight, {low_bits}), {low_bits})")), "shard-groups")
    levels = groups.groupBy("_level").agg(F.count("*").alias("n"), F.avg("_weight").alias("mean")).collect()  # under 110 000 rows by construction
    plan = schedule(sorted(((r["_level"], r["n"], r["mean"]) for r in levels), reverse=True), shards)
    places = spark.createDataFrame(plan, "_level bigint, _starts array<bigint>, _places array<int>")
    placed = _rank(groups, "_level", "_weight", "_group").join(places.hint("shuffle_hash"), "_level")
    at = F.size(F.filter("_starts", lambda x: x <= F.col("rank")))
    placed = stored(placed.select("_group", "_rows", F.get("_places", at - 1).alias("shard")), "shard-placed")
    rows = placed.agg(F.sum("_rows")).first()[0] or 0
    hot = placed.where(F.col("_rows") * HOT_SHARE > rows)
    rest = placed.where(F.col("_rows") * HOT_SHARE <= rows)
    # fewer than HOT_SHARE groups can each hold more than 1/HOT_SHARE of the rows
    found = base.join(F.broadcast(hot.select("_group", F.col("shard").alias("_hot"))), "_group", "left")
    found = found.where("_hot IS NOT NULL").withColumnRenamed("_hot", "shard").unionByName(
        found.where("_hot IS NULL").drop("_hot").join(rest.select("_group", "shard").hint("merge"), "_group")
    )
    found = stored(found, "shard-found")
    return _rank(found, "shard", "doc_id", "text_crc32", "_group").select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
