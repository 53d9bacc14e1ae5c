"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to.  A small flow network
(patterns -> sources -> quotas) routes whole words: a pattern's words cost nothing the
first time, more the second and third (convex repetition costs), and never count more
than MAX_PASSES times.  What a pattern must give is then turned into documents: all of
them for each full pass, and for the rest those that come first by a seeded hash, found
from sums per hash bucket; only the bucket that holds the cut is looked at row by row.

Defined cases: a null text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows are rows of their own; an empty table gives an
empty result; reruns give the same rows, since order depends on doc_id and text only; ties
of sizes go by that order; very long texts are counted whole; further columns pass through
`carry` whatever their names; more than MAX_PATTERNS patterns are an error.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.llm.io import stored

MAX_PASSES = 3
PASS_COSTS = (0, 1, 3)
#: A bucket this small is cut row by row inside one task.
CUT_ROWS = 1024
LEVEL_BITS = 8
#: The patterns and their sums are held on the driver; this many take about 1 GB.
MAX_PATTERNS = 1_000_000


def targets(sizes: dict[str | None, int], total: int, weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_PASSES) -> dict[str | None, float]:
    """Shares of `total` by weights dealt out in code-point order (null last); what exceeds `most` times a source is reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: dict[str | None, float] = {}
    while True:
        open_ = [s for s in order if s not in full]
        left, each = total - sum(full.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / each for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return full | share
        full |= {s: float(most * sizes[s]) for s in above}


def min_cost_flow(patterns: dict[str, tuple[list[str | None], int]], quotas: dict[str | None, int]) -> dict[str, dict[str | None, int]]:
    """Words that each pattern gives to each source: quotas met as far as possible, at the least repetition cost.

    A source that shares no pattern with another is met by its own words.  For the others the flow
    grows by one round a price of repetition (potentials from shortest ways, then blocking flows).
    """
    apart = {members[0] for members, _ in patterns.values() if len(members) == 1}
    apart -= {s for members, _ in patterns.values() if len(members) > 1 for s in members}
    alone = {p: {members[0]: min(quotas[members[0]], MAX_PASSES * words)} for p, (members, words) in patterns.items() if len(members) == 1 and members[0] in apart}
    patterns = {p: v for p, v in patterns.items() if p not in alone}
    quotas = {s: q for s, q in quotas.items() if s not in apart}
    names = ["", *patterns, *(("source", s) for s in quotas), "end"]
    index = {n: k for k, n in enumerate(names)}
    edges: list[list] = []  # to, capacity, cost; edge k ^ 1 is the reverse
    at: list[list[int]] = [[] for _ in names]

    def edge(a, b, capacity, cost):
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            at[index[x]].append(len(edges))
            edges.append([index[y], c, w])

    for p, (members, words) in patterns.items():
        for cost in PASS_COSTS:
            edge("", p, words, cost)
        for s in members:
            edge(p, ("source", s), sum(quotas.values()), 0)
    for s, q in quotas.items():
        edge(("source", s), "end", q, 0)
    potential = [0] * len(names)
    while True:
        dist, heap = [math.inf] * len(names), [(0, 0)]
        dist[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for k in at[x]:
                y, capacity, cost = edges[k]
                if capacity and (e := d + cost + potential[x] - potential[y]) < dist[y]:
                    dist[y] = e
                    heapq.heappush(heap, (e, y))
        if math.isinf(dist[-1]):
            break
        potential = [p + min(d, dist[-1]) for p, d in zip(potential, dist, strict=True)]
        while _push(edges, at, potential):
            pass
    flow: dict[str, dict[str | None, int]] = {}
    for p in patterns:
        flow[p] = {names[edges[k][0]][1]: edges[k ^ 1][1] for k in at[index[p]] if k % 2 == 0}
    return flow | alone


def _push(edges: list[list], at: list[list[int]], potential: list[int]) -> int:
    """Words sent along shortest ways of no reduced cost until every such way is blocked."""
    end = len(at) - 1
    level, queue = {0: 0}, [0]
    for x in queue:
        for k in at[x]:
            y, capacity, cost = edges[k]
            if capacity and y not in level and cost + potential[x] == potential[y]:
                level[y] = level[x] + 1
                queue.append(y)
    if end not in level:
        return 0
    turn, path, total, x = [0] * len(at), [], 0, 0
    while True:
        if x == end:
            amount = min(edges[k][1] for k in path)
            for k in path:
                edges[k][1] -= amount
                edges[k ^ 1][1] += amount
            total += amount
            full = next(i for i, k in enumerate(path) if not edges[k][1])
            x = edges[path[full] ^ 1][0]
            del path[full:]
        elif turn[x] < len(at[x]):
            k = at[x][turn[x]]
            y, capacity, cost = edges[k]
            if capacity and level.get(y) == level[x] + 1 and cost + potential[x] == potential[y]:
                path.append(k)
                x = y
            else:
                turn[x] += 1
        elif path:
            x = edges[path.pop() ^ 1][0]
            turn[x] += 1
        else:
            return total


def whole_quotas(wanted: dict[str | None, float]) -> dict[str | None, int]:
    """Round to words, the largest remainders first, so that the sum stays."""
    down = {s: int(t) for s, t in wanted.items()}
    rest = round(sum(wanted.values())) - sum(down.values())
    for s in sorted(wanted, key=lambda s: (down[s] - wanted[s], s is None, s or ""))[: max(0, rest)]:
        down[s] += 1
    return down


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take documents of a cut bucket in seeded order while they fit, then repeat the largest that still fit."""
    rows = rows.sort_values(["_order", "_key"], kind="stable")
    left = int(rows["_cut_rest"].iloc[0])
    sizes, base = rows["size"].to_numpy(), rows["_full"].to_numpy()
    extra = np.zeros(len(rows), np.int64)
    largest_first = np.argsort(-sizes, kind="stable")
    for turn in [range(len(rows)), *[largest_first] * (MAX_PASSES - 1)]:
        for k in turn:
            if 0 < sizes[k] <= left and base[k] + extra[k] < MAX_PASSES:
                extra[k] += 1
                left -= int(sizes[k])
    return pd.DataFrame({"_key": rows["_key"], "passes": base + extra})


def mix(docs: DataFrame, members: Column, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, members, source_size, target, passes, taken and carry of each row of docs(doc_id, text, ...).

    members: the array of sources that a row belongs to; source_size and target are those of its
    first source.  carry: struct of further columns of docs, under their own names.
    """
    spark = docs.sparkSession
    own = F.to_json(F.array_sort(F.array_distinct(members)))
    held = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    base = docs.select("doc_id", word_count(F.col("text")).alias("size"), own.alias("_pattern"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_order"), held.alias("carry"))
    base = stored(base.withColumn("_key", F.monotonically_increasing_id()), "mix-base")
    sums = base.groupBy("_pattern").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {r["_pattern"]: (json.loads(r["_pattern"]), r["words"]) for r in sums}
    sizes: dict[str | None, int] = {}
    for sources, words in patterns.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes, sum(w for _, w in patterns.values()), weights) if sizes else {}
    flow = min_cost_flow(patterns, whole_quotas(wanted))
    plan = []
    for r in sums:
        p, words = r["_pattern"], r["words"]
        first = patterns[p][0][0] if patterns[p][0] else None
        amount = sum(flow[p].values())
        full = min(MAX_PASSES, amount // words) if words else 0
        plan.append((p, sizes.get(first, 0), wanted.get(first, 0.0), full, amount - full * words))
    # one row a pattern, at most MAX_PATTERNS
    known = base.join(F.broadcast(spark.createDataFrame(plan, "_pattern string, source_size bigint, target double, _full bigint, _rest bigint")), "_pattern")
    columns = ["doc_id", "size", "_pattern", "source_size", "target", "carry", "passes"]
    parts = [known.where("_rest = 0").withColumn("passes", F.col("_full")).select(columns)]
    # state of the patterns that need a cut: used bits of the order, bits of the next bucket number, words still to take
    rows_of = {r["_pattern"]: r["rows"] for r in sums}
    state = {p[0]: (0, _bits(rows_of[p[0]]), p[4]) for p in plan if p[4]}
    left = known.where("_rest > 0")
    while True:
        now = F.broadcast(spark.createDataFrame([(p, *v) for p, v in state.items()], "_pattern string, _used int, _bits int, _cut_rest bigint"))
        left = left.join(now, "_pattern")
        if all(bits == 0 for _, bits, _ in state.values()):
            break
        bucket = F.when(F.col("_bits") > 0, F.expr("shiftrightunsigned(shiftleft(_order, _used), 64 - _bits)")).otherwise(0)
        left = left.withColumn("_bucket", bucket)
        buckets: dict[str, list[tuple[int, int, int]]] = {p: [] for p in state}
        for r in left.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect():  # at most 2**LEVEL_BITS a pattern
            buckets[r["_pattern"]].append((r["_bucket"], r["words"], r["rows"]))
        cuts = []
        for p, found in buckets.items():
            used, bits, rest = state[p]
            for at, words, n in sorted(found):  # noqa: B007
                if rest <= words or at == max(found)[0]:
                    break
                rest -= words
            cuts.append((p, at))
            state[p] = (used + bits, _bits(n) if bits and used + bits + LEVEL_BITS <= 64 else 0, rest)
        left = left.drop("_used", "_bits", "_cut_rest").join(F.broadcast(spark.createDataFrame(cuts, "_pattern string, _at bigint")), "_pattern")
        parts.append(left.where("_bucket != _at").withColumn("passes", F.col("_full") + (F.col("_bucket") < F.col("_at")).cast("int")).select(columns))
        left = left.where("_bucket = _at").drop("_bucket", "_at")
    filled = left.select("_pattern", "_order", "_key", "size", "_full", "_cut_rest").groupBy("_pattern").applyInPandas(_fill, "_key bigint, passes bigint")
    parts.append(left.join(filled.hint("merge"), "_key").select(columns))
    taken = parts[0]
    for part in parts[1:]:
        taken = taken.unionByName(part)
    return taken.select("doc_id", "size", F.from_json("_pattern", "array<string>").alias("members"), "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), "carry")


def _bits(rows: int) -> int:
    """Bits of the next bucket number: none for few rows, else for buckets of about CUT_ROWS / 4."""
    return min(LEVEL_BITS, int(math.log2(rows / (CUT_ROWS / 4)))) if rows > CUT_ROWS else 0
