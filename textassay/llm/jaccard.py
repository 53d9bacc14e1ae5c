"""N-gram Jaccard join through a token-group matrix.

A document's set is its distinct 5-word shingles (63-bit hashes).  Documents with equal
sets are one node.  Links are pairs of nodes with 100 * |x & y| >= 80 * |x | y|.

1. Candidates: of each set the SKETCH smallest hashes are counted.  Two sets that link share
   LEAST_COMMON of them at least, but with probability below 1e-12 (the smallest hashes of
   the union are a random sample of it; sets no larger than a sketch are compared whole),
   so a node with fewer hashes in common with others links with nothing.  From here on
   everything is exact and on whole sets: a node links with nothing either if less than
   80 % of its tokens occur in other candidates.
2. Groups: each node joins the leader that it shares most tokens with, if that is half of
   them.  Nodes that link with their leader are connected at once, by one comparison each.
3. Token-group matrix: each group's token union is stored as (group, token).  A node meets
   another group over the rarest tokens that any link must share one of (prefix filter);
   its overlap with the group's union is a bound, and only groups that reach it are
   opened, besides its own group where not all of that is connected.
4. An opened group's members stream past the query nodes in a grid of blocks; overlaps are
   counted on whole sets, and what a cell has connected is not linked again, so a cell
   gives fewer links than it has nodes, and no pair becomes a row.

All links between parts that are not connected are found that way; links inside a
connected part do not change components.

Defined cases: texts without words and null texts have empty sets and link with
nothing (component = own doc_id); fewer than five words are one shingle; repeated rows
and equal texts share a node; very long texts are read whole; a component's id is its
smallest doc_id (rows without id belong to components too, and one of them alone has none);
ties of leaders go by hash; an empty table gives an empty result; further columns are
ignored, whatever their names, but those named in `keep`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textassay.llm.io import bounded, drop, stored
from textassay.llm.textops import SPACE_WORDS, Slice, as_signed, mix64, slices

WORDS = 5
PERCENT = 80
SKETCH = 48
#: Members and query nodes that meet in a cell of an opened group's grid, about.
BLOCK, QUERIES = 1024, 64
#: Rounds in which nodes of too many tokens of their own are taken out.
ROUNDS = 2


def _least_common() -> int:
    """Largest c with P(Binomial(SKETCH, 0.8) < c) <= 1e-12."""
    p, below, c = PERCENT / 100, 0.0, 0
    while (below := below + math.comb(SKETCH, c) * p**c * (1 - p) ** (SKETCH - c)) <= 1e-12:
        c += 1
    return c


LEAST_COMMON = _least_common()


def shingle_sets(part: Slice) -> list[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each row of a slice."""
    words = part.words(SPACE_WORDS, lower=True)
    windows, _ = words.windows(WORDS)
    out = []
    for a, z in zip(words.rows[:-1], words.rows[1:], strict=True):
        if z - a >= WORDS:
            got = windows[a : z - WORDS + 1]
        elif z > a:
            got = np.array([z - a], np.uint64)
            for h in words.hash[a:z]:
                got = mix64(got * np.uint64(31) + h)
        else:
            got = np.zeros(0, np.uint64)
        out.append(np.unique(got >> np.uint64(1)))
    return out


def sketches(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, n (size of the set), node (hash of the whole set, null if empty) and sketch of each row of docs(doc_id, text)."""
    names = ["doc_id", *keep]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = shingle_sets(part)
                short = [s[:SKETCH] for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in short])]), pa.int32()), pa.array(as_signed(np.concatenate(short))))
                own = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_node, sets), pa.int64()), lists], [*names, "n", "node", "sketch"])

    return docs.select(*(f"`{c}`" for c in names), "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n bigint, node bigint, sketch array<bigint>"]))


def _node(tokens: np.ndarray) -> int | None:
    return int(as_signed(mix64(tokens).sum(keepdims=True) ^ np.uint64(len(tokens)))[0]) if len(tokens) else None


def components(edges: DataFrame) -> DataFrame:
    """node, group (smallest node it is connected with) of every node of edges(a, b): label propagation with pointer jumping."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "group").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("group").alias("before"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("far"))
        step = stored(step.join(jump.hint("merge"), "group", "left").select("node", "before", F.least("group", F.coalesce("far", "group")).alias("group")), "labels")
        labels = step.select("node", "group")
        if step.where("before != group").isEmpty():
            return labels


def _sets(texts: DataFrame) -> DataFrame:
    """node and tokens, its whole set, of each row of texts(text) that has words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = [s for s in shingle_sets(part) if len(s)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(as_signed(np.concatenate([*sets, np.zeros(0, np.uint64)]))))
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), lists], ["node", "tokens"])

    return texts.select("text").mapInArrow(run, "node bigint, tokens array<bigint>")


def _need():
    """Tokens that the sketch of a node of n shingles shares with any sketch it links with."""
    return F.when(F.col("n") * 100 <= SKETCH * PERCENT, F.ceil(F.col("n") * PERCENT / 100)).otherwise(LEAST_COMMON)


def _candidates(wide: DataFrame) -> DataFrame:
    """node, doc_id, n, copies of the nodes of wide(doc_id, n, node, sketch) whose sketches allow a link."""
    nodes = wide.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")
    tokens = nodes.select("node", F.explode("sketch").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    shared = tokens.join(common.hint("merge"), "token").groupBy("node").agg(F.count("*").alias("k"))
    slim = nodes.select("node", "doc_id", "n", "copies")
    few = stored(shared.join(slim.hint("merge"), "node").where(F.col("k") >= _need()).drop("k"), "candidates")
    drop(nodes)
    return few


def _pruned(sets: DataFrame) -> DataFrame:
    """node, n, copies, s, token, k of sets(node, n, copies, tokens): tokens of k > 1 nodes, of nodes that have s of them, enough for a link."""
    held = sets.select("node", "n", "copies", F.explode("tokens").alias("token"))
    for k in range(ROUNDS):
        before = held
        spread = held.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
        held = held.select("node", "n", "copies", "token").join(spread.hint("merge"), "token")
        enough = held.groupBy("node").agg(F.count("*").alias("s"), F.first("n").alias("m")).where(F.col("s") * 100 >= F.col("m") * PERCENT).select("node", "s")
        held = stored(held.join(enough.hint("merge"), "node"), "held")
        if k:
            drop(before)
    return held


def _grouped(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, group of every node of held, and the links (a, b) of nodes with the leaders of their groups."""
    # of a token the leader is the node with most copies, then by a hash
    order = F.struct((-F.col("copies")).alias("c"), F.xxhash64("node").alias("h"), F.col("node").alias("leader"))
    leaders = held.groupBy("token").agg(F.min(order).alias("o")).select("token", "o.leader")
    met = held.join(leaders.hint("merge"), "token").groupBy("node", "leader").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("k", "leader")).alias("o"), F.first("n").alias("n"))
    groups = stored(best.select("node", "n", F.when(F.col("o.k") * 2 >= F.col("n"), F.col("o.leader")).otherwise(F.col("node")).alias("group")), "groups")
    # one comparison a node, on all tokens that others have
    star = groups.where("node != group")
    theirs = held.select(F.col("node").alias("group"), "token", F.col("n").alias("m"))
    both = star.join(held.select("node", "token").hint("merge"), "node").join(theirs.hint("merge"), ["group", "token"])
    both = both.groupBy("node", "group").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    links = both.where(F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * PERCENT)
    return groups.select("node", "group"), stored(links.select(F.col("node").alias("a"), F.col("group").alias("b")), "star-links")


def _asked(held: DataFrame, members: DataFrame) -> DataFrame:
    """node, other: the groups that a node has to be held against; members(node, group, part)."""
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    parts = members.groupBy("group", "part").agg(F.count("*").alias("size")).groupBy("group").agg(F.max(F.struct("size", "part")).alias("o")).select("group", F.col("o.part").alias("most"))
    # in its own group a node of the largest part is met by the others
    own = members.join(parts.hint("merge"), "group").where("part != most").select("node", F.col("group").alias("other"))

    # tokens of which any two nodes that link share one: the rarest, as many as may be missing and one more
    place = F.row_number().over(Window.partitionBy("node").orderBy("k", "token"))
    prefix = held.select("node", "n", "s", "token", "k").withColumn("place", place).where(F.col("place") <= F.col("s") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    prefix = stored(prefix.select("node", "n", "s", "token").join(members.join(sizes.hint("merge"), "group").hint("merge"), "node"), "prefixes")
    least = lambda c: F.min(c).alias(f"least_{c}")
    target = prefix.withColumn("u", F.col("n") - F.col("s")).groupBy("token", "group").agg(F.first("size").alias("others"), least("n"), least("u"), F.max("s").alias("most_s"), F.min("part").alias("low"), F.max("part").alias("high"))
    target = target.withColumnRenamed("group", "other")
    # links are seen from both ends, so a node asks the larger group
    larger = (F.col("others") > F.col("size")) | ((F.col("others") == F.col("size")) & (F.col("other") > F.col("group")))
    apart = (F.col("low") != F.col("part")) | (F.col("high") != F.col("part"))
    # tokens that only one of two nodes has count in the union
    union = F.greatest(F.col("n") + F.col("least_u"), F.col("least_n") + F.col("n") - F.col("s"))
    reach = F.least("s", "most_s") * 100 >= union * PERCENT
    met = prefix.join(target.hint("merge"), "token").where((F.col("group") != F.col("other")) & larger & apart & reach)
    met = stored(met.select("node", "n", "other").distinct(), "met")
    drop(prefix)

    # the matrix, and the bound over all tokens: |x & y| >= 4/9 of both sizes
    named = held.select("node", "n", "token").join(members.select("node", F.col("group").alias("other")).join(met.select("other").distinct().hint("merge"), "other", "left_semi").hint("merge"), "node")
    matrix = named.groupBy("other", "token").agg(F.lit(1).alias("one")).select("other", "token")
    smallest = named.groupBy("other").agg(F.min("n").alias("least_n"))
    bound = met.select("node", "other").join(held.select("node", "n", "token").hint("merge"), "node").join(matrix.hint("merge"), ["other", "token"])
    bound = bound.groupBy("node", "other").agg(F.count("*").alias("c"), F.first("n").alias("n")).join(smallest.hint("merge"), "other")
    bound = bound.where((F.col("c") * 100 >= F.col("n") * PERCENT) & (F.col("c") * 9 * 100 >= (F.col("n") * 100 + F.greatest(F.col("least_n") * 100, F.col("n") * PERCENT)) * 4))
    return stored(own.unionByName(bound.select("node", "other")), "asked")


def _opened(asked: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between parts, by the nodes of asked(node, other) and the members of those groups.

    Queries and members of a group are dealt as a grid of blocks; in a cell members stream
    past the sets of at most about QUERIES queries.
    """
    held = members.withColumnRenamed("group", "other").join(asked.select("other").distinct().hint("merge"), "other", "left_semi")
    rows = held.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    columns = asked.groupBy("other").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("columns"))
    grid = rows.join(columns.hint("merge"), "other")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    queries = asked.join(members.select("node", "part").hint("merge"), "node").join(grid.hint("merge"), "other").select("other", every("rows").alias("row"), mine("columns").alias("column"), F.lit(0).alias("kind"), "node", "part")
    stream = held.join(grid.hint("merge"), "other").select("other", mine("rows").alias("row"), every("columns").alias("column"), F.lit(1).alias("kind"), "node", "part")
    dealt = queries.unionByName(stream).join(sets.select("node", "tokens").hint("merge"), "node")
    dealt = dealt.repartition("other", "row", "column").sortWithinPartitions("other", "row", "column", "kind", "node")

    def run(batches):
        cell = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("other", "row", "column")), strict=True))
            kinds, nodes, parts = (batch.column(c).to_pylist() for c in ("kind", "node", "part"))
            lists = batch.column("tokens")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            for i in range(batch.num_rows):
                if keys[i] != cell:
                    cell, names, of, sets, block, parent = keys[i], [], [], [], None, {}
                own = np.array(values[ends[i] : ends[i + 1]])
                if kinds[i] == 0:
                    names.append(nodes[i])
                    of.append(parts[i])
                    sets.append(own)
                    continue
                if block is None:
                    # the queries' tokens, and which query has which
                    flat = np.concatenate([*sets, np.zeros(0, np.int64)])
                    order = np.argsort(flat, kind="stable")
                    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
                    known, first = np.unique(flat[order], return_index=True)
                    block = known, np.append(first, len(flat)), owner, np.array([len(x) for x in sets])
                known, first, owner, sizes = block
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at = at[known[at] == own]
                times = first[at + 1] - first[at]
                hits = owner[np.repeat(first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                common = np.bincount(hits, minlength=len(sizes))
                for k in np.flatnonzero(100 * common >= PERCENT * (sizes + len(own) - common)):
                    a, b = _root(parent, of[k]), _root(parent, parts[i])
                    if a != b:
                        parent[a] = b
                        found.append((names[k], nodes[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _root(parent: dict, x):
    while x in parent:
        x = parent[x]
    return x


def _joined(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(node, group, part) after edges(a, b) between nodes join their parts."""
    of = lambda c: members.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
    links = edges.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    merged = components(links).select(F.col("node").alias("part"), F.col("group").alias("into"))
    return stored(members.join(merged.hint("merge"), "part", "left").select("node", "group", F.coalesce("into", "part").alias("part")), "members")


def join(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, part and the columns named in `keep` of every row of docs(doc_id, text).

    part tells components apart even where no row has an id; it is null for empty sets.
    """
    bounded(docs.sparkSession)
    wide = stored(sketches(docs, keep), "sketches")
    few = _candidates(wide)
    rows = stored(wide.drop("sketch"), "rows")
    drop(wide)
    # an id may belong to several texts, so the text's own node decides; its size is known, so Spark may choose how to join
    ids = stored(few.select(F.col("doc_id").alias("id")).distinct(), "ids")
    sets = _sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")).dropDuplicates(["node"])
    sets = stored(sets.join(few.select("node", "n", "copies").hint("merge"), "node"), "sets")
    held = _pruned(sets)
    groups, links = _grouped(held)
    members = _joined(groups.withColumn("part", F.col("node")), links)
    asked = _asked(held, members)
    drop(held)
    links = stored(_opened(asked, members, sets), "links")
    drop(sets)
    members = _joined(members, links)

    # the smallest id of a part, and of a node outside
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = ids.join(members.select("node", "part").hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    smallest = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_node = named.select("node", "part").join(smallest.hint("merge"), "part").select("node", "part", "component_id")
    found = rows.join(of_node.hint("merge"), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "part", *(f"`{c}`" for c in keep))
